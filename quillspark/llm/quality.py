"""Operator 1: quality rules with robust multivariate outliers.

Base rules fail a document of fewer than MIN_WORDS words, or with more than half of its words in repeated 3-word windows.
The others are judged by a minimum-covariance-determinant estimate of their transformed statistics, made for each language
and source, and are rejected where their squared Mahalanobis distance is above CUTOFF.

The estimate has three deterministic starts about the medians: the squared median absolute deviations alone, these with the
spatial signs' scatter, and with the correlations of the hyperbolic tangents. Each start makes FIRST_STEPS concentration
steps, which take the moments of the SUBSET share of documents that are nearest so far; the start of least determinant goes
on until its determinant falls no more, LAST_STEPS steps at most.

Statistics: log mean word length, log number of words, and the square roots of the rates of symbols, of repeated lines,
of words in repeated windows and of capital letters. Variances in the Cholesky factor have floors (FLOORS), as rates that are
nearly always 0 have no spread; the determinant is that of the floored factor.

Everything is built-in functions: statistics are one projection of each text (no word leaves its row), the estimates are
sums by group with map-side combination, and quantiles are counts on a fixed grid, so a group with a third of all rows
costs its tasks no more than their share. The table of groups is broadcast only after it was counted.

A language and source with fewer than MIN_GROUP documents is judged by the estimate of all documents of its language; if these
are fewer too, by that of all documents. So each document that passes the base rules is judged at any size of table; an
estimate of a handful of documents is held up by the floors alone. Null language or source is a group of its own. Null and
blank texts have 0 words and fail the base rules. Repeated rows each get the same verdict. Long texts are read whole. Extra
columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_SPACE, DOCUMENT_COLUMNS, cut, read, saved, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, MIN_GROUP, SUBSET = 50, 60, 0.75
#: Words up to which a window's hash and place share 64 bits; beyond that they are sorted as pairs.
PACKED = 1 << 16
#: Concentration steps of each start, and of the best one after these; a fall of the log-determinant by less than FALL ends them.
FIRST_STEPS, LAST_STEPS, FALL = 2, 6, 0.01
#: The chi-squared quantile of 6 degrees of freedom that one in a million exceeds.
CUTOFF = 38.258
#: Makes the covariance of the nearest 75 % of a normal sample of 6 dimensions consistent.
CONSISTENT = 1.362
#: Least standard deviation of each statistic.
FLOORS = {"x_length": 0.05, "x_words": 0.5, "x_symbols": 0.05, "x_lines": 0.15, "x_repeats": 0.15, "x_capitals": 0.05}
NAMES = tuple(FLOORS)
#: Groups that fit a broadcast: some 500 bytes each.
BROADCAST_GROUPS = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def statistics(docs: DataFrame) -> DataFrame:
    """docs with the BASE counts, n_lines and n_capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("_w", words(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.char_length(without(x, ASCII_SPACE)) > 0)
    rows = rows.withColumn("n_words", F.size("_w").cast("long")).withColumn("_bits", F.length(F.bin("n_words")))
    get = lambda i: F.get(F.col("_w"), i)
    hashes = F.transform(F.slice(F.col("_w"), F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, get(i + 1), get(i + 2)))
    rows = rows.withColumn("_h", hashes)
    # A window is its hash above, its place below, so that sorting puts equal windows side by side. Most texts repeat none.
    packed = F.transform("_h", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long")))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    short = F.col("n_words") <= PACKED
    rows = rows.withColumn("_p", F.when(some & short, F.sort_array(packed)).otherwise(F.array().cast("array<long>")))
    paired = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    rows = rows.withColumn("_q", F.when(some & ~short, paired).otherwise(F.array().cast("array<struct<h:bigint,i:bigint>>")))
    key = lambda p: F.call_function("shiftright", p, F.col("_bits"))
    at = lambda i: key(F.get(F.col("_p"), i))
    twice = F.filter(F.col("_p"), lambda p, i: F.coalesce(key(p) == at(i + 1), F.lit(False)) | F.coalesce(key(p) == at(i - 1), F.lit(False)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1
    of = lambda i: F.get(F.col("_q"), i)["h"]
    pairs = F.filter(F.col("_q"), lambda q, i: F.coalesce(q["h"] == of(i + 1), F.lit(False)) | F.coalesce(q["h"] == of(i - 1), F.lit(False)))
    rows = rows.withColumn("_t", F.sort_array(F.concat(F.transform(twice, lambda p: p.bitwiseAND(mask)), F.transform(pairs, lambda q: q["i"]))))
    covered = F.aggregate(
        F.col("_t"),
        F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    rows = rows.withColumns(
        {
            "word_chars": F.char_length(without(text, ASCII_SPACE)).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(without(text, SYMBOLS))).cast("long"),
            "n_capitals": (F.char_length(text) - F.char_length(without(text, CAPITALS))).cast("long"),
            "_lines": lines,
            "n_repeat_words": covered,
        }
    )
    rows = rows.withColumns({"n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return rows.drop("_w", "_bits", "_h", "_p", "_q", "_t", "_lines")


def transformed(rows: DataFrame) -> DataFrame:
    """rows with the transformed statistics and the names of their language and source, and of their language."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("~"))
    rate = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    x = {
        "x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "x_words": F.log1p(F.col("n_words")),
        "x_symbols": rate("n_symbols", "n_words"),
        "x_lines": rate("n_dup_lines", "n_lines"),
        "x_repeats": rate("n_repeat_words", "n_words"),
        "x_capitals": rate("n_capitals", "word_chars"),
    }
    return rows.withColumns(x | {"_own": F.concat(F.lit("source "), part("lang"), F.lit("\x01"), part("source")), "_lang": F.concat(F.lit("language "), part("lang"))})


def grid_quantile(rows: DataFrame, keys: list[str], value: Column, share: float, steps: int) -> DataFrame:
    """For each key the upper edge of the grid cell, 1 / steps wide, up to which at least that share of rows lies."""
    counts = rows.select(*keys, F.floor(value * steps).alias("_cell")).groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*keys).orderBy("_cell")
    ranked = counts.withColumn("_c", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    return ranked.where(F.col("_c") >= share * F.col("_all")).groupBy(*keys).agg(((F.min("_cell") + 1) / steps).alias("_q"))


def fits(groups: DataFrame) -> DataFrame:
    """The table of groups, marked for broadcast if its counted size allows."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


N = range(len(NAMES))
LOWER = [(i, j) for i in N for j in range(i + 1)]
ESTIMATE = [f"m_{i}" for i in N] + [f"l_{i}_{j}" for i, j in LOWER]


def factored(groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean and covariance columns to keys, means, the lower Cholesky factor and the log-determinant _det."""
    for j in N:
        inner = sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        floor = FLOORS[NAMES[j]] ** 2
        groups = groups.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - inner, F.lit(floor))))
        below = {f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}") for i in range(j + 1, len(NAMES))}
        groups = groups.withColumns(below) if below else groups
    return groups.select(*keys, *ESTIMATE, (2 * sum(F.log(f"l_{i}_{i}") for i in N)).alias("_det"))


def start(rows: DataFrame) -> DataFrame:
    """The three first estimates of each group, numbered by _s."""
    long = rows.select("_group", F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.col(x).alias("x")) for i, x in enumerate(NAMES)])).alias("_v")).select("_group", "_v.j", "_v.x")
    middle = grid_quantile(long, ["_group", "j"], F.col("x"), 0.5, 200).select("_group", "j", F.col("_q").alias("_m"))
    middle = fits(cut(middle))
    spread = grid_quantile(long.join(middle, ["_group", "j"]), ["_group", "j"], F.abs(F.col("x") - F.col("_m")), 0.5, 200).select("_group", "j", (F.col("_q") * 1.4826).alias("_s"))
    both = middle.join(spread, ["_group", "j"])
    pick = lambda c, i: F.max(F.when(F.col("j") == i, F.col(c)))
    wide = both.groupBy("_group").agg(*[pick("_m", i).alias(f"m_{i}") for i in N], *[F.greatest(pick("_s", i), F.lit(FLOORS[x])).alias(f"d_{i}") for i, x in enumerate(NAMES)])
    wide = cut(wide)
    z = rows.join(fits(wide), "_group").select("_group", *[((F.col(x) - F.col(f"m_{i}")) / F.col(f"d_{i}")).alias(f"z_{i}") for i, x in enumerate(NAMES)])
    z = z.withColumn("_r", F.greatest(sum(F.col(f"z_{i}") * F.col(f"z_{i}") for i in N), F.lit(1e-12)))
    z = z.withColumns({f"y_{i}": F.tanh(f"z_{i}") for i in N})
    sums = [F.sum(F.col(f"z_{i}") * F.col(f"z_{j}") / F.col("_r")).alias(f"u_{i}_{j}") for i, j in LOWER]
    sums += [F.sum(f"y_{i}").alias(f"t_{i}") for i in N] + [F.sum(F.col(f"y_{i}") * F.col(f"y_{j}")).alias(f"t_{i}_{j}") for i, j in LOWER]
    table = cut(z.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), *sums).join(fits(wide), "_group"))
    scale = lambda i, j: F.col(f"d_{i}") * F.col(f"d_{j}")
    joint = lambda i, j: F.col(f"t_{max(i, j)}_{min(i, j)}") / F.col("_n") - F.col(f"t_{i}") * F.col(f"t_{j}") / F.col("_n") / F.col("_n")
    shape = {
        0: lambda i, j: F.lit(1.0 if i == j else 0.0),
        1: lambda i, j: len(NAMES) * F.col(f"u_{i}_{j}") / F.col("_n"),
        2: lambda i, j: F.lit(1.0) if i == j else F.coalesce(joint(i, j) / F.sqrt(F.greatest(joint(i, i) * joint(j, j), F.lit(1e-12))), F.lit(0.0)),
    }
    out = None
    for k, of in shape.items():
        one = table.select("_group", F.lit(k).alias("_s"), *[f"m_{i}" for i in N], *[(of(i, j) * scale(i, j)).alias(f"c_{i}_{j}") for i, j in LOWER])
        out = one if out is None else out.unionByName(one)
    return factored(out, ["_group", "_s"])


def distances(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with their squared distance _d2 under each of their group's estimates, and its _s; null where there is none."""
    out = rows.join(fits(groups), "_group", "left")
    for i, x in enumerate(NAMES):
        above = sum((F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"y_{i}", (F.col(x) - F.col(f"m_{i}") - above) / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in N), F.lit(0.0))
    return out.select(*rows.columns, "_s", d2.alias("_d2"))


def concentrate(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One concentration step: the moments of the nearest SUBSET of each group, for each of its estimates."""
    keys = ["_group", "_s"]
    near = distances(rows, groups)
    logd = F.log1p(F.col("_d2"))
    edge = cut(grid_quantile(near, keys, logd, SUBSET, 100))
    kept = near.join(fits(edge), keys).where(F.floor(logd * 100) < F.round(F.col("_q") * 100))
    sums = [F.sum(x).alias(f"s_{i}") for i, x in enumerate(NAMES)] + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q_{i}_{j}") for i, j in LOWER]
    moments = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sums)
    means = [(F.col(f"s_{i}") / F.col("_n")).alias(f"m_{i}") for i in N]
    covariance = [(CONSISTENT * (F.col(f"q_{i}_{j}") / F.col("_n") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("_n") / F.col("_n"))).alias(f"c_{i}_{j}") for i, j in LOWER]
    return factored(moments.select(*keys, *means, *covariance), keys)


def least(groups: DataFrame) -> DataFrame:
    """The estimate of least determinant of each group, as _s 0."""
    best = groups.groupBy("_group").agg(F.min_by(F.struct(*ESTIMATE, "_det"), F.struct("_det", "_s")).alias("e"))
    return best.select("_group", F.lit(0).alias("_s"), "e.*")


def estimate(rows: DataFrame) -> DataFrame:
    """The minimum-covariance-determinant estimate of each _group of rows."""
    groups = cut(start(rows))
    for _ in range(FIRST_STEPS):
        groups = cut(concentrate(rows, groups))
    groups = cut(least(groups))
    for _ in range(LAST_STEPS):
        after = concentrate(rows, groups).withColumn("_s", F.lit(1))
        after = cut(after.unionByName(groups))
        falls = after.groupBy("_group").agg((F.max("_det") - F.min("_det")).alias("f"), F.min_by("_s", "_det").alias("s")).where((F.col("s") == 1) & (F.col("f") > FALL))
        groups = cut(least(after))
        if falls.isEmpty():
            break
    return groups


def judge(rows: DataFrame) -> DataFrame:
    """Rows of statistics with base_failed, d2 and kept."""
    rows = transformed(rows)
    good = rows.where(~F.col("base_failed"))
    large = lambda c: fits(cut(good.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_GROUP).select(c, F.lit(True).alias(f"_large{c}"))))
    rows = rows.join(large("_own"), "_own", "left").join(large("_lang"), "_lang", "left")
    rows = rows.withColumn("_group", F.when(F.col("_large_own"), F.col("_own")).when(F.col("_large_lang"), F.col("_lang")).otherwise(F.lit("*"))).drop("_large_own", "_large_lang")
    used = fits(cut(rows.where(~F.col("base_failed")).select("_group").distinct()))
    each = good.select(F.explode(F.array("_own", "_lang", F.lit("*"))).alias("_group"), *NAMES).join(used, "_group", "left_semi")
    out = distances(rows, estimate(saved(each, "statistics")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("_d2") <= CUTOFF, F.lit(False))
    return out.withColumn("d2", F.col("_d2")).withColumn("kept", kept)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their base counts, the base verdict and the method's."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    rows = saved(statistics(docs).drop("text"), "op1")
    return judge(rows).select("doc_id", *BASE, "base_failed", "kept", F.round("d2", 6).alias("d2"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns. Repeated rows are judged alike."""
    rows = saved(statistics(docs.select(*DOCUMENT_COLUMNS)), "quality")
    return judge(rows).where("kept").select(*DOCUMENT_COLUMNS)
