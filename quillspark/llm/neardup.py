"""Near-duplicates by SimHash fingerprints and by the Jaccard similarity of 5-word shingles, for the pipeline.

Documents whose sets of WIDTH-word shingles (in ASCII lower case; of fewer words the whole) have a similarity of SIMILAR
or more are linked, so are those whose fingerprints are linked by operator 5, and documents reachable from each other by
either are one component. At that similarity 64-bit SimHash fingerprints differ in some ten bits, too many for segments to
find, so further candidates come from MinHash: BANDS bands of ROWS
minima each. A pair of similarity s meets in some band but for a chance of (1 - s ** ROWS) ** BANDS, 3e-6 at 0.8.

Candidates are linked by stars, so their number is linear in the documents. A component of candidates is compared in tasks,
one text for each distinct set: pairs that meet in a band are counted exactly, unless they are linked already. A component of
more than BLOCK sets or BLOCK_WORDS words is dealt into blocks, and each two of its blocks are a task, so no task grows with a
group of copies, and no pair is left out.

No text is stored, and none is moved but those of candidates: rows are told apart by two 64-bit hashes of all their columns,
and the rows to keep, or to compare, are broadcast if they are LISTED or fewer (some 60 bytes each), else joined by a shuffle.

Null and blank texts have the empty set, equal to any other. Sets are told apart by a 64-bit sum of hashes. Of rows that are
equal in all columns one stays. Null ids come last. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOCUMENT_COLUMNS, saved, words
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 5
#: Sets and words that a task holds of one block, about.
BLOCK, BLOCK_WORDS = 1024, 1 << 21
#: Row names that may be broadcast.
LISTED = 1_000_000
#: Hashes that are permuted at once.
CHUNK = 1 << 12


def odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


PLACES, FLIPS, FACTORS, JOINS = odd(1, WIDTH), odd(2, BANDS * ROWS)[:, None], odd(3, BANDS * ROWS)[:, None], odd(4, BANDS * ROWS).reshape(BANDS, ROWS)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(w: np.ndarray) -> np.ndarray:
    """The distinct hashes of the shingles of a text, in order, from the hashes of its words."""
    n = max(1, len(w) - WIDTH + 1) if len(w) else 0
    total = np.zeros(n, np.uint64)
    for k in range(min(WIDTH, len(w))):
        total += w[k : k + n] * PLACES[k]
    return np.unique(mixed(total))


def sketch(s: np.ndarray, n: int) -> np.ndarray:
    """What tells a set of n words from others, n, and its bands; no bands for the empty set. Bands differ in their factors."""
    if not len(s):
        return np.zeros(2, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), CHUNK):
        np.minimum(least, ((s[None, i : i + CHUNK] ^ FLIPS) * FACTORS).min(axis=1), out=least)
    keys = mixed((mixed(least.reshape(BANDS, ROWS)) * JOINS).sum(axis=1, dtype=np.uint64))
    return np.concatenate([mixed(s ^ PLACES[0]).sum(dtype=np.uint64, keepdims=True), np.array([n], np.uint64), keys])


def arrays(lists: pa.Array) -> list[np.ndarray]:
    """The arrays of unsigned longs in a list column."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)).view(np.uint64)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@F.arrow_udf(T.ArrayType(T.LongType()))
def sketches(w: pa.Array) -> pa.Array:
    parts = [sketch(shingles(x), len(x)) for x in arrays(w)]
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def word_hashes(text: Column) -> Column:
    return F.transform(words(F.translate(text, UPPER, LOWER)), lambda x: F.xxhash64(x))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as arrays in order, have a Jaccard similarity of SIMILAR or more."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < SIMILAR * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= SIMILAR * (len(a) + len(b) - both)


def linked(sets: list[np.ndarray], bands: list[list[int]]) -> list[int]:
    """For each set the first of its component, where pairs that meet in a band are compared until they are linked."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    buckets: dict[tuple[int, int], dict[int, list[int]]] = {}
    for x, keys in enumerate(bands):
        apart: set[int] = set()
        for key in enumerate(keys):
            met: dict[int, list[int]] = {}
            for r, members in buckets.get(key, {}).items():
                if (now := find(r)) not in met:
                    met[now] = members
                elif len(met[now]) < len(members):
                    met[now] = members + met[now]
                else:
                    met[now].extend(members)
            for r, members in met.items():
                if find(r) == find(x):
                    continue
                for y in members:
                    if y not in apart:
                        if similar(sets[x], sets[y]):
                            a, b = sorted((find(x), find(y)))
                            root[b] = a
                            break
                        apart.add(y)
            met.setdefault(x, []).append(x)
            buckets[key] = met
    return [find(x) for x in range(len(sets))]


def verified(group: pa.Table) -> pa.Table:
    ids = group["_set"].to_pylist()
    first = linked([shingles(w) for w in arrays(group["_w"])], group["_bands"].to_pylist())
    return pa.table({"_set": pa.array(ids, pa.int64()), "_first": pa.array([ids[k] for k in first], pa.int64())})


def named(docs: DataFrame) -> DataFrame:
    """The columns of documents, and two hashes of all of them. Nulls are told from values, which xxhash64 alone skips."""
    columns = [x for c in DOCUMENT_COLUMNS for x in (F.col(c), F.col(c).isNull())]
    return docs.select(*DOCUMENT_COLUMNS).withColumns({"_a": F.xxhash64(*columns), "_b": F.xxhash64(F.lit(1), *reversed(columns))})


def listed(rows: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """rows joined with names on _a and _b; names is a written table."""
    return rows.join(F.broadcast(names) if names.count() <= LISTED else names, ["_a", "_b"], how)


def compared(docs: DataFrame, chosen: DataFrame, repeats: bool) -> DataFrame:
    """Of candidates (root, _set, _n, _a, _b, _bands) the _set and the _first of its component of near-duplicates. repeats: whether rows are."""
    sums = chosen.groupBy("root").agg(F.count(F.lit(1)).alias("s"), F.sum("_n").alias("w"))
    parts = F.ceil(F.greatest(F.col("s") / BLOCK, F.col("w") / BLOCK_WORDS)).cast("int")
    split = saved(sums.withColumn("_k", parts).where("_k > 1").select("root", "_k"), "split")
    own = F.pmod(F.xxhash64("_set"), F.col("_k")).cast("int")
    chosen = chosen.join(split, "root", "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_x", own)
    texts = listed(named(docs).select("_a", "_b", "text"), saved(chosen.drop("_n"), "chosen"), "inner")
    texts = texts.select("root", "_set", "_bands", "_k", "_x", word_hashes(F.col("text")).alias("_w"))
    texts = texts.dropDuplicates(["_set"]) if repeats else texts
    others = F.when(F.col("_k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_k") - 1), lambda y: y != F.col("_x")))
    dealt = texts.withColumn("_y", F.explode(others)).withColumns({"_p": F.least("_x", "_y"), "_q": F.greatest("_x", "_y")})
    firsts = dealt.groupBy("root", "_p", "_q").applyInArrow(lambda t: verified(t.select(["_set", "_bands", "_w"])), "_set long, _first long")
    if split.isEmpty():
        return firsts
    return components(firsts.select(F.col("_set").alias("a"), F.col("_first").alias("b"))).select(F.col("node").alias("_set"), F.col("root").alias("_first"))


def joined(rows: DataFrame, firsts: DataFrame, roots: DataFrame) -> DataFrame:
    """The _set and _first of the components that Jaccard similarity (firsts) and fingerprints (roots: node, root) make together."""
    pairs = rows.select("_set", "fp").distinct().join(firsts, "_set", "left").join(roots, F.col("node") == F.col("fp"), "left")
    pairs = saved(pairs.select(F.coalesce("_first", "_set").alias("g"), F.coalesce("root", "fp").alias("f")).distinct(), "pairs")
    heads = pairs.groupBy("f").agg(F.min("g").alias("a"), F.max("g").alias("z")).where("a < z").select("f", "a")
    merged = components(pairs.join(heads, "f").select("a", F.col("g").alias("b")))
    own = rows.select("_set").distinct().join(firsts, "_set", "left").select("_set", F.coalesce("_first", "_set").alias("g"))
    return own.join(merged, F.col("g") == F.col("node"), "left").select("_set", F.coalesce("root", "g").alias("_first"))


def keep_one(docs: DataFrame, fingerprints: Callable[[DataFrame], DataFrame], roots: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The documents with one row of each component: its smallest doc_id; of repeated rows one.

    fingerprints adds the long fp to documents, and roots gives the (node, root) of those fp that are linked to others.
    """
    s = F.col("_s")
    rows = fingerprints(named(docs)).select("_a", "_b", "doc_id", "fp", sketches(word_hashes(F.col("text"))).alias("_s"))
    rows = rows.select("_a", "_b", "doc_id", "fp", s[0].alias("_set"), s[1].alias("_n"), F.slice(s, F.lit(3), F.lit(BANDS)).alias("_bands"))
    rows = saved(rows, "near")
    # Rows that are equal in all columns have one name.
    twice = saved(rows.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_a", "_b"), "twice")
    repeats = not twice.isEmpty()
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    sets = saved(rows.groupBy("_set").agg(F.min(order).alias("_o"), F.first("_n").alias("_n"), F.first("_bands").alias("_bands")), "sets")
    keyed = sets.select("_set", F.explode("_bands").alias("key"))
    met = keyed.groupBy("key").agg(F.min("_set").alias("a"), F.max("_set").alias("b")).where("a < b").select("key", "a")
    near = components(keyed.join(met, "key").select("a", F.col("_set").alias("b")))
    chosen = near.join(sets, F.col("node") == F.col("_set")).select("root", "_set", "_n", F.col("_o")["a"].alias("_a"), F.col("_o")["b"].alias("_b"), "_bands")
    firsts = saved(compared(docs, saved(chosen, "candidates"), repeats).distinct(), "firsts")
    firsts = joined(rows, firsts, roots(rows.select("fp").distinct()))
    least = sets.join(firsts, "_set", "left").groupBy(F.coalesce("_first", "_set").alias("g")).agg(F.min("_o").alias("_o"))
    names = saved(least.select(F.col("_o")["a"].alias("_a"), F.col("_o")["b"].alias("_b")), "names")
    kept = listed(named(docs), names, "left_semi")
    if repeats:
        kept = listed(kept, twice, "left_anti").unionByName(listed(kept, twice, "left_semi").dropDuplicates(["_a", "_b"]))
    return kept.select(*DOCUMENT_COLUMNS)
