"""Operator 4: toxicity by maximum-scoring segments.

Learning. From at most MAX_ROWS labelled rows of each class (those of the least id hash, never of the held-out fold), the
share of each token among the words gives its log-odds between the classes under a Dirichlet prior of PRIOR words that
follows the tokens' overall shares; tokens of MIN_DOCS toxic documents whose log-odds are Z_MIN standard errors above 0 are
kept. Tokens are lower-case words and their first 4, 5 and 6 letters, so unseen inflections of a stem
count too. A word that stood among the last ECHO words already counts neither here nor when scoring, so a stuttered word
is one piece of evidence.

Scoring. Each word of the whole text scores its best token's log-odds, or -DRIFT. One linear scan finds all maximal
segments (disjoint, none extendable). Their scores are calibrated by extreme-value statistics: lambda solves
sum p * exp(lambda * s) = 1 over the non-toxic distribution, and a segment of score S among n words has the log-evidence
lambda * S - log(K * n). A logistic fit on the learning rows turns the best and the summed evidence of a document into a
probability. The scan looks at scoring words only, so its cost is that of reading the text.

The model is sent in the tasks' code; its size is bounded by the words of the MAX_ROWS toxic learning rows. Texts are streamed in Arrow batches; no
state is kept between rows.

Null and empty texts have no segment and get the calibrated score of that. Labels that are null, neither 0 nor 1, or of
unknown documents are left out; of several labels of a document the largest counts. Without labels of both classes all
scores are 0. Repeated rows score alike; a null id is never held out. An empty table gives an empty result; long texts are
scanned whole. Extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read

MAX_ROWS = 8_000
Z_MIN, PRIOR, DRIFT, MIN_DOCS, ECHO = 3.0, 5_000.0, 0.05, 3, 50
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
CACHE = 200_000
WORD = re.compile(r"[^\W\d_]+")


def tokens(word: str) -> list[str]:
    """A word and its beginnings, which a ~ marks."""
    return [word, *[word[:k] + "~" for k in PREFIXES if len(word) > k]]


@dataclass
class Model:
    """weights: log-odds of the kept tokens. lam, log_k: extreme-value parameters. fit: the logistic coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    fit: tuple[float, ...] = ()


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence given by its positive (place, score); the rest score -drift.

    The linear-time algorithm of Ruzzo and Tompa.
    """
    found: list[list[float]] = []  # first, last, sum before, sum up to the end
    links: list[int] = []  # the last earlier segment whose sum before is less
    total, at = 0.0, -1
    for place, s in scores:
        total -= drift * (place - at - 1)
        at = place
        new = [place, place, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = links[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                links.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], links[j:]
    return [(int(a), int(b), r - l) for a, b, l, r in found]


def evidence(text: str | None, model: Model, cache: dict[str, float]) -> tuple[float, float, int, list[tuple[int, int, float]]]:
    """Best and summed log-evidence of a text, its number of words, and its segments by words."""
    words = WORD.findall((text or "").lower())
    scored: list[tuple[int, float]] = []
    last: dict[str, int] = {}
    for i, w in enumerate(words):
        s = cache.get(w)
        if s is None:
            s = max((model.weights[t] for t in tokens(w) if t in model.weights), default=0.0)
            if len(cache) >= CACHE:
                cache.clear()
            cache[w] = s
        if s:
            if i - last.get(w, -ECHO - 1) > ECHO:
                scored.append((i, s))
            last[w] = i
    if not scored:
        return -5.0, 0.0, len(words), []
    found = segments(scored, DRIFT)
    base = model.log_k + math.log(len(words))
    each = [model.lam * s - base for _, _, s in found]
    return max(-5.0, *each), math.log1p(sum(e for e in each if e > 0)), len(words), found


def heard(text: str | None) -> list[str]:
    """The words of a text but those that stood among the last ECHO words already."""
    out, last = [], {}
    for i, w in enumerate(WORD.findall((text or "").lower())):
        if i - last.get(w, -ECHO - 1) > ECHO:
            out.append(w)
        last[w] = i
    return out


COUNTS = "token string, n0 long, n1 long, d1 long"


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each class that have a token, and toxic documents; the null token counts all words."""
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        documents: Counter = Counter()
        for text, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            counts = Counter(heard(text))
            seen[y][None] += sum(counts.values())
            own: Counter = Counter()
            for w, n in counts.items():
                for t in tokens(w):
                    own[t] += n
            seen[y].update(own)
            if y:
                documents.update(own.keys())
        names = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array(names, pa.string()), *[pa.array([c[t] for t in names], pa.int64()) for c in (*seen, documents)]]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "n0", "n1", "d1"])


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """The learning rows (text, toxic), and how many of each class."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS).collect() for y in (0, 1)]
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for part in few for r in part], "doc_id long, toxic int")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic"), len(few[0]), len(few[1])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled rows outside the held-out fold."""
    rows, docs0, docs1 = sample(docs, labels)
    if not docs0 or not docs1:
        return Model()
    counts = rows.mapInArrow(count_tokens, COUNTS).groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "d1")])
    whole = counts.where(F.col("token").isNull()).select(F.col("n0").alias("all0"), F.col("n1").alias("all1")).first()
    words0, words1 = (max(1, whole.all0), max(1, whole.all1)) if whole else (1, 1)
    share = (F.col("n0") + F.col("n1")) / (words0 + words1)
    a1, b1 = F.col("n1") + PRIOR * share, words1 - F.col("n1") + PRIOR * (1 - share) + 1
    a0, b0 = F.col("n0") + PRIOR * share, words0 - F.col("n0") + PRIOR * (1 - share) + 1
    odds = F.log(a1 / b1) - F.log(a0 / b0)
    kept = counts.where(F.col("token").isNotNull() & (F.col("d1") >= MIN_DOCS)).withColumn("w", odds).withColumn("z", odds / F.sqrt(1 / a1 + 1 / a0)).where(F.col("z") >= Z_MIN)
    top = kept.orderBy(F.col("z").desc(), "token").collect()
    if not top:
        return Model()
    model = Model({r.token: float(r.w) for r in top})
    p = np.array([(r.n0 + 0.5) / words0 for r in top if not r.token.endswith("~")] or [0.5 / words0])
    s = np.array([r.w for r in top if not r.token.endswith("~")] or [top[0].w])
    model.lam, model.log_k = extreme(p, s)
    found = rows.mapInArrow(measure(model), "a double, b double, n long, y int").toPandas()
    model.fit = logistic(found[["a", "b"]].to_numpy(), found["y"].to_numpy())
    return model


def extreme(p: np.ndarray, s: np.ndarray) -> tuple[float, float]:
    """lambda with sum(p * exp(lambda * s)) + rest * exp(-lambda * DRIFT) = 1, and log K."""
    rest = max(0.0, 1 - float(p.sum()))
    f = lambda x: float((p * np.exp(np.minimum(x * s, 500))).sum()) + rest * math.exp(-x * DRIFT) - 1
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    k = max(1e-12, float((p * np.exp(np.minimum(low * s, 500))).sum()))
    return low, math.log(k)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Coefficients of a slightly ridged logistic fit with intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.diag([1e-6, *[1e-2] * x.shape[1]]) * len(x) / 100
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            got = [evidence(t, model, cache)[:3] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64()), batch["toxic"].cast(pa.int32())], names=["a", "b", "n", "y"])

    return run


def probability(model: Model, best: float, total: float) -> float:
    if not model.fit:
        return 0.0
    z = model.fit[0] + model.fit[1] * best + model.fit[2] * total
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            score, n, spans = [], [], []
            for text in batch["text"].to_pylist():
                best, total, _, found = evidence(text, model, cache)
                score.append(probability(model, best, total))
                n.append(len(found))
                spans.append(",".join(f"{a}:{b + 1}" for a, b, _ in found))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(spans, pa.string())], names=["doc_id", "score", "n_segments", "segments"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, the number of segments, and their words as first:end."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scorer(model), "doc_id long, score double, n_segments long, segments string")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fold, score and prediction."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, learn(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_segments", "segments")
