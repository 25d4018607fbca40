"""Operator 7: masked pseudo-likelihood by a bidirectional window network.

Tokens are lower-case words by a 32-bit hash. A network sees the REACH tokens on either side of a place (hashed into
CONTEXTS buckets, one table of vectors for each offset), one tanh layer, and gives a distribution over CLASSES classes of
tokens; within its class a token has its share of the corpus, counts smoothed by one. The log-probabilities of all tokens of
a document, each given both its sides, sum to its pseudo-log-likelihood.

Everything that the model knows is gathered from the whole corpus. Each distinct token has its own count, in a table that
grows with the vocabulary and never leaves the cluster. The FREQUENT most frequent tokens are also sent with the tasks' code;
OWN of them are classes of their own, all other tokens share the rest of the classes by hash. The counts of the rarer tokens
of a document are joined from the table when it is scored; none of these tokens is hot, as the frequent ones are left out.

Training is local gradient descent by shard: documents are dealt by a hash of id and text into shards of about SHARD_BYTES
of text, and put in order of that hash. Each shard starts from the common weights and goes over its masked places in batches;
the shards' weights are averaged by their numbers of places. Neither shards nor order nor batches depend on how rows lie in
partitions, so scores agree at any partitioning, but for rounding. ROUNDS rounds are run, and each token is masked in just
one of them, so all are learnt from once. The driver gets the frequent counts and one set of weights.

Null and blank texts have no token: log_prob 0, mean and perplexity null. Repeated rows score alike. Long texts are scored
whole. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved

FREQUENT, CONTEXTS, CLASSES, OWN = 1 << 16, 1 << 10, 64, 40
REACH, HIDDEN, ROUNDS = 2, 12, 2
BATCH, RATE, SEED, CHUNK = 1024, 0.5, 11, 1 << 14
SHARD_BYTES = 12 << 20
#: Tokens that a task counts at once, and those that it trains on or scores at once, or one text if that has more.
COUNTED, PIECE = 1 << 21, 1 << 17
OFFSETS = tuple(k for k in range(-REACH, REACH + 1) if k)
SHAPES = {"t": (len(OFFSETS), CONTEXTS + 1, HIDDEN), "h": (HIDDEN,), "w": (HIDDEN, CLASSES), "b": (CLASSES,)}
SHARED = CLASSES - OWN


def hashes(text: str | None) -> np.ndarray:
    """The token hashes of a text."""
    w = (text or "").lower().encode("utf-8", "replace").split()
    return np.fromiter(map(zlib.crc32, w), dtype=np.uint32, count=len(w))


def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [hashes(t) for t in batch["text"].to_pylist()]
        n = pa.array([len(p) for p in parts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["o"], n, pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc_id", "o", "n_tokens", "tokens"])


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about PIECE tokens."""
    of = np.cumsum(np.asarray(batch["n_tokens"], dtype=np.int64)) // PIECE
    edges = [0, *(np.nonzero(np.diff(of))[0] + 1).tolist(), len(of)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a batch one after the other, and how many each row has."""
    flat = np.frombuffer(b"".join(batch["tokens"].to_pylist()), np.uint32).astype(np.int64)
    return flat, np.asarray(batch["n_tokens"], dtype=np.int64)


def contexts(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(tokens, offsets): the buckets around each token; CONTEXTS beyond its text's ends."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    size = np.repeat(lengths, lengths)
    bucket = (tokens * 40503 >> 6) & (CONTEXTS - 1)
    out = np.full((len(tokens), len(OFFSETS)), CONTEXTS, dtype=np.int64)
    for j, k in enumerate(OFFSETS):
        ok = (place + k >= 0) & (place + k < size)
        out[ok, j] = bucket[np.nonzero(ok)[0] + k]
    return out


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of a task's rows with their counts, by COUNTED tokens or some more at a time."""
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(n, pa.int64())], names=["token", "n"])

    for batch in (part for batch in batches for part in pieces(batch)):
        held.append(tokens_of(batch)[0])
        if sum(map(len, held)) >= COUNTED:
            yield counted()
    if held:
        yield counted()


def shared_class(token: np.ndarray | Column) -> np.ndarray | Column:
    """The class of a token that has none of its own."""
    return OWN + (token * 48271 + 11) % 65_537 % SHARED


@dataclass
class Model:
    """own: tokens with a class each. known, n: the frequent tokens in order and their counts. mass: smoothed counts by class."""

    own: np.ndarray
    known: np.ndarray
    n: np.ndarray
    mass: np.ndarray
    w: dict[str, np.ndarray]

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        out = shared_class(tokens)
        if len(self.own):
            order = np.argsort(self.own)
            at = order[np.minimum(np.searchsorted(self.own, tokens, sorter=order), len(order) - 1)]
            out = np.where(self.own[at] == tokens, at, out)
        return out

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """The frequent tokens' counts; -1 for all others."""
        if not len(self.known):
            return np.full(len(tokens), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
        return np.where(self.known[at] == tokens, self.n[at], -1)


def start(mass: np.ndarray) -> dict[str, np.ndarray]:
    r = np.random.default_rng(SEED)
    return {"t": r.normal(0, 0.1, SHAPES["t"]), "h": np.zeros(HIDDEN), "w": r.normal(0, 0.1, SHAPES["w"]), "b": np.log(mass / mass.sum())}


def hidden(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    h = w["t"][0][x[:, 0]] + w["h"]
    for j in range(1, len(OFFSETS)):
        h += w["t"][j][x[:, j]]
    return np.tanh(h, out=h)


def descend(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> None:
    """One gradient step on masked places with contexts x and classes y."""
    h = hidden(w, x)
    z = h @ w["w"] + w["b"]
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    dh = (p @ w["w"].T) * (1 - h * h)
    w["w"] -= RATE * (h.T @ p)
    w["b"] -= RATE * p.sum(axis=0)
    w["h"] -= RATE * dh.sum(axis=0)
    for j in range(len(OFFSETS)):
        # A vector is seen by few places of a batch, so its step isn't divided among all.
        at = (x[:, j, None] * HIDDEN + np.arange(HIDDEN)).ravel()
        w["t"][j] -= np.bincount(at, (RATE * np.sqrt(len(y)) * dh).ravel(), (CONTEXTS + 1) * HIDDEN).reshape(CONTEXTS + 1, HIDDEN)


def targets(tokens: np.ndarray, lengths: np.ndarray, turn: int) -> np.ndarray:
    """The places that are masked in a round; the rounds share all places out."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.nonzero(((tokens * 2654435761 + place * 40503) >> 7) % ROUNDS == turn)[0]


def trainer(model: Model, turn: int):
    """The weights of a task's shards, summed by their places; rows come by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, summed = 0, np.zeros(sum(math.prod(s) for s in SHAPES.values()))
        shard, w, n = None, {}, 0
        x, y = np.zeros((0, len(OFFSETS)), np.int64), np.zeros(0, np.int64)

        def close() -> None:
            nonlocal total
            if len(y):
                descend(w, x, y)
            if n:
                summed.__iadd__(np.concatenate([w[k].ravel() for k in SHAPES]) * n)
                total += n

        for batch in (part for batch in batches for part in pieces(batch)):
            of = np.asarray(batch["shard"], dtype=np.int64)
            edges = [0, *(np.nonzero(np.diff(of))[0] + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if of[a] != shard:
                    close()
                    shard, w, n = of[a], {k: v.copy() for k, v in model.w.items()}, 0
                    x, y = x[:0], y[:0]
                tokens, lengths = tokens_of(batch.slice(a, b - a))
                masked = targets(tokens, lengths, turn)
                n += len(masked)
                x, y = np.concatenate([x, contexts(tokens, lengths)[masked]]), np.concatenate([y, model.classes(tokens[masked])])
                whole = len(y) // BATCH * BATCH
                for i in range(0, whole, BATCH):
                    descend(w, x[i : i + BATCH], y[i : i + BATCH])
                x, y = x[whole:], y[whole:]
        close()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(summed)), pa.int64()), pa.array(np.concatenate([[float(total)], summed]), pa.float64())], names=["i", "v"])

    return run


def tokens_table(docs: DataFrame) -> DataFrame:
    """doc_id, the hash o that deals and orders documents, n_tokens and tokens; written once."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("o"))
    rows = saved(rows.mapInArrow(tokenized, "doc_id long, o long, n_tokens long, tokens binary"), "tokens")
    return rows


def learn(docs: DataFrame, rows: DataFrame) -> tuple[Model, DataFrame]:
    """A model of all documents and the table of all tokens' counts. rows: tokens_table(docs)."""
    counts = rows.where("n_tokens > 0").select("n_tokens", "tokens").mapInArrow(count, "token long, n long")
    counts = saved(counts.groupBy("token").agg(F.sum("n").alias("n")), "counts")
    top = counts.orderBy(F.col("n").desc(), "token").limit(FREQUENT).collect()
    own = np.array([r.token for r in top[:OWN]], np.int64)
    known = sorted((r.token, r.n) for r in top)
    model = Model(own, np.array([t for t, _ in known], np.int64), np.array([n for _, n in known], np.int64), np.ones(CLASSES), {})
    model.mass[: len(own)] += [r.n for r in top[:OWN]]
    rest = counts if not len(own) else counts.where(~F.col("token").isin(own.tolist()))
    for r in rest.groupBy(shared_class(F.col("token")).alias("c")).agg(F.sum(F.col("n") + 1).alias("m")).collect():
        model.mass[r.c] += r.m
    model.w = start(model.mass)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shard = F.pmod("o", F.lit(max(1, math.ceil(size / SHARD_BYTES))))
    for turn in range(ROUNDS):
        dealt = rows.where("n_tokens > 0").select(shard.alias("shard"), "o", "n_tokens", "tokens").repartition("shard").sortWithinPartitions("shard", "o")
        summed = dealt.mapInArrow(trainer(model, turn), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        if len(summed):
            flat = summed.sort_values("i")["v"].to_numpy()
            at = 1
            for k, shape in SHAPES.items():
                n = math.prod(shape)
                model.w[k] = (flat[at : at + n] / flat[0]).reshape(shape)
                at += n
    return model, counts


def log_probabilities(model: Model, w: dict[str, np.ndarray], tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-probability of each token given both its sides, and whether its log(count + 1) is still to be added."""
    x, y = contexts(tokens, lengths), model.classes(tokens)
    n = model.counts(tokens)
    out = np.log(np.maximum(n, 0) + 1.0) - np.log(model.mass)[y]
    for i in range(0, len(tokens), CHUNK):
        z = hidden(w, x[i : i + CHUNK]) @ w["w"] + w["b"]
        z -= z.max(axis=1)[:, None]
        own = z[np.arange(len(z)), y[i : i + CHUNK]]
        out[i : i + CHUNK] += own - np.log(np.exp(z, out=z).sum(axis=1))
    return out, n < 0


def scorer(model: Model):
    """Each row's sum without its rarer tokens' counts, and these tokens."""
    w = {k: v.astype(np.float32) for k, v in model.w.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in pieces(batch)):
            tokens, lengths = tokens_of(batch)
            each, rare = log_probabilities(model, w, tokens, lengths)
            ends = np.cumsum(lengths)
            sums, found = np.concatenate([[0.0], np.cumsum(each)]), np.concatenate([[0], np.cumsum(rare)])
            offsets = np.concatenate([[0], found[ends]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens[rare], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_tokens"], pa.array(sums[ends] - sums[ends - lengths], pa.float64()), lists], names=["doc_id", "n_tokens", "sum", "rare"])

    return run


def score(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob and perplexity of each row of a tokens_table."""
    out = rows.select("doc_id", "n_tokens", "tokens").mapInArrow(scorer(model), "doc_id long, n_tokens long, sum double, rare array<long>")
    out = saved(out.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = out.select("_row", F.explode("rare").alias("token")).join(counts, "token").groupBy("_row").agg(F.sum(F.log(F.col("n") + 1)).alias("more"))
    out = out.drop("rare").join(rare, "_row", "left").select("doc_id", "n_tokens", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("log_prob"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return out.withColumn("mean_log_prob", mean).withColumn("perplexity", F.exp(-F.col("mean_log_prob")))


def placer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in pieces(batch)):
            tokens, lengths = tokens_of(batch)
            each, rare = log_probabilities(model, model.w, tokens, lengths)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            own = batch["doc_id"].take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
            yield pa.RecordBatch.from_arrays([own, pa.array(place, pa.int64()), pa.array(tokens, pa.int64()), pa.array(each, pa.float64()), pa.array(rare, pa.bool_())], names=["doc_id", "place", "token", "part", "rare"])

    return run


def token_scores(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, place, token (its hash) and log_prob of each token of each row of a tokens_table."""
    each = rows.select("doc_id", "n_tokens", "tokens").mapInArrow(placer(model), "doc_id long, place long, token long, part double, rare boolean")
    met = each.where("rare").join(counts, "token", "left").withColumn("log_prob", F.col("part") + F.log(F.coalesce("n", F.lit(0)) + 1))
    return each.where("NOT rare").withColumn("log_prob", F.col("part")).select("doc_id", "place", "token", "log_prob").unionByName(met.select("doc_id", "place", "token", "log_prob"))


def op7_pseudolm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their pseudo-log-likelihood."""
    docs = read(spark, sf_dir, "documents")
    rows = tokens_table(docs)
    return score(rows, *learn(docs, rows))
