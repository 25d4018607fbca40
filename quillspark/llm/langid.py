"""Operator 9: language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of STEPS, once in each direction, and labels every byte with a distribution over
the languages; a document's probabilities are the mean over all its bytes. It is trained in numpy by backpropagation
through time (Adam, fixed seed) on the driver, on slices of at most ROWS documents a language outside the held-out fold,
drawn by id hash. Gates are clipped linear functions, so scoring is a few numpy operations a step over thousands of
windows at once. The weights are some thousand numbers in the tasks' code; texts stream through in Arrow batches.

Languages are all non-null values of lang in the learning rows. The learning sample is bounded: ALL_ROWS rows in equal shares
for the languages, but no more than ROWS and no fewer than 8 of each. Null texts and texts without a letter are und with
score 0, as is everything if there is nothing to learn from. Repeated rows agree; a null id is never held out. An empty table
gives an empty result; long texts are read whole, in windows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read

HIDDEN, STEPS, SEED = 8, 64, 7
#: Learning rows of a language at most, and of all languages together; a language has 8 at least.
ROWS, ALL_ROWS, SLICES = 400, 25_600, 8
EPOCHS, BATCH, RATE = 6, 256, 0.02
#: Languages whose table may be broadcast.
LISTED = 10_000
#: Windows scored at once.
WINDOWS = 2048


class Network:
    """One gated recurrent layer in each direction and a softmax over both states."""

    def __init__(self, n_out: int, seed: int = SEED):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.w[f"u{d}"] = r.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            self.w[f"o{d}"] = r.normal(0, 1 / np.sqrt(h), (h, n_out)).astype(np.float32)
        self.w["b"] = np.zeros(n_out, np.float32)

    def states(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states (steps, windows, HIDDEN) in text order of byte windows x (steps, windows); with keep, all parts."""
        h, n = HIDDEN, x.shape[1]
        wx, u = self.w[f"x{d}"], self.w[f"u{d}"]
        out = np.empty((len(x), n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        parts = []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, b = wx[x[t]], state @ u
            g = a[:, : 2 * h] + b[:, : 2 * h]
            g *= 0.25
            g += 0.5
            np.clip(g, 0, 1, out=g)
            c = g[:, :h] * b[:, 2 * h :]
            c += a[:, 2 * h :]
            np.tanh(c, out=c)
            if keep:
                parts.append((t, state, g, b[:, 2 * h :], c))
            state = state + g[:, h:] * (c - state)
            out[t] = state
        return (out, parts) if keep else out

    def logits(self, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
        return hf @ self.w["of"] + hb @ self.w["ob"] + self.w["b"]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(steps, windows, languages)."""
        z = self.logits(self.states(x, "f"), self.states(x, "b"))
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over valid positions and its gradients, by backpropagation through time."""
        h = HIDDEN
        runs = {d: self.states(x, d, keep=True) for d in "fb"}
        z = self.logits(runs["f"][0], runs["b"][0])
        z -= z.max(axis=2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=2, keepdims=True)
        n = max(1, int(valid.sum()))
        chosen = np.take_along_axis(p, y[None, :, None].repeat(len(x), 0), axis=2)[:, :, 0]
        loss = float(-(np.log(chosen + 1e-9) * valid).sum() / n)
        dz = p
        dz[:, np.arange(len(y)), y] -= 1
        dz *= valid[:, :, None] / n
        grads = {"b": dz.sum(axis=(0, 1))}
        for d in "fb":
            out, parts = runs[d]
            grads[f"o{d}"] = np.tensordot(out, dz, axes=([0, 1], [0, 1]))
            dh_out = dz @ self.w[f"o{d}"].T
            u = self.w[f"u{d}"]
            gx, gu = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u)
            dh = np.zeros_like(out[0])
            for t, before, g, un, c in reversed(parts):
                dh = dh + dh_out[t]
                r, zt = g[:, :h], g[:, h:]
                dc = dh * zt * (1 - c * c)
                dg = np.concatenate([dc * un, dh * (c - before)], axis=1)
                dg *= 0.25 * ((g > 0) & (g < 1))
                da = np.concatenate([dg, dc], axis=1)
                db = np.concatenate([dg, dc * r], axis=1)
                np.add.at(gx, x[t], da)
                gu += before.T @ db
                dh = dh * (1 - zt) + db @ u.T
            grads[f"x{d}"], grads[f"u{d}"] = gx, gu
        return loss, grads


def fit(slices: list[bytes], labels: np.ndarray, n_out: int) -> Network:
    """A network trained on byte slices of at most STEPS bytes."""
    net = Network(n_out)
    x = np.zeros((STEPS, len(slices)), np.uint8)
    valid = np.zeros((STEPS, len(slices)), np.float32)
    for i, s in enumerate(slices):
        x[: len(s), i] = np.frombuffer(s, np.uint8)
        valid[: len(s), i] = 1
    r = np.random.default_rng(SEED)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(slices))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            _, grads = net.gradients(x[:, part], labels[part], valid[:, part])
            step += 1
            rate = RATE * (1 - 0.8 * epoch / EPOCHS)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                net.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame) -> tuple[list[str], Network | None]:
    """The languages and a network of the documents outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return [], None
    most = min(ROWS, max(8, ALL_ROWS // len(langs)))
    share = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * most + 32) / r["count"])) for r in counts], "lang string, _share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_003))
    at = lambda i: 1 + F.pmod(F.xxhash64("doc_id", i), F.greatest(F.char_length("text") - STEPS, F.lit(1)))
    cut = F.transform(F.sequence(F.lit(1), F.lit(SLICES)), lambda i: F.substring(F.col("text"), at(i).cast("int"), F.lit(STEPS)))
    share = F.broadcast(share) if len(langs) <= LISTED else share
    few = rows.join(share, "lang").withColumn("_draw", draw).where(F.col("_draw") < F.col("_share") * 1_000_003).select("lang", "_draw", "doc_id", cut.alias("slices")).collect()
    slices, labels = [], []
    by_lang: dict[str, list] = {x: [] for x in langs}
    for r in few:
        by_lang[r["lang"]].append(r)
    for k, lang in enumerate(langs):
        own = sorted(by_lang[lang], key=lambda r: (r["_draw"], r["doc_id"] or 0, r["slices"]))[:most]
        # Languages with few documents are repeated, so all weigh alike.
        part = [s.encode("utf-8", "replace")[:STEPS] for r in own for s in r["slices"] if s]
        part = (part * (1 + most * SLICES // max(1, len(part))))[: most * SLICES]
        slices += part
        labels += [k] * len(part)
    return langs, fit(slices, np.array(labels), len(langs))


def pooled(texts: list[str | None], net: Network, n_out: int) -> np.ndarray:
    """Mean probabilities of each text over all its bytes; zeros for empty texts."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    out = np.zeros((len(data), n_out))
    sizes = np.array([-(-len(d) // STEPS) for d in data])
    first = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(d + b"\0" * (-len(d) % STEPS) for d in data), np.uint8).reshape(-1, STEPS)
    length = np.full(len(flat), STEPS)
    for d, n, i in zip(data, sizes, first, strict=True):
        if n:
            length[i + n - 1] = len(d) - (n - 1) * STEPS
    owner = np.repeat(np.arange(len(data)), sizes)
    for i in range(0, len(flat), WINDOWS):
        x = np.ascontiguousarray(flat[i : i + WINDOWS].T)
        p = net.probabilities(x)
        if (length[i : i + WINDOWS] < STEPS).any():
            p *= (np.arange(STEPS)[:, None] < length[None, i : i + WINDOWS])[:, :, None]
        np.add.at(out, owner[i : i + WINDOWS], p.sum(axis=0, dtype=np.float64))
    return out / np.maximum(1, [len(d) for d in data])[:, None]


def labeler(langs: list[str], net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = batch["text"].to_pylist(), batch["known"].to_pylist()
            if net is None:
                best, score = ["und"] * len(texts), [0.0] * len(texts)
            else:
                p = pooled(texts, net, len(langs))
                top = p.argmax(axis=1)
                best = [langs[k] if ok else "und" for k, ok in zip(top, known, strict=True)]
                score = [min(1.0, float(p[i, k])) if known[i] else 0.0 for i, k in enumerate(top)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, langs: list[str], net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of each document."""
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("known")
    return docs.select(F.col("doc_id").cast("long"), "text", known).mapInArrow(labeler(langs, net), "doc_id long, lang_pred string, score double")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fold, predicted language and its probability."""
    docs = read(spark, sf_dir, "documents")
    out = identify(docs, *learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
