"""Operator 3: benchmark decontamination by BM25 with block-max WAND.

The test items are the index, the training passages the queries. Items are cut into units of at most UNIT words; a
unit's impact of a term is its BM25 contribution over the unit's score against itself, so one threshold suits all.
Postings lie in unit order in blocks of BLOCK with each block's largest impact.

Every document is cut into overlapping windows of twice the longest unit, each half overlapping the next, so each unit
that a document holds lies whole in some window. Most windows hold no unit, which is found for many at once: a unit's
essential terms are those of largest impact; the others add up to less than REST. So a score of THRESHOLD needs
THRESHOLD - REST from essential terms, which is summed over the short essential postings. Each window where some unit passes
is a query of block-max WAND over the whole index, and every unit with a score of THRESHOLD or more is returned. A hit is verified: of both the question (all of the item but
its last sentence; the first half if there is one sentence) and the answer (the rest), at least OVERLAP of the 3-word
shingles must occur in the hit's surroundings, which are as many words on either side as the item has, or as the longest
unit if that is more. An item of several units is verified over the surroundings of all windows that hold one of them.

Items come to the driver in blocks of at most BLOCK_BYTES of text by hash, one pass over the documents for each, so the
index in the tasks' code is bounded; document frequencies and lengths are those of all items, so blocks change no hit.
Documents are streamed in Arrow batches.

Words are runs of ASCII letters and digits, and of any characters beyond ASCII, in lower case. Null and empty texts and items hit nothing. Repeated rows each give their
own hits; items of equal text are all reported. Extra columns are left out. An empty table, of documents or items, gives no hit.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, read, saved

UNIT, BLOCK, BLOCK_BYTES = 128, 32, 32 << 20
K1, B = 1.2, 0.75
THRESHOLD, REST, OVERLAP = 0.5, 0.2, 0.5
CHUNK = 100_000
#: The unit of a cursor past its postings.
END = 1 << 62
#: All ASCII that is no letter or digit to a space.
TABLE = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(TABLE).split()


def shingles(w: list[bytes]) -> set[tuple[bytes, ...]]:
    """3-word shingles; of fewer words the whole."""
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def halves(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if words(s)]
    if len(sentences) > 1:
        return words(" ".join(sentences[:-1])), words(sentences[-1])
    w = words(text)
    return w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]


def units_of(text: str | None) -> list[list[bytes]]:
    """The units of an item, of about equal length."""
    w = words(text)
    size = math.ceil(len(w) / max(1, math.ceil(len(w) / UNIT)))
    return [w[i : i + size] for i in range(0, len(w), size)] if w else []


@dataclass
class Statistics:
    """Of all items: the number of units, their words in all, the longest, and in how many units a term occurs."""

    n: int = 0
    words: int = 0
    longest: int = 1
    df: Counter = field(default_factory=Counter)

    def add(self, units: list[list[bytes]]) -> None:
        self.n += len(units)
        self.words += sum(map(len, units))
        self.longest = max([self.longest, *map(len, units)])
        for w in units:
            self.df.update(set(w))


class Index:
    """Inverted index of test items with block-max impacts."""

    def __init__(self, items: list[tuple[int | None, str | None]], statistics: Statistics | None = None):
        """statistics: of all items where these are a part of them; else they are taken from items."""
        self.items = [(i, *map(shingles, halves(t))) for i, t in items if words(t)]
        self.sizes_of = [len(words(t)) for _, t in items if words(t)]
        units = [(k, w) for k, t in enumerate(t for _, t in items if words(t)) for w in units_of(t)]
        if statistics is None:
            statistics = Statistics()
            statistics.add([w for _, w in units])
        self.owner = [k for k, _ in units]
        self.longest, df, n = statistics.longest, statistics.df, statistics.n
        mean = statistics.words / max(1, n)
        self.term = {t: i for i, t in enumerate(dict.fromkeys(t for _, w in units for t in w), 1)}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for u, (_, w) in enumerate(units):
            tf = Counter(w)
            part = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            own = sum(part.values())
            for t, x in part.items():
                postings[self.term[t]].append((u, x / own))
        self.postings = {t: ([u for u, _ in p], [x for _, x in p]) for t, p in postings.items()}
        self.most = {t: max(x) for t, (_, x) in self.postings.items()}
        self.block_max: dict[int, dict[int, float]] = {}
        for t, p in postings.items():
            top: dict[int, float] = defaultdict(float)
            for u, x in p:
                top[u // BLOCK] = max(top[u // BLOCK], x)
            self.block_max[t] = dict(top)
        self.essential()

    def essential(self) -> None:
        """Postings of the essential terms, as arrays by term: begin[t] to begin[t + 1] in unit and impact."""
        of: dict[int, list[tuple[float, int]]] = defaultdict(list)
        for t, (us, xs) in self.postings.items():
            for u, x in zip(us, xs, strict=True):
                of[u].append((x, t))
        kept: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for u, part in of.items():
            rest = 0.0
            for x, t in sorted(part):
                rest += x
                if rest >= REST:
                    kept[t].append((u, x))
        sizes = np.array([0, *[len(kept.get(t, ())) for t in range(1, len(self.term) + 1)]], dtype=np.int64)
        self.sizes, self.begin = sizes, np.concatenate([[0], np.cumsum(sizes)])
        flat = [p for t in range(1, len(self.term) + 1) for p in kept.get(t, ())]
        self.unit = np.array([u for u, _ in flat], dtype=np.int64)
        self.impact = np.array([x for _, x in flat], dtype=np.float64)

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """The units with a score of THRESHOLD or more for a query of distinct terms, by block-max WAND.

        Cursors stand on the terms' postings, in order of their units. The pivot is the first unit at which the list maxima of
        the cursors so far reach THRESHOLD; no unit before it can. Where the block maxima at the pivot don't reach it either,
        the cursors skip to the end of the block or the next cursor's unit; else the pivot is scored once all cursors are there.
        """
        found, slack = [], THRESHOLD - 1e-9
        cursors = [[self.postings[t][0][0], 0, t] for t in terms if t in self.postings]  # unit, place, term

        def skip(moved: list[list[int]], unit: int) -> None:
            for c in moved:
                units = self.postings[c[2]][0]
                c[1] = bisect_left(units, unit, c[1])
                c[0] = units[c[1]] if c[1] < len(units) else END

        while True:
            cursors.sort()
            while cursors and cursors[-1][0] == END:
                cursors.pop()
            reach, p = 0.0, -1
            for i, c in enumerate(cursors):
                reach += self.most[c[2]]
                if reach >= slack:
                    p = i
                    break
            if p < 0:
                return found
            unit = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == unit:
                p += 1
            block, upto = unit // BLOCK, cursors[: p + 1]
            if sum(self.block_max[c[2]].get(block, 0.0) for c in upto) < slack:
                skip(upto, min((block + 1) * BLOCK, cursors[p + 1][0] if p + 1 < len(cursors) else END))
            elif upto[0][0] < unit:
                skip([c for c in upto if c[0] < unit], unit)
            else:
                if (score := sum(self.postings[c[2]][1][c[1]] for c in upto)) >= slack:
                    found.append((unit, score))
                skip(upto, unit + 1)

    def windows(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, window) of several texts' term numbers, where some unit's essential terms reach THRESHOLD - REST."""
        at = np.nonzero(self.sizes[ids])[0]
        if not len(at):
            return
        halves = np.maximum(1, -(-lengths // self.longest))
        base = np.concatenate([[0], np.cumsum(halves)])
        text = np.repeat(np.arange(len(lengths)), lengths)[at]
        own = (at - (np.cumsum(lengths) - lengths)[text]) // self.longest  # the half's number in its text
        t = ids[at]
        n = self.sizes[t]
        place = np.repeat(self.begin[t] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        v, u = len(self.term) + 1, len(self.owner)
        half, rest = np.repeat(base[text] + own, n), self.unit[place] * v + np.repeat(t, n)
        here, before = np.repeat(own < np.maximum(1, halves[text] - 1), n), np.repeat(own > 0, n)
        keys = np.concatenate([half[here] * (u * v) + rest[here], (half[before] - 1) * (u * v) + rest[before]])
        keys, first = np.unique(keys, return_index=True)
        x = self.impact[np.concatenate([place[here], place[before]])[first]]
        group = keys // v
        starts = np.nonzero(np.diff(group, prepend=-1))[0]
        passed = group[starts][np.add.reduceat(x, starts) >= THRESHOLD - REST - 1e-9]
        for k in np.unique(passed // u).tolist():
            i = int(np.searchsorted(base, k, side="right")) - 1
            yield i, k - int(base[i])

    def hits(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float, int]]]:
        """For each text: item number to best score, question overlap, answer overlap and windows of its verified hits."""
        out: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in texts]
        i = 0
        while i < len(texts) and self.owner:
            first, tokens, size = i, [], 0
            while i < len(texts) and (size < CHUNK or i == first):
                tokens.append(words(texts[i]))
                size += len(tokens[-1])
                i += 1
            ids = np.fromiter(map(self.term.get, chain.from_iterable(tokens), repeat(0)), dtype=np.int64, count=size)
            lengths = np.array([len(w) for w in tokens], dtype=np.int64)
            begins = np.cumsum(lengths) - lengths
            spread: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
            for k, window in self.windows(ids, lengths):
                self.verify(k, tokens[k], ids[begins[k] : begins[k] + lengths[k]], window, out[first + k], spread)
            for (k, item), found in spread.items():
                near = self.around(tokens[k], [window for window, _ in found], self.sizes_of[item])
                self.count(item, near, max(score for _, score in found), len(found), out[first + k])
        return out

    def verify(self, k: int, w: list[bytes], ids: np.ndarray, window: int, out: dict, spread: dict) -> None:
        """Adds to out the items of the units that a window of text k holds; to spread those of several units, with window and score."""
        a, b = window * self.longest, (window + 2) * self.longest
        terms = np.unique(ids[a:b])
        near = None
        for unit, score in self.wand(terms[terms > 0].tolist()):
            item = self.owner[unit]
            if self.sizes_of[item] > self.longest:
                spread[k, item].append((window, score))
                continue
            near = self.around(w, [window], self.longest) if near is None else near
            self.count(item, near, score, 1, out)

    def count(self, item: int, near: set, score: float, n: int, out: dict) -> None:
        """Adds an item to out if its question and its answer are near."""
        _, question, answer = self.items[item]
        q, r = len(question & near) / max(1, len(question)), len(answer & near) / max(1, len(answer))
        if q >= OVERLAP and (r >= OVERLAP or not answer):
            old = out.get(item, (0.0, 0.0, 0.0, 0))
            out[item] = (max(old[0], score), max(old[1], q), max(old[2], r), old[3] + n)

    def around(self, w: list[bytes], windows: list[int], margin: int) -> set[tuple[bytes, ...]]:
        """Shingles of windows and of margin words or the longest unit's on either side; pairs and words too, for short items."""
        margin, near, end = max(margin, self.longest), set(), 0
        for window in sorted(windows):
            b = (window + 2) * self.longest + margin
            # What an earlier window has covered is left out, but for the two words that a shingle may begin with.
            part = w[max(0, window * self.longest - margin, end - 2) : b]
            near.update(tuple(part[i : i + n]) for n in (1, 2, 3) for i in range(len(part) - n + 1))
            end = b
        return near


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many units each term occurs; the null term has the number of units, their words and the longest."""
    for batch in batches:
        s = Statistics()
        for text in batch["text"].to_pylist():
            s.add(units_of(text))
        columns = [pa.array([None, *s.df], pa.binary()), pa.array([s.n, *s.df.values()], pa.int64()), pa.array([s.words, *[0] * len(s.df)], pa.int64()), pa.array([s.longest, *[0] * len(s.df)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "n", "words", "longest"])


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of all items, each of at most about BLOCK_BYTES of text, under the statistics of all items."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = math.ceil(total / BLOCK_BYTES)
    if n > 1:
        counts = items.mapInArrow(count_terms, "term binary, n long, words long, longest long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest"))
        counts = saved(counts, "terms")
        whole = counts.where(F.col("term").isNull()).first()
    for i in range(n):
        part = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()]
        statistics = None
        if n > 1:
            own = benchmark.sparkSession.createDataFrame([(t,) for t in {t for _, x in part for t in words(x)}], "term binary")
            df = {bytes(r.term): r.n for r in counts.join(own, "term").select("term", "n").collect()}
            statistics = Statistics(whole.n, whole.words, whole.longest, Counter(df))
        yield Index(part, statistics)


def finder(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch["doc_id"].to_pylist(), index.hits(batch["text"].to_pylist()), strict=True):
                rows += [(doc_id, index.items[k][0], *x) for k, x in found.items()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=HITS.replace(" long", "").replace(" double", "").split(", "))

    return run


HITS = "doc_id long, item_id long, score double, question double, answer double, n_windows long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The verified hits: one row for each document row and item."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], HITS)
    for index in blocks(benchmark):
        out = out.unionByName(docs.mapInArrow(finder(index), HITS))
    return out


def dropper(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not found for found in index.hits(batch["text"].to_pylist())], pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any verified hit."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    for index in blocks(benchmark):
        docs = docs.mapInArrow(dropper(index), docs.schema)
    return docs


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with the items that they hold."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
