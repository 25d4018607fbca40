"""Operator 8: removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH bytes that covers it starts at another place too, in the same or another document. Every
start with LENGTH bytes ahead is judged, on texts as UTF-8, and matches never cross documents.

Sampling. A suffix array over all bytes of a corpus would be many times its size, so it holds the suffixes that begin at
anchors: of the GRAM-byte strings within a start's LENGTH bytes the one of least hash, the leftmost if several. Equal strings
have equal anchors at equal distance, so nothing is lost, and consecutive starts share an anchor, some 200 each. A run of
starts is named by its anchor's hash (key) and by the digest of all bytes that its strings cover (tee), 128 bits together.

1. The family. Documents come in batches. A batch's suffix array is a table of its anchored suffixes in order of their first
   GRAM bytes (by these bytes' hash, which is a total order), suffixes that begin alike as one entry with their number and the
   least and greatest tee. It is a level of rank 0. Two levels of equal rank are merged into one of the next, where entries
   that begin alike meet, so a suffix is moved a logarithmic number of times. Levels are written to a folder, so a later run
   can open them, scan a new batch against them, and add it.
2. Entries of one suffix are dropped: their strings occur once.
3. Runs whose tee occurs twice or more under a key are repeated as a whole.
4. Of keys with several tees, one text per tee is fetched (by document, so documents with copies are read once), dealt by
   key, and all their starts are put into sorted levels by distance from the anchor and fingerprint of their LENGTH bytes, of
   which equal ones meet; with the key they make 128 bits.
5. A key of more than CONTEXTS_MAX tees (a passage shorter than LENGTH in very many surroundings) would be too much for a
   task. Its suffixes are dealt by the fingerprint of their prefix instead, and counted with combination before the
   shuffle, to the same result.
6. Each document's removed intervals are united, and the rest is digested.

Counts by key are combined before the shuffle, and joins salt hot keys. Step 4 holds BATCH contexts in a task, or those of one
key if these are more, which are CONTEXTS_MAX at most (about 600 bytes each, copies collapsed).

Null and empty texts count as empty. Rows are told apart by a 64-bit hash of id and text, so repeated rows share their result
and count as places of their own. Long texts are read whole. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, join_salted, read, saved

LENGTH, GRAM = 400, 32
SPAN = LENGTH - GRAM + 1
#: Bits of an anchor's place in a piece of a text, and the starts in a piece.
PLACE, PIECE = 28, 1 << 22
BATCH, SLICE = 4096, 48
#: Batches that the query deals its documents into.
BATCHES = 4
#: Contexts of one key that may meet in a task; some 60 MB with their fingerprints.
CONTEXTS_MAX = 50_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
TABLE = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x2545F4914F6CDD1D


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place."""
    n = len(data) - GRAM + 1
    lanes = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8)[:8].view(np.uint64), shape=(len(data) - 7,), strides=(1,))
    h = lanes[:n] * MIX[0]
    for k in (1, 2, 3):
        h ^= h >> np.uint64(29)
        h += lanes[8 * k : 8 * k + n]
        h *= MIX[k]
    h ^= h >> np.uint64(32)
    h *= MIX[0]
    h ^= h >> np.uint64(29)
    return h


def minima(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each span consecutive values."""
    width = 1
    while 2 * width <= span:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = span - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: bytes) -> list[np.ndarray]:
    """Place, first start, last start and key of the anchors of a text."""
    out = []
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        h = gram_hashes(data[at : at + PIECE + LENGTH - 1])
        ranked = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        place = (minima(ranked, SPAN) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.nonzero(np.diff(place, prepend=-1))[0]
        p = place[first]
        out.append((p + at, first + at, np.append(first[1:], len(place)) - 1 + at, h[p].view(np.int64)))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4


def tee(data: bytes, first: int, last: int, place: int) -> int:
    """The digest of the bytes that a run's strings cover, and of where its anchor lies in them."""
    return int.from_bytes(hashlib.blake2b(data[first : last + LENGTH], digest_size=8, salt=(place - first).to_bytes(4, "little")).digest(), "little", signed=True)


RUNS = "rid long, place int, first int, last int, key long, tee long"


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        columns: list[list] = [[] for _ in range(6)]
        for rid, text in zip(batch["rid"].to_pylist(), batch["text"].to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "replace")
            p, a, b, key = anchors(data)
            for c, x in zip(columns[1:5], (p, a, b, key), strict=True):
                c.append(x)
            columns[0].append(np.full(len(p), rid, np.int64))
            columns[5].append(np.array([tee(data, i, j, k) for i, j, k in zip(a.tolist(), b.tolist(), p.tolist(), strict=True)], dtype=np.int64))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(columns, kinds, strict=True)], names=["rid", "place", "first", "last", "key", "tee"])


CONTEXTS = "rid long, place int, first int, key long, whole boolean, bytes binary"


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of each document."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for rid, text, wanted in zip(batch["rid"].to_pylist(), batch["text"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "replace")
            for w in wanted:
                for c, x in zip(columns, (rid, w["place"], w["first"], w["key"], w["whole"], data[w["first"] : w["last"] + LENGTH]), strict=True):
                    c.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["rid", "place", "first", "key", "whole", "bytes"])


class Family:
    """Sorted levels of suffixes by prefix fingerprint; marks those whose prefix is in the index twice or more."""

    def __init__(self, marks: np.ndarray):
        self.marks, self.levels = marks, []

    def add(self, prints: np.ndarray, owners: np.ndarray) -> None:
        """A batch of suffixes: their prefix fingerprints, and their places in marks."""
        order = np.argsort(prints, kind="stable")
        v, o = prints[order], owners[order]
        same = v[1:] == v[:-1]
        self.marks[o[1:][same]] = True
        self.marks[o[:-1][same]] = True
        first = np.append(True, ~same)
        v, o = v[first], o[first]
        for level, held, _ in self.levels:
            at = np.minimum(np.searchsorted(level, v), len(level) - 1)
            hit = level[at] == v
            self.marks[o[hit]] = True
            self.marks[held[at[hit]]] = True
            v, o = v[~hit], o[~hit]
        if len(v):
            self.levels.append((v, o, 0))
        while len(self.levels) > 1 and self.levels[-1][2] == self.levels[-2][2]:
            (a, b, rank), (c, d, _) = self.levels.pop(), self.levels.pop()
            v, o = np.concatenate([c, a]), np.concatenate([d, b])
            order = np.argsort(v, kind="stable")
            self.levels.append((v[order], o[order], rank + 1))


class Batch:
    """Contexts whose starts can be fingerprinted by distance from the anchor."""

    def __init__(self, key: np.ndarray, place: np.ndarray, texts: list[bytes]):
        """place: of the anchor from the context's first byte."""
        self.place = place
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.n = self.size - LENGTH + 1  # starts of each context
        self.key = key.view(np.uint64) * MIX[1]
        self.flat = b"".join(texts)

    def prints(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the starts that lie low to high - 1 bytes before their anchor, and their numbers within the batch."""
        power = np.full(len(self.flat) + 1, BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[np.frombuffer(self.flat, np.uint8)] * power[:-1])])
        a = np.clip(self.place - high + 1, 0, self.n)
        b = np.clip(self.place - low + 1, 0, self.n)
        count = np.maximum(b - a, 0)
        ids = np.repeat(np.arange(len(a)), count)
        local = a[ids] + np.arange(len(ids)) - (np.cumsum(count) - count)[ids]
        at = self.begin[ids] + local
        # Scaled to one power for all, so equal strings are equal wherever they stand.
        prints = (sums[at + LENGTH] - sums[at]) * power[len(self.flat) - at]
        return (prints ^ (prints >> np.uint64(31))) * MIX[2] + self.key[ids], (np.cumsum(self.n) - self.n)[ids] + local


STARTS = "rid long, key long, whole boolean, a int, print long"


def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every start of the contexts with the fingerprint of its LENGTH bytes, wherever it stands."""
    back = np.uint64(pow(BASE, -1, 1 << 64))
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = part["bytes"].to_pylist()
            size = np.array([len(t) for t in texts], dtype=np.int64)
            count = size - LENGTH + 1
            owner = np.repeat(np.arange(len(size)), count)
            local = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
            at = (np.cumsum(size) - size)[owner] + local
            flat = np.frombuffer(b"".join(texts), np.uint8)
            power, inverse = np.full(len(flat), BASE, np.uint64), np.full(len(flat), back, np.uint64)
            power[0] = inverse[0] = 1
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[flat] * np.cumprod(power))])
            prints = (sums[at + LENGTH] - sums[at]) * np.cumprod(inverse)[at]
            prints = ((prints ^ (prints >> np.uint64(31))) * MIX[2]).view(np.int64)
            own = pa.array(owner)
            a = np.asarray(part["first"])[owner] + local
            yield pa.RecordBatch.from_arrays([part["rid"].take(own), part["key"].take(own), part["whole"].take(own), pa.array(a, pa.int32()), pa.array(prints, pa.int64())], names=["rid", "key", "whole", "a", "print"])


INTERVALS = "rid long, a int, b int"


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of key as tables of BATCH rows or more that part no key."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        keys = np.asarray(batch["key"], dtype=np.int64)
        edges = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if keys[a] != last and size >= BATCH:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size, last = size + b - a, keys[a]
    if held:
        yield pa.Table.from_batches(held)


def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated intervals of contexts that come by key, of those that aren't repeated as a whole."""
    for table in by_key(batches):
        yield intervals(table)


def intervals(table: pa.Table) -> pa.RecordBatch:
    get = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
    rid, first, whole, key = get("rid"), get("first").astype(np.int64), get("whole"), get("key")
    place = get("place").astype(np.int64) - first
    texts = table["bytes"].to_pylist()
    parts = [Batch(key[i : i + BATCH], place[i : i + BATCH], texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)]
    n = np.concatenate([p.n for p in parts])
    base = np.cumsum([0, *[int(p.n.sum()) for p in parts]])
    marks = np.zeros(int(base[-1]), bool)
    width = max(len(p.flat) for p in parts)
    for p in parts:
        p.flat += b"\0" * (width - len(p.flat))
    for low in range(0, SPAN, SLICE):
        family = Family(marks)
        for p, at in zip(parts, base, strict=False):
            prints, local = p.prints(low, low + SLICE)
            if len(prints):
                family.add(prints, local + at)
    edge = np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    # A run of marks may pass from one context to the next: cut it there.
    cut = np.cumsum(n) - n
    inner = cut[(cut > 0) & marks[np.minimum(cut, len(marks) - 1)] & marks[np.maximum(cut - 1, 0)]]
    starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    owner = np.searchsorted(cut, starts, side="right") - 1
    a = first[owner] + starts - cut[owner]
    b = first[owner] + ends - 1 - cut[owner] + LENGTH
    open_ = ~whole[owner].astype(bool)
    return pa.RecordBatch.from_arrays([pa.array(rid[owner][open_], pa.int64()), pa.array(a[open_], pa.int32()), pa.array(b[open_], pa.int32())], names=["rid", "a", "b"])


LEVEL = "key long, n long, lo long, hi long"


class Levels:
    """The suffix arrays of a corpus that grows by batches: sorted tables in a folder, at most one of each rank.

    A level is named by its number and rank. One that was written while a run died is left out, as Spark marks whole tables.
    """

    def __init__(self, spark: SparkSession, path: str):
        """Opens the levels in a folder, or a new family there."""
        self.spark, self.path, self.levels = spark, path.rstrip("/"), []
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if self.files.exists(folder):
            names = sorted(x.getPath().getName() for x in self.files.listStatus(folder))
            self.levels = [n for n in names if self.files.exists(self._place(f"{n}/_SUCCESS"))]
        self.next = 1 + max((int(n.split("-")[1]) for n in self.levels), default=0)

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _write(self, entries: DataFrame, rank: int) -> str:
        name = f"level-{self.next:08d}-{rank}"
        self.next += 1
        entries.sortWithinPartitions("key").write.parquet(f"{self.path}/{name}")
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(f"{self.path}/{name}")

    @staticmethod
    def array(found: DataFrame) -> DataFrame:
        """The suffix array of a batch of runs."""
        return found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("tee").alias("lo"), F.max("tee").alias("hi"))

    @staticmethod
    def merged(levels: list[DataFrame]) -> DataFrame:
        both = levels[0]
        for level in levels[1:]:
            both = both.unionByName(level)
        return both.groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def scan(self, found: DataFrame) -> DataFrame:
        """The keys of a new batch that it has twice or more, or that a level has: what long matches begin with."""
        array = self.array(found)
        keys = array.where("n > 1").select("key")
        for name in self.levels:
            keys = keys.unionByName(array.select("key").join(self.read(name).select("key").hint("merge"), "key"))
        return keys.distinct()

    def add(self, found: DataFrame) -> None:
        """Adds a batch of runs as a level of rank 0, and merges levels of equal rank."""
        self.levels.append(self._write(self.array(found), 0))
        rank = lambda name: int(name.split("-")[2])
        while len(self.levels) > 1 and rank(self.levels[-1]) == rank(self.levels[-2]):
            old = self.levels[-2:]
            self.levels[-2:] = [self._write(self.merged([self.read(n) for n in old]), rank(old[0]) + 1)]
            for name in old:
                self.files.delete(self._place(name), True)

    def repeated(self) -> DataFrame:
        """The entries of two suffixes or more, over all levels."""
        whole = self.read(self.levels[0]) if len(self.levels) == 1 else self.merged([self.read(n) for n in self.levels])
        return whole.where("n > 1")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's remaining bytes."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(5)]
        for doc_id, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "replace")
            out, at, n = [], 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                if a > at or not n:
                    out.append(data[at:a])
                    n += 1
                at = max(at, b)
            out.append(data[at:])
            rest = b"".join(out)
            for c, x in zip(columns, (doc_id, len(data), len(data) - len(rest), n, rest), strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("rid"))
    found = saved(docs.select("rid", "text").mapInArrow(runs, RUNS), "found")
    family = Levels(docs.sparkSession, f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/suffixes-{uuid.uuid4().hex}")
    for i in range(BATCHES):
        family.add(found.where(F.pmod("rid", F.lit(BATCHES)) == i))
    keys = saved(family.repeated().select("key", F.col("n").alias("_n"), (F.col("lo") != F.col("hi")).alias("mixed")), "keys")
    often = saved(join_salted(found, keys.select("key", "mixed"), keys.select("key", "_n"), ["key"], ["rid", "place"]), "runs")
    place = F.struct("rid", "place", "first", "last")
    tees = often.groupBy("key", "tee").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("at"), F.first("mixed").alias("mixed"))
    tees = saved(tees.withColumn("whole", F.col("_n") > 1).where(F.col("whole") | F.col("mixed")), "tees")
    repeated = tees.where("whole").select("key", "tee", "_n")
    whole = join_salted(often, repeated.drop("_n"), repeated, ["key", "tee"], ["rid", "place"]).select("rid", F.col("first").alias("a"), (F.col("last") + LENGTH).alias("b"))
    mixed = tees.where("mixed")
    # The joins read the documents dealt by rid; the planner makes that exchange once.
    dealt = docs.repartition("rid")

    def texts(of: DataFrame) -> DataFrame:
        wanted = of.select("at.rid", F.struct("at.place", "at.first", "at.last", "key", "whole").alias("w")).groupBy("rid").agg(F.collect_list("w").alias("wanted"))
        return dealt.join(wanted, "rid").select("doc_id", "rid", "text", "wanted").mapInArrow(contexts, CONTEXTS)

    large = saved(mixed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CONTEXTS_MAX).select("key"), "large")
    if large.isEmpty():
        edges = texts(mixed).repartition("key").sortWithinPartitions("key").mapInArrow(index, INTERVALS)
    else:
        edges = texts(mixed.join(large, "key", "left_anti")).repartition("key").sortWithinPartitions("key").mapInArrow(index, INTERVALS)
        each = texts(mixed.join(large, "key", "left_semi")).mapInArrow(starts, STARTS)
        again = saved(each.groupBy("key", "print").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "again")
        met = join_salted(each.where("NOT whole"), again.drop("_n"), again, ["key", "print"], ["rid", "a"])
        edges = edges.unionByName(met.select("rid", "a", (F.col("a") + LENGTH).alias("b")))
    # A set, as repeated rows share a rid and bring the same intervals.
    spans = whole.unionByName(edges).groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return dealt.join(spans, "rid", "left").select("doc_id", "rid", "text", "spans").mapInArrow(kept, RESULT)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the bytes and runs removed, and the digest of what is left."""
    out = dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
