"""Operator 5: near-duplicates by SimHash with pigeonring filtering.

A fingerprint takes, for each of 64 bits, the majority over the XXH64 hashes of a text's 3-word shingles, repeats
included. Fingerprints of RADIUS or fewer differing bits are linked, and documents reachable from each other are one
component, named by its smallest doc_id.

Links are found between distinct fingerprints only. Bits are cut into five segments on a ring. If two fingerprints differ
in at most 2 bits, some segment starts a chain whose first l segments differ in at most 2 * l / 5 bits for every l: none
in the first two, one in the first four. So candidates meet under the key of two consecutive equal segments, 26 bits, and
a pair must pass the rest of the chain before its whole Hamming distance is counted.

A key with more than MAX_BUCKET fingerprints is not paired. There each fingerprint is listed under itself and under every
fingerprint one bit away outside the key. Two that agree on the key differ in at most 2 bits just when they share such a
centre, and at most 65 fingerprints can lie within one bit of a centre, so the lists are short, nothing is lost and the
cost is linear, whatever the size of the group.

Null and blank texts have fingerprint zero, linked like any other. Null ids count as larger than all others; a component
of null ids only has a null component_id. Repeated rows share a fingerprint. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import neardup
from .common import join_salted, read, saved, words
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK = 1 << 16
RADIUS, MAX_BUCKET = 2, 64
#: First bit and width of the five segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: the bits that are set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def fingerprint(hashes: pa.Array) -> pa.Array:
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    values = np.ascontiguousarray(hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False))
    ends = np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return pa.array([majority(values[a:b]) if b > a else 0 for a, b in zip([0, *ends[:-1]], ends, strict=True)], type=pa.int64())


def shingle_hashes(w: Column) -> Column:
    """XXH64 with seed 42 of each 3-word shingle; of the whole sequence if it is shorter; none if it is empty."""
    long = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2))))
    return F.when(F.size(w) > 2, long).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with the fingerprint of their text as the long fp."""
    rows = docs.withColumn("_w", words(F.translate("text", UPPER, LOWER)))
    return rows.withColumn("fp", fingerprint(shingle_hashes(F.col("_w")))).drop("_w")


def segment(fp: Column, i: int) -> Column:
    at, width = SEGMENTS[i % 5]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def bits(x: Column) -> Column:
    return F.bit_count(x)


def keyed(fps: DataFrame) -> DataFrame:
    """Each fingerprint under its five keys, with the segment that starts the chain."""
    fp = F.col("fp")
    keys = [F.struct(F.lit(i).alias("i"), F.shiftleft(segment(fp, i), 13).bitwiseOR(segment(fp, i + 1)).alias("key")) for i in range(5)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.i", "k.key")


def chained(a: Column, b: Column, i: Column) -> Column:
    """Whether the chain from segment i keeps its budgets: one differing bit in its third and fourth segments."""
    x = a.bitwiseXOR(b)
    rest = None
    for k in range(5):
        both = bits(segment(x, k + 2)) + bits(segment(x, k + 3)) <= 1
        rest = F.when(i == k, both) if rest is None else rest.when(i == k, both)
    return rest


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints fp of RADIUS or fewer differing bits."""
    rows = keyed(fps)
    sizes = rows.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = saved(rows.join(sizes, ["i", "key"]), "met")
    cold = met.where(F.col("n") <= MAX_BUCKET)
    x, y = cold.alias("x"), cold.alias("y")
    a, b = F.col("x.fp"), F.col("y.fp")
    pairs = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.key") == F.col("y.key")) & (a < b) & chained(a, b, F.col("x.i")))
    pairs = pairs.where(bits(a.bitwiseXOR(b)) <= RADIUS).select(a.alias("a"), b.alias("b"))
    flips = []
    for i in range(5):
        free = [at + k for j in range(2, 5) for at, width in [SEGMENTS[(i + j) % 5]] for k in range(width)]
        masks = [0, *[(1 << k) - (1 << 64 if k == 63 else 0) for k in free]]
        flips.append(F.when(F.col("i") == i, F.array(*[F.lit(m).cast("long") for m in masks])))
    centres = met.where(F.col("n") > MAX_BUCKET).select("fp", F.explode(F.coalesce(*flips)).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("c"))
    near = centres.groupBy("c").agg(F.array_sort(F.collect_set("fp")).alias("f")).where(F.size("f") > 1)
    stars = near.select(F.element_at("f", 1).alias("a"), F.explode(F.slice("f", F.lit(2), F.size("f"))).alias("b"))
    return pairs.union(stars)


def grouped(rows: DataFrame) -> DataFrame:
    """Rows with fp and an order column _o (struct or id; least wins): adds _least, the least _o of the row's component.

    A fingerprint of very many rows is salted where its rows meet their label.
    """
    distinct = saved(rows.groupBy("fp").agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("_n")), "distinct")
    roots = components(links(distinct.select("fp")))
    linked = roots.join(distinct, F.col("node") == F.col("fp")).select("node", "root", "_o")
    least = linked.groupBy("root").agg(F.min("_o").alias("_least"))
    of = linked.join(least, "root").select(F.col("node").alias("fp"), "_least")
    labels = distinct.join(of, "fp", "left").select("fp", F.coalesce("_least", "_o").alias("_least"))
    return join_salted(rows, labels, distinct.select("fp", "_n"), ["fp"], ["_o"])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = saved(fingerprints(docs).select("doc_id", "fp"), "op5")
    out = grouped(rows.withColumn("_o", F.col("doc_id")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("_least").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row of each component that op5's links between fingerprints and similar 5-word shingles make."""
    return neardup.keep_one(docs, fingerprints, lambda fps: components(links(fps)))
