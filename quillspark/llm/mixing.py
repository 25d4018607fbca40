"""Operator 2: mixing sources to target weights by capped water-filling.

Sources, by code point with null last, weigh 1, 2, 3, repeating, and share all words. A source's target stops at CAP times
its size; what it can't take is shared by weight among the others until none is above. The level L with
sum(min(cap, L * weight)) = total has a closed form: in order of cap / weight the first k sources are full, and L is what
is left over the weights of the others. So no loop over sources runs; one window over the table of sources (one row a
source) finds it.

A source's rate target / size has a whole part, which every document takes, and a fraction, which a seeded draw takes:
documents in order of a digest of seed and id, until the fraction of the source's words is reached; the document at the
edge gives its first words only. The running sum is by digest prefix: words by (source, prefix) are pre-aggregated, and
only the documents of the one prefix that holds the edge are put in order, so a source with a third of all rows is never
sorted in one task.

Null text has size 0. A null source is a source of its own. A source of size 0 takes 0. Ties of the digest (repeated ids,
null ids) are ordered by size; equal rows may swap their shares. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, read, saved

CAP, WEIGHTS, SEED = 3, 3, "mix-1"
#: Hexadecimal digits of a digest prefix: each holds 1/4096 of a source's documents.
PREFIX = 3
#: Rows of sources and prefixes, some 100 bytes each, that may be broadcast.
PARTS = 200_000


def digest(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target): one row a source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    weighed = sources.withColumn("weight", ((F.row_number().over(order) - 1) % WEIGHTS + 1).cast("long"))
    weighed = weighed.withColumns({"cap": F.col("source_size") * CAP, "_total": F.sum("source_size").over(everything), "_weights": F.sum("weight").over(everything)})
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    full, weight = F.coalesce(F.sum("cap").over(upto), F.lit(0)), F.coalesce(F.sum("weight").over(upto), F.lit(0))
    # The level if all sources before this one are full; this one is full too if its cap is below it.
    level = (F.col("_total") - full).cast("double") / (F.col("_weights") - weight).cast("double")
    leveled = weighed.withColumn("_level", level).withColumn("_open", F.col("cap") / F.col("weight") >= F.col("_level"))
    at = F.min(F.when(F.col("_open"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.struct(F.col("source").isNull(), F.col("source")).alias("s"), F.col("_level").alias("level")))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), at * F.col("weight"))
    return leveled.withColumn("target", F.coalesce(target, F.col("cap").cast("double"))).select("source", "source_size", "weight", "target")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(docs: DataFrame) -> DataFrame:
    """docs with size, source_size, target and taken. Columns of those names are replaced.

    The table of parts, one row a source and prefix, is written once, and broadcast if it has PARTS rows or fewer; so texts are
    read for their sizes and once more to be handed on, and are not shuffled, but for those of the edges.
    """
    new = ("size", "source_size", "target", "taken")
    docs = docs.drop(*new)
    prefix = F.substring(digest(F.col("doc_id")), 1, PREFIX)
    groups = docs.select("source", n_words(F.col("text")).alias("size"), prefix.alias("_prefix")).groupBy("source", "_prefix").agg(F.sum("size").alias("_words"))
    groups = saved(groups, "mix-groups")
    rates = targets(groups.groupBy("source").agg(F.sum("_words").alias("source_size")))
    rates = rates.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rates = rates.withColumn("_rest", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    g, r = groups.alias("g"), rates.alias("r")
    placed = g.join(r, same(F.col("g.source"), F.col("r.source"))).select("g.source", "_prefix", "_words", "source_size", "target", "_whole", "_rest")
    running = W.partitionBy("source").orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0)))
    placed = placed.withColumn("_left", F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_rest") - F.col("_before"))).cast("long"))
    parts = placed.select(F.col("source").alias("_s"), F.col("_prefix").alias("_p"), "_words", "source_size", "target", "_whole", "_left")
    parts = saved(parts.withColumn("_edge", (F.col("_left") > 0) & (F.col("_left") < F.col("_words"))), "mix-parts")
    parts = F.broadcast(parts) if parts.count() <= PARTS else parts
    met = lambda p: docs.withColumn("_prefix", prefix).join(p, same(F.col("source"), F.col("_s")) & (F.col("_prefix") == F.col("_p"))).withColumn("size", n_words(F.col("text")))
    plain = met(parts.where("NOT _edge")).withColumn("_more", F.when(F.col("_left") > 0, F.col("size")).otherwise(F.lit(0)).cast("long"))
    edge = met(parts.where("_edge")).withColumn("_digest", digest(F.col("doc_id")))
    drawn = W.partitionBy("_s", "_p").orderBy("_digest", "size").rowsBetween(W.unboundedPreceding, -1)
    cut = edge.withColumn("_more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.coalesce(F.sum("size").over(drawn), F.lit(0)))).cast("long")).drop("_digest")
    both = plain.unionByName(cut).withColumn("taken", F.col("_whole") * F.col("size") + F.col("_more"))
    return both.select(*docs.columns, *new)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their size, their source's size and target, and the words that the mix takes of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS dg
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {WEIGHTS} + 1 AS weight, source_size * {CAP} AS cap FROM s),
l AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
         CAST((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER o, 0) AS DOUBLE)
         / CAST((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS lev
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT lev FROM l WHERE ratio >= lev ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), v.lev * weight) AS target FROM l, v),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
f AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole,
         CAST(round(r.target - r.whole * r.source_size) AS BIGINT) AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.dg, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM f
"""
