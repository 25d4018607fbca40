"""Operator 6: secret scans that link the parts of a credential.

Base kinds (assign, access, hex) are reported as they stand. Weak candidates are too common to report alone: an
identifier-like token (wid: 16 or more capitals and digits, of both), a high-variety token (wsecret: 20 or more characters
with small letters, capitals and digits) and an endpoint (url), of any length. They are reported only where
complementary parts meet within SCOPE code points: an identifier next to a secret, a secret next to an identifier or an
endpoint, an endpoint next to both. Base spans count as parts: access as identifier, assign and hex as secrets.

The link is an interval join of each part with the nearest part of every class on either side. Rows are parts, not
pairs: one sort by document and position gives the nearest earlier ends, one the nearest later starts, so a document
with many parts costs n log n and no list of pairs exists. A document is the unit of work; its parts meet in one task.

Null texts count as empty. Repeated rows and null ids each keep their own result, as rows are told apart by their place
in the input. Extra columns are left out. An empty table gives an empty result; long texts and any number of matches are
taken whole. Spans of equal start are ordered as the kinds are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read
from .spans import digest, find, joined

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "wid", "wsecret", "url")
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
WEAK_ID = r"(?<![A-Za-z0-9])(?=[0-9]*+[A-Z])(?=[A-Z]*+[0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+=*+(?![A-Za-z0-9+/_=-])"
URL = r"(?i)\b(?:https?|jdbc:[a-z0-9]++|amqps?|postgres(?:ql)?|mysql|mongodb|redis|s3)://[^\x20\x09-\x0D\"'<>]{3,}+"
#: The class of each kind, and the code points between two parts of one credential at most.
CLASS = {"assign": "secret", "hex": "secret", "wsecret": "secret", "access": "id", "wid": "id", "url": "endpoint"}
CLASSES = ("id", "secret", "endpoint")
SCOPE = 256


def parts(text: Column) -> Column:
    """All parts of a text, base and weak."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(find(text, ASSIGN, "assign", group=2), lambda s: F.char_length(s["match"]) >= 12)
    found = [assign, find(text, ACCESS, "access"), find(text, HEX, "hex")]
    found += [find(text, WEAK_ID, "wid"), find(text, WEAK_SECRET, "wsecret"), find(text, URL, "url")]
    return F.concat(*found)


def order_of(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def linked(rows: DataFrame) -> DataFrame:
    """rows of (_row, kind, start, end): adds whether each part is reported."""
    of_class = F.create_map(*[F.lit(x) for pair in CLASS.items() for x in pair])[F.col("kind")]
    rows = rows.withColumn("_class", of_class)
    earlier = W.partitionBy("_row").orderBy("start", "end", "kind").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("_row").orderBy(F.col("start").desc(), F.col("end").desc(), F.col("kind").desc()).rowsBetween(W.unboundedPreceding, -1)
    for c in CLASSES:
        own = F.col("_class") == c
        rows = rows.withColumn(f"_end_{c}", F.max(F.when(own, F.col("end"))).over(earlier))
    for c in CLASSES:
        rows = rows.withColumn(f"_start_{c}", F.min(F.when(F.col("_class") == c, F.col("start"))).over(later))
    near = {c: F.coalesce(F.col("start") - F.col(f"_end_{c}") <= SCOPE, F.lit(False)) | F.coalesce(F.col(f"_start_{c}") - F.col("end") <= SCOPE, F.lit(False)) for c in CLASSES}
    report = (
        F.when(F.col("kind").isin(*BASE), True)
        .when(F.col("_class") == "id", near["secret"])
        .when(F.col("_class") == "secret", near["id"] | near["endpoint"])
        .when(F.col("_class") == "endpoint", near["id"] & near["secret"])
        .otherwise(False)
    )
    return rows.withColumn("reported", report)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the reported spans of each row, ordered by start and kind."""
    found = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), parts(F.col("text")).alias("_parts"))
    rows = found.select("doc_id", "_row", F.explode_outer("_parts").alias("p")).select("doc_id", "_row", "p.kind", "p.start", "p.end", "p.match")
    span = F.when(F.col("reported"), F.struct("start", order_of(F.col("kind")).alias("o"), "kind", "end", "match"))
    out = linked(rows).groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("_s"))
    return out.select("doc_id", F.transform("_s", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "match")])).alias("found"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts by base kind, the digest of the base spans, and all spans."""
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == base_kind)).cast("long").alias(f"n_{base_kind}") for base_kind in BASE]
    return scan(read(spark, sf_dir, "documents")).select("doc_id", *counts, digest(base).alias("base_sha256"), joined(F.col("found")).alias("spans"))
