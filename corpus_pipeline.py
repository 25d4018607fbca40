"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows as Parquet in the folder that spark.checkpoint.dir names and reads them again, so a lost executor
costs no more than a part of one stage; the rows of the stage before are deleted then. SQL can't express near-duplicate components, BM25 retrieval or the robust estimates, so
ORACLE_SQL is None and the tests hold the rows against a brute-force version.

Every stage takes null texts, ids, languages and sources, blank and very long texts, repeated rows, empty tables and extra
columns: null and blank texts fail the quality rules; extra columns are left out; an empty table gives an empty one; of
repeated rows near_dedup keeps one. The operators' docstrings say the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, mixing, pii, quality, simhash
from quillspark.llm.common import DOCUMENT_COLUMNS, WRITTEN, forget, read, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates (SimHash fingerprints, and 5-word shingles of Jaccard 0.8), that of the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; keeps every document."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and the words taken, repeats counted."""
    return mixing.mix(docs.select(*DOCUMENT_COLUMNS)).where(F.col("taken") > 0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mask_pii", mask_pii),
    ("mix_sources", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a data folder."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            forget(before)
        before = list(WRITTEN)[-1]
    return docs
