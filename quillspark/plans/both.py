"""Queries stated once for Spark SQL and DuckDB, over tables named alike."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching
from ..functions import text as T
from ..functions.sqltext import DUCK, SPARK, Dialect, lit
from ..session import spread, stored
from ..sources import fixtures
from .entry import REGISTRY, query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def intake(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """All documents as one-page referrals, and the fixtures."""
    own = documents.select("doc_id", F.lit(1).alias("page"), "text")
    return own.unionByName(spark.createDataFrame(fixtures.rows(), fixtures.SCHEMA))


def lines(pages: DataFrame) -> DataFrame:
    """Pages to lines: doc_id, page, line, text, section."""
    split = pages.select("doc_id", "page", F.posexplode(F.split(F.expr(T.normalized(SPARK, "text")), r"\r?\n")).alias("line", "text"))
    return sectioned(split)


def sectioned(split: DataFrame) -> DataFrame:
    return split.withColumn("section", F.expr(T.tag_section(SPARK, "text")))


INTAKE_SQL = "(SELECT doc_id, 1 AS page, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {p}, {lit(t)})" for i, p, t in fixtures.rows()) + ") AS fixture(doc_id, page, text))"
_PARTS = f"(SELECT doc_id, page, string_split_regex({T.normalized(DUCK, 'text')}, '\\r?\\n') AS parts FROM {INTAKE_SQL} AS pages_of)"
LINES_SQL = f"(SELECT doc_id, page, CAST(i - 1 AS INTEGER) AS line, parts[i] AS text, {T.tag_section(DUCK, 'parts[i]')} AS section FROM (SELECT doc_id, page, parts, unnest(range(1, len(parts) + 1)) AS i FROM {_PARTS} AS split_pages) AS numbered)"


#: Derived tables that are written, by session, name and state of the documents.
STORED: dict[tuple, DataFrame] = {}


class Names:
    """Table references of a statement; intake and lines are derived."""

    def __init__(self, spark: SparkSession | None = None, sf_dir: str = ""):
        self._spark, self._dir = spark, sf_dir.rstrip("/")
        self._later: dict[str, Callable[[set[str] | None], str]] = {}
        self._views: set[str] = set()
        self._read: DataFrame | None = None

    def later(self, name: str, build: Callable[[set[str] | None], str]) -> str:
        """A derived table that holds no more than is read of it: in Spark built once the words of the statement around it are known."""
        if self._spark is None:
            return f"{build(None)} AS {name}"
        self._later[name] = build
        return f"@{name}@ AS {name}"

    def resolved(self, sql: str) -> str:
        for name, build in self._later.items():
            if f"@{name}@" in sql:
                sql = sql.replace(f"@{name}@", build(set(re.findall(r"\w+", sql))))
        return sql

    def _pages(self) -> DataFrame:
        if self._read is None:
            self._read = intake(self._spark, spread(self._spark.read.parquet(f"{self._dir}/documents.parquet").select("doc_id", "text")))
        return self._read

    def _view(self, kind: str, what: object, make: Callable[[DataFrame], DataFrame], alias: str) -> str:
        view = f"qs_{kind}_{hashlib.md5(repr(what).encode()).hexdigest()[:12]}"
        if view not in self._views:
            make(self._pages()).createOrReplaceTempView(view)
            self._views.add(view)
        return f"{view} AS {alias}"

    def held(self, *ps: str) -> str:
        """intake; in Spark only the rows that have one of the patterns."""
        return self.intake if self._spark is None else self._view("held", ps, lambda pages: matching.held(pages, ps), "intake")

    def blanked(self, *ps: str) -> str:
        """intake; in Spark with nulls for the texts that have none of the patterns."""
        return self.intake if self._spark is None else self._view("blanked", ps, lambda pages: matching.blanked(pages, ps), "intake")

    def flagged(self, flags: dict[str, str], words: dict[str, list[str]], gate: tuple[str, ...] | None = None, keep: tuple[str, ...] = ("doc_id",), signs: dict[str, str] | None = None) -> str:
        """In Spark: of the rows of intake (that have a pattern of gate) which patterns and words they have, as columns."""
        return self._view("flagged", (flags, words, gate, keep), lambda pages: matching.flagged(pages, flags, words, gate, keep, signs), "intake")

    def picked(self, name: str, choice: matching.Choice, *around: int) -> str:
        """lines; in Spark only those of a choice, and those so many below its hits."""
        return self.lines if self._spark is None else self._view(f"picked_{name}", around, lambda pages: sectioned(matching.picked(pages, choice, around)), "lines")

    def stored(self, name: str, sql: str) -> str:
        """A derived table that many statements use: in Spark written once by the shared folder, and read again while the documents
        file stays the same (its time and length)."""
        if self._spark is None:
            return f"{sql} AS {name}"
        place = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._dir}/documents.parquet")
        status = place.getFileSystem(self._spark._jsc.hadoopConfiguration()).getFileStatus(place)
        key = (self._spark.sparkContext.applicationId, name, self._dir, status.getModificationTime(), status.getLen())
        if key not in STORED:
            STORED[key] = stored(self._spark.sql(self.resolved(f"SELECT * FROM {sql} AS {name}")), name)
        STORED[key].createOrReplaceTempView(f"qs_{name}")
        return f"qs_{name} AS {name}"

    def in_order(self, name: str, key: str) -> str:
        """A table; in Spark with the rows of a key together in the order of the file, so sums of doubles come out the same in every
        run, and as DuckDB's on one thread."""
        if self._spark is None:
            return name
        place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
        rows = self._spark.read.parquet(f"{self._dir}/{name}.parquet").select("*", *place)
        rows.repartition(key).sortWithinPartitions(key, "_file", "_row").drop("_file", "_row").createOrReplaceTempView(f"qs_{name}_by_{key}")
        return f"qs_{name}_by_{key} AS {name}"

    def __getattr__(self, name: str) -> str:
        if self._spark is None:
            return {"intake": f"{INTAKE_SQL} AS intake", "lines": f"{LINES_SQL} AS lines"}.get(name, name)
        view = f"qs_{name}"
        if name in ("intake", "lines"):
            pages = self._pages()
            (pages if name == "intake" else lines(pages)).createOrReplaceTempView(view)
        else:
            self._spark.read.parquet(f"{self._dir}/{name}.parquet").createOrReplaceTempView(view)
        return f"{view} AS {name}"


def both(name: str) -> Callable[[Callable[[Dialect, Names], str]], Callable]:
    """Registers build(dialect, names) as a query and as its DuckDB statement."""

    def keep(build: Callable[[Dialect, Names], str]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            names = Names(spark, sf_dir)
            return spark.sql(names.resolved(build(SPARK, names)))

        query(name, build(DUCK, Names()))(run)
        return build

    return keep


__all__ = ["REGISTRY", "both", "intake", "lines"]
