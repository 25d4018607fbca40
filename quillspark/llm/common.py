"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of code points that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What stands between words.
GAP = r"[\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{GAP}|{GAP}\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def n_words(text: Column) -> Column:
    """The number of words of a text, as a long: the marks that are left of it, one a word, as a count of matches would hold every word."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\A{GAP}", "")
    return F.length(F.regexp_replace(bare, WORD + rf"[\x20\x09-\x0D]*+", "x")).cast("long")


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id's text leaves 1 when divided by 3. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: A key of more than one in HOT rows is hot, so there are fewer than HOT hot keys.
HOT = 1000


def join_salted(rows: DataFrame, table: DataFrame, counts: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """rows joined with table, which has one row a key; a hot key's rows are dealt to many tasks.

    counts has one row a key too, and in _n how many of the rows have it; it is read twice, so it should be a written table.
    The hot keys, fewer than HOT by their definition, are broadcast and salt their rows by a hash of the columns spread;
    their rows of table are repeated once a salt, fewer than 2 * HOT times in all.
    """
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    share = max(1, total // HOT)
    hot = counts.where(F.col("_n") * HOT > max(total, HOT)).select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_parts"))
    hot = F.broadcast(hot)
    salt = lambda x: F.coalesce(x, F.lit(0)).cast("int")
    left = rows.join(hot, keys, "left").withColumn("_salt", salt(F.pmod(F.xxhash64(*spread), F.col("_parts")))).drop("_parts")
    right = table.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salt(F.col("_parts") - 1)))).drop("_parts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset a local master gets one of its own; a cluster gets an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        shared = "/tmp/quillspark-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that saved() wrote in this process; they go when it ends.
WRITTEN: dict[str, SparkSession] = {}


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: compressed and pruned by column, unlike a checkpoint."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def forget(path: str) -> None:
    """Deletes a folder that saved() wrote, which nothing reads any more."""
    jvm = WRITTEN.pop(path)._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)


@atexit.register
def _forget_all() -> None:
    for path in list(WRITTEN):
        with contextlib.suppress(Exception):  # the JVM may have ended before
            forget(path)
