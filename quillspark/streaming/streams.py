"""Structured Streaming over event files, bounded by what is there when it starts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def events(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream with a ten-minute watermark. Times are cut to milliseconds; a watermark needs a zone."""
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        # A stream reads folders: the file's own, narrowed to its name.
        stream = reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    else:
        stream = reader.parquet(path)
    return stream.withColumn("ts", F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp"))).withWatermark("ts", "10 minutes")


def sessions(stream: DataFrame) -> DataFrame:
    """Events by user and session; a gap of more than five minutes ends one."""
    window = F.session_window("ts", "5 minutes")
    return stream.groupBy("user_id", window).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_millis("session_window.start").alias("first_ms"), "n")


def tumbling(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events by kind and hour."""
    return stream.groupBy("event_type", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most")).select("event_type", F.unix_millis("window.start").alias("start_ms"), "n", "least", "most")


def once(frame: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there, into Parquet in the shared folder, and returns that table. Nothing goes to the driver.

    In complete mode each batch writes the whole result to a folder of its own, and the last one is read.
    """
    spark = frame.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # One batch at least, so that a stream without rows gives an empty table.
    last = {"path": f"{base}/none"}
    spark.createDataFrame([], frame.schema).write.parquet(last["path"])

    def keep(rows: DataFrame, batch: int) -> None:
        if mode == "complete":
            last["path"] = f"{base}/b{batch}"
            rows.write.mode("overwrite").parquet(last["path"])
        else:
            rows.write.mode("overwrite").parquet(f"{base}/out/b{batch}")
            last["path"] = f"{base}/out"

    run = frame.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(frame.schema).option("recursiveFileLookup", True).parquet(last["path"])


def deduplicated(stream: DataFrame) -> DataFrame:
    """The first event of each id within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
