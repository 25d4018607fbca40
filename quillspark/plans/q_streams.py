"""Streaming queries and file sources, held against SQL over the tables that they are fed with, and the folds, held against plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

from ..catalogs import cpt as P
from ..catalogs import payers as Y
from ..functions import text as T
from ..functions.sqltext import DUCK, SPARK
from ..operators import candidates, folds
from ..session import shared_dir
from ..sources import files
from ..streaming import streams
from . import q_result as R
from .both import Names, intake
from .entry import query
from .q_detect import INSURANCE_WORDS, MEMBER_MARK, MEMBER_SOURCES, member_ids, placed_members, rule_scores


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.events(spark, f"{sf_dir.rstrip('/')}/events.parquet")


SESSIONS = """SELECT user_id, min(ms) AS first_ms, count(*) AS n FROM (SELECT user_id, ms, sum(CASE WHEN before IS NULL OR ms - before > 300000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT user_id, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) AS a) AS b GROUP BY user_id, session"""


@query("stream_sessions", SESSIONS)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.once(streams.sessions(_events(spark, sf_dir)), "complete")


@query("stream_tumbling", "SELECT event_type, epoch_us(date_trunc('hour', ts)) // 1000 AS start_ms, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.once(streams.tumbling(_events(spark, sf_dir)), "complete")


@query("stream_queue", "SELECT DISTINCT event_id, event_type FROM events")
def stream_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.once(streams.deduplicated(_events(spark, sf_dir)), "append")


@query("near_dup_lines")
def near_dup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = intake(spark, spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
    return folds.near_dup_lines(pages)


@query("member_id_merge")
def member_id_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = Names(spark, sf_dir)
    return folds.merge_member_ids(spark.sql(f"SELECT doc_id, value, score, n FROM {member_ids(SPARK, names)}"))


@query("member_id_rank_merged")
def member_id_rank_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of ids after they are merged, those that carriers' patterns propose among them."""
    names = Names(spark, sf_dir)
    carrier = R.main_carriers(SPARK, names)
    texts = spark.sql(f"SELECT intake.doc_id, {T.normalized(SPARK, 'text')} AS text, carrier FROM {names.held(MEMBER_MARK, candidates.DASHED)} LEFT JOIN {carrier} ON carriers.doc_id = intake.doc_id")
    texts.mapInArrow(candidates.merged_batches(INSURANCE_WORDS), candidates.SCHEMA).createOrReplaceTempView("qs_found_ids")
    ids = names.stored("merged_ids", "(SELECT * FROM qs_found_ids)").replace(" AS merged_ids", " AS m")
    return spark.sql(f"SELECT doc_id, value, total, place FROM {placed_members(SPARK, rule_scores(SPARK, names, ids), MEMBER_SOURCES | {'carrier_pattern': 40})} AS ranked")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes of a page: place by quantity and line number."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("box"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") % 3).cast("double").alias("y"), F.lit(20.0).alias("w"), F.lit(5.0).alias("h"), F.col("l_discount").alias("conf"), F.col("l_returnflag").alias("text"))


@query("join_iou_dedupe")
def join_iou_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.suppress_boxes(_boxes(spark, sf_dir))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("src_ndjson", "SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS \"user\", event_type AS path, value > 60 AS accepted FROM events")
def src_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback as JSON lines, written and read."""
    path = _folder(spark, "ndjson")
    rows = _table(spark, sf_dir, "events")
    rows.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("path"), (F.col("value") > 60).alias("accepted")).write.json(path)
    return files.read_ndjson(spark, path).select("id", "user", "path", "accepted")


def _log(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "log")
    rows = _table(spark, sf_dir, "events")
    line = F.struct(F.when(F.col("event_type") == "purchase", "text_llm").otherwise(F.col("event_type")).alias("msg"), F.col("event_id").cast("string").alias("id"), F.col("value").alias("elapsed"))
    rows.select(F.to_json(line).alias("value")).unionByName(spark.createDataFrame([("not json",)], "value string")).write.text(path)
    return path


LOG = "SELECT CAST(event_id AS VARCHAR) AS id, value AS elapsed FROM events WHERE event_type = 'purchase'"


@query("src_log_jsonl", LOG)
def src_log_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_log_jsonl(spark, _log(spark, sf_dir)).select("id", "elapsed")


@query("stream_log_tail", LOG)
def stream_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines, followed as a stream of text."""
    line = F.from_json("value", "msg string, id string, elapsed double").alias("l")
    lines = spark.readStream.text(_log(spark, sf_dir)).select(line).where(F.col("l.msg") == "text_llm").select("l.id", "l.elapsed")
    return streams.once(lines, "append")


DAYS = "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS intake_date, count(*) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY 1"


def _results(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "results")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("intake_date"))
    files.write_results(rows.repartition("intake_date"), path)
    return path


@query("sink_result_json", DAYS)
def sink_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON in a folder a day, read back by day."""
    rows = spark.read.schema("id long, intake_date string").json(_results(spark, sf_dir))
    return rows.groupBy("intake_date").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("src_results_dir", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS intake_date, o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT min(d) FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY d DESC LIMIT 20))")
def src_results_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of the 20 newest days: by the folders' names, so no other folder is read."""
    rows = spark.read.schema("id long, intake_date string").json(_results(spark, sf_dir))
    days = [r[0] for r in _table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct().orderBy(F.col("d").desc()).limit(20).collect()]
    return rows.where(F.col("intake_date").isin(days)).select("intake_date", "id")


RULE_ROWS = [(code, k, p) for code, _, ps in P.CPT for k, p in enumerate(ps)]


@query("src_rule_dir", f"SELECT category, code, ord, pattern FROM {DUCK.values('rules', 'category, code, ord, pattern', [('cpt', *r) for r in RULE_ROWS])}")
def src_rule_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of rule files as one row a code and pattern."""
    path = _folder(spark, "rules")
    codes = [{"code": c, "description": d, "patterns": [{"pattern": p, "name": p, "score": 1.0} for p in ps]} for c, d, ps in P.CPT]
    spark.createDataFrame([("cpt", codes)], files.RULES).coalesce(1).write.json(path)
    return files.read_rule_dir(spark, path).select("category", "code", F.col("ord").cast("int").alias("ord"), "pattern")


def _config(spark: SparkSession, name: str, schema: str, rows: list) -> DataFrame:
    path = _folder(spark, name)
    spark.createDataFrame([(rows,)], schema).coalesce(1).write.json(path)
    return files.read_json_config(spark, path, schema)


@query("src_json_config", f"SELECT code, description FROM {DUCK.values('codes', 'code, description', [(c, d) for c, d, _ in P.CPT])}")
def src_json_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings file: one JSON document whose list becomes rows."""
    schema = "codes array<struct<code string, description string>>"
    return _config(spark, "config", schema, [(c, d) for c, d, _ in P.CPT]).select(F.explode("codes").alias("c")).select("c.code", "c.description")


@query("src_kb_json", f"SELECT name, payer FROM {DUCK.values('routes', 'name, payer', Y.ROUTES)}")
def src_kb_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge-base file: its table of routes as rows."""
    schema = "routes array<struct<name string, payer string>>"
    return _config(spark, "kb", schema, list(Y.ROUTES)).select(F.explode("routes").alias("r")).select("r.name", "r.payer")


@query("src_pdf_upload", "SELECT sha256(concat('%PDF-1.4 ', coalesce(text, ''))) AS doc_id, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1")
def src_pdf_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads by the digest of their bytes, and how many are alike; files that don't begin as a PDF are refused."""
    docs = _table(spark, sf_dir, "documents")
    body = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("GIF89a ")).otherwise(F.lit("%PDF-1.4 ")), F.coalesce("text", F.lit(""))).cast("binary")
    uploads = docs.select(F.col("doc_id").cast("string").alias("path"), body.alias("content"))
    return files.accepted(uploads).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
