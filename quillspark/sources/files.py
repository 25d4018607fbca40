"""File sources and sinks: explicit schemas in, partitioned or line-wise JSON out. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OCR_PAGE = """doc_id string, page int, text string, boxes array<struct<bbox array<double>, text string, conf double>>,
  tables array<struct<bbox array<double>, cells array<struct<r int, c int, bbox array<double>, text string, conf double>>>>"""
FEEDBACK = "id string, ts string, docId string, path string, previousValue string, newValue string, reason string, user string, accepted boolean, type string"
SNAPSHOT = "id string, ts string, docId string, summary struct<patient struct<dob string, hasPhones boolean>, procedure struct<cpt string, ambiguous boolean>, confidence string>"
PROCESSED = "id string, processedAt string, pages int, intakeDate string, suggestedFilename string, fileHash string, confidence string, problems array<string>, actions array<string>"
RULES = "category string, codes array<struct<code string, description string, patterns array<struct<pattern string, name string, score double>>>>"


def accepted(uploads: DataFrame) -> DataFrame:
    """Uploads (path, content) that begin as a PDF, named by the digest of their bytes."""
    pdf = uploads.where(F.substring("content", 1, 4) == F.lit("%PDF").cast("binary"))
    return pdf.select(F.sha2("content", 256).alias("doc_id"), "path", F.octet_length("content").cast("long").alias("length"), "content")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """PDF files by their magic bytes, named by the digest of their content."""
    return accepted(spark.read.format("binaryFile").load(path))


def read_ocr_json(spark: SparkSession, path: str) -> DataFrame:
    """OCR pages as JSON lines, empty box texts dropped and confidences clamped to 0 to 1."""
    pages = spark.read.schema(OCR_PAGE).json(path)
    box = lambda b: F.struct(b["bbox"].alias("bbox"), b["text"].alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), b["conf"])).alias("conf"))
    return pages.withColumn("boxes", F.transform(F.filter("boxes", lambda b: F.trim(b["text"]) != ""), box))


def read_ndjson(spark: SparkSession, path: str, schema: str = FEEDBACK) -> DataFrame:
    """JSON lines; lines that don't parse are dropped."""
    bad = "_corrupt_record"
    rows = spark.read.schema(f"{schema}, {bad} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    return rows.where(F.col(bad).isNull()).drop(bad)


def read_json_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One multi-line JSON document as rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_rule_dir(spark: SparkSession, path: str) -> DataFrame:
    """A folder of rule files: one row a code and pattern, with its category and order."""
    files = spark.read.schema(RULES).option("multiLine", True).json(path)
    codes = files.select("category", F.posexplode("codes").alias("code_ord", "c"))
    return codes.select("category", "c.code", "c.description", "code_ord", F.posexplode_outer("c.patterns").alias("ord", "p")).select("category", "code", "description", "code_ord", "ord", "p.pattern", "p.name", "p.score")


def read_results_dir(spark: SparkSession, path: str, schema: str, limit: int = 300) -> DataFrame:
    """The newest result files by name, descending; the limit is the feature."""
    return spark.read.schema(schema).json(path).withColumn("file_name", F.input_file_name()).orderBy(F.col("file_name").desc()).limit(limit)


def read_log_jsonl(spark: SparkSession, path: str, message: str = "text_llm") -> DataFrame:
    """Log lines of one message, from JSON; other lines are skipped."""
    line = F.from_json("value", "t string, level string, msg string, id string, elapsed double, pages int")
    return spark.read.text(path).select(line.alias("l")).where(F.col("l.msg") == message).select("l.*")


def write_results(results: DataFrame, path: str, by: str = "intake_date") -> None:
    """Results as JSON by intake day, so reports read one folder a day."""
    results.write.mode("append").partitionBy(by).json(path)


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Both together, the last record of each key."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return old.unionByName(new).withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def rotated(rows: DataFrame, order: str, keep: int) -> DataFrame:
    """The newest rows of a log; the number kept is the feature."""
    return rows.orderBy(F.col(order).desc()).limit(keep)


def purged(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't listed."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def fhir_rows(results: DataFrame) -> DataFrame:
    """One row a FHIR resource of (doc_id, first, last, dob, cpt, codes); ids are digests, so exports repeat."""
    uid = lambda kind: F.substring(F.sha2(F.concat_ws(":", F.lit(kind), F.col("doc_id").cast("string")), 256), 1, 32)
    patient = F.struct(F.lit("Patient").alias("resourceType"), uid("patient").alias("id"), F.array(F.struct(F.col("last").alias("family"), F.array("first").alias("given"))).alias("name"), F.col("dob").alias("birthDate"))
    request = F.struct(F.lit("ServiceRequest").alias("resourceType"), uid("request").alias("id"), F.lit("active").alias("status"), F.struct(F.col("cpt").alias("text")).alias("code"))

    def condition(code: Column) -> Column:
        return F.to_json(F.struct(F.lit("Condition").alias("resourceType"), F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), code), 256).alias("id"), F.struct(code.alias("text")).alias("code")))

    resources = F.concat(F.array(F.to_json(patient), F.to_json(request)), F.transform(F.coalesce("codes", F.array().cast("array<string>")), condition))
    return results.select("doc_id", F.posexplode(resources).alias("entry", "resource"))
