"""The library's tables over the driver's tables: files and pages from documents, versions from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.functions.text import normalize

DAY = 86_400
#: The moment that stands for now, so that results don't change from day to day (2026-01-01, epoch seconds).
NOW = 1_767_225_600

EXT = "CASE WHEN doc_id % 10 = 7 THEN 'ppt' WHEN doc_id % 10 = 8 THEN 'docx' WHEN doc_id % 10 = 9 THEN 'pdf' ELSE 'pptx' END"
STATUS = "CASE WHEN doc_id % 97 = 5 THEN 'error' WHEN doc_id % 89 = 4 THEN 'encrypted' WHEN doc_id % 10 = 7 THEN 'filename_only' WHEN doc_id % 53 = 3 THEN 'pending' ELSE 'ok' END"
MTIME = "1577836800 + (doc_id * 7919 % 2000) * 86400 + (doc_id * 3607 % 86400)"
NAME = f"concat(CASE WHEN doc_id % 11 = 0 THEN 'report final ' WHEN doc_id % 13 = 0 THEN 'presentation' WHEN doc_id % 7 = 0 THEN 'plan v' ELSE 'doc_' END, CAST(doc_id % 400 AS VARCHAR(20)), '.', {EXT})"

#: The same model for the second engine, as CTEs that each query's SQL begins with.
FILES_CTE = f"""files AS (SELECT doc_id AS file_id, concat('/lib/', source, '/', lang, '/', {NAME}) AS path, {NAME} AS name, {EXT} AS ext, n_chars AS size,
  CAST({MTIME} AS DOUBLE) AS mtime, make_timestamp(CAST({MTIME} AS BIGINT) * 1000000) AS ts, concat('sha256:', sha256(text)) AS content_hash, {STATUS} AS status, source, lang, text,
  len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS page_count FROM documents)"""
PAGES_CTE = r"""pages_raw AS (SELECT file_id, page_no, raw_text, replace(lower(raw_text), 'ß', 'ss') AS norm FROM (
  SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS raw_text, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents) WHERE trim(raw_text) <> '')"""
VERSIONS_CTE = """versions AS (SELECT event_id AS version_id, user_id AS doc_id, epoch(ts) AS ts, ts AS at, CAST(floor(value * 1000) AS BIGINT) AS size, CAST(event_id % 37 AS BIGINT) AS page_count,
  CASE WHEN event_type = 'error' THEN 'invalid' ELSE 'ok' END AS health, event_type, concat('改 ', event_id % 9, ' 页') AS changed FROM events)"""
#: A document for each user that has events; its paths over time are where its versions were saved.
DOCS_CTE = "docs AS (SELECT user_id AS doc_id, concat('/lib/', user_id % 5, '/deck_', user_id, '.pptx') AS path, CASE WHEN user_id % 7 = 3 THEN 'deleted' ELSE 'active' END AS status FROM events GROUP BY user_id)"
PATHS_CTE = "paths AS (SELECT user_id AS doc_id, concat('/lib/', event_id % 5, '/deck_', user_id, '_', event_id % 4, '.pptx') AS path, min(epoch(ts)) AS first_seen, max(epoch(ts)) AS last_seen FROM events GROUP BY ALL)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, name, ext, size, mtime, ts, content_hash, page_count, status, source, lang, text. Columns that aren't used aren't read."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("file_id"), F.expr(f"concat('/lib/', source, '/', lang, '/', {NAME})").alias("path"), F.expr(NAME).alias("name"), F.expr(EXT).alias("ext"),
        F.col("n_chars").alias("size"), F.expr(f"CAST({MTIME} AS DOUBLE)").alias("mtime"), F.expr(f"timestamp_seconds({MTIME})").alias("ts"),
        F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"), F.expr(STATUS).alias("status"), "source", "lang", "text",
        F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("page_count"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, page_no (physical, from 1), raw_text, norm: pages of non-blank text."""
    d = read(spark, sf_dir, "documents")
    p = d.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("pos", "raw_text")).where(F.trim("raw_text") != "")
    return p.select("file_id", (F.col("pos") + 1).cast("long").alias("page_no"), "raw_text", normalize(F.col("raw_text")).alias("norm"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version_id, doc_id, ts (epoch seconds), at, size, page_count, health, event_type."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("version_id"), F.col("user_id").alias("doc_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("ts").cast("timestamp").alias("at"),
        F.floor(F.col("value") * 1000).cast("long").alias("size"), (F.col("event_id") % 37).alias("page_count"),
        F.when(F.col("event_type") == "error", "invalid").otherwise("ok").alias("health"), "event_type", F.concat(F.lit("改 "), F.col("event_id") % 9, F.lit(" 页")).alias("changed"),
    )


def managed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, status."""
    u = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    path = F.concat(F.lit("/lib/"), F.col("doc_id") % 5, F.lit("/deck_"), F.col("doc_id"), F.lit(".pptx"))
    return u.select("doc_id", path.alias("path"), F.when(F.col("doc_id") % 7 == 3, "deleted").otherwise("active").alias("status"))


def doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, first_seen, last_seen: every path that a document was saved at."""
    e = read(spark, sf_dir, "events")
    path = F.concat(F.lit("/lib/"), F.col("event_id") % 5, F.lit("/deck_"), F.col("user_id"), F.lit("_"), F.col("event_id") % 4, F.lit(".pptx"))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.groupBy(F.col("user_id").alias("doc_id"), path.alias("path")).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
