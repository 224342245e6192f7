"""Logical views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import first_line, title_key
from tidemark.functions.urls import looks_live, normalised


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, title, tag, seen_at: one headline a document."""
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id, 0)")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", first_line(F.col("text")).alias("title"), F.col("lang").alias("tag"), at.alias("seen_at"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, title, tag, seen_at, is_live, content_key (the title's key) and article_key (the normalised link)."""
    rows = headlines(spark, sf_dir).withColumn("content_key", title_key(F.col("title"))).withColumn("article_key", normalised(F.col("url")))
    return rows.select("id", "source", "title", "tag", F.col("fetched_at").alias("seen_at"), "is_live", "content_key", "article_key")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, started_at, finished_at, id, status, error, items_found, items_new: one attempt an event; attempts begin in bursts."""
    bad = (F.col("event_type") == "error") | (F.col("user_id") % 9 == 0)
    status = F.when(bad, "error").when(F.col("event_type") == "signup", "skipped").otherwise("ok")
    error = F.when(bad & (F.col("event_id") % 2 == 0), "Temporary failure in name resolution").when(bad, "HTTP 503")
    found = F.get_json_object("props", "$.k").cast("long")
    started = F.date_trunc("hour", "ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod("event_id", F.lit(500)).cast("decimal(18,6)"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("Src"), "user_id").alias("source"), started.alias("started_at"), (started + F.expr("interval 2 seconds")).alias("finished_at"), F.col("event_id").alias("id"),
        status.alias("status"), error.alias("error"), found.alias("items_found"), F.floor("value").cast("long").alias("items_new"),
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, tag, title, summary, url, published_at, fetched_at, is_live: one reading of an article a document; one article's readings share a link."""
    minutes = lambda c: F.make_dt_interval(F.lit(0), F.lit(0), c, F.lit(0))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    query = F.when(F.col("doc_id") % 5 == 0, "?utm_source=feed").when(F.col("doc_id") % 5 == 1, "?page=2&at_medium=RSS#top").otherwise("")
    slug = F.when(F.col("doc_id") % 11 == 0, "live/").otherwise("")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        "source",
        F.upper("lang").alias("tag"),
        first_line(F.col("text")).alias("title"),
        F.nullif(F.trim(F.regexp_replace(F.substring_index(F.ltrim("text"), "\n", 3), r"^[^\n]*\n?", "")), F.lit("")).alias("summary"),
        F.concat(F.when(F.col("doc_id") % 3 == 0, "http://www.").otherwise("https://"), "source", F.lit(".example.co.uk/"), "lang", F.lit("/"), slug, F.lit("story-"), F.col("doc_id") % 400, query).alias("url"),
        (start + minutes((F.col("doc_id") * 31).cast("int"))).alias("fetched_at"),
    )
    rows = rows.withColumn("published_at", F.when(F.col("id") % 7 != 0, F.col("fetched_at") - minutes((F.col("id") % 50).cast("int"))))
    return rows.withColumn("is_live", looks_live(F.col("url"), F.col("title")))
