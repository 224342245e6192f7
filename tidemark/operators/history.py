"""Operators over ordered histories: changes, latest and first rows, sessions, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import title_key


def revisions(versions: DataFrame) -> DataFrame:
    """First sighting of each wording of an article, with the wording before it."""
    seen = versions.groupBy("article_key", "title").agg(F.min_by(F.struct("id", "source", "tag", "seen_at", "content_key"), F.col("id")).alias("r"))
    rows = seen.select("article_key", "title", "r.*")
    order = Window.partitionBy("article_key").orderBy("id")
    rows = rows.withColumn("prev_title", F.lag("title").over(order)).withColumn("revision", F.row_number().over(order).cast("long"))
    return rows.withColumn("minor", F.col("content_key") == title_key(F.col("prev_title")))


def latest_per_key(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The last row of each key; a hot key is reduced before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(order, *columns), F.col(order)).alias("r")).select(key, "r.*")


def sessions(rows: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    return rows.groupBy(key, F.session_window(at, gap).alias("w"))


def last_statuses(log: DataFrame, n: int) -> DataFrame:
    """The last n statuses of each source, newest first."""
    newest = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("id"))
    return log.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)
