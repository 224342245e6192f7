"""One article under several links or titles: twins of readings, readings folded by link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import title_key
from tidemark.functions.urls import brand_key, match_key, normalised

DAYS = 7


def keyed(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.lower("source").alias("outlet"), "title", "fetched_at", normalised(F.col("url")).alias("whole"), match_key(F.col("url")).alias("by_link"), brand_key(F.col("url")).alias("by_brand"), title_key(F.col("title")).alias("by_title"))


def earlier(rows: DataFrame, days: int = DAYS) -> DataFrame:
    """(id, twin, way): the newest earlier reading of the same source by link (1), else by brand and path (2), else by title (3).

    Each key is one group of readings in order, in which the newest before a reading
    is the one before it, so nothing is joined and a popular title costs a sort.
    """
    from pyspark.sql import Window

    out, own = None, keyed(rows)
    for way, key in enumerate(("by_link", "by_brand", "by_title"), 1):
        order = Window.partitionBy("outlet", key).orderBy("fetched_at", "id")
        last = F.lag(F.struct("fetched_at", "id")).over(order)
        found = own.select("id", "fetched_at", last.alias("last"), F.lit(way).alias("way")).where(F.col("last.fetched_at") >= F.col("fetched_at") - F.expr(f"interval {days} days"))
        found = found.select("id", "way", F.col("last.id").alias("twin"))
        out = found if out is None else out.unionAll(found)
    return out.groupBy("id").agg(F.min(F.struct("way", "twin")).alias("x")).select("id", "x.twin", "x.way")


def folded(rows: DataFrame) -> DataFrame:
    """One row a normalised link (whole): see the columns; sums are partial before the shuffle, so a hot link is one row a task."""
    own = rows.select("id", "title", "fetched_at", "published_at", "is_live", normalised(F.col("url")).alias("whole"), title_key(F.col("title")).alias("by_title"))
    first = F.min(F.struct("fetched_at", "id", "published_at"))
    out = own.groupBy("whole").agg(
        F.count("*").alias("readings"), F.count_distinct("by_title").alias("titles"), first.alias("f"), F.min("published_at").alias("p"), F.bool_or("is_live").alias("is_live"), F.max_by("title", F.struct("fetched_at", "id")).alias("title"),
    )
    return out.select("whole", "readings", "titles", F.col("f.id").alias("keeper"), F.col("f.fetched_at").alias("first_fetched"), "is_live", F.coalesce("f.published_at", "p").alias("published_at"), "title")
