"""Batches of readings stored by link: heads (one row an article) and revisions (one row a wording), set-based.

A batch is ordered by `fetched_at`, `id`. Storing it again changes nothing, and storing
two batches in their order equals storing both at once. A link's rows meet in one group of
partial aggregates, so a hot link is one row a task before the shuffle; only the
count of rewrites needs a link's readings in order.

Nulls: a reading without link or title is left out; null dates and summaries are
filled by nothing but the reading that brought the article in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import title_key
from tidemark.functions.urls import normalised

HEAD = "url string, source string, title string, summary string, content_key string, published_at timestamp, fetched_at timestamp, first_id long, is_live boolean, methods array<string>"
REVISION = "url string, title string, seen_at timestamp, first_id long"


def prepared(batch: DataFrame, method: str) -> DataFrame:
    rows = batch.select("id", "source", "title", "summary", normalised(F.col("url")).alias("url"), "published_at", "fetched_at", F.coalesce("is_live", F.lit(False)).alias("is_live"))
    return rows.where("url is not null and title is not null").withColumn("content_key", title_key(F.col("title"))).withColumn("method", F.lit(method))


def feed_heads(heads: DataFrame, batch: DataFrame, method: str = "rss") -> DataFrame:
    """Heads after a batch: the first reading's source, dates and id, the last one's title and summary, live once live, all methods."""
    rows, when = prepared(batch, method), F.struct("fetched_at", "id")
    new = rows.groupBy("url").agg(
        F.min_by(F.struct("source", "published_at", "fetched_at", F.col("id").alias("first_id")), when).alias("first"),
        F.max_by(F.struct("title", "summary", "content_key"), when).alias("last"),
        F.bool_or("is_live").alias("live"),
    )
    old = heads.select("url", F.struct("source", "published_at", "fetched_at", "first_id").alias("was"), F.col("is_live").alias("was_live"), F.struct("title", "summary", "content_key").alias("said"), "methods")
    both = old.join(new, "url", "full")
    first, last = F.coalesce("was", "first"), F.coalesce("last", "said")
    methods = F.when(F.col("last").isNull(), F.col("methods")).otherwise(F.array_sort(F.array_union(F.coalesce("methods", F.array().cast("array<string>")), F.array(F.lit(method)))))
    live = F.coalesce("was_live", F.lit(False)) | F.coalesce("live", F.lit(False))
    return both.select(
        "url", first["source"].alias("source"), last["title"].alias("title"), last["summary"].alias("summary"), last["content_key"].alias("content_key"),
        first["published_at"].alias("published_at"), first["fetched_at"].alias("fetched_at"), first["first_id"].alias("first_id"), live.alias("is_live"), methods.alias("methods"),
    )


def feed_revisions(revisions: DataFrame, batch: DataFrame, method: str = "rss") -> DataFrame:
    """Wordings after a batch: each of a link's titles once, at its first time; one that comes back adds none."""
    rows = prepared(batch, method).select("url", "title", F.col("fetched_at").alias("seen_at"), F.col("id").alias("first_id"))
    first = F.min(F.struct("seen_at", "first_id")).alias("f")
    return revisions.select("url", "title", "seen_at", "first_id").unionByName(rows).groupBy("url", "title").agg(first).select("url", "title", "f.seen_at", "f.first_id")


def outcome(heads: DataFrame, batch: DataFrame, method: str = "rss") -> DataFrame:
    """One row: new articles, rewrites in the batch, minor ones among them, readings stored, articles that a live reading touched."""
    rows = prepared(batch, method).select("url", "title", "content_key", "is_live", F.col("fetched_at").alias("at"), "id", F.lit(True).alias("own"))
    touched = rows.select("url").distinct()
    known = heads.join(touched, "url", "semi").select("url", "title", "content_key", "is_live", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("id"), F.lit(False).alias("own"))
    order = Window.partitionBy("url").orderBy(F.col("own"), "at", "id")
    both = known.unionByName(rows).withColumn("was", F.lag("title").over(order)).withColumn("key", F.lag("content_key").over(order)).where("own")
    changed = F.col("was") != F.col("title")
    return both.agg(
        F.count("*").alias("readings"), F.count_if(F.col("was").isNull()).alias("new"), F.count_if(changed).alias("retitled"),
        F.count_if(changed & (F.col("key") == F.col("content_key"))).alias("minor"), F.count_distinct(F.when(F.col("is_live"), F.col("url"))).alias("live"),
    )


def page_heads(heads: DataFrame, batch: DataFrame) -> DataFrame:
    """Heads after a front page: known links keep their title, dates fill gaps only; unknown ones come in."""
    out = feed_heads(heads, batch, "front_page")
    own = heads.select("url", F.struct("title", "summary", "content_key").alias("_said"), F.col("published_at").alias("_was"))
    fresh = prepared(batch, "front_page").groupBy("url").agg(F.min_by("published_at", F.struct("fetched_at", "id")).alias("_new"))
    kept = out.join(own, "url", "left").join(fresh, "url", "left")
    for name in ("title", "summary", "content_key"):
        kept = kept.withColumn(name, F.when(F.col("_said").isNull(), F.col(name)).otherwise(F.col("_said")[name]))
    return kept.withColumn("published_at", F.coalesce("_was", "published_at", "_new")).drop("_said", "_was", "_new")
