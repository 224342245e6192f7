"""Operators over a log of fetch attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a failure of the network looks like in a stored error.
NETWORK = r"(?i)name or service not known|temporary failure in name resolution|nodename nor servname|errno -[235]\b|network is unreachable|no route to host|network down:"
GAP = "10 minutes"


def is_network_error(error: Column) -> Column:
    return F.coalesce(error, F.lit("")).rlike(NETWORK)


def runs(log: DataFrame, gap: str = GAP) -> DataFrame:
    """(started, finished, ok, skipped, failed, found, new, failed_sources): attempts no more than a gap apart, whatever their sources.

    Attempts are first summed up by second of their start, so the order that finds
    the gaps is over as many rows as there are seconds with an attempt.
    """
    status = F.col("status")
    # A session ends strictly later than its last start plus the gap; the reference of time is a second.
    each = log.groupBy("started_at").agg(
        F.max("finished_at").alias("finished"), F.count_if(status == "ok").alias("ok"), F.count_if(status == "skipped").alias("skipped"), F.count_if(status == "error").alias("failed"),
        F.sum("items_found").alias("found"), F.sum("items_new").alias("new"), F.collect_set(F.when(status == "error", F.col("source"))).alias("bad"),
    )
    whole = each.groupBy(F.session_window("started_at", f"{gap} 1 microsecond").alias("w"))
    sums = [F.sum(c).alias(c) for c in ("ok", "skipped", "failed", "found", "new")]
    out = whole.agg(F.min("started_at").alias("started"), F.max("finished").alias("finished"), *sums, F.array_distinct(F.flatten(F.collect_list("bad"))).alias("bad"))
    return out.select("started", "finished", "ok", "skipped", "failed", "found", "new", F.array_join(F.array_sort("bad"), ",").alias("failed_sources"))


def failing(log: DataFrame, n: int) -> DataFrame:
    """(source, n): sources, in any case of letters, whose last n attempts all failed."""
    rows = log.withColumn("source", F.lower("source"))
    newest = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("id"))
    last = rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n).groupBy("source")
    return last.agg(F.count("*").alias("n"), F.every(F.col("status") == "error").alias("bad")).where((F.col("n") == n) & F.col("bad")).drop("bad")


def turnover(log: DataFrame) -> DataFrame:
    rows = log.withColumn("source", F.lower("source"))
    first = rows.groupBy("source").agg(F.min("id").alias("_first"))
    status, ok = F.col("status"), F.col("status") == "ok"
    kept = rows.join(first, "source").where("id <> _first").groupBy("source")
    return kept.agg(
        F.count_if(ok).alias("ok"), F.count_if(status == "error").alias("failed"), F.count_if(~status.isin("ok", "error")).alias("skipped"),
        F.coalesce(F.sum(F.when(ok, F.col("items_found"))), F.lit(0)).alias("found"), F.coalesce(F.sum(F.when(ok, F.col("items_new"))), F.lit(0)).alias("new"),
        F.count_if(ok & (F.col("items_found") > 0) & (F.col("items_new") >= F.col("items_found"))).alias("all_new"),
    )


def network_down(log: DataFrame, by: str) -> DataFrame:
    failed = F.col("status") == "error"
    rows = log.groupBy(by).agg(F.count("*").alias("attempts"), F.count_if(failed).alias("failed"), F.count_if(failed & is_network_error(F.col("error"))).alias("network"))
    return rows.withColumn("down", (F.col("failed") >= F.greatest(F.lit(3.0), 0.8 * F.col("attempts"))) & (F.col("failed") == F.col("network")))
