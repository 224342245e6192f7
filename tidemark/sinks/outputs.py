"""Rows as JSON, CSV or fixed-width text, and snapshots that are read again before they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def machine(rows: DataFrame) -> DataFrame:
    """Times as ISO text in UTC (the session's zone), marks as 0 or 1: what CSV has."""
    form = {"timestamp": lambda c: F.date_format(c, UTC), "boolean": lambda c: c.cast("int")}
    return rows.select(*(form.get(kind, lambda c: c)(F.col(name)).alias(name) for name, kind in rows.dtypes))


def as_json(rows: DataFrame) -> Column:
    """One JSON object a row, nulls kept, times in ISO."""
    return F.to_json(F.struct(*(F.col(c) for c in rows.columns)), {"ignoreNullFields": "false", "timestampFormat": UTC})


def write_csv(rows: DataFrame, folder: str) -> None:
    machine(rows).write.mode("overwrite").csv(folder, header=True, quote='"', escape='"')


def write_json(rows: DataFrame, folder: str) -> None:
    rows.select(as_json(rows).alias("value")).write.mode("overwrite").text(folder)


def fixed_width(rows: DataFrame, widths: dict[str, int], keep: tuple[str, ...] = ()) -> DataFrame:
    """One line a row: each column cut to its width with a mark, padded, two spaces between."""
    cell = lambda c, n: F.rpad(F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c), n, " ")
    texts = [cell(F.coalesce(F.col(c).cast("string"), F.lit("")), n) for c, n in widths.items()]
    return rows.select(*keep, F.rtrim(F.concat_ws("  ", *texts)).alias("line"))


def fingerprint(rows: DataFrame) -> tuple:
    """Rows and an order-free sum of their hashes."""
    got = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
    return got["n"], got["h"]


def snapshot(rows: DataFrame, folder: str) -> tuple:
    """A Parquet copy at `folder`: written beside it, read again and compared, then renamed; a copy that differs is removed and raises."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    partial = folder.rstrip("/") + ".partial"
    files = path(partial).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path(folder)):
        raise FileExistsError(folder)
    rows.write.mode("overwrite").parquet(partial)
    want, got = fingerprint(rows), fingerprint(spark.read.parquet(partial))
    if want != got:
        files.delete(path(partial), True)
        raise ValueError(f"the copy differs: {got} for {want}")
    if not files.rename(path(partial), path(folder)):
        raise OSError(f"{partial} can't be renamed")
    return got
