"""Uniform sharding with exact shard sizes (operator 5), in DataFrame functions only.

Rows first fall into source blocks by a hash. A communication matrix, drawn from
the multivariate hypergeometric law with the blocks' counts as row sums and the
shards' sizes as column sums, says how many rows each block sends to each shard:
exactly the law of a uniform shuffle. Each block permutes its rows and cuts them
by its row of the matrix; after the exchange each shard permutes again. Only the
matrix (blocks x shards numbers) reaches the driver.

Blocks and the ranges of a shard's second permutation hold a bounded number of
rows each, whatever the input, because they follow a hash of the whole row: equal
texts, a hot source or a repeated id spread over all of them.

Defined results: law ``rows``, so shard sizes differ by at most one; a null text
has no bytes and the checksum 0; repeated rows are rows of their own; an empty
table gives no rows; further columns are kept, those named as an output column
are replaced. A task that runs again draws the same numbers, since the seed, the
hash and a total order fix every choice.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

BLOCK_ROWS = 20_000
EXTRA = 16  # bytes that a row costs besides its text


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw; numpy's sampler where it is defined, inversion from the mode beyond."""
    if draws == 0 or good == 0:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = right = mode
    p_left = p_right = p
    u = rng.random() - p
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) / (right + 1) * (draws - right) / (bad - draws + right + 1)
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left / (good - left + 1) * (bad - draws + left) / (draws - left + 1)
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard; row sums are counts, column sums differ by at most one."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = []
    for count in counts:
        sent, left, open_ = [], count, sum(room)
        for s in range(n_shards):
            open_ -= room[s]
            k = hypergeometric(rng, room[s], open_, left)
            sent.append(k)
            left -= k
        room = [r - k for r, k in zip(room, sent, strict=True)]
        matrix.append(sent)
    return matrix


def shuffle_shards(rows: DataFrame, n_shards: int, order: list[Column], seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 within each shard).

    order: columns that tell rows apart; rows equal in all of them are alike, so
    it doesn't matter which of them goes where.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    rows = rows.select(*kept, *[c.alias(f"_order{i}") for i, c in enumerate(order)])
    keys = [F.col(f"_order{i}") for i in range(len(order))]
    total = rows.count()
    n_blocks = max(1, math.ceil(total / block_rows))
    placed = rows.withColumn("_first", F.xxhash64(F.lit(seed), *keys)).withColumn("_second", F.xxhash64(F.lit(seed + 1), *keys))
    placed = placed.withColumn("_block", F.pmod(F.col("_first"), F.lit(n_blocks)).cast("int"))
    found = dict(placed.groupBy("_block").count().collect())  # one number a block
    counts = [found.get(b, 0) for b in range(n_blocks)]
    cuts = []
    for b, sent in enumerate(communication_matrix(counts, n_shards, seed)):
        upto = 0
        for s, k in enumerate(sent):
            if k:
                upto += k
                cuts.append((b, s, upto))
    schema = "_block int, shard int, _to long"
    matrix = spark.createDataFrame(cuts, schema) if cuts else spark.createDataFrame([], schema)
    starts = matrix.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_to", "shard"))).alias("_cuts"))  # at most n_shards a block
    local = Window.partitionBy("_block").orderBy("_first", *keys)
    sent = placed.withColumn("_rank", F.row_number().over(local)).join(F.broadcast(starts) if n_blocks * n_shards <= 1 << 18 else starts, "_block")
    shard = F.filter("_cuts", lambda c: c["_to"] >= F.col("_rank"))[0]["shard"]
    sent = sent.withColumn("shard", shard).drop("_cuts", "_rank", "_block", "_first")
    # The second permutation: ranges of the second hash, in order, each sorted on its own.
    n_ranges = max(1, math.ceil(total / n_shards / block_rows))
    sent = sent.withColumn("_range", F.floor((F.shiftrightunsigned("_second", 33) * n_ranges) / F.lit(1 << 31)).cast("int"))
    within = Window.partitionBy("shard", "_range").orderBy("_second", *keys)
    slotted = sent.withColumn("_place", F.row_number().over(within) - 1)
    if n_ranges > 1:
        sizes = sent.groupBy("shard", "_range").count()
        offsets = sizes.select("shard", "_range", (F.sum("count").over(Window.partitionBy("shard").orderBy("_range")) - F.col("count")).alias("_offset"))
        slotted = slotted.join(offsets, ["shard", "_range"])
    else:
        slotted = slotted.withColumn("_offset", F.lit(0))
    return slotted.select(*kept, F.col("shard"), (F.col("_place") + F.col("_offset")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of all documents; texts are read, not moved."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + EXTRA).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = written(rows)  # one pass over the texts; what follows moves a few numbers a row
    out = shuffle_shards(rows, n_shards, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
