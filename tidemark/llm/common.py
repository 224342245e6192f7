"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SHORT = 0.6  # seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the session has no such setting, a local session (tests, benchmarks) takes
    a temporary folder of this machine; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, a lost executor loses nothing.

    The files of `spent` tables, of which df was the last reader, go, and so do the
    shuffle files of df's own plan, after short writes only with those of a later one.
    """
    spark = df.sparkSession
    path, begun = shared_dir(spark), time.monotonic()
    df.write.parquet(path)
    took = time.monotonic() - begun
    out = spark.read.schema(df.schema).parquet(path)
    del df
    drop_written(*spent)
    if took > SHORT:
        release(spark)
    return out


def drop_written(*tables: DataFrame) -> None:
    """Remove the files behind tables made by `written`; others are left alone."""
    for df in tables:
        context = df.sparkSession.sparkContext
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("tidemark-"):
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and broadcasts whose plans are no longer referenced."""
    for _ in range(2):  # what the first pass frees refers to plans too
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Executors give back what earlier work has left them: heap beyond the live objects, and what Python workers hold free.

    An executor's heap grows with what a stage throws away and stays so large for the next one,
    beside whose Python workers there may be no room for it. One small task a core; all cores should be idle.
    """
    release(spark)
    cores = spark.sparkContext.defaultParallelism
    heap = F.java_method(F.lit("java.lang.System"), F.lit("gc"))  # a full collection shrinks the heap
    spark.range(0, cores, 1, cores).mapInArrow(trimmed, "id long").select(heap.alias("done")).agg(F.max("done")).collect()


def trimmed(batches):
    """The batches; the worker's free memory goes back to the system, where its allocators can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    yield from batches


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case of letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, one partial sum a task."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)


def bucket_count(total: int, each: int, least: int = 1) -> int:
    """Buckets of about `each` units; their number grows with the data, their size doesn't."""
    return max(least, math.ceil(total / each))


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered for the words seen lately (bounded)."""

    LIMIT = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, vectorised."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space."""
    return text.lower().split() if text else []


def hashed_words(texts: list, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, flat, and each text's number of words."""
    flat: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = words_of(text)
        counts[i] = len(own)
        flat += own
    return np.fromiter(map(cache.__getitem__, flat), U, len(flat)), counts


def hashed_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of a column of texts: each distinct word of the column is hashed once."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(column))
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), U, len(distinct))
    code = coded.indices.to_numpy(zero_copy_only=False)
    if b"" in distinct:  # beside white space at a text's ends
        keep = code != distinct.index(b"")
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts)).astype(np.int64)
        code = code[keep]
    return hashes[code] if len(code) else np.zeros(0, U), counts


def slices(texts: list, limit: int = 1 << 22):
    """Index ranges of consecutive texts of about `limit` bytes together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def binaries(column: pa.Array) -> list:
    """Text column of an Arrow batch as Python bytes (None: null)."""
    return column.cast(pa.binary()).to_pylist()


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, as many as the greatest one needs."""
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(planes.T).tobytes()


def unpack(raw: bytes, count: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    if count:
        out[:, : len(raw) // count] = np.frombuffer(raw, np.uint8).reshape(-1, count).T
    return out.view("<u8").ravel()


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of the ranges that divide all 64-bit keys evenly each key lies in."""
    return ((keys >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def by_block(batches, block: int):
    """(block, its rows as one batch) of batches sorted by the block column."""
    held: list = []
    for batch in batches:
        own = batch.column(block).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held[0][0] != own[a]:
                yield held[0][0], [part for _, part in held]
                held = []
            held.append((int(own[a]), batch.slice(a, b - a)))
    if held:
        yield held[0][0], [part for _, part in held]
