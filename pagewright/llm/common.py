"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: a few MB of ordinary documents.
BATCH_ROWS = 512
#: Rows that Spark's Parquet reader decodes at a time: its buffers hold the texts of all of them.
READER_ROWS = 64
#: Bytes of text that a kernel looks at in one go; a longer text is a chunk of its own.
CHUNK_BYTES = 500_000
#: So many ids at most are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Where checkpoints go if the session names no folder (local mode and tests only).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def prepare(spark: SparkSession) -> None:
    """Reader and Arrow batches of bounded size, and a checkpoint folder: the one the cluster names, else a local one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or LOCAL_CHECKPOINTS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether Spark deletes the shuffle files of a query that has run; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder among the checkpoints."""
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows, written as Parquet in the checkpoint folder, or one in it, and read again: smaller than a checkpoint, and as durable.

    What was shuffled for them is deleted at once: a step of many small queries would fill the disks with it.
    """
    spark = df.sparkSession
    path = f"{folder or spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until no column has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def some_of(rows: DataFrame, wanted: DataFrame, condition: Column, how: str) -> DataFrame:
    """Semi or anti join with a written table: broadcast if it is short, else by a hash join."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted.hint("shuffle_hash"), condition, how)


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and each row's offsets in them (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes within rows, and the number of them before each row."""
    inside = kinds[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (fresh[:-1] | ~before))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (fresh[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with ASCII letters in lower case."""
    change = np.arange(256, dtype=np.uint8)
    change[0x41:0x5B] += 32
    return change[data]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``limit`` bytes together; a longer text stands alone."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        stop = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        stop = min(rows, max(stop, at + 1))
        yield at, stop
        at = stop


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling; the result is shorter by ``width - 1``."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Marks each hash that is the minimum of some run of ``width`` consecutive ones (all of equal ones)."""
    if len(hashes) < width:
        return np.zeros(len(hashes), bool)
    least = sliding_min(hashes, width)
    padded = np.concatenate([np.zeros(width - 1, hashes.dtype), least, np.zeros(width - 1, hashes.dtype)])
    most = ~sliding_min(~padded, width)
    return most == hashes


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_POWERS: dict[str, np.ndarray] = {}
BASE = 0x5851F42D4C957F2D


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, by prefix sums of a polynomial."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * up[: len(data)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))
