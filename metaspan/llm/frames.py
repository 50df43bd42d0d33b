"""Small helpers that the operators share: Arrow columns, checkpoints, table reads."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one vectorised step takes at most, unless a single document is longer.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, which gives free memory back to the system when a task ends: workers outlive tasks and stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def pieces(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def long_id(df: DataFrame, name: str) -> Column:
    return df[name].cast("long")


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array in which null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls, and where each row begins and the last ends."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body, at


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one row."""
    begin, rows = 0, len(at) - 1
    while begin < rows:
        end = int(np.searchsorted(at, at[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), rows)
        yield begin, end
        begin = end


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session of one machine that names none gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            folder = found.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="shared")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows that go to Python at once while a table is written: documents may be long.
BATCH_ROWS = 512


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in parts by a column if one is given: computed once, read by column, safe against lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key, None)
    conf.set(key, str(BATCH_ROWS))
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``left``, a table that is cheap to read twice, joined to ``right``, which has one row for a key, without hot tasks.

    A key (null is one) with more than a fair share of the rows of ``left`` is dealt over several tasks, and its row of ``right``
    copied to each. Under 4 * pieces keys can be that frequent, so the list of them may be broadcast.
    """
    spark = left.sparkSession
    fair = max(1, left.count() // (4 * pieces(spark)))
    hot = F.broadcast(left.groupBy(F.col(on).alias("_hot")).count().where(F.col("count") > fair).select("_hot", F.ceil(F.col("count") / fair).cast("int").alias("_parts")))
    dealt = left.join(hot, left[on].eqNullSafe(hot["_hot"]), "left").drop("_hot")
    dealt = dealt.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = right.join(hot, right[on].eqNullSafe(hot["_hot"]), "left").drop("_hot")
    copies = copies.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [on, "_part"], how).drop("_part")


#: Bytes, as JSON, up to which a table is broadcast to rows that are costly to shuffle.
SMALL = 32 << 20


def join_by_size(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """As split_join(), but a ``right`` whose measured size is small is broadcast, so that ``left``, with its texts, stays where it is."""
    size = right.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return left.join(F.broadcast(right), on, how) if size <= SMALL else split_join(left, right, on, how)


_FORM = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or 97 <= _b <= 122:
        _FORM[_b] = _b
    elif 65 <= _b <= 90:
        _FORM[_b] = _b + 32


def formed(body: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters lower-cased and other ASCII made spaces."""
    out = _FORM[body]
    if len(body) > 1:
        upper = np.flatnonzero((body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)) + 1
        out[upper] += 32
    return out
