"""Tables in the folder that all executors share, which cut long plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Only a session of one machine that names none gets a temporary folder."""
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


#: Cells that a task counts, of its share of a shuffle. Bytes of a shuffle and of files that a task reads.
CELLS, SHUFFLED, SPLIT = 1 << 21, "16m", "32m"


def tasks_for(spark: SparkSession, rows: int, each: int = CELLS) -> int:
    """Tasks that so many rows are dealt to: as the session says, more if a task had over ``each`` of them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


@contextmanager
def sized(spark: SparkSession, cells: int) -> Iterator[None]:
    """Tables written within are made by more tasks the more cells they are made of, so that no task grows with them. The session's settings are put back."""
    wanted = {"spark.sql.shuffle.partitions": str(tasks_for(spark, cells)), "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHUFFLED, "spark.sql.files.maxPartitionBytes": SPLIT}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in as many files as it has partitions: computed once, safe against lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table: computed once, a leaf for every plan built on it, safe against lost executors. For metadata, not for data."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.repartition(1).write.parquet(path)  # not coalesce: what is before keeps its tasks
    return df.sparkSession.read.schema(df.schema).parquet(path)
