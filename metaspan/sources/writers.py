"""Tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaspan.sources import files


def flat(df: DataFrame) -> DataFrame:
    """Columns that flat files can hold: arrays, maps and structs as JSON."""
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes])


BYTE_ORDER_MARK = "\ufeff"


def write_csv(df: DataFrame, path: str, mark: bool = False, encoding: str | None = None, append: bool = False) -> None:
    """Flat files with a header; with ``mark`` each begins with a byte-order mark, by which spreadsheet programs tell UTF-8; ``encoding`` (as Java names it) is for programs that cannot read it.

    ``append`` adds files to the folder, which may hold some in other encodings. A task that finds a character outside the encoding fails, it never writes a replacement.
    """
    if mark and encoding:
        raise ValueError("a byte-order mark is for UTF-8")
    out = flat(df)
    if mark and out.columns:
        out = out.withColumnRenamed(out.columns[0], BYTE_ORDER_MARK + out.columns[0])
    if encoding:
        # without it only UTF and Latin-1 names are allowed
        out.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
        # the writer alone would put question marks; encode() refuses
        out = out.select(*[F.decode(F.encode(F.col(f"`{c}`"), encoding), encoding).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in out.dtypes])
    writer = out.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"')
    if encoding:
        writer = writer.option("encoding", encoding)
    writer.csv(path)


def write_excel(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of workbooks, written by the tasks: see sheets.WorkbookWriter."""
    df.sparkSession.dataSource.register(files.Workbook)
    flat(df).write.format("workbook").mode("append" if append else "overwrite").save(path)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def replace_partition(new: DataFrame, path: str, by: str, value) -> None:
    """The rows of one value of the partition column ``by`` in the table at ``path``, replaced by ``new``; files of other partitions are not touched.

    ``new`` holds rows of that value only; an empty one removes the partition. ``new`` may be derived from the table itself: what it reads stays until all of it is written.
    """
    if not new.where(~F.col(by).eqNullSafe(F.lit(value))).isEmpty():
        raise ValueError(f"rows of another {by} than {value!r}")
    if new.isEmpty():
        jvm = new.sparkSession._jvm
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(by, str(value) if value is not None else "__HIVE_DEFAULT_PARTITION__")
        folder = jvm.org.apache.hadoop.fs.Path(path, name)
        folder.getFileSystem(new.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_stages(path: str, **frames: DataFrame) -> None:
    """Named intermediate tables, each under its name."""
    for name, df in frames.items():
        write_table(df, f"{path}/{name}")
