"""Small projections that prepare tables for people: order, fill, select, summarise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaspan.operators.stats import to_number
from metaspan.sources.shared import stored


def ordered(df: DataFrame, first: list[str]) -> DataFrame:
    """The columns in ``first`` that exist, then the rest; level_N columns among the rest in order of N."""
    head = [c for c in first if c in df.columns]
    rest = [c for c in df.columns if c not in head]
    level = {c: int(m[1]) for c in rest if (m := re.match(r"(?i)level_?(\d+)", c))}
    numbered = iter(sorted(level, key=level.__getitem__))
    return df.select(*[f"`{c}`" for c in head], *[f"`{next(numbered) if c in level else c}`" for c in rest])


def for_display(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Numeric columns as numbers with 0 for what is none, other texts with '' for null."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        if c in numeric:
            return F.coalesce(to_number(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c)
        return F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if kinds[c] == "string" else F.col(f"`{c}`")

    return df.select(*[cell(c) for c in df.columns])


def without_hangul(text: Column) -> Column:
    """Whether a name has no Hangul; null has none."""
    return F.coalesce(~text.rlike("[가-힣]"), F.lit(True))


def is_key(flag: Column) -> Column:
    """Whether a key flag is set, however it is spelt."""
    return F.coalesce(F.upper(F.trim(flag.cast("string"))).isin("1", "1.0", "Y", "TRUE"), F.lit(False))


def table_stats(columns: DataFrame, levels: DataFrame) -> DataFrame:
    """Per table: distinct columns, path (the least), greatest level of its chains. columns: file_name, column_name, file_path; levels: file_name, depth."""
    own = columns.groupBy("file_name").agg(F.countDistinct("column_name").alias("column_cnt"), F.min("file_path").alias("file_path"))
    deepest = levels.groupBy("file_name").agg(F.max("depth").alias("max_level"))
    return own.join(deepest, "file_name", "left").withColumn("max_level", F.coalesce("max_level", F.lit(0)))


def selection(columns: DataFrame, summary: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Files for choosing among them: number of columns, names of keys, relation summary and physical hierarchy; files of one column are left out.

    ``columns`` has file, column and pk; the others a row for each file.
    """
    files = columns.groupBy("file").agg(F.countDistinct("column").alias("column_cnt"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("pk") == 1, F.col("column")))), ", ").alias("pk_columns"))
    return files.join(summary, "file", "left").join(hierarchy, "file", "left").where("column_cnt > 1").orderBy("file")


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in the order of all of them; equal rows are told apart by where they stand.

    Rows are dealt to ranges of the order; a row's place is that in its range plus the rows of the ranges before, so no task holds all rows and the only
    running sum is over a count for each range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, F.asc("_row")]
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows-to-place")
    dealt = stored(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "dealt-to-place")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    # a row for each shuffle partition
    return dealt.withColumn(name, inner).join(F.broadcast(starts), "_range").select(*df.columns, (F.col(name) + F.col("_before")).alias(name))


def reference_set(df: DataFrame, column: str, upper: bool = False) -> DataFrame:
    """The distinct normalised values of a reference column: what validators take as their sets."""
    value = F.trim(F.regexp_replace(F.col(f"`{column}`").cast("string"), r"\s+", " "))
    return df.select((F.upper(value) if upper else value).alias("value")).where("value IS NOT NULL AND value <> ''").distinct()


def calendar_sets(df: DataFrame, column: str) -> DataFrame:
    """value, kind (DATECHAR, YYMMDD, YEARMONTH, YEAR) of every form of a calendar's days."""
    d = F.regexp_replace(F.col(f"`{column}`").cast("string"), "[^0-9]", "")
    forms = F.array(
        F.struct(d.alias("value"), F.lit("DATECHAR").alias("kind")), F.struct(F.substring(d, 3, 6).alias("value"), F.lit("YYMMDD").alias("kind")),
        F.struct(F.substring(d, 1, 6).alias("value"), F.lit("YEARMONTH").alias("kind")), F.struct(F.substring(d, 1, 4).alias("value"), F.lit("YEAR").alias("kind")),
    )
    return df.where(F.length(d) == 8).select(F.inline(forms)).distinct()
