"""Numeric description and control limits of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaspan.operators.profile import COLUMN
from metaspan.sources.shared import materialised, stored

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def to_number(c: Column) -> Column:
    """The number that a text is, or null."""
    return F.when(F.trim(c).rlike(NUMBER), F.trim(c).try_cast("double"))


def numeric_form(df: DataFrame, columns: list[str]) -> DataFrame:
    types = dict(df.dtypes)
    cell = lambda c: F.col(f"`{c}`").cast("double") if types[c] != "string" else to_number(F.col(f"`{c}`"))
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias(COLUMN), cell(c).alias("value")) for c in columns]))).where("value IS NOT NULL AND NOT isnan(value)")


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, value, n as a table."""
    return stored(numeric_form(df, columns).groupBy(COLUMN, "value").agg(F.count("*").alias("n")), "numbers")


def quantiles(counted: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Linear quantiles of counted values (column_name, value, n), one row per column.

    Values are dealt to ranges of their order. A place in the order of a column is found by the sums of its ranges, of which there are a few, and only the ranges that
    hold a wanted place are ordered, each by itself; so no task holds a column.
    """
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(counted.repartitionByRange(parts, COLUMN, "value").withColumn("range", F.spark_partition_id()), "numbers-dealt")
    w = Window.partitionBy(COLUMN).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(COLUMN, "range").agg(F.sum("n").alias("held")).withColumns({"before": F.coalesce(F.sum("held").over(w), F.lit(0)), "total": F.sum("held").over(Window.partitionBy(COLUMN))})
    place = lambda q: F.lit(q) * (F.col("total") - 1)
    ends = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), end(place(q)).cast("long").alias("place")) for name, q in shares.items() for side, end in (("low", F.floor), ("high", F.ceil))]
    wanted = materialised(ranges.select("*", F.inline(F.array(*ends))).where("place >= before AND place < before + held"), "places")
    some = dealt.join(F.broadcast(wanted.select(COLUMN, "range", "before").distinct()), [COLUMN, "range"])
    some = some.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(COLUMN, "range").orderBy("value"))).drop("before")
    found = some.join(F.broadcast(wanted.drop("before", "held")), [COLUMN, "range"]).where("place < upto AND place >= upto - n")
    at = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("value")))
    out = found.groupBy(COLUMN).agg(F.max("total").alias("total"), *[at(name, side).alias(f"{name}_{side}") for name in shares for side in ("low", "high")])

    def between(name: str, q: float) -> Column:
        low, high, over = F.col(f"{name}_low"), F.col(f"{name}_high"), place(q) - F.floor(place(q))
        return F.when(low == high, low).otherwise((1 - over) * low + over * high).alias(name)

    return out.select(COLUMN, *[between(name, q) for name, q in shares.items()])


def _described(df: DataFrame, columns: list[str], counted: DataFrame) -> DataFrame:
    out = numeric_form(df, columns).groupBy(COLUMN).agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.join(quantiles(counted, QUARTILES), COLUMN).select(COLUMN, "count", "mean", "std", "min", *QUARTILES, "max")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample standard deviation, least, linear quartiles, greatest of each column."""
    return _described(df, columns, _counted(df, columns))


def control_limits(df: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """describe() with limits k sample standard deviations from the mean and the counts strictly outside.

    The counted values join a row per column, which is as small as the column list.
    """
    counted = _counted(df, columns)
    return _limits(counted, _described(df, columns, counted), k)


def numbers_counted(vc: DataFrame, types: dict[str, str]) -> DataFrame:
    """column_name, value, n as a table, of columns whose values are counted: ``vc`` as of profile.value_counts(), and the data type of each column that is wanted."""
    number = lambda t: to_number(F.col("value")) if t == "string" else F.col("value").try_cast(t).cast("double")
    value = F.coalesce(*[F.when(F.col(COLUMN) == c, number(t)) for c, t in types.items()])
    found = vc.where(F.col(COLUMN).isin(list(types))).select(COLUMN, value.alias("value"), "cnt").where("value IS NOT NULL AND NOT isnan(value)")
    return stored(found.groupBy(COLUMN, "value").agg(F.sum("cnt").alias("n")), "numbers")  # some texts are the same number


def control_limits_counted(vc: DataFrame, types: dict[str, str], k: float = 3.0) -> DataFrame:
    """control_limits() of columns whose values are counted, of one table or several at once; see numbers_counted()."""
    counted = numbers_counted(vc, types)
    ends = counted.groupBy(COLUMN).agg(F.sum("n").alias("count"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    ends = materialised(ends, "ends")
    squares = counted.join(F.broadcast(ends.select(COLUMN, "mean")), COLUMN).groupBy(COLUMN).agg(F.sum(F.col("n") * (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))).alias("squares"))
    out = ends.join(squares, COLUMN).withColumn("std", F.when(F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1))))
    return _limits(counted, out.join(quantiles(counted, QUARTILES), COLUMN).select(COLUMN, "count", "mean", "std", "min", *QUARTILES, "max"), k)


def _limits(counted: DataFrame, described: DataFrame, k: float) -> DataFrame:
    stats = materialised(described.withColumns({"lcl": F.col("mean") - k * F.col("std"), "ucl": F.col("mean") + k * F.col("std")}), "limits")
    outside = counted.join(F.broadcast(stats.select(COLUMN, "lcl", "ucl")), COLUMN).groupBy(COLUMN).agg(
        F.coalesce(F.sum(F.when(F.col("value") < F.col("lcl"), F.col("n"))), F.lit(0)).alias("below_lcl"), F.coalesce(F.sum(F.when(F.col("value") > F.col("ucl"), F.col("n"))), F.lit(0)).alias("above_ucl")
    )
    return stats.join(outside, COLUMN)


def numeric_candidates(profile: DataFrame) -> DataFrame:
    """Columns of a profile worth describing: over two values, no dominant format, no semantic type."""
    return profile.where((F.col("len_cnt") > 2) & (F.col("format_pct") < 90) & (F.coalesce(F.col("detail_type"), F.lit("")) == ""))
