"""The algebraic part of the profile over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaspan.functions import patterns


def windowed_profile(events: DataFrame, time: str, columns: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and column: rows, values, nulls, lengths and composition flags. Works on batches and streams alike."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    long = events.withWatermark(time, late).select(F.col(time).alias("at"), F.inline(cells))
    how = {"any": F.max, "all": F.min}
    return long.groupBy(F.window("at", width), "column_name").agg(
        F.count("*").alias("record_cnt"), F.count("value").alias("value_cnt"), F.count_if(F.col("value").isNull()).alias("null_cnt"),
        F.min(F.length("value")).alias("len_min"), F.max(F.length("value")).alias("len_max"), F.approx_count_distinct("value").alias("unique_approx"),
        *[how[q](F.col("value").rlike(p).cast("int")).alias(n) for n, p, q in patterns.FLAGS],
    )


#: Hash parts in which a window's values are ranked before they are ranked together.
PARTS = 64


def windowed_values(events: DataFrame, time: str, columns: list[str], width: str = "1 hour", late: str = "10 minutes", k: int = 10, parts: int = PARTS) -> DataFrame:
    """Per window and column: values, exactly how many are different, and the k most frequent ones (ties by value) with their counts. Works on batches and streams (append mode) alike.

    Three aggregations follow each other, each with its state in the state store and closed by the watermark: counts of each value, then for each hash part of
    a window and column its number of values and its k best, then those of the parts together. So no state row holds more than a part's values, and what a task
    ranks at the end is k values for each part.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    long = events.withWatermark(time, late).select(F.col(time).alias("at"), F.inline(cells)).where("value IS NOT NULL")
    again = F.window(F.window_time("window"), width).alias("window")  # the same window, as a later aggregation may group by it
    best = lambda ranked: F.slice(F.array_sort(ranked), 1, k)
    counted = long.groupBy(F.window("at", width).alias("window"), "column_name", "value").agg(F.count("*").alias("cnt"))
    part = F.pmod(F.xxhash64("value"), F.lit(parts)).alias("part")
    ranked = counted.groupBy(again, "column_name", part).agg(F.sum("cnt").alias("cnt"), F.count("*").alias("different"), best(F.collect_list(F.struct(F.negative("cnt").alias("less"), "value"))).alias("top"))
    out = ranked.groupBy(again, "column_name").agg(F.sum("cnt").alias("value_cnt"), F.sum("different").alias("unique_cnt"), best(F.flatten(F.collect_list("top"))).alias("top"))
    return out.select("window", "column_name", "value_cnt", "unique_cnt", F.transform("top", lambda r: F.struct(r["value"].alias("value"), F.negative(r["less"]).alias("cnt"))).alias("top_values"))
