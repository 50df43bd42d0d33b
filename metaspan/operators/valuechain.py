"""Industry, activity and system roll-ups of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaspan.sources.shared import stored


def enrich(mapping: DataFrame, activities: DataFrame, systems: DataFrame) -> DataFrame:
    """File mappings with the sequences of their activity and system; rows without a known activity and system are left out."""
    a = activities.select("industry", "activity", "activity_type", "activity_seq")
    s = systems.select("industry", "system", "system_seq")
    out = mapping.join(a, ["industry", "activity"], "left").join(s, ["industry", "system"], "left").dropna(subset=["activity", "system"])
    return out.where("activity <> 'Unknown' AND system <> 'Unknown'")


def files_per(mapping: DataFrame, by: str) -> DataFrame:
    """Files of each activity or system."""
    return mapping.groupBy(by).agg(F.countDistinct("file_name").alias("file_cnt"))


def industry_kpis(activities: DataFrame, systems: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per industry: distinct activities, systems, files."""
    parts = activities.select("industry", F.lit("activity_cnt").alias("k"), F.col("activity").alias("v")).union(systems.select("industry", F.lit("system_cnt"), F.col("system"))).union(mapping.select("industry", F.lit("file_cnt"), F.col("file_name")))
    return parts.groupBy("industry").agg(*[F.countDistinct(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in ("activity_cnt", "system_cnt", "file_cnt")])


def industries(*tables: DataFrame) -> DataFrame:
    """The industries of several tables, sorted."""
    out = None
    for t in tables:
        out = t.select("industry") if out is None else out.union(t.select("industry"))
    return out.where("industry IS NOT NULL AND trim(industry) <> ''").distinct().orderBy("industry")


def consecutive(activities: DataFrame) -> DataFrame:
    """industry, src, dst: edges of each industry's activities in order of their sequence."""
    w = Window.partitionBy("industry").orderBy("activity_seq", "activity")
    return activities.select("industry", F.col("activity").alias("src"), F.lead("activity").over(w).alias("dst")).where("dst IS NOT NULL")


def links(mapping: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges between two columns of a mapping, such as system and activity or activity and file."""
    return mapping.select("industry", F.col(a).alias("src"), F.col(b).alias("dst")).dropna().distinct()


def replace_slice(df: DataFrame, key: str, value, new: DataFrame) -> DataFrame:
    """The table with one key's rows replaced."""
    return df.where(~F.col(key).eqNullSafe(F.lit(value))).unionByName(new)


def append_numbered(df: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """The table with new rows numbered on from the greatest sequence of their key, in their order by all columns.

    The new rows are dealt to ranges of that order, so one key may be many tasks. A row's number is its place among the rows of its key and range, plus the rows of the
    key in the ranges before: a prefix sum of counts, of which a key has one for each range that it spans. Equal rows are told apart by where they stand.
    """
    order = [c for c in new.columns if c not in (key, seq)]
    rows = stored(new.drop(seq).withColumn("_row", F.monotonically_increasing_id()), "new-rows")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, key, *order, "_row").withColumn("_range", F.spark_partition_id()), "dealt-rows")
    before = F.sum("n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy(key, "_range").agg(F.count("*").alias("n")).select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    top = df.groupBy(F.col(key).alias("_key")).agg(F.max(seq).alias("_top"))
    starts = starts.join(top, starts["_key"].eqNullSafe(top["_key"]), "left").select(starts["_key"], "_at", (F.col("_before") + F.coalesce("_top", F.lit(0))).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range", key).orderBy(*order, "_row"))
    numbered = dealt.withColumn("_place", place).join(starts, dealt[key].eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    numbered = numbered.withColumn(seq, (F.col("_start") + F.col("_place")).cast(dict(df.dtypes)[seq]))
    return df.unionByName(numbered.select(*df.columns))


def file_overview(stats: DataFrame, profile: DataFrame, mapping: DataFrame | None = None, industry: str | None = None) -> DataFrame:
    """File statistics with key columns and, if given, activity and system of the file, in one industry if it is named; '' where there are none."""
    keys = profile.where("pk = 1").groupBy("file_path", "file_name").agg(F.array_join(F.array_sort(F.collect_set("column_name")), ", ").alias("pk_columns"))
    out = stats.join(keys, ["file_path", "file_name"], "left")
    if mapping is None:
        return out
    own = mapping if industry is None else mapping.where(F.col("industry") == industry)
    out = out.join(own.select("file_name", "activity", "system"), "file_name", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("activity", "system")})
