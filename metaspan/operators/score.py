"""Data-quality score, issue tags, views and key figures over profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaspan.operators.profile import rounded

#: Weights of the score's penalties, and below them limits and texts of its tags.
WEIGHTS = {"null_share": 0.40, "type_mixed": 0.25, "length_vol": 0.15, "duplicate": 0.10, "rule_fail": 0.10}
#: Measure, limit, tag of values above it
TAGS = (("null_share", 20, "High NULLs"), ("type_mixed", 30, "Mixed formats"), ("length_vol", 30, "Length volatility"), ("duplicate", 90, "Very low uniqueness"), ("rule_fail", 0, "Rule failures"))


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def with_scores(profile: DataFrame, weights: dict[str, float] = WEIGHTS, tags=TAGS) -> DataFrame:
    """dq_score, dq_issues, issue_count and their measures; a column without values has all measures but rule_fail at 100."""
    empty = F.col("value_cnt") == 0
    top = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ("format_pct", "format_pct_2", "format_pct_3")])
    volatile = F.when(F.col("len_max") > 0, (F.col("len_max") - F.col("len_min")) / F.col("len_max") * 100).otherwise(0.0)
    out = profile.withColumns(
        {
            "null_share": F.coalesce(F.col("null_pct"), F.lit(0.0)),
            "type_mixed": F.lit(100.0) - _clip(top),
            "length_vol": F.when(empty, 100.0).otherwise(_clip(volatile)),
            "duplicate": F.lit(100.0) - _clip(F.coalesce(F.col("unique_pct"), F.lit(0.0))),
            "rule_fail": _clip(F.col("rule_fail_pct")) if "rule_fail_pct" in profile.columns else F.lit(0.0),
        }
    )
    penalty = sum(F.lit(w) * F.col(c) for c, w in weights.items())
    issues = F.array_compact(F.array(*[F.when(F.col(c) > limit, tag) for c, limit, tag in tags]))
    return out.withColumns({"dq_score": rounded(_clip(100.0 - penalty)), "dq_issues": F.array_join(issues, ", "), "issue_count": F.size(issues)})


#: Views of a profile; a column that a profile lacks is left out.
VIEWS = {
    "value": ["file_name", "column_name", "record_cnt", "value_cnt", "null_cnt", "null_pct", "unique_cnt", "unique_pct", "min_string", "max_string", "mode_string", "median_string"],
    "value_type": ["file_name", "column_name", "oracle_type", "detail_type", "pk", "format", "format_pct", "format_2", "format_pct_2", "format_3", "format_pct_3"],
    "top10": ["file_name", "column_name", "top_values", "top_pct", "mode_cnt"],
    "length": ["file_name", "column_name", "len_cnt", "len_distinct", "len_min", "len_max", "len_avg", "len_mode", "len_median"],
    "character": ["file_name", "column_name", "has_blank", "has_alpha", "has_num", "has_kor", "has_special", "has_unicode", "first_kor", "first_num", "first_alpha", "first_special"],
    "dq_score": ["file_name", "column_name", "dq_score", "issue_count", "dq_issues", "null_share", "type_mixed", "length_vol", "duplicate", "rule_fail"],
}


def view(profile: DataFrame, name: str) -> DataFrame:
    return profile.select(*[c for c in VIEWS[name] if c in profile.columns])


#: Issue -> predicate over a profile (the relation and control-limit counters join in where they exist).
def issues(profile: DataFrame) -> dict[str, Column]:
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0 if c in profile.columns else F.lit(False)
    return {
        "unicode": has("has_unicode2"), "broken_kor": has("has_broken_kor"), "chinese": has("has_chinese"), "special": has("has_special"), "below_lcl": has("below_lcl"), "above_ucl": has("above_ucl"),
        "fk_mismatch": has("fk_mismatch"), "date_mismatch": has("date_mismatch"), "length": F.col("len_max") > 2 * F.col("len_mode"),
    }


def alerts(profile: DataFrame) -> DataFrame:
    """The profile with a flag per issue and one for any."""
    found = issues(profile)
    out = profile.withColumns({f"issue_{k}": F.coalesce(c, F.lit(False)).cast("int") for k, c in found.items()})
    return out.withColumn("alert", F.greatest(*[F.col(f"issue_{k}") for k in found]))


def issue_columns(profile: DataFrame, issue: str) -> DataFrame:
    return profile.where(issues(profile)[issue])


def quality_kpis(profile: DataFrame) -> DataFrame:
    """Per issue: files and columns with it, and their share of all."""
    flagged = alerts(profile)
    names = list(issues(profile))
    cells = F.array(*[F.struct(F.lit(k).alias("issue"), F.col(f"issue_{k}").alias("hit")) for k in names])
    long = flagged.select("file_name", "column_name", F.inline(cells))
    out = long.groupBy("issue").agg(F.countDistinct(F.when(F.col("hit") == 1, F.col("file_name"))).alias("files"), F.sum("hit").alias("columns"), F.count("*").alias("all_columns"))
    return out.select("issue", "files", "columns", rounded(F.col("columns") / F.col("all_columns") * 100).alias("columns_pct"))


def file_kpis(stats: DataFrame) -> DataFrame:
    """Distinct files, records, columns, megabytes and the last day of work of file statistics."""
    return stats.agg(F.countDistinct("file_name").alias("files"), F.sum("record_cnt").alias("records"), F.sum("column_cnt").alias("columns"), F.sum("file_size").alias("file_size"), F.max("work_date").alias("work_date"))


def files_by_type(stats: DataFrame, expected: list[str]) -> DataFrame:
    """Distinct files of each expected type, zero where there are none."""
    wanted = stats.sparkSession.createDataFrame([(t,) for t in expected], "master_type string")
    found = stats.groupBy("master_type").agg(F.countDistinct("file_name").alias("files"))
    return wanted.join(found, "master_type", "left").select("master_type", F.coalesce("files", F.lit(0)).alias("files"))


def per_file_kpis(profile: DataFrame) -> DataFrame:
    """Per file: columns that are all null, partly null, unique, and the names of its key candidates."""
    return profile.groupBy("file_name").agg(
        F.count("*").alias("column_cnt"),
        F.count_if(F.col("null_pct") == 100).alias("all_null"),
        F.count_if(F.col("null_pct") > 0).alias("some_null"),
        F.count_if(F.col("unique_pct") == 100).alias("all_unique"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("pk") == 1, F.col("column_name")))), ", ").alias("pk_columns"),
    )


def operational(df: DataFrame, excluded=("Common", "Reference", "Validation")) -> DataFrame:
    return df.where(~F.col("master_type").isin(*excluded))


def display_size(count: Column) -> Column:
    """Bytes in the largest unit that keeps them at 1 or more."""
    out = F.concat(count.cast("string"), F.lit(" Bytes"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(count >= 1024**power, F.concat(F.format_number(count / 1024**power, 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def scaled_count(count: Column) -> tuple[Column, Column]:
    """A number of records and its unit: as it is under a thousand, else in ten thousands. The units' names."""
    return F.when(count < 1000, count.cast("double")).otherwise(count / 10000), F.when(count < 1000, "건").otherwise("만건")


def scaled_size(size: Column) -> tuple[Column, Column]:
    """Bytes in the largest unit of powers of a thousand that keeps them at 1 or more, and the unit."""
    value, unit = size.cast("double"), F.lit("Bytes")
    for power, name in ((1, "KB"), (2, "MB"), (3, "GB")):
        value, unit = F.when(size >= 1000**power, size / 1000**power).otherwise(value), F.when(size >= 1000**power, name).otherwise(unit)
    return value, unit


def sampling_share(sampled: Column, records: Column) -> Column:
    """Sampled rows as a percentage of all records, null without records."""
    return rounded(F.try_divide(sampled, records) * 100)
