"""Counters of integrity issues, put into a profile: orphans of relations, dates that are none, values outside control limits.

A profile has one row per column; the counters come from tables that also have one row per column or relation, so joins here
are between metadata. The counting itself is done where the values are: orphans in match.inclusion(), dates from counted values
in date_conflicts(), limits in stats.control_limits().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaspan.functions.validators import VALIDATORS
from metaspan.operators.match import rank_matches
from metaspan.operators.profile import rounded

#: Semantic types whose values have to be dates, by the validator that tells.
DATES = ["DATECHAR", "YYMMDD", "YEARMONTH", "YEAR"]
#: Share of a column's rows, as a percentage, that has to be matched or valid.
TOLERANCE = 100.0

KEYS = ["file_name", "column_name"]


def orphans(mapping: DataFrame, tolerance: float = TOLERANCE, keys: list[str] | None = None) -> DataFrame:
    """Per column with a master: its best master, rows with and without a value of it, and fk_mismatch.

    ``mapping`` is a table as of match.internal_mapping(). Rows with a null or blank value have no master to miss and do not count. fk_mismatch is the
    number of orphan rows if fewer rows than the tolerance are matched, else 0.
    """
    keys = keys or ["file_path", *KEYS]
    best = rank_matches(mapping, keys, 1)
    share = F.col("matched_rows") / F.col("source_rows") * 100
    return best.select(
        *keys, F.concat_ws(".", "master_file", "master_column").alias("master"), "source_rows", "matched_rows", "orphan_rows", rounded(share).alias("matched_rows_pct"),
        F.when(share < tolerance, F.col("orphan_rows")).otherwise(0).alias("fk_mismatch"),
    )


def date_conflicts(counted: DataFrame, kinds: dict[str, str], tolerance: float = TOLERANCE) -> DataFrame:
    """Per column of ``kinds`` (name -> one of DATES): rows with a value, rows whose value is such a date, and date_mismatch, the others if they exceed the tolerance.

    ``counted`` has distinct values with their counts (column_name, value, cnt), so each different text is checked once, whatever its rows.
    """
    wrong = sorted(set(kinds.values()) - set(DATES))
    if wrong:
        raise ValueError(f"no kinds of dates: {', '.join(wrong)}")
    valid = reduce(lambda out, kind: F.when(F.col("kind") == kind, VALIDATORS[kind](F.col("value"))).otherwise(out), DATES, F.lit(False))
    named = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]) if kinds else F.lit(None).cast("map<string,string>")
    present = counted.withColumn("kind", F.try_element_at(named, F.col("column_name"))).where("kind IS NOT NULL AND value IS NOT NULL")
    out = present.groupBy("column_name", "kind").agg(F.sum("cnt").alias("date_rows"), F.sum(F.when(valid, F.col("cnt")).otherwise(0)).alias("valid_rows"))
    bad = F.col("date_rows") - F.col("valid_rows")
    return out.withColumn("date_mismatch", F.when(F.col("valid_rows") / F.col("date_rows") * 100 < tolerance, bad).otherwise(0))


def date_columns(profile: DataFrame) -> dict[str, str]:
    """Columns of a profile whose semantic type is a date, with the type."""
    rows = profile.where(F.col("detail_type").isin(DATES)).select("column_name", "detail_type").distinct().collect()
    return {r.column_name: r.detail_type for r in rows}


def with_counters(profile: DataFrame, found_orphans: DataFrame | None = None, dates: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """The profile with fk_mismatch, date_mismatch, below_lcl and above_ucl, each 0 where nothing was counted.

    ``found_orphans`` as of orphans(), ``dates`` as of date_conflicts(), ``limits`` as of stats.control_limits(). A table without file_name is joined
    on the column's name alone.
    """
    out = profile
    for table, names in ((found_orphans, ["master", "fk_mismatch", "matched_rows_pct"]), (dates, ["date_mismatch"]), (limits, ["below_lcl", "above_ucl"])):
        if table is None:
            continue
        on = [k for k in ("file_path", *KEYS) if k in table.columns and k in profile.columns]
        out = out.drop(*[n for n in names if n in out.columns]).join(table.select(*on, *names), on, "left")
    counters = ["fk_mismatch", "date_mismatch", "below_lcl", "above_ucl"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in out.columns else F.lit(0).cast("long") for c in counters})


#: Issue -> the columns that its list shows.
LISTS = {
    "unicode": ["value_cnt", "has_unicode2"], "broken_kor": ["value_cnt", "has_broken_kor"], "chinese": ["value_cnt", "has_chinese"], "special": ["value_cnt", "has_special"],
    "below_lcl": ["value_cnt", "below_lcl"], "above_ucl": ["value_cnt", "above_ucl"], "fk_mismatch": ["record_cnt", "value_cnt", "null_cnt", "master", "matched_rows_pct", "fk_mismatch"],
    "date_mismatch": ["detail_type", "record_cnt", "value_cnt", "null_cnt", "date_mismatch"], "length": ["data_type", "record_cnt", "value_cnt", "len_mode", "len_max"],
}


def issue_list(profile: DataFrame, issue: str) -> DataFrame:
    """The columns that have an issue, with the figures that explain it."""
    from metaspan.operators.score import issues

    return profile.where(issues(profile)[issue]).select(*[c for c in [*KEYS, *LISTS[issue]] if c in profile.columns])
