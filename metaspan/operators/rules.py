"""Rules over profiles: which match, how well, and how often values pass a validator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaspan.functions import rules, validators
from metaspan.functions.types import rule_type
from metaspan.operators.profile import long_form, rounded

#: Rule names of profile columns -> their column and kind.
NAMES = {
    "Format": ("format", "text"), "FormatCnt": ("format_cnt", "number"), "FormatValue": ("format_value", "number"), "FormatMin": ("format_min", "text"), "FormatMax": ("format_max", "text"),
    "FormatMode": ("format_mode", "text"), "FormatMedian": ("format_median", "text"), "Format2nd": ("format_2", "text"), "Format3rd": ("format_3", "text"), "ColumnName": ("column_name", "text"),
    "OracleType": ("oracle_type", "text"), "DetailDataType": ("detail_type", "text"), "ValueCnt": ("value_cnt", "number"), "NullCnt": ("null_cnt", "number"), "UniqueCnt": ("unique_cnt", "number"),
    "LenMin": ("len_min", "number"), "LenMax": ("len_max", "number"), "LenAvg": ("len_avg", "number"), "LenMode": ("len_mode", "number"), "LenCnt": ("len_cnt", "number"),
    "MinString": ("min_string", "text"), "MaxString": ("max_string", "text"), "ModeString": ("mode_string", "text"), "MedianString": ("median_string", "text"), "ModeCnt": ("mode_cnt", "number"),
    "HasBlank": ("has_blank", "number"), "HasDash": ("has_dash", "number"), "HasDot": ("has_dot", "number"), "HasAt": ("has_at", "number"), "HasAlpha": ("has_alpha", "number"),
    "HasKor": ("has_kor", "number"), "HasNum": ("has_num", "number"), "HasBracket": ("has_bracket", "number"), "HasMinus": ("has_minus", "number"), "HasOnlyAlpha": ("has_only_alpha", "number"),
    "HasOnlyNum": ("has_only_num", "number"), "HasOnlyKor": ("has_only_kor", "number"), "HasOnlyAlphanum": ("has_only_alphanum", "number"), "HasSpecial": ("has_special", "number"),
    "FirstChrKor": ("first_kor", "number"), "FirstChrNum": ("first_num", "number"), "FirstChrAlpha": ("first_alpha", "number"), "FirstChrSpecial": ("first_special", "number"),
}


def environment(profile: DataFrame) -> dict[str, rules.Value]:
    """The names that a rule over this profile can use."""
    names = {}
    for name, (column, kind) in NAMES.items():
        if column in profile.columns:
            names[name] = rules.Value(F.col(column).cast("double") if kind == "number" else F.coalesce(F.col(column).cast("string"), F.lit("")), kind)
    if "top_values" in profile.columns:
        names["Top10"] = rules.Value(F.coalesce(F.col("top_values.value"), F.array().cast("array<string>")), "list")
    for side in ("First", "Last"):
        for n in (1, 2, 3):
            column = f"{side.lower()}{n}_top10"
            if column in profile.columns:
                names[f"{side}{n}Top10"] = rules.Value(F.coalesce(F.col(column), F.array().cast("array<string>")), "list")
    pattern = F.coalesce(F.col("format"), F.lit(""))
    names["FormatBlankCnt"] = rules.Value((F.length(pattern) - F.length(F.replace(pattern, F.lit(" "), F.lit("")))).cast("double"), "number")
    names["FormatLength"] = rules.Value(F.length(pattern).cast("double"), "number")
    names["RuleTypeAuto"] = rules.Value(F.coalesce(rule_type(), F.lit("")), "text")
    return names


def apply_rules(profile: DataFrame, definitions: list[tuple[str, str, str | None]], sets: dict[str, list[str]] | None = None, threshold: float = rules.THRESHOLD, strict: bool = True) -> DataFrame:
    """The profile with rule_type, matched_rules, matched_scores, score_avg, score_max and rule.

    definitions are (name, rule1, rule2); both must hold; a match scores the mean ratio of rule2's memberships, or 1.
    Matches are in order of score, then of definition; the columns in order of their best and mean score. All rules are one projection: no join with
    the rule table. A run in which no rule matches any column has the rule types as its rules.
    """
    names = environment(profile)
    cells = []
    for order, (name, first, second) in enumerate(definitions):
        one = rules.compile_rule(first, names, sets, threshold, strict)
        two = rules.compile_rule(second, names, sets, threshold, strict) if second and second.strip() else rules.Compiled(F.lit(True))
        score = sum(two.ratios[1:], two.ratios[0]) / len(two.ratios) if two.ratios else F.lit(1.0)
        cells.append(F.when(one.holds & two.holds, F.struct((-score).alias("key"), F.lit(order).alias("no"), F.lit(name).alias("rule"), F.round(score, 4).alias("score"))))
    found = F.array_sort(F.array_compact(F.array(*cells))) if cells else F.array().cast("array<struct<key:double,no:int,rule:string,score:double>>")
    out = profile.withColumns({"rule_type": rule_type(), "found": found})
    scores = F.col("found.score")
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    out = out.withColumns(
        {
            "matched_rules": F.array_join("found.rule", "; "),
            "matched_scores": scores,
            "score_avg": F.round(F.try_divide(total, F.size(scores)), 4),
            "score_max": F.array_max(scores),
        }
    )
    # if no rule matched any column of the run, its columns are named by their types
    some = out.agg(F.coalesce(F.bool_or(F.col("matched_rules") != ""), F.lit(False))).scalar()
    out = out.withColumn("rule", F.when(some, F.col("matched_rules")).otherwise(F.col("rule_type"))).drop("found")
    return out.orderBy(F.desc_nulls_last("score_max"), F.desc_nulls_last("score_avg"), "column_name")


def validator_rates(df: DataFrame, checks: dict[str, str | list[str]]) -> DataFrame:
    """column_name, validator, value_cnt, valid_cnt, valid_pct of (column -> validators), over all rows in one pass."""
    pairs = [(c, v) for c, vs in checks.items() for v in ([vs] if isinstance(vs, str) else vs)]
    long = long_form(df, sorted({c for c, _ in pairs})).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("cnt"))
    cells = [F.when(F.col("column_name") == c, F.struct(F.lit(v).alias("validator"), validators.VALIDATORS[v](F.col("value")).alias("valid"))) for c, v in pairs]
    out = long.select("column_name", "cnt", F.inline(F.array_compact(F.array(*cells))))
    out = out.groupBy("column_name", "validator").agg(F.sum("cnt").alias("value_cnt"), F.sum(F.when(F.col("valid"), F.col("cnt")).otherwise(0)).alias("valid_cnt"))
    return out.withColumn("valid_pct", rounded(F.col("valid_cnt") / F.col("value_cnt") * 100))


def rule_checks(matched: DataFrame) -> Column:
    """The validator of a column's single matched rule; several rules name none."""
    names = F.create_map(*[F.lit(x) for k, v in {**{k: k for k in validators.VALIDATORS}, **validators.SYNONYMS}.items() for x in (k, v)])
    name = F.when(~matched.matched_rules.contains(";"), F.trim(matched.matched_rules))
    return F.coalesce(F.try_element_at(names, name), F.try_element_at(names, F.upper(name)))
