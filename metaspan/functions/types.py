"""Physical and semantic column types, as ordered decisions over a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import validators as v

#: Names of columns whose numbers are codes. The second list is that of the rule stage.
CODE_NAMES = r"(?i)(zip|postal|우편|code|코드|id|식별|번호)\z"
RULE_CODE_NAMES = r"(?i)(code|id|no|key)\z"
CLOB = 4000
#: Longest value, longest pattern and most patterns of what is not free text.
TEXT_LENGTH, TEXT_PATTERN, TEXT_PATTERNS = 1000, 50, 20
RULE_TEXT_LENGTH, RULE_TEXT_PATTERN = 4000, 100

#: The patterns that each semantic type goes by.
TIMESTAMPS = ["nnnn-nn-nn nn:nn:nn", "nnnn-nn-nn nn:nn:nn.nnnnnn", "nnnn-nn-nn nn:nn:nn."]
TIMES = ["nn:nn.n", "nn:nn:nn", "nn:nn:nn.nnnnnn", "nn:nn:nn."]
SHORT_DATES = ["nnnnnn", "nn-nn-nn", "nn/nn/nn", "nn.nn.nn", "nn.nn.nn."]
DATES = ["nnnnnnnn", "nnnn-nn-nn", "nnnn/nn/nn", "nnnnKnnKnnK", "nnnn.nn.nn", "nnnn. n. nn."]
MONTHS = ["nnnnnn", "nnnn-nn", "nnnn/nn", "nnnn.nn", "nnnnKnnK"]
TELEPHONES = ["nnn-nnn-nnnn", "nn-nnnn-nnnn", "nn-nnn-nnnn", "nnn-nnnn", "nnnn-nnnn", "nnnnnnn", "nnnnnnnn", "nnnnnnnnnn"]
CELLPHONES = ["nnn-nnnn-nnnn", "nnnnnnnnnnn"]
CARS = ["KKnnKnnnn", "nnKnnnn", "nnnKnnnn"]
COMPANIES = ["(K)KKKK", "(K)KKKKK", "(K)KKKKKK"]


def oracle_type(name: Column, code_names: str = CODE_NAMES) -> Column:
    """DATE, NUMBER(p[,s]), VARCHAR2(n), CLOB or NULL, from the columns of numeric_shape()."""
    p, s = F.col("whole_digits"), F.coalesce(F.col("fraction_digits"), F.lit(0))
    number = F.when(s == 0, F.concat(F.lit("NUMBER("), p.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("NUMBER("), (p + s).cast("string"), F.lit(","), s.cast("string"), F.lit(")")))
    is_number = (F.col("number_share") >= 0.98) & ~name.rlike(code_names) & ~F.col("leading_zero") & (F.col("trimmed_lengths") > 1)
    return (
        F.when(F.col("trimmed_max").isNull(), "NULL")
        .when(F.col("date_share") >= 0.98, "DATE")
        .when(is_number, number)
        .when(F.col("trimmed_max") <= CLOB, F.concat(F.lit("VARCHAR2("), F.col("trimmed_max").cast("string"), F.lit(")")))
        .otherwise("CLOB")
    )


def _telephones(least: float) -> Column:
    """Whether the most frequent value is a telephone number and so is the given share of the ten most frequent. Columns of a number type (data_type) hold none."""
    top = F.col("top_values.value")
    hits = F.size(F.filter(top, v.telephone))
    number = F.coalesce(F.col("data_type").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)"), F.lit(False))
    return F.coalesce(~number & F.col("format").isin(TELEPHONES) & v.telephone(F.element_at(top, 1)) & (hits / F.size(top) >= least), F.lit(False))


def _count(pattern: Column, character: str) -> Column:
    return F.length(pattern) - F.length(F.replace(pattern, F.lit(character), F.lit("")))


def _coordinate(digits: int) -> Column:
    return F.col("format").rlike(rf"^n{{{digits}}}\.n{{4,8}}\z")


def is_sequence() -> Column:
    """Least and greatest value are whole numbers that span as many numbers as there are distinct values."""
    low, high = (F.when(F.col(c).rlike(r"^[+-]?[0-9]+(\.0*)?\z"), F.col(c).try_cast("double")) for c in ("min_string", "max_string"))
    return F.coalesce((high - low + 1 > 0) & (high - low + 1 == F.col("unique_cnt")), F.lit(False))


def flag_type() -> Column:
    one = F.col("format_cnt") == 1
    return (
        F.when((F.col("format") == "A") & (F.col("min_string") == "N") & (F.col("max_string") == "Y") & one, "YN_Flag")
        .when((F.col("format") == "n") & (F.col("min_string") == "0") & (F.col("max_string") == "1") & one, "True_False_Flag")
        .when(F.col("format").isin("A", "a") & one, "Alpha_Flag")
        .when((F.col("format") == "n") & one, "Num_Flag")
        .when((F.col("format") == "K") & one, "Kor_Flag")
        .when((F.col("format") == "KKK") & (F.col("format_cnt") < 6), "KOR_NAME")
    )


def _year() -> Column:
    mode = F.when(F.col("mode_string").rlike(r"^[0-9]+\z"), F.col("mode_string").try_cast("double"))
    return F.coalesce((F.col("format") == "nnnn") & (mode > 1990) & (mode < 2999), F.lit(False))


def detail_type() -> Column:
    """The first that holds. Coordinates are checked on the most frequent value of the format, dates on its median."""
    f, median, one = F.col("format"), F.col("format_median"), F.col("format_cnt") == 1
    korean = f.startswith("K")
    return (
        F.when(F.col("len_max") > CLOB, "CLOB")
        .when(f.isin(TIMESTAMPS) & one, "TIMESTAMP")
        .when(f.isin(TIMES) & one, "TIME")
        .when(f.isin(SHORT_DATES) & v.yymmdd(median), "YYMMDD")
        .when(f.isin(DATES) & v.date(median), "DATECHAR")
        .when(f.isin(MONTHS) & v.year_month(median), "YEARMONTH")
        .when(_year(), "YEAR")
        .when(_coordinate(2) & v.latitude(F.col("format_mode")), "LATITUDE")
        .when(_coordinate(3) & v.longitude(F.col("format_mode")), "LONGITUDE")
        .when(_telephones(0.8), "TEL")
        .when(f.isin(CELLPHONES) & v.cellphone(median), "CELLPHONE")
        .when(f.isin(CARS), "CAR_NUMBER")
        .when(f.isin(COMPANIES) & (F.col("format_cnt") > 5), "COMPANY")
        .when(f.contains("@") & _count(f, ".").between(1, 2), "EMAIL")
        .when(f.contains("://") & (_count(f, ".") >= 1), "URL")
        .when(f == "", "NULL")
        .when(korean & (F.length(f) >= 8) & (_count(f, "K") >= 6) & (_count(f, " ") >= 2) & v.korean_address(median), "ADDRESS")
        .when(korean & ((F.col("len_max") > TEXT_LENGTH) | (F.length(f) > TEXT_PATTERN) | (F.col("format_cnt") > TEXT_PATTERNS)), "Text")
        .when(flag_type().isNotNull(), flag_type())
        .when(is_sequence(), "SEQUENCE")
        .when(F.col("unique_cnt") == 1, "SINGLE VALUE")
        .when((F.col("value_cnt") > 0) & (F.col("value_cnt") == F.col("unique_cnt")), "UNIQUE")
        .otherwise("")
    )


def rule_type() -> Column:
    """The rule stage's decision: without UNIQUE, with stricter telephones and wider limits of free text."""
    f, median, one = F.col("format"), F.col("format_median"), F.col("format_cnt") == 1
    return (
        F.when(F.col("len_max") > CLOB, "CLOB")
        .when(f.isin(TIMESTAMPS) & one, "TIMESTAMP")
        .when(f.isin(TIMES) & one, "TIME")
        .when(f.isin(SHORT_DATES) & v.yymmdd(median), "YYMMDD")
        .when(f.isin(DATES) & v.date(median), "DATECHAR")
        .when(f.isin(MONTHS) & v.year_month(median), "YEARMONTH")
        .when(_year(), "YEAR")
        .when(_coordinate(2) & v.latitude(median), "LATITUDE")
        .when(_coordinate(3) & v.longitude(median), "LONGITUDE")
        .when(_telephones(0.9) & (F.col("unique_cnt") < F.col("value_cnt")) & (F.col("has_alpha") == 0), "TEL")
        .when(f.isin(CELLPHONES) & v.cellphone(median), "CELLPHONE")
        .when(f.isin(CARS), "CAR_NUMBER")
        .when(f.isin(COMPANIES) & (F.col("format_cnt") > 5), "COMPANY")
        .when(f.contains("@") & _count(f, ".").between(1, 2), "EMAIL")
        .when(f.contains("://") & (_count(f, ".") >= 1), "URL")
        .when(flag_type().isNotNull(), flag_type())
        .when((F.col("len_max") > RULE_TEXT_LENGTH) | (F.length(f) > RULE_TEXT_PATTERN) | (F.col("format_cnt") > TEXT_PATTERNS), "Text")
        .when(is_sequence(), "SEQUENCE")
        .when(F.col("unique_cnt") == 1, "SINGLE VALUE")
        .otherwise("")
    )


def with_types(profile: DataFrame, name: str = "column_name") -> DataFrame:
    """oracle_type, detail_type and pk (a unique column is a key candidate) of a profile. Without its data_type a column counts as text."""
    empty = F.col("value_cnt") == 0
    typed = profile if "data_type" in profile.columns else profile.withColumn("data_type", F.lit(None).cast("string"))
    out = typed.withColumns({"oracle_type": F.when(empty, "VARCHAR2(255)").otherwise(oracle_type(F.col(name))), "detail_type": F.when(empty, "").otherwise(detail_type())})
    return out.withColumn("pk", (F.col("detail_type") == "UNIQUE").cast("int"))
