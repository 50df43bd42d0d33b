"""Profile queries over the driver tables, each beside its oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaspan.functions import patterns, types
from metaspan.operators import profile as p
from metaspan.operators import rules, score, stats
from metaspan.sources.shared import materialised, sized, stored

#: Columns whose text form is the same in both engines.
SHOWN = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"],
    "lineitem": ["l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
}
#: All columns of these tables. Numbers of the tables with fractions have one text in both engines, as they are under 10^7 and have two digits.
WHOLE = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
}
TEXTS = {"documents": ["text", "lang"], "pages": ["url"], "events": ["event_type", "props"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(spark: SparkSession, sf_dir: str, shown: dict[str, list[str]] = SHOWN) -> DataFrame:
    """Value counts of the columns of several tables; each table is read for its own columns only."""
    return reduce(DataFrame.unionByName, [p.value_counts_apart(table(spark, sf_dir, t), cs) for t, cs in shown.items()])


def stored_counts(spark: SparkSession, sf_dir: str, shown: dict[str, list[str]] = SHOWN) -> DataFrame:
    """counted() as a table, made by tasks that do not grow with the tables."""
    with sized(spark, max(table(spark, sf_dir, t).count() for t in shown)):  # each column is counted by itself
        return stored(counted(spark, sf_dir, shown), "values")


def data_types(spark: SparkSession, sf_dir: str, shown: dict[str, list[str]] = SHOWN) -> Column:
    """The data type of the column that column_name names."""
    kinds = {c: t for name, cs in shown.items() for c, t in table(spark, sf_dir, name).dtypes if c in cs}
    return F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("column_name"))


def long_sql(shown: dict[str, list[str]] = SHOWN) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {t}" for t, cs in shown.items() for c in cs)


def vc_sql(shown: dict[str, list[str]] = SHOWN) -> str:
    """Common table expressions long, vc (with nulls) and pv (without)."""
    return (
        f"long AS ({long_sql(shown)}), vc AS (SELECT column_name, value, count(*) AS cnt FROM long GROUP BY column_name, value), "
        "pv AS (SELECT * FROM vc WHERE value IS NOT NULL)"
    )


COUNTS_SQL = """SELECT column_name, sum(cnt)::BIGINT AS record_cnt, coalesce(sum(cnt) FILTER (value IS NOT NULL), 0)::BIGINT AS value_cnt, count(value) AS unique_cnt,
 (sum(cnt) - coalesce(sum(cnt) FILTER (value IS NOT NULL), 0))::BIGINT AS null_cnt,
 round(((sum(cnt) - coalesce(sum(cnt) FILTER (value IS NOT NULL), 0))::DOUBLE / sum(cnt)::DOUBLE * 100)::DECIMAL(18, 6), 2)::DOUBLE AS null_pct,
 round((count(value)::DOUBLE / nullif(coalesce(sum(cnt) FILTER (value IS NOT NULL), 0), 0)::DOUBLE * 100)::DECIMAL(18, 6), 2)::DOUBLE AS unique_pct
FROM vc GROUP BY column_name"""


def profile_counts(spark, sf_dir):
    return p.counts(counted(spark, sf_dir))


def profile_counts_sql():
    return f"WITH {vc_sql()} {COUNTS_SQL}"




def profile_lengths(spark, sf_dir):
    return p.lengths(counted(spark, sf_dir))


def profile_lengths_sql():
    modes = "lm AS (SELECT column_name, l AS len_mode FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, l) AS rn FROM (SELECT column_name, length(value) AS l, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL)) WHERE rn = 1)"
    return f"""WITH {vc_sql()}, {modes} SELECT o.column_name, count(*) AS len_cnt, count(DISTINCT length(value)) AS len_distinct, min(length(value))::INT AS len_min, max(length(value))::INT AS len_max,
 round((sum(length(value))::DOUBLE / count(*)::DOUBLE)::DECIMAL(18, 6), 1)::DOUBLE AS len_avg, any_value(len_mode)::INT AS len_mode, quantile_cont(length(value), 0.5)::DOUBLE AS len_median
FROM long o JOIN lm USING (column_name) WHERE value IS NOT NULL GROUP BY o.column_name"""


VALUES_SQL = """ordered AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY column_name) AS n FROM long WHERE value IS NOT NULL),
modes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn FROM pv) WHERE rn = 1),
vals AS (SELECT column_name, min(value) AS min_string, max(value) AS max_string, max(value) FILTER (pos = n // 2) AS median_string FROM ordered GROUP BY column_name)"""


def profile_values(spark, sf_dir):
    return p.value_stats(stored_counts(spark, sf_dir))


def profile_values_sql():
    return f"WITH {vc_sql()}, {VALUES_SQL} SELECT column_name, min_string, max_string, median_string, modes.value AS mode_string, modes.cnt AS mode_cnt FROM vals JOIN modes USING (column_name)"


def value_top10(spark, sf_dir):
    top = p.top_values(counted(spark, sf_dir))
    return top.select("column_name", "top_pct", F.posexplode("top_values").alias("pos", "v")).select("column_name", "top_pct", (F.col("pos") + 1).alias("rank"), F.col("v.value").alias("value"), F.col("v.cnt").alias("cnt"))


def value_top10_sql():
    return f"""WITH {vc_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rank, sum(cnt) OVER (PARTITION BY column_name) AS n FROM pv)
SELECT column_name, round((sum(cnt) OVER (PARTITION BY column_name)::DOUBLE / n::DOUBLE * 100)::DECIMAL(18, 6), 2)::DOUBLE AS top_pct, rank::INT AS rank, value, cnt FROM r WHERE rank <= 10"""


def formats_cte() -> str:
    return f"""f AS (SELECT column_name, value, {patterns.format_pattern_sql("value")} AS format FROM long WHERE value IS NOT NULL),
fo AS (SELECT *, row_number() OVER (PARTITION BY column_name, format ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY column_name, format) AS n FROM f),
fm AS (SELECT column_name, format, value AS format_mode FROM (SELECT column_name, format, value, row_number() OVER (PARTITION BY column_name, format ORDER BY count(*) DESC, value) AS rn FROM f GROUP BY column_name, format, value) WHERE rn = 1),
fa AS (SELECT column_name, format, count(*) AS cnt, min(value) AS format_min, max(value) AS format_max, max(value) FILTER (pos = n // 2) AS format_median FROM fo GROUP BY column_name, format),
fr AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, format) AS rank, sum(cnt) OVER (PARTITION BY column_name) AS value_cnt, count(*) OVER (PARTITION BY column_name) AS format_cnt FROM fa),
formats AS (SELECT column_name, rank::INT AS rank, format, format_cnt, cnt AS format_value, round((cnt::DOUBLE / value_cnt::DOUBLE * 100)::DECIMAL(18, 6), 2)::DOUBLE AS format_pct, format_min, format_max, format_mode, format_median
 FROM fr JOIN fm USING (column_name, format) WHERE rank <= 3)"""


def format_top3(spark, sf_dir):
    return p.formats(counted(spark, sf_dir, {**SHOWN, "pages": ["url"]}))


def format_top3_sql():
    return f"WITH {vc_sql({**SHOWN, 'pages': ['url']})}, {formats_cte()} SELECT * FROM formats"


def edge_top3(spark, sf_dir):
    return p.edges(counted(spark, sf_dir))


def edge_top3_sql():
    parts = " UNION ALL ".join(
        f"SELECT column_name, '{s}' AS side, {n} AS n, {'left' if s == 'first' else 'right'}(value, {n}) AS value, cnt FROM pv" for s in ("first", "last") for n in (1, 2, 3)
    )
    return f"""WITH {vc_sql()}, e AS ({parts}), g AS (SELECT column_name, side, n, value, sum(cnt)::BIGINT AS cnt FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name, side, n ORDER BY cnt DESC, value)::INT AS rank FROM g) SELECT column_name, side, n, rank, value, cnt FROM r WHERE rank <= 3"""


def composition_flags(spark, sf_dir):
    return p.composition(counted(spark, sf_dir, {**SHOWN, **TEXTS}))


def composition_flags_sql():
    flags = ", ".join(f"{'max' if q == 'any' else 'min'}(regexp_matches(value, '{e}')::INT) AS {n}" for n, e, q in patterns.FLAGS)
    return f"WITH {vc_sql({**SHOWN, **TEXTS})} SELECT column_name, {flags} FROM pv GROUP BY column_name"


def first_char_counts(spark, sf_dir):
    return p.first_characters(counted(spark, sf_dir, {**SHOWN, **TEXTS}))


FIRST_SQL = ", ".join(f"coalesce(sum(cnt) FILTER (regexp_matches(value, '{e}')), 0)::BIGINT AS {n}" for n, e in patterns.FIRST_CHARACTERS)


def first_char_counts_sql():
    return f"""WITH {vc_sql({**SHOWN, **TEXTS})}, x AS (SELECT column_name, sum(cnt)::BIGINT AS n, {FIRST_SQL} FROM pv GROUP BY column_name)
SELECT column_name, first_kor, first_num, first_alpha, n - first_kor - first_num - first_alpha AS first_special FROM x"""


def oracle_type(spark, sf_dir):
    shape = p.numeric_shape(counted(spark, sf_dir))
    return shape.select("column_name", types.oracle_type(F.col("column_name")).alias("oracle_type"), types.oracle_type(F.col("column_name"), types.RULE_CODE_NAMES).alias("rule_oracle_type"))


SHAPE_SQL = r"""shape AS (SELECT column_name,
 sum(cnt) FILTER (regexp_matches(trim(value), '^[0-9]{4}[-/.]?[0-9]{2}[-/.]?[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?\z')) / sum(cnt) AS dates,
 sum(cnt) FILTER (regexp_matches(trim(value), '^[+-]?[0-9]+(\.[0-9]+)?\z')) / sum(cnt) AS numbers,
 bool_or(regexp_matches(trim(value), '^0[0-9]+\z')) AS zero, count(DISTINCT length(trim(value))) AS lens, max(length(trim(value))) AS longest,
 max(length(regexp_replace(regexp_extract(trim(value), '^[+-]?([0-9]+)(\.[0-9]+)?\z', 1), '^0+([0-9])', '\1'))) AS p,
 max(length(regexp_replace(regexp_extract(trim(value), '^[+-]?[0-9]+\.([0-9]+)\z', 1), '0+\z', ''))) AS s FROM pv GROUP BY column_name)"""


def _oracle_case(names: str) -> str:
    return f"""CASE WHEN dates >= 0.98 THEN 'DATE' WHEN numbers >= 0.98 AND NOT regexp_matches(column_name, '{names}') AND NOT zero AND lens > 1
 THEN CASE WHEN s = 0 THEN 'NUMBER(' || p || ')' ELSE 'NUMBER(' || (p + s) || ',' || s || ')' END WHEN longest <= 4000 THEN 'VARCHAR2(' || longest || ')' ELSE 'CLOB' END"""


def oracle_type_sql():
    return f"WITH {vc_sql()}, {SHAPE_SQL} SELECT column_name, {_oracle_case(types.CODE_NAMES)} AS oracle_type, {_oracle_case(types.RULE_CODE_NAMES)} AS rule_oracle_type FROM shape"


def _profiles(spark, sf_dir, shown: dict[str, list[str]] = SHOWN) -> DataFrame:
    """Profiles of all shown columns, with their table as the file."""
    owner = F.create_map(*[F.lit(x) for t, cs in shown.items() for c in cs for x in (c, t)])
    vc = stored_counts(spark, sf_dir, shown)
    out = p.assembled(vc)
    out = score.with_scores(types.with_types(out.withColumn("data_type", data_types(spark, sf_dir, shown)))).withColumns({"file_name": F.element_at(owner, F.col("column_name")), "file_path": F.lit("tables"), "master_type": F.lit("Master")})
    return materialised(out, "profiles")


def detail_type(spark, sf_dir):
    return _profiles(spark, sf_dir, WHOLE).select("column_name", "detail_type", "pk")


def wide_cte() -> str:
    """One row per column: wide, with what types and scores need."""
    return f"""{formats_cte()}, {VALUES_SQL}, {SHAPE_SQL}, c AS ({COUNTS_SQL}), l AS (SELECT column_name, max(length(value)) AS len_max, min(length(value)) AS len_min FROM pv GROUP BY column_name),
ff AS (SELECT column_name, any_value(format_cnt) AS format_cnt, max(format) FILTER (rank = 1) AS format, max(format_median) FILTER (rank = 1) AS format_median, max(format_pct) AS format_pct FROM formats GROUP BY column_name),
wide AS (SELECT *, modes.value AS mode_string FROM c JOIN l USING (column_name) JOIN ff USING (column_name) JOIN vals USING (column_name) JOIN modes USING (column_name) JOIN shape USING (column_name))"""


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def detail_case() -> str:
    d = "regexp_replace(format_median, '[^0-9]', '', 'g')"
    real = lambda text: f"try_strptime({text}, '%Y%m%d') IS NOT NULL"
    number = lambda c: f"CASE WHEN regexp_matches({c}, '^[+-]?[0-9]+(\\.0*)?\\z') THEN {c}::DOUBLE END"
    return f"""CASE WHEN len_max > 4000 THEN 'CLOB'
 WHEN format IN ({_quoted(types.TIMESTAMPS)}) AND format_cnt = 1 THEN 'TIMESTAMP'
 WHEN format IN ({_quoted(types.TIMES)}) AND format_cnt = 1 THEN 'TIME'
 WHEN format IN ({_quoted(types.SHORT_DATES)}) AND length({d}) = 6 AND {real(f"(CASE WHEN left({d}, 2) >= '69' THEN '19' ELSE '20' END || {d})")} THEN 'YYMMDD'
 WHEN format IN ({_quoted(types.DATES)}) AND length({d}) >= 8 AND {real(f"left({d}, 8)")} AND left({d}, 4) >= '1900' THEN 'DATECHAR'
 WHEN format IN ({_quoted(types.MONTHS)}) AND length({d}) = 6 AND left({d}, 4) BETWEEN '1900' AND '9999' AND right({d}, 2) BETWEEN '01' AND '12' THEN 'YEARMONTH'
 WHEN format = 'nnnn' AND CASE WHEN regexp_matches(mode_string, '^[0-9]+\\z') THEN mode_string::DOUBLE END > 1990 AND mode_string::DOUBLE < 2999 THEN 'YEAR'
 WHEN format = 'A' AND min_string = 'N' AND max_string = 'Y' AND format_cnt = 1 THEN 'YN_Flag'
 WHEN format = 'n' AND min_string = '0' AND max_string = '1' AND format_cnt = 1 THEN 'True_False_Flag'
 WHEN format IN ('A', 'a') AND format_cnt = 1 THEN 'Alpha_Flag' WHEN format = 'n' AND format_cnt = 1 THEN 'Num_Flag'
 WHEN {number("max_string")} - {number("min_string")} + 1 = unique_cnt THEN 'SEQUENCE' WHEN unique_cnt = 1 THEN 'SINGLE VALUE' WHEN value_cnt = unique_cnt THEN 'UNIQUE' ELSE '' END"""


def detail_type_sql():
    return f"WITH {vc_sql(WHOLE)}, {wide_cte()}, t AS (SELECT column_name, {detail_case()} AS detail_type FROM wide) SELECT *, (detail_type = 'UNIQUE')::INT AS pk FROM t"


def dq_score(spark, sf_dir):
    return score.view(_profiles(spark, sf_dir), "dq_score").drop("file_name").withColumns({c: F.round(c, 4) for c in ("type_mixed", "length_vol", "duplicate")})


def dq_score_sql():
    return f"""WITH {vc_sql()}, {wide_cte()}, m AS (SELECT column_name, null_pct AS null_share, 100.0 - format_pct AS type_mixed,
 CASE WHEN len_max > 0 THEN (len_max - len_min)::DOUBLE / len_max::DOUBLE * 100 ELSE 0.0 END AS length_vol, 100.0 - unique_pct AS duplicate, 0.0::DOUBLE AS rule_fail FROM wide),
t AS (SELECT *, round(greatest(0.0, least(100.0, 100.0 - (0.40 * null_share + 0.25 * type_mixed + 0.15 * length_vol + 0.10 * duplicate + 0.10 * rule_fail)))::DECIMAL(18, 6), 2)::DOUBLE AS dq_score,
 list_filter([CASE WHEN null_share > 20 THEN 'High NULLs' END, CASE WHEN type_mixed > 30 THEN 'Mixed formats' END, CASE WHEN length_vol > 30 THEN 'Length volatility' END,
 CASE WHEN duplicate > 90 THEN 'Very low uniqueness' END], lambda x: x IS NOT NULL) AS tags FROM m)
SELECT column_name, dq_score, len(tags)::INT AS issue_count, array_to_string(tags, ', ') AS dq_issues, null_share, round(type_mixed, 4) AS type_mixed, round(length_vol, 4) AS length_vol, round(duplicate, 4) AS duplicate, rule_fail FROM t"""


def quality_kpis(spark, sf_dir):
    return score.quality_kpis(_profiles(spark, sf_dir)).where(F.col("issue").isin("unicode", "broken_kor", "chinese", "special"))


def quality_kpis_sql():
    owner = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS file_name" for t, cs in SHOWN.items() for c in cs)
    tests = {"unicode": r"[\x{10000}-\x{10FFFF}]", "broken_kor": r"\x{FFFD}", "chinese": r"[\x{4E00}-\x{9FFF}]", "special": r"[^a-zA-Z0-9가-힣\s]"}
    rows = " UNION ALL ".join(f"SELECT column_name, '{k}' AS issue, max(regexp_matches(value, '{e}')::INT) AS hit FROM pv GROUP BY column_name" for k, e in tests.items())
    return f"""WITH {vc_sql()}, o AS ({owner}), x AS ({rows})
SELECT issue, count(DISTINCT file_name) FILTER (hit = 1) AS files, sum(hit)::BIGINT AS columns, round((sum(hit)::DOUBLE / count(*)::DOUBLE * 100)::DECIMAL(18, 6), 2)::DOUBLE AS columns_pct FROM x JOIN o USING (column_name) GROUP BY issue"""


def per_file_kpis(spark, sf_dir):
    return score.per_file_kpis(_profiles(spark, sf_dir))


def per_file_kpis_sql():
    owner = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS file_name" for t, cs in SHOWN.items() for c in cs)
    return f"""WITH {vc_sql()}, {wide_cte()}, o AS ({owner}), t AS (SELECT *, {detail_case()} AS detail FROM wide JOIN o USING (column_name))
SELECT file_name, count(*) AS column_cnt, count(*) FILTER (null_pct = 100) AS all_null, count(*) FILTER (null_pct > 0) AS some_null, count(*) FILTER (unique_pct = 100) AS all_unique,
 coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (detail = 'UNIQUE'), '') AS pk_columns FROM t GROUP BY file_name"""


def validator_rates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.date_format("o_orderdate", "yyMMdd").alias("short_day"), F.date_format("o_orderdate", "yyyyMM").alias("month"), F.date_format("o_orderdate", "yyyy").alias("year"))
    one = rules.validator_rates(orders, {"day": ["DATECHAR", "YYMMDD"], "short_day": "YYMMDD", "month": "YEARMONTH", "year": "YEAR"})
    two = rules.validator_rates(table(spark, sf_dir, "pages"), {"url": ["URL", "EMAIL"]})
    three = rules.validator_rates(table(spark, sf_dir, "customer").select(F.substring("c_name", 10, 9).alias("number"), F.col("c_nationkey").alias("degree"), F.substring("c_mktsegment", 1, 3).alias("code")), {"number": ["TEL", "CELLPHONE"], "degree": ["LATITUDE", "LONGITUDE"], "code": "COUNTRY_ISO3"})
    return one.unionByName(two).unionByName(three)


def validator_rates_sql():
    def rate(column, name, source, test):
        return f"SELECT '{column}' AS column_name, '{name}' AS validator, count(*) AS value_cnt, count(*) FILTER ({test}) AS valid_cnt FROM ({source}) WHERE x IS NOT NULL"

    # the patterns are written out here, so that a changed constant of the library shows
    # What an address of a page and of a mailbox looks like
    url_form = r"(?i)^https?://((?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}(?:\.\d{1,3}){3})(?::\d+)?(?:/?|[/?]\S+)$"
    mail_form = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
    local = r"[2-9][0-9]{6,7}"
    phone_form = rf"^({local}|02{local}|010{local}|0[3-9][0-9]{local})$"
    mobile_form = rf"^01[016789]{local}$"
    day = lambda f: f"SELECT strftime(o_orderdate, '{f}') AS x FROM orders"
    number, url = "SELECT substr(c_name, 10, 9) AS x FROM customer", "SELECT url AS x FROM pages"
    rows = [
        rate("day", "DATECHAR", day("%Y%m%d"), "try_strptime(x, '%Y%m%d') IS NOT NULL AND left(x, 4) >= '1900'"), rate("day", "YYMMDD", day("%Y%m%d"), "length(x) = 6"),
        rate("short_day", "YYMMDD", day("%y%m%d"), "try_strptime(x, '%y%m%d') IS NOT NULL"), rate("month", "YEARMONTH", day("%Y%m"), "left(x, 4) >= '1900' AND right(x, 2) BETWEEN '01' AND '12'"),
        rate("year", "YEAR", day("%Y"), "x::INT BETWEEN 1900 AND 2999"), rate("url", "URL", url, f"regexp_matches(trim(x), '{url_form}')"), rate("url", "EMAIL", url, f"regexp_matches(trim(x), '{mail_form}')"),
        rate("number", "TEL", number, f"regexp_matches(x, '{phone_form}')"), rate("number", "CELLPHONE", number, f"regexp_matches(x, '{mobile_form}')"),
        rate("degree", "LATITUDE", "SELECT c_nationkey AS x FROM customer", "abs(x) <= 90"), rate("degree", "LONGITUDE", "SELECT c_nationkey AS x FROM customer", "abs(x) <= 180"),
        rate("code", "COUNTRY_ISO3", "SELECT left(c_mktsegment, 3) AS x FROM customer", "regexp_matches(x, '^[A-Z]{3}\\z')"),
    ]
    return f"SELECT *, round((valid_cnt::DOUBLE / value_cnt::DOUBLE * 100)::DECIMAL(18, 6), 2)::DOUBLE AS valid_pct FROM ({' UNION ALL '.join(rows)})"


#: Texts that tell right patterns from nearly right ones, dealt to customers by number: column -> validator and (text, valid).
CASES = {
    "mail": ("EMAIL", [("a@b.co", 1), ("a%b@x.com", 1), ("a@b.1", 0), ("a@b.c-", 0), ("a.b+c@d-e.org", 1), ("a b@x.com", 0), ("a@x", 0)]),
    "page": ("URL", [("http://a.com./", 1), ("http://a.museums", 0), ("http://a.com#x", 0), ("https://localhost:80/x", 1), ("HTTP://1.2.3.4?q", 1), ("ftp://a.com", 0), ("http://-a.com", 0)]),
    "plate": ("CAR_NUMBER", [("12가3456", 1), ("123나4567", 1), ("서울12가3456", 1), ("12A3456", 0), ("12가 3456", 0), (" 12가3456 ", 1)]),
    "clock": ("TIME", [("12:30:59", 1), ("12:30", 0), ("noon", 0), ("12:345", 0), ("12:30.5", 1), ("12:3015", 1)]),
    "short": ("YYMMDD", [("240131.0", 1), ("240131", 1), ("240230", 0), (" 24-01-31 ", 1), ("2401310", 0)]),
    "month": ("YEARMONTH", [("202401.0", 1), ("2024-13", 0), ("2024.01", 1), ("189912", 0)]),
    "annual": ("YEAR", [("2024.0", 1), ("1899", 0), ("2024.5", 0), (" 2999 ", 1)]),
    "mobile": ("CELLPHONE", [("01023456789.0", 1), ("010-2345-6789", 1), ("010-1234-5678", 0), ("0102345678", 1)]),
    "sex": ("GENDER", [("남", 1), ("여", 1), ("M", 0)]),
    "sex_en": ("GENDER_EN", [("m", 1), ("F", 1), ("x", 0)]),
    "stamp": ("TIMESTAMP", [("2024-01-01 00:00:00", 1), ("anything", 1)]),
    "family": ("KOR_NAME", [("김", 1), ("x", 1)]),
    "place": ("ADDRESS", [("서울특별시 강남구", 1), ("x", 1)]),
}


def validator_cases(spark, sf_dir):
    """Rates of texts whose validity is known; without sets of valid values names and addresses pass."""
    texts = {c: F.element_at(F.array(*[F.lit(x) for x, _ in cases]), (F.col("c_custkey") % len(cases)).cast("int") + 1) for c, (_, cases) in CASES.items()}
    return rules.validator_rates(table(spark, sf_dir, "customer").select(*[x.alias(c) for c, x in texts.items()]), {c: v for c, (v, _) in CASES.items()})


def validator_cases_sql():
    rows = []
    for column, (validator, cases) in CASES.items():
        good = ", ".join(str(i) for i, (_, valid) in enumerate(cases) if valid)
        rows.append(f"SELECT '{column}' AS column_name, '{validator}' AS validator, count(*) AS value_cnt, count(*) FILTER (c_custkey % {len(cases)} IN ({good})) AS valid_cnt FROM customer")
    return f"SELECT *, round((valid_cnt::DOUBLE / value_cnt::DOUBLE * 100)::DECIMAL(18, 6), 2)::DOUBLE AS valid_pct FROM ({' UNION ALL '.join(rows)})"


#: Names of rules -> validators that the oracle expects; None: no validator.
RULE_NAMES = {
    "주소": "ADDRESS", "국가코드": "COUNTRY_ISO3", "이메일": "EMAIL", "휴대폰": "CELLPHONE", "전화": "TEL", "위도": "LATITUDE", "경도": "LONGITUDE", "연월": "YEARMONTH", "연월일": "DATECHAR",
    "성씨": "KOR_NAME", "성별구분": "GENDER", "성별구분_영문": "GENDER_EN", "차량번호": "CAR_NUMBER", "url": "URL", "URL": "URL", "전화; 휴대폰": None, "성명": None,
}


def rule_validators(spark, sf_dir):
    """The validator that each customer's rule name stands for."""
    names = list(RULE_NAMES)
    named = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("c_custkey") % len(names)).cast("int") + 1).alias("matched_rules"))
    return named.select("c_custkey", "matched_rules", rules.rule_checks(named).alias("validator"))


def rule_validators_sql():
    cases = " ".join(f"WHEN {i} THEN " + (f"'{v}'" if v else "NULL") for i, v in enumerate(RULE_NAMES.values()))
    names = ", ".join(f"'{n}'" for n in RULE_NAMES)
    return f"SELECT c_custkey, ([{names}])[c_custkey % {len(RULE_NAMES)} + 1] AS matched_rules, CASE c_custkey % {len(RULE_NAMES)} {cases} END AS validator FROM customer"


NUMERIC = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount"], "orders": ["o_totalprice"], "customer": ["c_acctbal"], "events": ["value"]}


def numeric_control_limits(spark, sf_dir):
    out = reduce(DataFrame.unionByName, [stats.control_limits(table(spark, sf_dir, t), cs) for t, cs in NUMERIC.items()])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75", "lcl", "ucl")})


def numeric_control_limits_sql():
    rows = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::DOUBLE AS value FROM {t} WHERE {c} IS NOT NULL" for t, cs in NUMERIC.items() for c in cs)
    return f"""WITH x AS ({rows}), d AS (SELECT column_name, count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
 quantile_cont(value, 0.75) AS q75, max(value) AS max FROM x GROUP BY column_name)
SELECT column_name, count, round(mean, 4) AS mean, round(std, 4) AS std, min, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, max, round(mean - 3 * std, 4) AS lcl, round(mean + 3 * std, 4) AS ucl,
 (SELECT count(*) FROM x WHERE x.column_name = d.column_name AND value < d.mean - 3 * d.std) AS below_lcl, (SELECT count(*) FROM x WHERE x.column_name = d.column_name AND value > d.mean + 3 * d.std) AS above_ucl FROM d"""


RULES = [
    ("status", "FormatCnt == 1 and Format == 'A'", "Top10 in 유효상태"),
    ("name", "HasAlpha == 1 and HasNum == 0", None),
    ("number", "HasOnlyNum == 1 & LenMax <= 3", None),
    ("segment", "Format.count('A') >= 4 and not HasNum", "Top10 in ['BUILDING', 'MACHINERY', 'NONE']"),
    ("wide", "LenMax > 2 * LenMode or len(Top10) < 3", ""),
]
VALID = {"유효상태": ["F", "O", "P", "A", "N", "R"]}


def rule_matches(spark, sf_dir):
    out = rules.apply_rules(_profiles(spark, sf_dir), RULES, VALID)
    return out.select("column_name", "matched_rules", "score_avg", "score_max")


def unmatched_rules(spark, sf_dir):
    """A run in which no rule matches: the rule types take the place of the rules."""
    return rules.apply_rules(_profiles(spark, sf_dir), [("never", "LenMax < 0", None)]).select("column_name", "matched_rules", (F.col("rule") == F.col("rule_type")).alias("falls_back"))


def unmatched_rules_sql():
    return f"WITH {vc_sql()} SELECT DISTINCT column_name, '' AS matched_rules, true AS falls_back FROM pv"


def rule_matches_sql():
    """Rule 3 shows the grammar: `HasOnlyNum == 1 & LenMax <= 3` is HasOnlyNum == (1 & LenMax) <= 3, where (1 & LenMax) is true."""
    top = "t10 AS (SELECT column_name, list(value ORDER BY cnt DESC, value) AS top FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn FROM pv) WHERE rn <= 10 GROUP BY column_name)"
    flags = "fl AS (SELECT column_name, max(regexp_matches(value, '[a-zA-Z]')::INT) AS has_alpha, max(regexp_matches(value, '[0-9]')::INT) AS has_num, min(regexp_matches(value, '^[0-9]+\\z')::INT) AS only_num FROM pv GROUP BY column_name)"
    modes = "lm AS (SELECT column_name, l AS len_mode FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, l) AS rn FROM (SELECT column_name, length(value) AS l, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL)) WHERE rn = 1)"
    share = lambda vals: f"len(list_filter(top, lambda x: x IN ({_quoted(vals)})))::DOUBLE / len(top)"
    return f"""WITH {vc_sql()}, {wide_cte()}, {top}, {flags}, {modes},
x AS (SELECT *, {share(VALID["유효상태"])} AS s1, {share(["BUILDING", "MACHINERY", "NONE"])} AS s4 FROM wide JOIN t10 USING (column_name) JOIN fl USING (column_name) JOIN lm USING (column_name)),
m AS (SELECT column_name, list_filter([
 CASE WHEN format_cnt = 1 AND format = 'A' AND s1 >= 0.3 THEN {{'s': round(s1, 4), 'no': 0, 'r': 'status'}} END,
 CASE WHEN has_alpha = 1 AND has_num = 0 THEN {{'s': 1.0, 'no': 1, 'r': 'name'}} END,
 CASE WHEN only_num = 1 THEN {{'s': 1.0, 'no': 2, 'r': 'number'}} END,
 CASE WHEN length(format) - length(replace(format, 'A', '')) >= 4 AND has_num = 0 AND s4 >= 0.3 THEN {{'s': round(s4, 4), 'no': 3, 'r': 'segment'}} END,
 CASE WHEN len_max > 2 * len_mode OR len(top) < 3 THEN {{'s': 1.0, 'no': 4, 'r': 'wide'}} END], lambda z: z IS NOT NULL) AS ms FROM x),
u AS (SELECT column_name, unnest(ms) AS z FROM m)
SELECT m.column_name, coalesce(string_agg(z.r, '; ' ORDER BY z.s DESC, z.no), '') AS matched_rules, round(avg(z.s), 4) AS score_avg, max(z.s) AS score_max FROM m LEFT JOIN u USING (column_name) GROUP BY m.column_name"""


FLAGSHIP = {"customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}}
EDGES = [f"{side}{n}" for side in ("first", "last") for n in (1, 2, 3)]


def column_profile(spark, sf_dir):
    """The flagship: the whole profile of customer, its lists as texts."""
    out = p.profile(table(spark, sf_dir, "customer"), file_name="customer", master_type="Master")
    top = F.transform("top_values", lambda v: F.concat(v["value"], F.lit(" ("), v["cnt"].cast("string"), F.lit(")")))
    texts = {"top_values": F.array_join(top, "; "), **{f"{e}_top10": F.array_join(f"{e}_top10", "; ") for e in EDGES}}
    return out.withColumns(texts | {c: F.round(c, 4) for c in ("type_mixed", "length_vol", "duplicate", "date_share", "number_share")})


def column_profile_sql():
    shown = {t: list(cs) for t, cs in FLAGSHIP.items()}
    kinds = ", ".join(f"('{c}', '{k}')" for cs in FLAGSHIP.values() for c, k in cs.items())
    names = ("format", "format_value", "format_pct", "format_min", "format_max", "format_mode", "format_median")
    forms = ", ".join(f"max({n}) FILTER (rank = {r}) AS {n}{'' if r == 1 else f'_{r}'}" for r in (1, 2, 3) for n in names)
    flags = ", ".join(f"{'max' if q == 'any' else 'min'}(regexp_matches(value, '{e}')::INT) AS {n}" for n, e, q in patterns.FLAGS)
    parts = " UNION ALL ".join(f"SELECT column_name, '{s}{n}' AS e, {'left' if s == 'first' else 'right'}(value, {n}) AS value, cnt FROM pv" for s in ("first", "last") for n in (1, 2, 3))
    edges = ", ".join(f"coalesce(string_agg(value, '; ' ORDER BY rank) FILTER (e = '{e}'), '') AS {e}_top10" for e in EDGES)
    return f"""WITH {vc_sql(shown)}, {wide_cte()},
k(column_name, data_type) AS (VALUES {kinds}),
lm AS (SELECT column_name, l AS len_mode FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, l) AS rn FROM (SELECT column_name, length(value) AS l, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
le AS (SELECT o.column_name, count(*) AS len_cnt, count(DISTINCT length(value)) AS len_distinct, round((sum(length(value))::DOUBLE / count(*)::DOUBLE)::DECIMAL(18, 6), 1)::DOUBLE AS len_avg, any_value(len_mode)::INT AS len_mode,
 quantile_cont(length(value), 0.5)::DOUBLE AS len_median FROM long o JOIN lm USING (column_name) WHERE value IS NOT NULL GROUP BY o.column_name),
tr AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rank, sum(cnt) OVER (PARTITION BY column_name) AS n FROM pv),
tp AS (SELECT column_name, string_agg(value || ' (' || cnt || ')', '; ' ORDER BY rank) AS top_values, round((sum(cnt)::DOUBLE / any_value(n)::DOUBLE * 100)::DECIMAL(18, 6), 2)::DOUBLE AS top_pct FROM tr WHERE rank <= 10 GROUP BY column_name),
fp AS (SELECT column_name, {forms} FROM formats GROUP BY column_name), fl AS (SELECT column_name, {flags} FROM pv GROUP BY column_name),
fx AS (SELECT column_name, sum(cnt)::BIGINT AS n, {FIRST_SQL} FROM pv GROUP BY column_name),
eg AS (SELECT column_name, e, value, sum(cnt) AS cnt FROM ({parts}) GROUP BY ALL), er AS (SELECT *, row_number() OVER (PARTITION BY column_name, e ORDER BY cnt DESC, value) AS rank FROM eg),
ed AS (SELECT column_name, {edges} FROM er WHERE rank <= 10 GROUP BY column_name),
m AS (SELECT column_name, null_pct AS null_share, 100.0 - format_pct AS type_mixed, CASE WHEN len_max > 0 THEN (len_max - len_min)::DOUBLE / len_max::DOUBLE * 100 ELSE 0.0 END AS length_vol, 100.0 - unique_pct AS duplicate FROM wide),
t AS (SELECT *, list_filter([CASE WHEN null_share > 20 THEN 'High NULLs' END, CASE WHEN type_mixed > 30 THEN 'Mixed formats' END, CASE WHEN length_vol > 30 THEN 'Length volatility' END, CASE WHEN duplicate > 90 THEN 'Very low uniqueness' END], lambda x: x IS NOT NULL) AS tags FROM m),
ty AS (SELECT column_name, {_oracle_case(types.CODE_NAMES)} AS oracle_type, {detail_case()} AS detail_type FROM wide)
SELECT w.column_name, record_cnt, value_cnt, unique_cnt, null_cnt, null_pct, unique_pct, len_cnt, len_distinct, w.len_min::INT AS len_min, w.len_max::INT AS len_max, len_avg, len_mode, len_median, min_string, max_string, mode_string, w.cnt::BIGINT AS mode_cnt, median_string,
 top_values, top_pct, w.format_cnt, fp.* EXCLUDE (column_name), fl.* EXCLUDE (column_name), first_kor, first_num, first_alpha, fx.n - first_kor - first_num - first_alpha AS first_special, round(coalesce(dates, 0)::DOUBLE, 4) AS date_share, round(coalesce(numbers, 0)::DOUBLE, 4) AS number_share,
 zero AS leading_zero, lens AS trimmed_lengths, longest::INT AS trimmed_max, CASE WHEN numbers > 0 THEN p::INT END AS whole_digits, CASE WHEN numbers > 0 THEN s::INT END AS fraction_digits, ed.* EXCLUDE (column_name), data_type, oracle_type, detail_type, (detail_type = 'UNIQUE')::INT AS pk,
 null_share, round(type_mixed, 4) AS type_mixed, round(length_vol, 4) AS length_vol, round(duplicate, 4) AS duplicate, 0.0::DOUBLE AS rule_fail,
 round(greatest(0.0, least(100.0, 100.0 - (0.40 * null_share + 0.25 * type_mixed + 0.15 * length_vol + 0.10 * duplicate)))::DECIMAL(18, 6), 2)::DOUBLE AS dq_score, array_to_string(tags, ', ') AS dq_issues, len(tags)::INT AS issue_count, 'customer' AS file_name, 'Master' AS master_type
FROM wide w JOIN k USING (column_name) JOIN le USING (column_name) JOIN tp USING (column_name) JOIN fp USING (column_name) JOIN fl USING (column_name) JOIN fx USING (column_name) JOIN ed USING (column_name) JOIN t USING (column_name) JOIN ty USING (column_name)"""


QUERIES = {
    f.__name__: f
    for f in (
        column_profile, profile_counts, profile_lengths, profile_values, value_top10, format_top3, edge_top3, composition_flags, first_char_counts, oracle_type, detail_type, dq_score, quality_kpis,
        per_file_kpis, validator_rates, validator_cases, rule_validators, numeric_control_limits, rule_matches, unmatched_rules,
    )
}
ORACLES = {
    f.__name__.removesuffix("_sql"): f()
    for f in (
        column_profile_sql, profile_counts_sql, profile_lengths_sql, profile_values_sql, value_top10_sql, format_top3_sql, edge_top3_sql, composition_flags_sql, first_char_counts_sql, oracle_type_sql, detail_type_sql,
        dq_score_sql, quality_kpis_sql, per_file_kpis_sql, validator_rates_sql, validator_cases_sql, rule_validators_sql, numeric_control_limits_sql, rule_matches_sql, unmatched_rules_sql,
    )
}
