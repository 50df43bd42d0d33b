"""Queries whose tables go out to files and come back: flat files, workbooks, catalogues, rules and sets, each beside its oracle."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaspan.operators import checks, display, match, rules, score
from metaspan.operators import profile as p
from metaspan.plans.columns import COUNTS_SQL, RULES, SHOWN, VALID, VALUES_SQL, _profiles, rule_matches_sql, table, vc_sql
from metaspan.sources import readers, writers
from metaspan.sources.shared import shared_folder, stored

#: All columns of the tables that are exchanged as flat files.
WHOLE = {
    "region": {"r_regionkey": "int", "r_name": "text"},
    "nation": {"n_nationkey": "int", "n_name": "text", "n_regionkey": "int"},
    "customer": {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "money", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "int", "s_name": "text", "s_nationkey": "int", "s_acctbal": "money"},
    "part": {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "money"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "money", "o_orderdate": "time", "o_orderpriority": "text"},
    "lineitem": {
        "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "money", "l_extendedprice": "money", "l_discount": "money", "l_tax": "money",
        "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time",
    },
}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


def _exported(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with amounts as decimals and times as texts, which both engines write alike."""
    form = {"money": lambda c: c.cast("decimal(15,2)"), "time": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    return table(spark, sf_dir, name).select(*[form.get(kind, lambda c: c)(F.col(c)).alias(c) for c, kind in WHOLE[name].items()])


def _text_sql(column: str, kind: str) -> str:
    return {"money": f"{column}::DECIMAL(15, 2)::VARCHAR", "time": f"strftime({column}, '%Y-%m-%d %H:%M:%S')"}.get(kind, f"{column}::VARCHAR")


def _long_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS file_name, '{t}.{c}' AS column_name, {_text_sql(c, kind)} AS value FROM {t}" for t, cs in WHOLE.items() for c, kind in cs.items())


def flat_file_profile(spark, sf_dir):
    """Every column of seven tables, written as flat files with byte-order marks, read back in byte ranges and profiled in one shuffle."""
    parts = []
    for name in WHOLE:
        path = _folder(spark, name)
        writers.write_csv(_exported(spark, sf_dir, name), path, mark=True)
        flat = readers.read_directory(spark, path).drop("file_path", "file_name")
        parts.append(p.value_counts(flat.toDF(*[f"{name}#{c}" for c in flat.columns])))
    vc = stored(reduce(DataFrame.unionByName, parts).withColumn("column_name", F.replace("column_name", F.lit("#"), F.lit("."))), "values")
    return p.counts(vc).join(p.lengths(vc).select("column_name", "len_distinct", "len_min", "len_max", "len_avg"), "column_name", "left")


def flat_file_profile_sql():
    return f"""WITH long AS ({_long_sql()}), vc AS (SELECT column_name, value, count(*) AS cnt FROM long GROUP BY column_name, value), counts AS ({COUNTS_SQL}),
ls AS (SELECT column_name, count(DISTINCT length(value)) AS len_distinct, min(length(value))::INT AS len_min, max(length(value))::INT AS len_max, round((sum(length(value))::DOUBLE / count(*)::DOUBLE)::DECIMAL(18, 6), 1)::DOUBLE AS len_avg
 FROM long WHERE value IS NOT NULL GROUP BY column_name) SELECT * FROM counts LEFT JOIN ls USING (column_name)"""


#: What each encoding's files of legacy_encodings() say.
LABELS = {"x-windows-949": "고객 똠", "EUC-KR": "고객", None: "고객 ﬁ"}


def legacy_encodings(spark, sf_dir):
    """All customers in one folder of files of three encodings, each file decoded in its own."""
    path, whole = _folder(spark, "encodings"), table(spark, sf_dir, "customer")
    for k, (encoding, label) in enumerate(LABELS.items()):
        own = whole.where(F.pmod("c_custkey", F.lit(len(LABELS))) == k).select("c_custkey", F.concat(F.lit(label), F.lit(" "), "c_name").alias("label"))
        writers.write_csv(own, path, encoding=encoding, append=True)
    return readers.read_directory(spark, path).select("c_custkey", "label")


def legacy_encodings_sql():
    names = " ".join(f"WHEN {k} THEN '{label} '" for k, label in enumerate(LABELS.values()))
    return f"SELECT c_custkey::VARCHAR AS c_custkey, CASE c_custkey % {len(LABELS)} {names} END || c_name AS label FROM customer"


def workbook_round_trip(spark, sf_dir):
    """All orders through workbooks, with an odd text and a column that is null for some."""
    path = _folder(spark, "workbooks")
    odd = F.concat(F.lit(" <김 & \u0001_x0041_> "), "o_orderpriority")
    late = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    writers.write_excel(_exported(spark, sf_dir, "orders").withColumns({"odd": odd, "late": late, "done": F.col("o_orderstatus") == "F"}), path)
    return readers.read_excel(path, spark)


def workbook_round_trip_sql():
    cells = ", ".join(f"{_text_sql(c, kind)} AS {c}" for c, kind in WHOLE["orders"].items())
    return f"""SELECT {cells}, ' <김 & ' || chr(1) || '_x0041_> ' || o_orderpriority AS odd, CASE WHEN o_orderstatus <> 'P' THEN o_custkey::VARCHAR END AS late,
 CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE 'FALSE' END AS done FROM orders"""


def malformed_lines(spark, sf_dir):
    """Orders as lines, of which those in process have a field too many: skipped, or kept without it."""
    path, o = _folder(spark, "lines"), table(spark, sf_dir, "orders")
    line = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "P", F.lit("more")))
    o.select(line.alias("o_orderkey,o_custkey,o_orderstatus")).write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    out = [readers.read_directory(spark, path, skip_bad=skip).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey").cast("long")).alias("keys")).withColumn("skipped", F.lit(skip)) for skip in (True, False)]
    return out[0].unionByName(out[1])


def malformed_lines_sql():
    one = "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, {0} AS skipped FROM orders {1} GROUP BY o_orderstatus"
    return " UNION ALL ".join((one.format("true", "WHERE o_orderstatus <> 'P'"), one.format("false", "")))


def auto_numbers(spark, sf_dir):
    """Text columns that become numbers: by their name, by most of their values, or not at all."""
    c = table(spark, sf_dir, "customer")
    odd = lambda n, t: F.when(F.col("c_custkey") % n == 0, F.lit(t)).otherwise(F.col("c_custkey").cast("string"))
    out = readers.auto_numeric(c.select("c_custkey", odd(7, "x").alias("mostly"), odd(3, "y").alias("partly"), odd(2, "-").alias("row_cnt"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise("12").alias("blanks"), "c_name"))
    return out.select("*", F.lit(", ".join(f"{n}: {t}" for n, t in sorted(out.dtypes))).alias("types"))


def auto_numbers_sql():
    return """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey::DOUBLE END AS mostly, CASE WHEN c_custkey % 3 = 0 THEN 'y' ELSE c_custkey::VARCHAR END AS partly,
 CASE WHEN c_custkey % 2 <> 0 THEN c_custkey::DOUBLE END AS row_cnt, CASE WHEN c_custkey % 5 <> 0 THEN 12::DOUBLE END AS blanks, c_name,
 'blanks: double, c_custkey: bigint, c_name: string, mostly: double, partly: string, row_cnt: double' AS types FROM customer"""


def catalog_sources(spark, sf_dir):
    """Sources that a catalogue says are in use: a flat file of customers with flags and types in several spellings."""
    path, c = _folder(spark, "catalogue"), table(spark, sf_dir, "customer")
    flag = F.element_at(F.array(*map(F.lit, ("Y", " y ", "N", "Yes"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("Master", "Reference ", "Rule", "Other", "master"))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    writers.write_csv(c.select(flag.alias(" execution_flag "), kind.alias("type"), F.col("c_name").alias("source"), F.lit(".csv").alias("extension")), path, mark=True)
    return readers.read_catalog(readers.read_directory(spark, path)).select("source", F.trim("type").alias("type"), "extension")


def catalog_sources_sql():
    return """SELECT c_name AS source, CASE c_nationkey % 5 WHEN 0 THEN 'Master' WHEN 1 THEN 'Reference' ELSE 'Rule' END AS type, '.csv' AS extension
FROM customer WHERE c_custkey % 4 < 2 AND c_nationkey % 5 < 3"""


def valid_sets(spark, sf_dir):
    """Sets of valid values from their table: two lists and a file, the file's values those of a reference table."""
    files, path = _folder(spark, "sets"), _folder(spark, "valid")
    writers.write_csv(table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("name")), f"{files}/nations.csv")
    regions = table(spark, sf_dir, "region").agg(F.array_join(F.array_sort(F.collect_list("r_name")), ";")).scalar()
    rows = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(a).alias("valid_name"), F.lit(b).alias("ListOrFile"), (c if not isinstance(c, str) else F.lit(c)).alias("valid_list")) for a, b, c in (("status", "List", "['F', 'O', 'P']"), ("nation", "File", "nations.csv"))]))
    )
    listed = table(spark, sf_dir, "region").select(F.lit("region").alias("valid_name"), F.lit("list").alias("ListOrFile"), regions.alias("valid_list")).distinct()
    writers.write_csv(rows.unionByName(listed), path)
    found = readers.read_valid_sets(spark, path, files)
    return spark.createDataFrame([(name, value) for name, values in found.items() for value in values], "valid_name string, value string")


def valid_sets_sql():
    return "SELECT 'status' AS valid_name, unnest(['F', 'O', 'P']) AS value UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'region', r_name FROM region"


def file_rules(spark, sf_dir):
    """Rules from their table, one with a bracket too few, one not in use, applied to the profiles."""
    path = _folder(spark, "rules")
    rows = [("Y" if k % 2 else " y", name, f"({first}" if k == 1 else first, second) for k, (name, first, second) in enumerate(RULES)] + [("N", "unused", "LenMax > 0", None)]
    # one file keeps the rules' order
    writers.write_csv(spark.createDataFrame(rows, "Use_Flag string, RuleName string, rule1 string, rule2 string").coalesce(1), path)
    return rules.apply_rules(_profiles(spark, sf_dir), readers.read_rules(spark, path), VALID).select("column_name", "matched_rules", "score_avg", "score_max")


def staged_tables(spark, sf_dir):
    """Intermediate tables written under their names and read again; one that is missing is named."""
    path = _folder(spark, "stages")
    writers.write_stages(path, nations=table(spark, sf_dir, "nation"), suppliers=table(spark, sf_dir, "supplier"), flat=_exported(spark, sf_dir, "region"))
    writers.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), f"{path}/orders.csv")
    parquet = {n: f"{path}/{n}" for n in ("nations", "suppliers", "flat")}
    found = {n: spark.read.parquet(f) for n, f in parquet.items()}
    more, missing = readers.read_existing(spark, {"orders": f"{path}/orders.csv", "lost": f"{path}/lost.csv"})
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(", ".join(f"{c} {t}" for c, t in df.dtypes)).alias("columns")) for name, df in (found | more).items()]
    parts += [table(spark, sf_dir, "region").agg(F.lit(0).cast("long").alias("n")).select(F.lit(name).alias("name"), "n", F.lit("").alias("columns")) for name in missing]
    return reduce(DataFrame.unionByName, parts)


def staged_tables_sql():
    one = lambda n, t, c: f"SELECT '{n}' AS name, count(*) AS n, '{c}' AS columns FROM {t}"
    return " UNION ALL ".join((
        one("nations", "nation", "n_nationkey int, n_name string, n_regionkey int"), one("suppliers", "supplier", "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
        one("flat", "region", "r_regionkey int, r_name string"), one("orders", "orders", "o_orderkey int, o_orderstatus string"), "SELECT 'lost', 0::BIGINT, ''",
    ))


_OWNER = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS file_name" for t, cs in SHOWN.items() for c in cs)


def value_view(spark, sf_dir):
    """The view of values and their counts over the profiles."""
    return score.view(_profiles(spark, sf_dir), "value")


def value_view_sql():
    return f"""WITH {vc_sql()}, counts AS ({COUNTS_SQL}), {VALUES_SQL}, o AS ({_OWNER})
SELECT file_name, o.column_name, record_cnt, value_cnt, null_cnt, null_pct, unique_cnt, unique_pct, min_string, max_string, modes.value AS mode_string, median_string
FROM o JOIN counts USING (column_name) LEFT JOIN vals USING (column_name) LEFT JOIN modes USING (column_name)"""


def typed_columns(spark, sf_dir):
    """Types joined to profiles on path, file and column, whatever the slashes; the type's own master type wins."""
    profiles = _profiles(spark, sf_dir)
    names = profiles.where("file_name <> 'part'").select(F.lit("C:\\\\data\\tables").alias("file_path"), "file_name", "column_name", F.when(F.col("file_name") == "region", "Reference").alias("master_type"), F.lit(1).alias("known"))
    shown = profiles.select(F.lit("C:/data/tables").alias("file_path"), "file_name", "column_name", "master_type", "record_cnt", "unique_cnt")
    return match.join_types(names, shown)


def typed_columns_sql():
    return f"""WITH {vc_sql()}, counts AS ({COUNTS_SQL}), o AS ({_OWNER}) SELECT 'C:/data/tables' AS file_path, file_name, column_name, CASE WHEN file_name = 'region' THEN 'Reference' ELSE 'Master' END AS master_type,
 1 AS known, record_cnt, unique_cnt FROM o JOIN counts USING (column_name) WHERE file_name <> 'part'"""


def standard_differences(spark, sf_dir):
    """Customers' segments against a standard of their nation, the least of its segments."""
    c = table(spark, sf_dir, "customer")
    standard = c.groupBy(F.col("c_nationkey").alias("code")).agg(F.min("c_mktsegment").alias("standard_meaning")).where("code <> 3")
    return checks.standard_differences(c.select("c_custkey", F.col("c_nationkey").alias("code"), F.col("c_mktsegment").alias("meaning")), standard)


def standard_differences_sql():
    return """SELECT c_custkey, c_nationkey AS code, c_mktsegment AS meaning, standard_meaning FROM customer
JOIN (SELECT c_nationkey AS k, min(c_mktsegment) AS standard_meaning FROM customer WHERE c_nationkey <> 3 GROUP BY 1) ON k = c_nationkey WHERE c_mktsegment <> standard_meaning"""


def ordered_lines(spark, sf_dir):
    """Every line item with its place by day, then price downwards, then keys: an order of the whole table without a task that holds it."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    return display.placed(lines, F.asc("l_shipdate"), F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "place")


def ordered_lines_sql():
    return "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_shipdate, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem"


_ALL = (
    flat_file_profile, legacy_encodings, workbook_round_trip, malformed_lines, auto_numbers, catalog_sources, valid_sets, file_rules, staged_tables, value_view, typed_columns,
    standard_differences, ordered_lines,
)
file_rules_sql = rule_matches_sql
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f"{f.__name__}_sql"]() for f in _ALL}
