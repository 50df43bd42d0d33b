"""Relation, lineage, value-chain and maintenance queries over the driver tables, each beside its oracle."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaspan.operators import checks, integrity, lineage, match, rules, score, stats, valuechain
from metaspan.operators import profile as p
from metaspan.operators.profile import rounded
from metaspan.plans.columns import _profiles, data_types, detail_case, stored_counts, table, vc_sql, wide_cte
from metaspan.sources import readers
from metaspan.sources.shared import materialised, sized, stored

#: Key columns that refer to each other: table -> columns.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"],
}
#: The pairs that are compared: source, master.
PAIRS = [
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("part", "p_partkey", "customer", "c_custkey"), ("supplier", "s_suppkey", "region", "r_regionkey"),
]


def literal(spark: SparkSession, schema: str, rows) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def values_sql(names: str, rows) -> str:
    """A common table expression body of literal rows."""
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) v({names}))"


def _owner():
    return F.element_at(F.create_map(*[F.lit(x) for t, cs in KEYS.items() for c in cs for x in (c, t)]), F.col("column_name"))


def _values(vc: DataFrame, file=None) -> DataFrame:
    """What match.distinct_values() gives of columns (their table as ``file`` tells, else key columns), from their counted values."""
    return vc.select(F.lit("tables").alias("file_path"), (_owner() if file is None else file).alias("file_name"), "column_name", F.trim("value").alias("value"), "cnt").where("value IS NOT NULL AND value <> ''")


def inclusion_match(spark, sf_dir):
    pairs = literal(spark, "file_path string, file_name string, column_name string, master_path string, master_file string, master_column string, compare_length int", [("tables", a, b, "tables", c, d, 0) for a, b, c, d in PAIRS])
    return match.inclusion(pairs, _values(stored_counts(spark, sf_dir, KEYS)), 0.0).select("file_name", "column_name", "master_file", "master_column", "compare_count", "source_count", "match_pct")


def inclusion_match_sql():
    rows = [
        f"SELECT '{a}' AS file_name, '{b}' AS column_name, '{c}' AS master_file, '{d}' AS master_column, (SELECT count(DISTINCT {b}) FROM {a} WHERE {b} IN (SELECT {d} FROM {c})) AS compare_count, (SELECT count(DISTINCT {b}) FROM {a}) AS source_count"
        for a, b, c, d in PAIRS
    ]
    return f"SELECT *, round((compare_count::DOUBLE / source_count::DOUBLE * 100)::DECIMAL(18, 6), 2)::DOUBLE AS match_pct FROM ({' UNION ALL '.join(rows)})"


def _typed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Profiles of the key columns, and their values; nation and region are the reference lists."""
    from metaspan.functions import types

    vc = stored_counts(spark, sf_dir, KEYS)
    out = p.assembled(vc)
    file = _owner()
    out = types.with_types(out.withColumn("data_type", data_types(spark, sf_dir, KEYS))).withColumns({"file_name": file, "file_path": F.lit("tables"), "master_type": F.when(file.isin("nation", "region", "part"), "Reference").otherwise("Master")})
    return materialised(out, "typed"), _values(vc)


_SHOW = ["file_name", "column_name", "master_file", "master_column", "compare_count", "source_count", "match_pct"]


def reference_mapping(spark, sf_dir):
    return match.reference_mapping(*_typed(spark, sf_dir)).select(*_SHOW)


def internal_mapping(spark, sf_dir):
    return match.internal_mapping(*_typed(spark, sf_dir)).select(*_SHOW)


def mapping_cte() -> str:
    """links: matches above the limit of columns (s) with master columns (m), by the gates of candidate_pairs()."""
    owner = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS file_name, {'1' if t in ('nation', 'region', 'part') else '0'} AS ref" for t, cs in KEYS.items() for c in cs)
    # written out, so that a changed list of the library shows
    never = (
        "'Time', 'Timestamp', 'Date', 'DateTime', 'DATECHAR', 'TIME', 'TIMESTAMP', 'DATE', 'DATETIME', 'YEAR', 'YEARMONTH', 'YYMMDD', 'LATITUDE', 'LONGITUDE', "
        "'TEL', 'CELLPHONE', 'ADDRESS', 'Alpha_Flag', 'Num_Flag', 'YN_Flag', 'NUM_Flag', 'KOR_Flag', 'KOR_Name'"
    )
    return f"""{vc_sql(KEYS)}, {wide_cte()}, owner AS ({owner}), td AS (SELECT column_name, unique_cnt, {detail_case()} AS detail FROM wide),
x AS (SELECT o.file_name, o.ref, t.unique_cnt, f.* FROM formats f JOIN owner o USING (column_name) JOIN td t USING (column_name) WHERE format <> '' AND format_pct > 10 AND detail NOT IN ({never})),
cand AS (SELECT DISTINCT s.file_name, s.column_name, s.ref AS s_ref, m.file_name AS master_file, m.column_name AS master_column, m.ref AS m_ref FROM x s JOIN x m ON s.format = m.format
 WHERE s.format_median BETWEEN m.format_min AND m.format_max AND s.format_cnt < m.format_value AND NOT (s.format_cnt >= 1.5 * m.format_cnt AND s.format_cnt >= 5) AND s.unique_cnt >= 10 AND s.format_value >= 10
 AND s.column_name <> m.column_name AND s.ref = 0),
links AS (SELECT c.file_name, c.column_name, c.master_file, c.master_column, c.m_ref, count(m.value) AS compare_count, count(*) AS source_count FROM cand c JOIN pv s ON s.column_name = c.column_name
 LEFT JOIN pv m ON m.column_name = c.master_column AND m.value = s.value GROUP BY ALL),
good AS (SELECT * FROM (SELECT *, round((compare_count::DOUBLE / source_count::DOUBLE * 100)::DECIMAL(18, 6), 2)::DOUBLE AS match_pct FROM links) WHERE match_pct > 20)"""


def reference_mapping_sql():
    return f"WITH {mapping_cte()} SELECT {', '.join(_SHOW)} FROM good WHERE m_ref = 1"


def internal_mapping_sql():
    return f"WITH {mapping_cte()} SELECT {', '.join(_SHOW)} FROM good WHERE m_ref = 0"


def mapping_top3_pivot(spark, sf_dir):
    out = match.pivot_mapping(match.internal_mapping(*_typed(spark, sf_dir)))
    return out.select("file_name", "column_name", *[f"{n}_{r}" for r in (1, 2, 3) for n in ("code_file", "code_column", "matched_pct")])


def mapping_top3_pivot_sql():
    cells = ", ".join(f"max({c}) FILTER (rk = {r}) AS {n}_{r}" for r in (1, 2, 3) for n, c in (("code_file", "master_file"), ("code_column", "master_column"), ("matched_pct", "match_pct")))
    return f"""WITH {mapping_cte()}, r AS (SELECT *, row_number() OVER (PARTITION BY file_name, column_name ORDER BY match_pct DESC, compare_count DESC, master_file, master_column) AS rk FROM good WHERE m_ref = 0)
SELECT file_name, column_name, {cells} FROM r GROUP BY file_name, column_name"""


def final_mapping(spark, sf_dir):
    """The pivot and the best reference match assembled per column, with foreign-key flags."""
    typed, values = _typed(spark, sf_dir)
    out = match.final_mapping(typed, match.pivot_mapping(match.internal_mapping(typed, values)), match.reference_mapping(typed, values))
    return out.select("file_name", "column_name", "code_file_1", "code_column_1", "code_file_4", "code_column_4", "attribute", "pk", "fk")


def final_mapping_sql():
    return f"""WITH {mapping_cte()}, r AS (SELECT *, row_number() OVER (PARTITION BY file_name, column_name, m_ref ORDER BY match_pct DESC, compare_count DESC, master_file, master_column) AS rk FROM good),
one AS (SELECT file_name, column_name, master_file AS code_file_1, master_column AS code_column_1 FROM r WHERE m_ref = 0 AND rk = 1),
four AS (SELECT column_name, master_file AS code_file_4, master_column AS code_column_4 FROM r WHERE m_ref = 1 AND rk = 1), pks AS (SELECT column_name FROM td WHERE detail = 'UNIQUE')
SELECT o.file_name, o.column_name, code_file_1, code_column_1, code_file_4, code_column_4, coalesce(code_column_4, '') AS attribute, (t.detail = 'UNIQUE')::INT AS pk,
 (code_column_1 IN (SELECT column_name FROM pks) AND code_column_1 IS NOT NULL)::INT AS fk
FROM owner o JOIN td t USING (column_name) LEFT JOIN one USING (file_name, column_name) LEFT JOIN four USING (column_name)"""


#: Rules that name key columns, in the order in which they are tried.
KEY_RULES = [("identity", "UniqueCnt == ValueCnt", None), ("small code", "LenMax <= 2 and HasOnlyNum == 1", None)]


def final_mapping_rules(spark, sf_dir):
    """The final mapping with the rules that the columns match: the first of them is the attribute."""
    typed, values = _typed(spark, sf_dir)
    named = rules.apply_rules(typed, KEY_RULES)
    out = match.final_mapping(typed, match.pivot_mapping(match.internal_mapping(typed, values)), match.reference_mapping(typed, values), named)
    return out.select("file_name", "column_name", "rule", "code_column_4", "attribute", "fk")


def final_mapping_rules_sql():
    return f"""WITH {mapping_cte()}, r AS (SELECT *, row_number() OVER (PARTITION BY file_name, column_name, m_ref ORDER BY match_pct DESC, compare_count DESC, master_file, master_column) AS rk FROM good),
one AS (SELECT file_name, column_name, master_column AS code_column_1 FROM r WHERE m_ref = 0 AND rk = 1), four AS (SELECT column_name, master_column AS code_column_4 FROM r WHERE m_ref = 1 AND rk = 1), pks AS (SELECT column_name FROM td WHERE detail = 'UNIQUE'),
named AS (SELECT column_name, array_to_string(list_filter([CASE WHEN unique_cnt = value_cnt THEN 'identity' END, CASE WHEN len_max <= 2 THEN 'small code' END], lambda x: x IS NOT NULL), '; ') AS rule FROM wide)
SELECT o.file_name, o.column_name, rule, code_column_4, coalesce(nullif(split_part(rule, ';', 1), ''), code_column_4, '') AS attribute, (code_column_1 IN (SELECT column_name FROM pks) AND code_column_1 IS NOT NULL)::INT AS fk
FROM owner o JOIN named USING (column_name) LEFT JOIN one USING (file_name, column_name) LEFT JOIN four USING (column_name)"""


#: Key columns whose values are also tried with a validator: table, column, validator, the same in SQL.
CHECKED = [("customer", "c_nationkey", "LATITUDE", "abs({0}) <= 90"), ("supplier", "s_nationkey", "LONGITUDE", "abs({0}) <= 180"), ("orders", "o_custkey", "YEAR", "{0} BETWEEN 1900 AND 2999")]


def all_mappings(spark, sf_dir):
    """Internal, reference and rule mappings in one table, told apart by their kind."""
    typed, values = _typed(spark, sf_dir)
    rates = reduce(DataFrame.unionByName, [rules.validator_rates(table(spark, sf_dir, t), {c: v}) for t, c, v, _ in CHECKED])
    out = match.concat_mappings(internal=match.internal_mapping(typed, values), reference=match.reference_mapping(typed, values), rule=match.rule_mapping(typed, rates))
    return out.select("mapping_kind", *_SHOW)


def all_mappings_sql():
    rate = "SELECT 'rule' AS mapping_kind, '{t}' AS file_name, '{c}' AS column_name, '' AS master_file, '{v}' AS master_column, count(*) FILTER ({test}) AS compare_count, count(*) AS source_count FROM {t} WHERE {c} IS NOT NULL"
    rows = " UNION ALL ".join(rate.format(t=t, c=c, v=v, test=test.format(c)) for t, c, v, test in CHECKED)
    return f"""WITH {mapping_cte()}, r AS (SELECT *, round((compare_count::DOUBLE / source_count::DOUBLE * 100)::DECIMAL(18, 6), 2)::DOUBLE AS match_pct FROM ({rows}))
SELECT CASE WHEN m_ref = 1 THEN 'reference' ELSE 'internal' END AS mapping_kind, {", ".join(_SHOW)} FROM good UNION ALL SELECT mapping_kind, {", ".join(_SHOW)} FROM r WHERE match_pct > 20"""


#: The tables of the graph with their columns. A column goes by its name without the table's letter, under which tables share it.
GRAPH = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value"],
}


def _shared_name(column: str) -> str:
    return column[2:] if column[1] == "_" else column


def _graph(spark, sf_dir) -> DataFrame:
    """file, column, pk, type of the tables' columns: keys and lengths from their profiles, the rest from their schemas."""
    parts, tables = [], {name: table(spark, sf_dir, name) for name in GRAPH}
    for name, columns in GRAPH.items():
        df = tables[name]
        kinds = {c: "NUMBER" if t in ("int", "bigint", "double") else t.upper().removesuffix("_NTZ") for c, t in df.dtypes}
        for c in columns:
            # values as they are, not their texts: only the lengths of texts are asked for
            vc = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("cnt"))
            kind = F.concat(F.lit("VARCHAR2("), F.max(F.length("value")), F.lit(")")) if kinds[c] == "STRING" else F.lit(kinds[c])
            parts.append(vc.agg(F.count("value").alias("unique_cnt"), F.sum("cnt").alias("record_cnt"), kind.alias("type")).select(
                F.lit(name).alias("file"), F.lit(_shared_name(c)).alias("column"), (F.col("unique_cnt") == F.col("record_cnt")).cast("int").alias("pk"), "type",
            ))
    with sized(spark, max(df.count() for df in tables.values())):
        return materialised(reduce(DataFrame.unionByName, parts), "graph")


def graph_sql() -> str:
    """The same table, from the columns themselves."""
    kind = "CASE typeof(any_value({0})) WHEN 'VARCHAR' THEN 'VARCHAR2(' || max(length(CAST({0} AS VARCHAR))) || ')' WHEN 'TIMESTAMP' THEN 'TIMESTAMP' ELSE 'NUMBER' END"
    return "(" + " UNION ALL ".join(f"SELECT '{t}' AS file, '{_shared_name(c)}' AS col, (count(DISTINCT {c}) = count(*))::INT AS pk, {kind.format(c)} AS type FROM {t}" for t, cs in GRAPH.items() for c in cs) + ")"


def _references(spark, sf_dir) -> DataFrame:
    """a, ac, b, bc, weight: references between columns, weighted by how many of their values the tables share."""
    shared = lambda c: F.when(F.col(c).rlike("^[a-z]_"), F.substr(c, F.lit(3))).otherwise(F.col(c))
    found = inclusion_match(spark, sf_dir)
    return found.select(F.col("file_name").alias("a"), shared("column_name").alias("ac"), F.col("master_file").alias("b"), shared("master_column").alias("bc"), F.col("match_pct").alias("weight"))


def references_sql() -> str:
    return f"(SELECT file_name AS a, column_name[3:] AS ac, master_file AS b, master_column[3:] AS bc, match_pct AS w FROM ({inclusion_match_sql()}))"


def _edges(spark, sf_dir) -> DataFrame:
    node = lambda f, c: F.struct(F.col(f).alias("file"), F.col(c).alias("column"), F.lit("Master").alias("type"))
    return materialised(_references(spark, sf_dir).select(node("a", "ac").alias("src"), node("b", "bc").alias("dst"), "weight"), "edges")


def fk_chain_paths(spark, sf_dir):
    return lineage.levels(lineage.chains(_edges(spark, sf_dir))).select("level_0", "level_1", "level_2", "level_3", "relationship", "depth", "depth_internal")


CHAINS_SQL = f"""refs AS {references_sql()}, edge AS (SELECT DISTINCT a || '.' || ac AS s, b || '.' || bc AS d FROM refs WHERE w IS NULL OR w > 50),
walk AS (SELECT [s] AS path FROM edge GROUP BY s UNION ALL SELECT list_append(path, d) FROM walk JOIN edge ON s = path[-1] WHERE NOT list_contains(path, d) AND len(path) < 10),
chain AS (SELECT path FROM walk w WHERE len(path) > 1 AND NOT EXISTS (SELECT 1 FROM edge WHERE s = w.path[-1] AND NOT list_contains(w.path, d)))"""


def fk_chain_paths_sql():
    return f"""WITH RECURSIVE {CHAINS_SQL} SELECT path[1] AS level_0, path[2] AS level_1, path[3] AS level_2, path[4] AS level_3, array_to_string(path, ' -> ') AS relationship, (len(path) - 1)::INT AS depth, (len(path) - 1)::INT AS depth_internal FROM chain"""


def path_relations(spark, sf_dir):
    """Table pairs parsed back from path texts."""
    return lineage.table_pairs(lineage.parse_relationships(lineage.levels(lineage.chains(_edges(spark, sf_dir)))))


STEPS_SQL = "steps AS (SELECT DISTINCT path[i] AS c, path[i + 1] AS p FROM (SELECT path, unnest(range(1, len(path))) AS i FROM chain)), rel AS (SELECT split_part(c, '.', 1) AS child_file, split_part(c, '.', 2) AS cc, split_part(p, '.', 1) AS parent_file, split_part(p, '.', 2) AS pc FROM steps)"


def path_relations_sql():
    return f"WITH RECURSIVE {CHAINS_SQL}, {STEPS_SQL} SELECT child_file, parent_file, string_agg(DISTINCT cc, ', ' ORDER BY cc) AS fk_columns, string_agg(DISTINCT pc, ', ' ORDER BY pc) AS pk_columns FROM rel GROUP BY child_file, parent_file"


def related_files(spark, sf_dir):
    return lineage.related_files(lineage.parse_relationships(lineage.levels(lineage.chains(_edges(spark, sf_dir)))))


def related_files_sql():
    return f"""WITH RECURSIVE {CHAINS_SQL}, {STEPS_SQL}, both_ways AS (SELECT child_file AS f, parent_file AS o FROM rel UNION SELECT parent_file, child_file FROM rel)
SELECT f AS file, count(DISTINCT o) AS related_cnt, string_agg(DISTINCT o, ', ' ORDER BY o) AS related_files FROM both_ways WHERE f <> o GROUP BY f"""


def table_summary(spark, sf_dir):
    return lineage.table_summary(lineage.parse_relationships(lineage.levels(lineage.chains(_edges(spark, sf_dir)))))


def table_summary_sql():
    return f"""WITH RECURSIVE {CHAINS_SQL}, {STEPS_SQL}, t AS (SELECT child_file AS file, cc AS fk, parent_file AS parent, NULL::VARCHAR AS child FROM rel UNION ALL SELECT parent_file, NULL, NULL, child_file FROM rel)
SELECT file, coalesce(string_agg(DISTINCT fk, ', ' ORDER BY fk), '') AS fk_columns, coalesce(string_agg(DISTINCT parent, ', ' ORDER BY parent), '') AS parents, coalesce(string_agg(DISTINCT child, ', ' ORDER BY child), '') AS children, count(*) AS edge_cnt FROM t GROUP BY file"""


GRAPH_SQL = f"""g AS {graph_sql()},
shared AS (SELECT x.file AS a, y.file AS b, x.col AS col, x.pk AS a_pk, y.pk AS b_pk FROM g x JOIN g y USING (col) WHERE x.file < y.file AND (x.pk = 1 OR y.pk = 1)),
link AS (SELECT DISTINCT a, b FROM shared UNION SELECT DISTINCT b, a FROM shared),
reach(start, tab, level) AS (SELECT DISTINCT file, file, 0 FROM g UNION SELECT start, link.b, level + 1 FROM reach JOIN link ON link.a = tab WHERE level < {{}}),
lev AS (SELECT start, tab, min(level) AS level FROM reach GROUP BY start, tab)"""


def physical_hierarchy(spark, sf_dir):
    return lineage.physical_hierarchy(_graph(spark, sf_dir))


def physical_hierarchy_sql():
    return f"""WITH RECURSIVE {GRAPH_SQL.format(3)} SELECT start AS file, count(*) FILTER (level = 1) AS level_1_cnt, count(*) FILTER (level = 2) AS level_2_cnt, count(*) FILTER (level = 3) AS level_3_cnt,
 coalesce(array_to_string(list_sort(list(tab) FILTER (level > 0))[1:5], ', '), '') AS related_list FROM lev GROUP BY start"""


def related_tables(spark, sf_dir):
    """Tables within five hops of two anchors."""
    links = lineage.shared_columns(_graph(spark, sf_dir)).select("a", "b").distinct()
    return lineage.neighbourhood(links, literal(spark, "start string", [("lineitem",), ("region",)]), 5)


def related_tables_sql():
    return f"""WITH RECURSIVE {GRAPH_SQL.format(5)} SELECT start, tab AS "table", level FROM lev WHERE start IN ('lineitem', 'region')"""


#: Columns that make no relation in a diagram.
EXCLUDED = ["name", "nationkey"]


def related_without_excluded(spark, sf_dir):
    """Tables that share a key column when some columns are excluded, and the steps from orders over what is left."""
    shared = lineage.shared_columns(_graph(spark, sf_dir), literal(spark, "column string", [(c,) for c in EXCLUDED]))
    reached = lineage.neighbourhood(shared.select("a", "b").distinct(), literal(spark, "start string", [("orders",)]), 4).select(F.col("table").alias("b"), "level")
    return shared.select("a", "b", "column").join(reached, "b", "left")


def related_without_excluded_sql():
    out = ", ".join(f"'{c}'" for c in EXCLUDED)
    return f"""WITH RECURSIVE g AS {graph_sql()},
sh AS (SELECT DISTINCT x.file AS a, y.file AS b, x.col FROM g x JOIN g y ON x.col = y.col AND x.file < y.file AND (x.pk = 1 OR y.pk = 1) WHERE x.col NOT IN ({out})),
link AS (SELECT a, b FROM sh UNION SELECT b, a FROM sh), walk(t, k) AS (SELECT 'orders', 0 UNION SELECT link.b, k + 1 FROM walk JOIN link ON link.a = t WHERE k < 4), lev AS (SELECT t, min(k) AS level FROM walk GROUP BY t)
SELECT a, b, col AS "column", level FROM sh LEFT JOIN lev ON lev.t = sh.b"""


def physical_edges(spark, sf_dir, graph=None):
    g = _graph(spark, sf_dir) if graph is None else graph
    links = lineage.shared_columns(g).select("a", "b").distinct()
    levels = lineage.neighbourhood(links, literal(spark, "start string", [("lineitem",)]), 4).select("table", "level")
    return lineage.physical_edges(g, levels)


EDGES_SQL = """near AS (SELECT s.*, x.level AS la, y.level AS lb FROM shared s JOIN lev x ON x.tab = s.a AND x.start = 'lineitem' JOIN lev y ON y.tab = s.b AND y.start = 'lineitem' WHERE abs(x.level - y.level) <= 1),
dir AS (SELECT *, CASE WHEN b_pk = 1 AND a_pk = 0 THEN true WHEN a_pk = 1 AND b_pk = 0 THEN false ELSE la <= lb END AS fwd FROM near),
phys AS (SELECT DISTINCT CASE WHEN fwd THEN a ELSE b END AS src, CASE WHEN fwd THEN b ELSE a END AS dst, col FROM dir)"""


def physical_edges_sql():
    return f"""WITH RECURSIVE {GRAPH_SQL.format(4)}, {EDGES_SQL} SELECT src, dst, col AS "column" FROM phys"""


def edge_classification(spark, sf_dir):
    logical = _references(spark, sf_dir).withColumnsRenamed({"a": "src", "b": "dst"})
    return lineage.classify_edges(physical_edges(spark, sf_dir), logical)


def edge_classification_sql():
    return f"""WITH RECURSIVE {GRAPH_SQL.format(4)}, {EDGES_SQL}, refs AS (SELECT a AS src, b AS dst FROM {references_sql()}),
t AS (SELECT src, dst, 1 AS p, 0 AS l FROM phys UNION ALL SELECT src, dst, 0, 1 FROM refs), u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(p) AS p, max(l) AS l FROM t WHERE src <> dst GROUP BY 1, 2)
SELECT a, b, CASE WHEN p = 1 AND l = 1 THEN 'both' WHEN p = 1 THEN 'physical' ELSE 'logical' END AS edge_kind FROM u"""


def erd_info(spark, sf_dir):
    logical = _references(spark, sf_dir).toDF("child_file", "child_column", "parent_file", "parent_column", "weight")
    graph = _graph(spark, sf_dir)
    return lineage.erd_info(graph, physical_edges(spark, sf_dir, graph), logical)


def erd_info_sql():
    return f"""WITH RECURSIVE {GRAPH_SQL.format(4)}, {EDGES_SQL}, refs AS {references_sql()}, lo AS (SELECT a AS file, ac AS col FROM refs UNION SELECT b, bc FROM refs), ph AS (SELECT src AS file, col FROM phys UNION SELECT dst, col FROM phys),
t AS (SELECT g.*, (EXISTS (SELECT 1 FROM ph WHERE ph.file = g.file AND ph.col = g.col))::INT AS physical, (EXISTS (SELECT 1 FROM lo WHERE lo.file = g.file AND lo.col = g.col))::INT AS logical FROM g)
SELECT file, col AS "column", pk, type, physical, logical, (logical = 1 AND physical = 0)::INT AS "check" FROM t"""


def erd_frame(spark, sf_dir):
    """The rows of a diagram around two anchors in its three modes."""
    graph = _graph(spark, sf_dir)
    physical = materialised(physical_edges(spark, sf_dir, graph), "physical")
    # a row per pair: found once for the three modes
    logical = materialised(_references(spark, sf_dir).toDF("child_file", "child_column", "parent_file", "parent_column", "weight").drop("weight"), "logical")
    anchors = literal(spark, "file string", [("orders",), ("nation",)])
    frames = [lineage.erd_frame(graph, physical, logical, anchors, mode).withColumn("mode", F.lit(mode)) for mode in lineage.ERD_MODES]
    return reduce(DataFrame.unionByName, frames)


def erd_frame_sql():
    return f"""WITH RECURSIVE {GRAPH_SQL.format(4)}, {EDGES_SQL}, refs AS {references_sql()},
rel AS (SELECT src AS file, col, dst AS rf, col AS rc, 1 AS p, 0 AS l FROM phys UNION ALL SELECT dst, col, src, col, 1, 0 FROM phys UNION ALL SELECT a, ac, b, bc, 0, 1 FROM refs UNION ALL SELECT b, bc, a, ac, 0, 1 FROM refs),
modes(mode, wp, wl) AS (VALUES ('physical', 1, 0), ('logical', 0, 1), ('both', 1, 1)),
r AS (SELECT mode, file, col, rf, rc, max(p) AS p, max(l) AS l FROM rel, modes WHERE p * wp + l * wl > 0 GROUP BY ALL),
x AS (SELECT m.mode, g.file, g.col, g.pk, r.rf, r.rc, coalesce(p, 0) AS p, coalesce(l, 0) AS l FROM g CROSS JOIN modes m LEFT JOIN r ON r.mode = m.mode AND r.file = g.file AND r.col = g.col)
SELECT mode, file, col AS "column", pk, (rf IS NOT NULL)::INT AS fk, p AS physical, l AS logical, (p = 1 AND l = 1)::INT AS "both", (l = 1 AND p = 0)::INT AS "check",
 coalesce(rf, '') AS related_file, coalesce(rc, '') AS related_column, (file IN ('orders', 'nation'))::INT AS anchor FROM x WHERE rf IS NOT NULL OR pk = 1 OR file IN ('orders', 'nation')"""


#: Part of the customers' keys that some orders are given a mark on, so that no customer has them, and the like for days.
LOST, BAD_DAYS = 10, 7


def _planted(spark, sf_dir) -> DataFrame:
    """Orders with orphans planted in a derived key, and days of which some are none."""
    o = table(spark, sf_dir, "orders")
    ref = F.when(F.col("o_orderkey") % LOST == 0, F.concat(F.lit("X"), "o_custkey")).otherwise(F.col("o_custkey").cast("string"))
    day = F.when(F.col("o_orderkey") % BAD_DAYS == 0, F.lit("20240230")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select("o_orderkey", ref.alias("o_ref"), day.alias("o_day"), "o_totalprice")


def integrity_kpis(spark, sf_dir):
    """Key figures of issues in a profile with counters: orphans of a reference, dates that are none, values outside control limits."""
    orders, customer = _planted(spark, sf_dir).drop("o_orderkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    file, kinds = F.when(F.col("column_name").isin(orders.columns), "orders").otherwise("customer"), dict(orders.dtypes + customer.dtypes)
    # counted once; the profile of both tables and all counters are made from the counts
    with sized(spark, max(orders.count(), customer.count())):
        vc = stored(p.value_counts_apart(orders).unionByName(p.value_counts_apart(customer)), "values")
    both = p.profile_counted(vc, kinds, file, "Master").withColumn("file_path", F.lit("tables"))
    values = _values(vc.where(F.col("column_name").isin("o_ref", "c_custkey")), file)
    pair = literal(spark, "file_path string, file_name string, column_name string, master_path string, master_file string, master_column string, compare_length int", [("tables", "orders", "o_ref", "tables", "customer", "c_custkey", 0)])
    lost = integrity.orphans(match.inclusion(pair, values))
    dates = integrity.date_conflicts(vc.where("column_name = 'o_day'"), {"o_day": "DATECHAR"})
    limits = stats.control_limits_counted(vc, {c: kinds[c] for c in ("o_totalprice", "c_acctbal")})
    return score.quality_kpis(integrity.with_counters(both, lost, dates, limits)).where("issue IN ('fk_mismatch', 'date_mismatch', 'below_lcl', 'above_ucl')")


def integrity_kpis_sql():
    lim = lambda t, c, f, s: f"(SELECT count(*) > 0 FROM {t}, (SELECT avg({c}) {s} 3 * stddev_samp({c}) AS x FROM {t}) WHERE {c} {f} x)::INT"
    row = lambda issue, *cells: f"SELECT '{issue}' AS issue, {' + '.join(cells)} AS files, {' + '.join(cells)} AS columns"
    rows = " UNION ALL ".join((
        row("fk_mismatch", f"(SELECT count(*) > 0 FROM orders WHERE o_orderkey % {LOST} = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer))::INT"),
        row("date_mismatch", f"(SELECT count(*) > 0 FROM orders WHERE o_orderkey % {BAD_DAYS} = 0)::INT"),
        row("below_lcl", lim("orders", "o_totalprice", "<", "-"), lim("customer", "c_acctbal", "<", "-")), row("above_ucl", lim("orders", "o_totalprice", ">", "+"), lim("customer", "c_acctbal", ">", "+")),
    ))
    return f"SELECT issue, files::BIGINT AS files, columns::BIGINT AS columns, round((columns / 5 * 100)::DECIMAL(18, 6), 2)::DOUBLE AS columns_pct FROM ({rows})"


def orphan_rows(spark, sf_dir):
    """Rows of orders by whether their derived key has a customer."""
    orders, customer = _planted(spark, sf_dir), table(spark, sf_dir, "customer").select("c_custkey")
    values = match.distinct_values({("tables", "orders"): orders, ("tables", "customer"): customer}, {("tables", "orders"): ["o_ref"], ("tables", "customer"): ["c_custkey"]})
    pair = literal(spark, "file_path string, file_name string, column_name string, master_path string, master_file string, master_column string, compare_length int", [("tables", "orders", "o_ref", "tables", "customer", "c_custkey", 0)])
    return integrity.orphans(match.inclusion(pair, values)).drop("file_path")


def orphan_rows_sql():
    ref = f"CASE WHEN o_orderkey % {LOST} = 0 THEN 'X' || o_custkey ELSE o_custkey::VARCHAR END"
    return f"""WITH x AS (SELECT count(*) AS source_rows, count(*) FILTER ({ref} IN (SELECT c_custkey::VARCHAR FROM customer)) AS matched_rows FROM orders)
SELECT 'orders' AS file_name, 'o_ref' AS column_name, 'customer.c_custkey' AS master, source_rows, matched_rows, source_rows - matched_rows AS orphan_rows,
 round((matched_rows / source_rows * 100)::DECIMAL(18, 6), 2)::DOUBLE AS matched_rows_pct, source_rows - matched_rows AS fk_mismatch FROM x"""


def type_consistency(spark, sf_dir):
    return lineage.type_consistency(_graph(spark, sf_dir))


def type_consistency_sql():
    return f"""WITH g AS {graph_sql()} SELECT col AS "column", type, count(DISTINCT file) AS table_cnt, string_agg(DISTINCT file, ', ' ORDER BY file) AS tables FROM g
WHERE col IN (SELECT col FROM g GROUP BY col HAVING count(DISTINCT type) > 1) GROUP BY col, type"""


def table_connection_counts(spark, sf_dir):
    kept = literal(spark, "column string, exclusive int", [("name", 1), ("orderdate", 0), ("shipdate", None)])
    return lineage.exclusions(lineage.connection_counts(_graph(spark, sf_dir)), kept)


def table_connection_counts_sql():
    return f"""WITH g AS {graph_sql()}, n AS (SELECT col, type, count(DISTINCT file) AS n FROM g GROUP BY col, type),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY type IN ('DATE', 'TIMESTAMP') DESC, n DESC, type) AS rn FROM n)
SELECT r.col AS "column", (SELECT count(DISTINCT file) FROM g WHERE g.col = r.col) AS connection_cnt, type,
 CASE col WHEN 'name' THEN 1 WHEN 'orderdate' THEN 0 ELSE (type IN ('DATE', 'TIMESTAMP'))::INT END AS exclusive FROM r WHERE rn = 1"""


# value chain: nations as industries, market segments as activities, order priorities as systems, customers as files


def _chain_tables(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    mapping = orders.select(F.col("n_name").alias("industry"), F.col("c_name").alias("file_name"), F.col("c_mktsegment").alias("activity"), F.col("o_orderpriority").alias("system")).distinct()
    acts = customer.groupBy(F.col("n_name").alias("industry"), F.col("c_mktsegment").alias("activity")).agg(F.min("c_custkey").alias("activity_seq"), F.lit("Primary").alias("activity_type"))
    systems = mapping.select("industry", "system").distinct().withColumn("system_seq", F.ascii("system"))
    return mapping, acts, systems


CHAIN_SQL = """cn AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey),
mapping AS (SELECT DISTINCT n_name AS industry, c_name AS file_name, c_mktsegment AS activity, o_orderpriority AS system FROM orders JOIN cn ON o_custkey = c_custkey),
acts AS (SELECT n_name AS industry, c_mktsegment AS activity, min(c_custkey) AS activity_seq FROM cn GROUP BY 1, 2)"""


def industry_kpis(spark, sf_dir):
    mapping, acts, systems = _chain_tables(spark, sf_dir)
    return valuechain.industry_kpis(acts, systems, mapping)


def industry_kpis_sql():
    return f"""WITH {CHAIN_SQL}, i AS (SELECT industry FROM mapping UNION SELECT industry FROM acts) SELECT industry, (SELECT count(DISTINCT activity) FROM acts a WHERE a.industry = i.industry) AS activity_cnt,
 (SELECT count(DISTINCT system) FROM mapping m WHERE m.industry = i.industry) AS system_cnt, (SELECT count(DISTINCT file_name) FROM mapping m WHERE m.industry = i.industry) AS file_cnt FROM i"""


def files_per_group(spark, sf_dir):
    mapping, acts, systems = _chain_tables(spark, sf_dir)
    rich = valuechain.enrich(mapping, acts, systems)
    return valuechain.files_per(rich, "activity").select(F.lit("activity").alias("kind"), F.col("activity").alias("name"), "file_cnt").unionByName(valuechain.files_per(rich, "system").select(F.lit("system").alias("kind"), F.col("system").alias("name"), "file_cnt"))


def files_per_group_sql():
    return f"WITH {CHAIN_SQL} SELECT 'activity' AS kind, activity AS name, count(DISTINCT file_name) AS file_cnt FROM mapping GROUP BY activity UNION ALL SELECT 'system', system, count(DISTINCT file_name) FROM mapping GROUP BY system"


def activity_edges(spark, sf_dir):
    return valuechain.consecutive(_chain_tables(spark, sf_dir)[1])


def activity_edges_sql():
    return f"WITH {CHAIN_SQL}, e AS (SELECT industry, activity AS src, lead(activity) OVER (PARTITION BY industry ORDER BY activity_seq, activity) AS dst FROM acts) SELECT * FROM e WHERE dst IS NOT NULL"


def system_activity_links(spark, sf_dir):
    return valuechain.links(_chain_tables(spark, sf_dir)[0], "system", "activity")


def system_activity_links_sql():
    return f"WITH {CHAIN_SQL} SELECT DISTINCT industry, system AS src, activity AS dst FROM mapping"


# maintenance and set operations


def upsert_slice(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)).where("o_orderkey % 2 = 0")
    return valuechain.replace_slice(orders, "o_orderstatus", "F", new)


def upsert_slice_sql():
    return "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' UNION ALL SELECT o_orderkey, o_orderstatus, 0.0::DOUBLE FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0"


def append_numbered(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_regionkey", "n_name", "n_nationkey")
    new = table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.lit("new "), "n_name").alias("n_name"), F.lit(None).cast("int").alias("n_nationkey")).where("n_regionkey < 2")
    return valuechain.append_numbered(nation, new, "n_regionkey", "n_nationkey")


def append_numbered_sql():
    return """SELECT n_regionkey, n_name, n_nationkey FROM nation UNION ALL SELECT n_regionkey, 'new ' || n_name,
 ((SELECT max(n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey) + row_number() OVER (PARTITION BY n_regionkey ORDER BY 'new ' || n_name))::INT FROM nation n WHERE n_regionkey < 2"""


def semi_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


def semi_filter_sql():
    return "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"


def anti_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


def anti_filter_sql():
    return "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"


def union_distinct(spark, sf_dir):
    return valuechain.industries(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("industry")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("industry")), table(spark, sf_dir, "region").select(F.col("r_name").alias("industry")))


def union_distinct_sql():
    return "SELECT c_mktsegment AS industry FROM customer UNION SELECT n_name FROM nation UNION SELECT r_name FROM region"


def ambiguous_codes(spark, sf_dir):
    return checks.ambiguous(table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment"), "c_nationkey", "c_mktsegment")


def ambiguous_codes_sql():
    return "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS value_cnt, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS value_list FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1"


CONTRACT = [
    {"column": "o_*key", "max_null_pct": 0, "min": 0}, {"file": "orders", "column": "o_orderstatus", "regex": "^[FOP]\\z", "max_length": 1}, {"column": "o_totalprice", "min": 1000, "max": 400000, "severity": "warning"},
    {"file": "other*", "column": "*", "max_null_pct": 0},
]


def contract_checks(spark, sf_dir):
    return checks.contract(table(spark, sf_dir, "orders"), "orders", CONTRACT)


def contract_checks_sql():
    row = lambda c, r, s, bad: f"SELECT '{c}' AS column_name, '{r}' AS rule, '{s}' AS severity, count(*) AS checked, count(*) FILTER ({bad}) AS failed FROM orders"
    rows = [
        *[row(c, "max_null_pct", "error", f"{c} IS NULL") for c in ("o_orderkey", "o_custkey")], *[row(c, "min", "error", f"{c} < 0") for c in ("o_orderkey", "o_custkey")],
        row("o_orderstatus", "regex", "error", "NOT regexp_matches(o_orderstatus, '^[FOP]\\z')"), row("o_orderstatus", "max_length", "error", "length(o_orderstatus) > 1"),
        row("o_totalprice", "min", "warning", "o_totalprice < 1000"), row("o_totalprice", "max", "warning", "o_totalprice > 400000"),
    ]
    return f"SELECT *, failed = 0 AS passed FROM ({' UNION ALL '.join(rows)})"


def contract_report(spark, sf_dir):
    """Customers against the data contract in the file beside this one."""
    config = readers.read_config(os.path.join(os.path.dirname(__file__), "contract.yaml"))
    return checks.contract_report(table(spark, sf_dir, "customer"), "customer", config)


def contract_report_sql():
    row = lambda c, r, s, w, most, bad: f"SELECT '{c}' AS column_name, '{r}' AS rule, '{s}' AS severity, {w}::DOUBLE AS importance, count(*) AS checked, count(*) FILTER ({bad}) AS failed, {most} AS most FROM customer"
    rows = [
        row("c_custkey", "max_null_pct", "high", 1.8, 0, "c_custkey IS NULL"), row("c_custkey", "min", "high", 1.8, 0, "c_custkey < 1"), row("c_name", "max_null_pct", "medium", 1, 5, "c_name IS NULL"),
        row("c_name", "min_length", "medium", 1, 0, "length(c_name) < 10"), row("c_name", "max_length", "medium", 1, 0, "length(c_name) > 18"), row("c_name", "regex", "medium", 1, 0, "NOT regexp_matches(c_name, '^Customer#[0-9]+\\z')"),
        row("c_nationkey", "max_null_pct", "high", 2.5, 0, "c_nationkey IS NULL"), row("c_nationkey", "min", "high", 2.5, 0, "c_nationkey < 0"), row("c_nationkey", "max", "high", 2.5, 0, "c_nationkey > 19"),
        row("c_acctbal", "max_null_pct", "medium", 1, 5, "c_acctbal IS NULL"), row("c_mktsegment", "max_null_pct", "low", 1, 5, "c_mktsegment IS NULL"),
        row("c_mktsegment", "values", "low", 1, 0, "c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')"),
    ]
    return f"SELECT column_name, rule, severity, checked, failed, failed * 100 <= most * checked AS passed, importance, round(least(100, failed * 100.0 / checked * importance)::DECIMAL(18, 6), 2)::DOUBLE AS weighted_pct FROM ({' UNION ALL '.join(rows)})"


def migration_outcome(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return checks.migration_outcome(orders, orders.where("o_orderstatus <> 'P'"), ["o_custkey"], ["o_orderkey"])


def migration_outcome_sql():
    same = lambda e: f"CASE WHEN (SELECT {e} FROM orders) = (SELECT {e} FROM orders WHERE o_orderstatus <> 'P') THEN 'same' ELSE 'differs' END"
    return f"SELECT {same('count(*)')} AS row_status, 'same' AS column_status, {same('sum(o_orderkey)')} AS sum_status, {same('count(DISTINCT o_custkey)')} AS dimension_status"


def migration_cases(spark, sf_dir):
    """Three tables that orders could have become: columns in another order, some prices raised, some rows lost."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    raised = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") * 1.5).otherwise(F.col("o_totalprice"))
    made = {"same": orders.select("o_totalprice", "o_orderkey", "o_orderstatus", "o_custkey"), "raised": orders.withColumn("o_totalprice", raised), "lost": orders.where("o_orderstatus <> 'P'")}
    found = [checks.migration_case(orders, after, ["o_custkey"], ["o_totalprice"], "o_orderkey").withColumn("variant", F.lit(name)) for name, after in made.items()]
    return reduce(DataFrame.unionByName, found).select("variant", "case", "right", "rows_before", "rows_after", "keys_changed", "measures_changed", "totals_agree", "rows_agree")


def migration_cases_sql():
    after = {"same": ("o_totalprice", "true"), "raised": ("CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 1.5 ELSE o_totalprice END", "true"), "lost": ("o_totalprice", "o_orderstatus <> 'P'")}
    side = lambda price, kept: f"(SELECT o_custkey AS k, count(*) AS n, sum(({price})::DECIMAL(28, 6)) AS m FROM orders WHERE {kept} GROUP BY 1)"
    rows = " UNION ALL ".join(f"SELECT '{v}' AS variant, a.k AS ka, b.k AS kb, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb FROM {side('o_totalprice', 'true')} a FULL JOIN {side(p_, kept)} b ON a.k = b.k" for v, (p_, kept) in after.items())
    return f"""WITH x AS ({rows}), y AS (SELECT variant, sum(na)::BIGINT AS rows_before, sum(nb)::BIGINT AS rows_after, count(*) FILTER (ka IS NULL OR kb IS NULL) AS keys_changed, count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL AND ma <> mb) AS measures_changed,
 coalesce(sum(ma), 0) = coalesce(sum(mb), 0) AS totals_agree, bool_and(na IS NOT DISTINCT FROM nb AND ma IS NOT DISTINCT FROM mb) AS rows_agree FROM x GROUP BY variant),
z AS (SELECT *, CASE WHEN rows_agree THEN 2 WHEN rows_after < rows_before AND totals_agree THEN 18 WHEN rows_after < rows_before THEN 19 WHEN keys_changed = 0 AND measures_changed > 0 AND NOT totals_agree THEN 12 ELSE 0 END AS c FROM y)
SELECT variant, c AS "case", c BETWEEN 1 AND 10 AS "right", rows_before, rows_after, keys_changed, measures_changed, totals_agree, rows_agree FROM z"""


def similar_words(spark, sf_dir):
    """Words of part names that are within two edits of each other."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return checks.similar_names(words, "word").drop("same_sound")


def similar_words_sql():
    return """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT x.w AS a, y.w AS b, levenshtein(x.w, y.w)::INT AS distance FROM w x JOIN w y ON x.w < y.w AND levenshtein(x.w, y.w) <= 2"""


def null_tokens(spark, sf_dir):
    """Texts that flat-file readers take for null, here planted in a typed table."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "NA").when(F.col("p_size") % 5 == 1, "").otherwise(F.col("p_brand")).alias("p_brand"))
    return readers.null_tokens(part).groupBy("p_brand").agg(F.count("*").alias("n"))


def null_tokens_sql():
    return "SELECT CASE WHEN p_size % 5 < 2 THEN NULL ELSE p_brand END AS p_brand, count(*) AS n FROM part GROUP BY 1"


def expanded_formats(spark, sf_dir):
    return match.expand_formats(_profiles(spark, sf_dir)).select("file_name", "column_name", "match_no", "format", "format_value", rounded(F.col("format_pct")).alias("format_pct"))


def expanded_formats_sql():
    from metaspan.plans.columns import SHOWN, formats_cte

    owner = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS file_name" for t, cs in SHOWN.items() for c in cs)
    return f"WITH {vc_sql()}, {formats_cte()}, o AS ({owner}) SELECT file_name, column_name, rank AS match_no, format, format_value, format_pct FROM formats JOIN o USING (column_name) WHERE trim(format) <> '' AND format_pct > 10"


def hash_sample(spark, sf_dir):
    """A sample of a fixed size is the feature here."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return readers.sample_rows(orders, 100, F.md5(F.col("o_orderkey").cast("string").cast("binary")))


def hash_sample_sql():
    return "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 100"


def event_windows(spark, sf_dir):
    """The stream's profile, on a batch of events."""
    from metaspan.streaming.profile import windowed_profile

    out = windowed_profile(table(spark, sf_dir, "events"), "ts", ["event_type", "user_id"], "1 day")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "column_name", "record_cnt", "value_cnt", "null_cnt", "len_min", "len_max", "has_only_num", "has_alpha")


def event_windows_sql():
    rows = " UNION ALL ".join(f"SELECT ts, '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM events" for c in ("event_type", "user_id"))
    return f"""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, column_name, count(*) AS record_cnt, count(v) AS value_cnt, count(*) FILTER (v IS NULL) AS null_cnt, min(length(v))::INT AS len_min, max(length(v))::INT AS len_max,
 min(regexp_matches(v, '^[0-9]+\\z')::INT) AS has_only_num, max(regexp_matches(v, '[a-zA-Z]')::INT) AS has_alpha FROM ({rows}) GROUP BY 1, 2"""


_ALL = (
    inclusion_match, reference_mapping, internal_mapping, mapping_top3_pivot, final_mapping, final_mapping_rules, all_mappings, related_without_excluded, fk_chain_paths, path_relations, related_files, table_summary, physical_hierarchy, related_tables, physical_edges,
    edge_classification, erd_info, erd_frame, integrity_kpis, orphan_rows, type_consistency, table_connection_counts, industry_kpis, files_per_group, activity_edges, system_activity_links, upsert_slice, append_numbered, semi_filter, anti_filter,
    union_distinct, ambiguous_codes, contract_checks, contract_report, migration_outcome, migration_cases, similar_words, null_tokens, expanded_formats, hash_sample, event_windows,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f"{f.__name__}_sql"]() for f in _ALL if f"{f.__name__}_sql" in globals()}
