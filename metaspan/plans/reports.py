"""Report queries: key figures, issue lists, selections and assembled lineage, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaspan.functions import types
from metaspan.operators import display, lineage, match, score, stats, valuechain
from metaspan.plans.columns import SHAPE_SQL, SHOWN, _oracle_case, _profiles, detail_case, table, vc_sql, wide_cte
from metaspan.plans.relations import CHAINS_SQL, EDGES_SQL, GRAPH_SQL, STEPS_SQL, _edges, _graph, _typed, graph_sql, literal, mapping_cte, physical_edges
from metaspan.streaming.profile import windowed_values

STATS = [("customer", "Master"), ("orders", "Master"), ("nation", "Reference"), ("region", "Reference")]


def _stats(spark, sf_dir):
    out = None
    for name, kind in STATS:
        df = table(spark, sf_dir, name)
        part = df.agg(F.count("*").alias("record_cnt")).select(F.lit(name).alias("file_name"), F.lit(kind).alias("master_type"), "record_cnt", F.lit(len(df.columns)).alias("column_cnt"), F.lit(1.5).alias("file_size"), F.lit("2024-01-02").alias("work_date"))
        out = part if out is None else out.unionByName(part)
    return out


def _stats_sql() -> str:
    widths = {"customer": 5, "orders": 6, "nation": 3, "region": 2}
    return " UNION ALL ".join(f"SELECT '{n}' AS file_name, '{k}' AS master_type, count(*) AS record_cnt, {widths[n]} AS column_cnt, 1.5::DOUBLE AS file_size, '2024-01-02' AS work_date FROM {n}" for n, k in STATS)


def file_kpis(spark, sf_dir):
    return score.file_kpis(_stats(spark, sf_dir))


def file_kpis_sql():
    return f"WITH s AS ({_stats_sql()}) SELECT count(DISTINCT file_name) AS files, sum(record_cnt)::BIGINT AS records, sum(column_cnt)::BIGINT AS columns, sum(file_size) AS file_size, max(work_date) AS work_date FROM s"


def files_by_type(spark, sf_dir):
    return score.files_by_type(score.operational(_stats(spark, sf_dir), ("Common",)), ["Master", "Reference", "Rule"])


def files_by_type_sql():
    return f"WITH s AS ({_stats_sql()}), t(master_type) AS (VALUES ('Master'), ('Reference'), ('Rule')) SELECT t.master_type, count(DISTINCT file_name) AS files FROM t LEFT JOIN s USING (master_type) GROUP BY t.master_type"


def issue_flags(spark, sf_dir):
    out = score.alerts(_profiles(spark, sf_dir))
    return out.select("column_name", "issue_special", "issue_unicode", "issue_chinese", "issue_broken_kor", "issue_length", "alert")


def issue_flags_sql():
    tests = {"special": r"[^a-zA-Z0-9가-힣\s]", "unicode": r"[\x{10000}-\x{10FFFF}]", "chinese": r"[\x{4E00}-\x{9FFF}]", "broken_kor": r"\x{FFFD}"}
    cells = ", ".join(f"max(regexp_matches(value, '{e}')::INT) AS issue_{k}" for k, e in tests.items())
    modes = "lm AS (SELECT column_name, l AS len_mode FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, l) AS rn FROM (SELECT column_name, length(value) AS l, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL)) WHERE rn = 1)"
    return f"""WITH {vc_sql()}, {modes}, x AS (SELECT column_name, {cells}, max(length(value)) AS longest FROM pv GROUP BY column_name),
y AS (SELECT *, (longest > 2 * len_mode)::INT AS issue_length FROM x JOIN lm USING (column_name))
SELECT column_name, issue_special, issue_unicode, issue_chinese, issue_broken_kor, issue_length, greatest(issue_special, issue_unicode, issue_chinese, issue_broken_kor, issue_length) AS alert FROM y"""


def numeric_candidates(spark, sf_dir):
    return stats.numeric_candidates(_profiles(spark, sf_dir)).select("file_name", "column_name", "format_pct")


def numeric_candidates_sql():
    owner = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS file_name" for t, cs in SHOWN.items() for c in cs)
    return f"WITH {vc_sql()}, {wide_cte()}, o AS ({owner}) SELECT file_name, column_name, format_pct FROM wide JOIN o USING (column_name) WHERE value_cnt > 2 AND format_pct < 90 AND {detail_case()} = ''"


def erd_mapping(spark, sf_dir):
    """Columns with their chains of inclusions as levels, or their code slots."""
    typed, values = _typed(spark, sf_dir)
    final = match.final_mapping(typed, match.pivot_mapping(match.internal_mapping(typed, values)), match.reference_mapping(typed, values))
    return lineage.erd_mapping(final).select("file_name", "column_name", "level_1", "level_2", "relationship", "depth")


def erd_mapping_sql():
    return f"""WITH RECURSIVE {mapping_cte()}, r AS (SELECT *, row_number() OVER (PARTITION BY file_name, column_name, m_ref ORDER BY match_pct DESC, compare_count DESC, master_file, master_column) AS rk FROM good),
edge AS (SELECT file_name || '.' || column_name AS s, master_file || '.' || master_column AS d FROM r WHERE m_ref = 0 AND rk = 1 AND match_pct > 50),
walk AS (SELECT [s] AS path FROM edge UNION ALL SELECT list_append(path, d) FROM walk JOIN edge ON s = path[-1] WHERE NOT list_contains(path, d) AND len(path) < 10),
chain AS (SELECT path FROM walk w WHERE len(path) > 1 AND NOT EXISTS (SELECT 1 FROM edge WHERE s = w.path[-1] AND NOT list_contains(w.path, d))),
slots AS (SELECT file_name, column_name, list(master_file || '.' || master_column ORDER BY m_ref, rk) AS sl FROM r WHERE (m_ref = 0 AND rk <= 3) OR (m_ref = 1 AND rk = 1) GROUP BY ALL),
t AS (SELECT o.file_name, o.column_name, o.file_name || '.' || o.column_name AS root, coalesce((SELECT path[2:5] FROM chain WHERE path[1] = o.file_name || '.' || o.column_name), sl[1:4], []::VARCHAR[]) AS shown FROM owner o LEFT JOIN slots USING (file_name, column_name))
SELECT file_name, column_name, shown[1] AS level_1, shown[2] AS level_2, array_to_string(list_prepend(root, shown), ' -> ') AS relationship, len(shown)::INT AS depth FROM t"""


def shown_columns(spark, sf_dir):
    """Columns of a diagram around one anchor."""
    graph = _graph(spark, sf_dir)
    involved = physical_edges(spark, sf_dir, graph).select(F.col("src").alias("file"), "column")
    return lineage.shown_columns(graph, involved, literal(spark, "file string", [("nation",)]))


def shown_columns_sql():
    return f"""WITH RECURSIVE {GRAPH_SQL.format(4)}, {EDGES_SQL} SELECT file, col AS "column" FROM g WHERE pk = 1 UNION SELECT src, col FROM phys UNION SELECT file, col FROM g WHERE file = 'nation'"""


def column_roles(spark, sf_dir):
    return lineage.column_roles(lineage.parse_relationships(lineage.levels(lineage.chains(_edges(spark, sf_dir)))))


def column_roles_sql():
    return f"""WITH RECURSIVE {CHAINS_SQL}, {STEPS_SQL}, t AS (SELECT child_file AS file, cc AS col, 1 AS fk, 0 AS pk FROM rel UNION ALL SELECT parent_file, pc, 0, 1 FROM rel) SELECT file, col AS "column", max(fk) AS is_fk, max(pk) AS is_pk FROM t GROUP BY file, col"""


def table_stats(spark, sf_dir):
    levels = lineage.levels(lineage.chains(_edges(spark, sf_dir))).select(F.substring_index("level_0", ".", 1).alias("file_name"), "depth")
    columns = _graph(spark, sf_dir).select(F.col("file").alias("file_name"), F.col("column").alias("column_name"), F.lit("tables").alias("file_path"))
    return display.table_stats(columns, levels)


def table_stats_sql():
    return f"""WITH RECURSIVE {CHAINS_SQL}, g AS {graph_sql()} SELECT file AS file_name, count(DISTINCT col) AS column_cnt, 'tables' AS file_path,
 coalesce((SELECT max(len(path) - 1) FROM chain WHERE split_part(path[1], '.', 1) = file), 0)::INT AS max_level FROM g GROUP BY file"""


def reference_sets(spark, sf_dir):
    """Normalised values of a reference column, and the forms of the order days."""
    days = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    names = display.reference_set(table(spark, sf_dir, "nation"), "n_name", True).withColumn("kind", F.lit("NATION"))
    return names.unionByName(display.calendar_sets(days, "day"))


def reference_sets_sql():
    form = lambda f, k: f"SELECT strftime(o_orderdate, '{f}') AS value, '{k}' AS kind FROM orders"
    return "SELECT upper(trim(n_name)) AS value, 'NATION' AS kind FROM nation UNION " + " UNION ".join(form(f, k) for f, k in (("%Y%m%d", "DATECHAR"), ("%y%m%d", "YYMMDD"), ("%Y%m", "YEARMONTH"), ("%Y", "YEAR")))


def profile_display(spark, sf_dir):
    """Numbers filled with 0 and texts with '' for display."""
    out = _profiles(spark, sf_dir).select("column_name", "format_pct_2", "format_2", F.lit("12x").alias("odd"))
    return display.ordered(display.for_display(out, ["format_pct_2", "odd"]), ["format_2"])


def profile_display_sql():
    return f"""WITH {vc_sql()}, {wide_cte()} SELECT w.column_name, coalesce((SELECT format_pct FROM formats f WHERE f.column_name = w.column_name AND rank = 2), 0.0)::DOUBLE AS format_pct_2,
 coalesce((SELECT format FROM formats f WHERE f.column_name = w.column_name AND rank = 2), '') AS format_2, 0.0::DOUBLE AS odd FROM wide w"""


def without_hangul(spark, sf_dir):
    flag = display.without_hangul(F.col("n_name")) & ~display.is_key((F.col("n_regionkey") == 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", flag.alias("plain"))


def without_hangul_sql():
    return "SELECT n_nationkey, NOT regexp_matches(n_name, '[가-힣]') AND n_regionkey <> 1 AS plain FROM nation"


def scaled_kpis(spark, sf_dir):
    """Records of tables in units, with the share of them that a sample of ten thousand is; bytes of the documents in units."""
    out = None
    for name in ("nation", "customer", "orders", "documents"):
        df = table(spark, sf_dir, name)
        size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) if name == "documents" else F.lit(None).cast("long")
        part = df.agg(F.count("*").alias("n"), size.alias("size")).withColumn("file_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    (count, count_unit), (size, size_unit) = score.scaled_count(F.col("n")), score.scaled_size(F.col("size"))
    sampled = F.least(F.col("n"), F.lit(10_000))
    return out.select("file_name", count.alias("records"), count_unit.alias("records_unit"), size.alias("size"), F.when(F.col("size").isNotNull(), size_unit).alias("size_unit"), score.sampling_share(sampled, F.col("n")).alias("sampling_pct"))


def scaled_kpis_sql():
    one = lambda t, s: f"SELECT '{t}' AS file_name, count(*) AS n, {s} AS size FROM {t}"
    rows = " UNION ALL ".join([*(one(t, "NULL::BIGINT") for t in ("nation", "customer", "orders")), one("documents", "sum(strlen(text))::BIGINT")])
    return f"""WITH x AS ({rows}) SELECT file_name, CASE WHEN n < 1000 THEN n ELSE n / 10000 END AS records, CASE WHEN n < 1000 THEN '건' ELSE '만건' END AS records_unit,
 CASE WHEN size >= 1000000000 THEN size / 1000000000 WHEN size >= 1000000 THEN size / 1000000 WHEN size >= 1000 THEN size / 1000 ELSE size END AS size,
 CASE WHEN size IS NULL THEN NULL WHEN size >= 1000000000 THEN 'GB' WHEN size >= 1000000 THEN 'MB' WHEN size >= 1000 THEN 'KB' ELSE 'Bytes' END AS size_unit, round((least(n, 10000) / n * 100)::DECIMAL(18, 6), 2)::DOUBLE AS sampling_pct FROM x"""


def file_selection(spark, sf_dir):
    """Tables to choose from, with keys, relations and neighbours."""
    graph = _graph(spark, sf_dir)
    relations = lineage.parse_relationships(lineage.levels(lineage.chains(_edges(spark, sf_dir))))
    return display.selection(graph, lineage.table_summary(relations), lineage.physical_hierarchy(graph))


def file_selection_sql():
    return f"""WITH RECURSIVE {GRAPH_SQL.format(3)}, {CHAINS_SQL}, {STEPS_SQL},
t AS (SELECT child_file AS file, cc AS fk, parent_file AS parent, NULL::VARCHAR AS child FROM rel UNION ALL SELECT parent_file, NULL, NULL, child_file FROM rel),
sm AS (SELECT file, coalesce(string_agg(DISTINCT fk, ', ' ORDER BY fk), '') AS fk_columns, coalesce(string_agg(DISTINCT parent, ', ' ORDER BY parent), '') AS parents, coalesce(string_agg(DISTINCT child, ', ' ORDER BY child), '') AS children, count(*) AS edge_cnt FROM t GROUP BY file),
hi AS (SELECT start AS file, count(*) FILTER (level = 1) AS level_1_cnt, count(*) FILTER (level = 2) AS level_2_cnt, count(*) FILTER (level = 3) AS level_3_cnt, coalesce(array_to_string(list_sort(list(tab) FILTER (level > 0))[1:5], ', '), '') AS related_list FROM lev GROUP BY start)
SELECT f.file, column_cnt, pk_columns, fk_columns, parents, children, edge_cnt, level_1_cnt, level_2_cnt, level_3_cnt, related_list
FROM (SELECT file, count(DISTINCT col) AS column_cnt, coalesce(string_agg(DISTINCT col, ', ' ORDER BY col) FILTER (pk = 1), '') AS pk_columns FROM g GROUP BY file) f LEFT JOIN sm USING (file) LEFT JOIN hi USING (file) WHERE column_cnt > 1"""


def enriched_types(spark, sf_dir):
    """Columns of the shown tables with their physical type, where their values' shape gives one."""
    columns = [(t, c) for t, cs in SHOWN.items() for c in [*cs, "not_shown"]]
    return lineage.with_types(literal(spark, "file string, column string", columns), _profiles(spark, sf_dir))


def enriched_types_sql():
    owner = " UNION ALL ".join(f"SELECT '{t}' AS file, '{c}' AS col" for t, cs in SHOWN.items() for c in [*cs, "not_shown"])
    return f"""WITH {vc_sql()}, {SHAPE_SQL}, o AS ({owner}) SELECT file, col AS "column", {_oracle_case(types.CODE_NAMES)} AS type FROM o LEFT JOIN shape ON shape.column_name = o.col WHERE shape.column_name IS NOT NULL
UNION ALL SELECT file, col, NULL FROM o WHERE col NOT IN (SELECT column_name FROM shape)"""


def file_overview(spark, sf_dir):
    """Customers as files with what one industry's mapping says of them."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    files = customer.select(F.lit("tables").alias("file_path"), F.col("c_name").alias("file_name"), F.lit(5).alias("column_cnt"))
    keys = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("tables").alias("file_path"), F.col("c_name").alias("file_name"), F.col("o_orderpriority").alias("column_name"), (F.col("o_orderstatus") == "P").cast("int").alias("pk"))
    mapping = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("industry"), F.col("c_name").alias("file_name"), F.col("c_mktsegment").alias("activity"), F.lit("sales").alias("system"))
    return valuechain.file_overview(files, keys, mapping, nation.orderBy("n_nationkey").first().n_name)


def file_overview_sql():
    return """SELECT 'tables' AS file_path, c_name AS file_name, 5 AS column_cnt, k.pk_columns, CASE WHEN n.c THEN c_mktsegment ELSE '' END AS activity, CASE WHEN n.c THEN 'sales' ELSE '' END AS system
FROM customer LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS pk_columns FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) k ON k.o_custkey = c_custkey
LEFT JOIN (SELECT n_nationkey, n_name = (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1) AS c FROM nation) n ON n_nationkey = c_nationkey"""


def event_top_values(spark, sf_dir):
    """Exact distinct values and the three most frequent ones of each day, as the stream gives them."""
    out = windowed_values(table(spark, sf_dir, "events"), "ts", ["event_type", "user_id"], "1 day", k=3)
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "column_name", "value_cnt", "unique_cnt", F.posexplode("top_values").alias("rank", "top")).select("day", "column_name", "value_cnt", "unique_cnt", "rank", "top.value", "top.cnt")


def event_top_values_sql():
    rows = " UNION ALL ".join(f"SELECT date_trunc('day', ts)::TIMESTAMP AS day, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM events WHERE {c} IS NOT NULL" for c in ("event_type", "user_id"))
    return f"""WITH c AS (SELECT day, column_name, value, count(*) AS cnt FROM ({rows}) GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY day, column_name ORDER BY cnt DESC, value) - 1)::INT AS rank, sum(cnt) OVER (PARTITION BY day, column_name)::BIGINT AS value_cnt, count(*) OVER (PARTITION BY day, column_name) AS unique_cnt FROM c)
SELECT day, column_name, value_cnt, unique_cnt, rank, value, cnt FROM r WHERE rank < 3"""


_ALL = (scaled_kpis, file_selection, enriched_types, file_overview, event_top_values, file_kpis, files_by_type, issue_flags, numeric_candidates, erd_mapping, shown_columns, column_roles, table_stats, reference_sets, profile_display, without_hangul)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f"{f.__name__}_sql"]() for f in _ALL}
