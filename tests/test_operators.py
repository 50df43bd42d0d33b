import pytest
from pyspark.sql import functions as F

from metaspan.functions import patterns
from metaspan.operators import checks, display, lineage, match, profile, rules, score, stats, valuechain
from metaspan.sources import readers, shared, writers
from metaspan.streaming.profile import windowed_profile


def test_weighted_median_is_the_middle_of_the_sorted_values(spark):
    values = ["b"] * 3 + ["a"] * 2 + ["ccc", "cca", "ccb"] * 2 + [None]
    vc = profile.value_counts(spark.createDataFrame([(v,) for v in values], "x string"))
    present = sorted(v for v in values if v is not None)
    got = profile.value_stats(vc).first()
    assert (got.median_string, got.min_string, got.max_string, got.mode_string, got.mode_cnt) == (present[len(present) // 2], "a", "ccc", "b", 3)


def test_lengths_and_edges_of_odd_values(spark):
    vc = profile.value_counts(spark.createDataFrame([("",), ("🙂é",), ("abcd",), (None,)], "x string"))
    got = profile.lengths(vc).first()
    assert (got.len_min, got.len_max, got.len_avg, got.len_mode, got.len_median, got.len_distinct) == (0, 4, 2.0, 0, 2.0, 3)
    assert {r.value for r in profile.edges(vc).where("side = 'last' AND n = 1").collect()} == {"", "é", "d"}


def test_views_and_alerts(spark):
    df = spark.createDataFrame([("a", "x" * 30), ("b!", "y"), ("c", "z"), ("d", "w")], "k string, v string")
    found = profile.profile(df, file_name="f", master_type="Master")
    for name in score.VIEWS:
        assert score.view(found, name).columns == [c for c in score.VIEWS[name] if c in found.columns]
    rows = {r.column_name: r for r in score.alerts(found).collect()}
    assert rows["k"].issue_special == 1 and rows["v"].issue_length == 1 and rows["v"].alert == 1
    assert score.issue_columns(found, "special").count() == 1
    assert score.files_by_type(spark.createDataFrame([("Master", "f")], "master_type string, file_name string"), ["Master", "Rule"]).orderBy("master_type").collect()[1].files == 0
    assert spark.range(1).select(score.display_size(F.lit(3 << 20))).first()[0] == "3.00 MB"


def test_profile_of_empty_table(spark):
    assert profile.profile(spark.createDataFrame([], "a string, b int")).count() == 0


def test_control_limits_of_one_value(spark):
    r = stats.control_limits(spark.createDataFrame([("5",), ("x",), (None,)], "v string"), ["v"]).first()
    assert r["count"] == 1 and r.std is None and r.lcl is None and r.below_lcl == 0


def test_mapping_gates(spark):
    """A code column maps to the list that holds its values; a column too small does not."""
    codes = spark.createDataFrame([(f"C{k:03d}",) for k in range(40)], "code string")
    data = spark.createDataFrame([(f"C{k % 30:03d}", f"C{k % 5:03d}", f"r{k}") for k in range(120)], "ref string, few string, id string")
    one = profile.profile(codes, file_name="codes", master_type="Reference").withColumn("file_path", F.lit("d"))
    two = profile.profile(data, file_name="data", master_type="Master").withColumn("file_path", F.lit("d"))
    both = one.unionByName(two)
    values = match.distinct_values({("d", "codes"): codes, ("d", "data"): data}, {("d", "codes"): ["code"], ("d", "data"): ["ref", "few", "id"]})
    got = match.reference_mapping(both, values).collect()
    assert [(r.column_name, r.master_column, r.compare_count, r.source_count, r.match_pct) for r in got] == [("ref", "code", 30, 30, 100.0)]
    final = match.final_mapping(both, match.pivot_mapping(match.internal_mapping(both, values)), match.reference_mapping(both, values))
    assert {r.column_name: r.attribute for r in final.collect()}["ref"] == "code"
    assert lineage.erd_mapping(final).where("column_name = 'ref'").first().relationship == "data.ref -> codes.code"


def test_compare_length_cuts_values(spark):
    pairs = spark.createDataFrame([("d", "a", "x", "d", "b", "y3", 3)], "file_path string, file_name string, column_name string, master_path string, master_file string, master_column string, compare_length int")
    values = spark.createDataFrame([("d", "a", "x", "abcd"), ("d", "a", "x", "abce"), ("d", "a", "x", "zzz"), ("d", "b", "y3", "abcX")], "file_path string, file_name string, column_name string, value string")
    r = match.inclusion(pairs, values).first()
    assert (r.compare_count, r.source_count, r.match_pct) == (1, 2, 50.0)
    assert spark.range(1).select(match.compare_length(F.lit("code3")), match.compare_length(F.lit("code"))).first()[:] == (3, 0)


def test_type_join_normalises_paths(spark):
    a = spark.createDataFrame([("x\\y", "f", "c", "Master", "T")], "file_path string, file_name string, column_name string, master_type string, t string")
    b = spark.createDataFrame([("x/y", "f", "c", "Other", 1)], "file_path string, file_name string, column_name string, master_type string, n int")
    assert match.join_types(a, b).first().master_type == "Master"


def test_chains_are_free_of_cycles_and_bounded(spark):
    node = lambda k: (f"t{k}", "c", "Master")
    rows = [(node(k), node(k + 1), 100.0) for k in range(14)] + [(node(2), node(0), 80.0), (node(3), node(9), 40.0)]
    kind = "struct<file:string,column:string,type:string>"
    edges = spark.createDataFrame(rows, f"src {kind}, dst {kind}, weight double")
    paths = [[n.file for n in r.path] for r in lineage.chains(edges).collect()]
    assert all(len(p) == len(set(p)) and 1 < len(p) <= 10 for p in paths)
    assert ["t6", "t7", "t8", "t9", "t10", "t11", "t12", "t13", "t14"] in paths and not any(p[0] == "t4" and p[-1] == "t14" for p in paths)


def test_levels_leave_out_reference_nodes(spark):
    kind = "array<struct<file:string,column:string,type:string>>"
    df = spark.createDataFrame([([("a.b", "c", "Master"), ("r", "x", "Reference")],)], f"path {kind}")
    r = lineage.levels(df).first()
    assert (r.relationship, r.relationship_internal, r.depth, r.depth_internal, r.level_1) == ("a.b.c -> r.x", "a.b.c", 1, 0, "r.x")
    assert lineage.parse_relationships(df.select(F.lit("a.b.c -> r.x").alias("relationship"))).first().child_file == "a.b"


def test_graph_views(spark):
    g = spark.createDataFrame([("a", "k", 1, "N"), ("b", "k", 0, "N"), ("b", "z", 0, "N"), ("c", "z", 0, "N")], "file string, column string, pk int, type string")
    assert [(r.a, r.b) for r in lineage.shared_columns(g).collect()] == [("a", "b")]
    assert lineage.shared_columns(g, spark.createDataFrame([("k",)], "column string")).count() == 0
    shown = lineage.shown_columns(g, spark.createDataFrame([("b", "k")], "file string, column string"), spark.createDataFrame([("c",)], "file string"))
    assert sorted(tuple(r) for r in shown.collect()) == [("a", "k"), ("b", "k"), ("c", "z")]
    assert lineage.to_dot(["a", 'b"'], [("a", 'b"', "k")]).splitlines()[-2] == '  "a" -> "b\\"" [label="k"];'
    roles = lineage.column_roles(spark.createDataFrame([("b", "k", "a", "k")], "child_file string, child_column string, parent_file string, parent_column string"))
    assert {(r.file, r.is_fk, r.is_pk) for r in roles.collect()} == {("b", 1, 0), ("a", 0, 1)}


def test_rules_over_profiles(spark):
    df = spark.createDataFrame([(f"u{k}@x.com", str(k)) for k in range(20)], "mail string, n string")
    found = rules.apply_rules(profile.profile(df), [("mail", "Format.count('@') == 1", "Top10 in good"), ("any", "ValueCnt > 0", None)], {"good": ["u0@x.com", "u1@x.com", "u10@x.com", "u11@x.com"]})
    rows = {r.column_name: r for r in found.collect()}
    assert rows["mail"].matched_rules == "any; mail" and rows["mail"].score_max == 1.0 and rows["n"].matched_rules == "any"
    assert {r.column_name: r[0] for r in found.select(rules.rule_checks(found), "column_name").collect()} == {"mail": None, "n": None}


def test_checks(spark):
    df = spark.createDataFrame([("a", "Jon"), ("a", "John"), ("b", "Mary")], "code string, meaning string")
    assert checks.ambiguous(df, "code", "meaning").first().value_list == "John, Jon"
    assert [tuple(r) for r in checks.similar_names(df, "meaning").collect()] == [("John", "Jon", 1, True)]
    assert checks.standard_differences(df, spark.createDataFrame([("b", "Maria")], "code string, standard_meaning string")).count() == 1
    present = spark.createDataFrame([("Master", "id")], "master_type string, column_name string")
    assert checks.missing_columns(present, present.union(spark.createDataFrame([("Master", "name")], present.schema))).first().column_name == "name"
    assert checks.contract(df, "other", [{"file": "x*", "max_null_pct": 0}]).count() == 0


def test_overview_and_enrichment(spark):
    stats_ = spark.createDataFrame([("p", "f", 3)], "file_path string, file_name string, record_cnt long")
    prof = spark.createDataFrame([("p", "f", "k", 1)], "file_path string, file_name string, column_name string, pk int")
    assert valuechain.file_overview(stats_, prof).first().pk_columns == "k"
    mapping = spark.createDataFrame([("i", "f", "a", "s"), ("i", "g", None, "s"), ("i", "h", "Unknown", "s")], "industry string, file_name string, activity string, system string")
    acts = spark.createDataFrame([("i", "a", "t", 1)], "industry string, activity string, activity_type string, activity_seq int")
    systems = spark.createDataFrame([("i", "s", 1)], "industry string, system string, system_seq int")
    assert [r.file_name for r in valuechain.enrich(mapping, acts, systems).collect()] == ["f"]


@pytest.mark.parametrize("encoding,java", [("utf-8-sig", "UTF-8"), ("cp949", "x-windows-949")])
def test_csv(spark, tmp_path, encoding, java):
    (tmp_path / "a.csv").write_bytes('이름, code \n홍길동,NA\n"a, ""b""",001\n,null\n'.encode(encoding))
    path = str(tmp_path / "a.csv")
    assert [readers.JAVA_NAMES[e] for e in readers.encodings(path).values()] == [java]
    df = readers.read_csv(spark, path)
    assert df.columns == ["이름", "code"]
    assert [tuple(r) for r in df.collect()] == [("홍길동", None), ('a, "b"', "001"), (None, None)]


def test_directory_catalog_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a", "b"):
        (tmp_path / "in" / f"{n}.csv").write_text(f"x,y\n{n},1\n")
    (tmp_path / "in" / "c.txt").write_text("no")
    df = readers.read_directory(spark, str(tmp_path / "in"))
    assert sorted((r.x, r.file_name) for r in df.collect()) == [("a", "a.csv"), ("b", "b.csv")]
    assert {r.file_name for r in readers.list_files(spark, str(tmp_path / "in")).collect()} == {"a.csv", "b.csv", "c.txt"}
    catalog = spark.createDataFrame([("Y", "Master", "d", ".csv"), ("N", "Rule", "d", ".csv"), ("y", "Other", "d", ".csv")], "execution_flag string, type string, source string, extension string")
    assert readers.read_catalog(catalog).count() == 1
    with pytest.raises(ValueError, match="extension"):
        readers.read_catalog(catalog.drop("extension"))
    nested = spark.createDataFrame([(1, ["a"])], "i int, l array<string>")
    writers.write_csv(nested, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first().l == '["a"]'
    writers.write_stages(str(tmp_path / "stages"), one=nested)
    assert spark.read.parquet(str(tmp_path / "stages/one")).count() == 1
    assert readers.file_statistics(df, "d", "a", "Master", 0.1).first().record_cnt == 2


def test_lists_and_numbers(spark):
    assert readers.parse_list("['a', 'b']") == ["a", "b"] and readers.parse_list('["x"]') == ["x"] and readers.parse_list("a; b|c") == ["a", "b", "c"] and readers.parse_list("") == []
    df = spark.createDataFrame([("1", "x", "7"), ("2.5", "3", "y")], "a string, b string, row_cnt string")
    out = readers.auto_numeric(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string", "row_cnt": "double"}
    assert readers.sample_rows(df, 1).collect() == readers.sample_rows(df.repartition(3), 1).collect()


def test_stream_profile(spark, tmp_path):
    source = spark.createDataFrame([("2024-01-01 00:10:00", "a1"), ("2024-01-01 00:50:00", None), ("2024-01-01 01:10:00", "bb")], "t string, v string").select(F.to_timestamp("t").alias("ts"), "v")
    source.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "events"))
    query = windowed_profile(stream, "ts", ["v"]).writeStream.outputMode("complete").format("memory").queryName("profiled").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    rows = sorted((r.record_cnt, r.value_cnt, r.has_num) for r in spark.table("profiled").collect())
    assert rows == [(1, 1, 0), (2, 1, 1)]


def test_rules_from_their_tables(spark, tmp_path):
    (tmp_path / "rules.csv").write_text('﻿Use_Flag,RuleName,rule1,rule2\nY,day,"Format == ""nnnnnnnn""",First2Top10 in century and Last2Top10 in days\nN,off,LenMax > 0,\nY,broken,"(Format == ""A"") | Format == ""B"")",\n', encoding="utf-8")
    (tmp_path / "days.csv").write_text("code\n" + "\n".join(f"{d:02d}" for d in range(1, 32)) + "\n")
    (tmp_path / "valid.csv").write_text('valid_name,ListOrFile,valid_list\ncentury,List ,"""19"", ""20"""\ndays,File,days.csv\n')
    definitions = readers.read_rules(spark, str(tmp_path / "rules.csv"))
    assert [d[0] for d in definitions] == ["day", "broken"]
    sets = readers.read_valid_sets(spark, str(tmp_path / "valid.csv"), str(tmp_path))
    assert sets["century"] == ["19", "20"] and len(sets["days"]) == 31
    df = spark.createDataFrame([("20240131", "x"), ("19990215", "y")], "d string, t string")
    found = profile.profile(df, file_name="f", master_type="Master")
    got = {r.column_name: r.rule for r in rules.apply_rules(found, definitions, sets, strict=False).collect()}
    assert got == {"d": "day", "t": ""}


def test_directory_with_encodings_and_nulls(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("이름,n\n김,NA\n".encode("cp949"))
    (tmp_path / "b.csv").write_bytes(("이름,n\n" + "x,1\n" * 30_000 + "박,2\n").encode("utf-8"))
    (tmp_path / "c.csv").write_bytes(("이름,n\n" + "x,1\n" * 30_000 + "최,3\n").encode("cp949"))
    (tmp_path / "d.txt").write_text("no")
    rows = readers.read_directory(spark, str(tmp_path)).where("`이름` <> 'x'").collect()
    assert sorted((r.file_name, r["이름"], r.n) for r in rows) == [("a.csv", "김", None), ("b.csv", "박", "2"), ("c.csv", "최", "3")]


def test_existing_tables_and_config(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k\n1\n")
    (tmp_path / "c.yaml").write_text("quality:\n  - rule: not_null\n    column: k\n")
    found, missing = readers.read_existing(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv"), "p": str(tmp_path / "p.parquet")})
    assert list(found) == ["a"] and missing == ["b", "p"] and found["a"].first().k == 1
    assert readers.read_config(str(tmp_path / "c.yaml"))["quality"][0]["column"] == "k"


@pytest.mark.parametrize("ordered", [1, 3, 40])
def test_medians_by_selection_equal_sorting(spark, ordered):
    import random

    rnd = random.Random(ordered)
    made = {
        "random": ["".join(rnd.choice("abé🙂") for _ in range(rnd.randint(0, 9))) for _ in range(300)],
        "one beginning": [f"http://example.org/a/long/shared/path/{rnd.randint(0, 10**6):07d}" for _ in range(200)],
        "nested": ["x" * k for k in range(60)] + ["x" * 60] * 5, "one": ["same"] * 7, "two": ["a", "b"],
    }
    rows = [(k, v) for k, vs in made.items() for v in vs]
    vc = spark.createDataFrame(rows, "k string, value string").groupBy("k", "value").agg(F.count("*").alias("cnt"))
    found = {r.k: r.median for r in profile.weighted_medians(vc, ["k"], ordered).collect()}
    assert found == {k: sorted(vs, key=str.encode)[len(vs) // 2] for k, vs in made.items()}


def _pair_tables(spark, n):
    """n columns of one format, each with its own range of values, and one that spans all."""
    names = "file_path string, file_name string, column_name string, master_type string, detail_type string, unique_cnt long, value_cnt long, format_cnt long, pk int, match_no int, format string, format_value long, format_pct double, format_min string, format_max string, format_mode string, format_median string"
    rows = [("d", f"f{k}", "c", "Master", "", 50, 50, 1, 0, 1, "AAn", 50, 100.0, f"ID{k * 100:09d}", f"ID{k * 100 + 99:09d}", "", f"ID{k * 100 + 50:09d}") for k in range(n)]
    rows.append(("d", "all", "c", "Master", "", 50, 50, 1, 0, 1, "AAn", 50, 100.0, f"ID{0:09d}", f"ID{n * 100:09d}", "", "ID"))
    return spark.createDataFrame(rows, names)


def test_candidates_of_many_columns_of_one_format(spark, capsys):
    table = _pair_tables(spark, 5000)
    found = match.candidate_pairs(table, table)
    rows = {(r.file_name, r.master_file) for r in found.collect()}
    # each median lies in the range of its own column (left out) and in that of the one that spans all
    assert rows == {(f"f{k}", "all") for k in range(5000)}
    found.explain()
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_ranges_met_equals_all_comparisons(spark):
    import random

    rnd = random.Random(5)
    word = lambda: "pre" + "".join(rnd.choice("ab é한") for _ in range(rnd.randint(0, 12)))
    points = [(rnd.choice("fg"), word(), k) for k in range(150)] + [("h", "same", 1000), (None, "x", 1001)]
    ranges = [(rnd.choice("fg"), *sorted((word(), word()), key=str.encode), k) for k in range(120)] + [("h", "same", "same", 500), ("f", "z", "a", 501)]
    met = match.ranges_met(spark.createDataFrame(points, "format string, point string, p int"), spark.createDataFrame(ranges, "format string, low string, high string, r int"))
    rows = sorted((r.p, r.r) for r in met.collect())
    assert rows == sorted((p, r) for f, x, p in points for g, a, b, r in ranges if f == g and a.encode() <= x.encode() <= b.encode())


def test_inclusion_counts_values_and_rows(spark):
    import random
    from collections import Counter

    rnd = random.Random(3)
    columns = [("d", f"f{k % 3}", f"c{k}") for k in range(7)]
    held = {c: Counter(rnd.choice([f"v{i}" for i in range(30)]) for _ in range(rnd.randint(5, 90))) for c in columns}
    values = spark.createDataFrame([(*c, v, n) for c, vs in held.items() for v, n in vs.items()], "file_path string, file_name string, column_name string, value string, cnt long")
    wanted = [(*a, *b, size) for a in columns for b in columns if a != b for size in (0, 2) if size == 0 or rnd.random() < 0.3]
    pairs = spark.createDataFrame(wanted, "file_path string, file_name string, column_name string, master_path string, master_file string, master_column string, compare_length int")
    cut = lambda vs, size: Counter({k: sum(n for v, n in vs.items() if (v[:size] if size else v) == k) for k in {v[:size] if size else v for v in vs}})
    want = []
    for r in wanted:
        a, b = cut(held[r[:3]], r[6]), cut(held[r[3:6]], r[6])
        want.append((*r, len(a.keys() & b.keys()), len(a), sum(n for v, n in a.items() if v in b), sum(a.values())))
    found = match.inclusion(pairs, values, 0.0).select(*pairs.columns, "compare_count", "source_count", "matched_rows", "source_rows")
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_integrity_counters_in_a_profile(spark):
    from metaspan.operators import integrity

    masters = spark.createDataFrame([(f"K{k:03d}",) for k in range(40)], "id string")
    facts = spark.createDataFrame([(f"K{k % 45:03d}" if k % 10 else None, "20240230" if k % 8 == 0 else f"202401{k % 28 + 1:02d}", float(k % 7) if k else 1e6) for k in range(270)], "ref string, day string, amount double")
    a = profile.profile(masters, file_name="masters", master_type="Master").withColumn("file_path", F.lit("d"))
    b = profile.profile(facts, file_name="facts", master_type="Master").withColumn("file_path", F.lit("d"))
    both = a.unionByName(b)
    values = match.distinct_values({("d", "masters"): masters, ("d", "facts"): facts}, {("d", "masters"): ["id"], ("d", "facts"): ["ref"]})
    pairs = spark.createDataFrame([("d", "facts", "ref", "d", "masters", "id", 0)], "file_path string, file_name string, column_name string, master_path string, master_file string, master_column string, compare_length int")
    lost = integrity.orphans(match.inclusion(pairs, values))
    dates = integrity.date_conflicts(profile.value_counts(facts, ["day"]), {"day": "DATECHAR"})
    out = integrity.with_counters(both, lost, dates, stats.control_limits(facts, ["amount"]))
    rows = {r.column_name: r for r in out.collect()}
    orphan = sum(1 for k in range(270) if k % 10 and k % 45 >= 40)
    assert rows["ref"].fk_mismatch == orphan > 0 and rows["ref"].master == "masters.id" and rows["day"].date_mismatch == 34
    assert rows["amount"].above_ucl == 1 and rows["amount"].below_lcl == 0 and rows["id"].fk_mismatch == 0
    kpis = {r.issue: (r.files, r["columns"]) for r in score.quality_kpis(out).collect()}
    assert kpis["fk_mismatch"] == kpis["date_mismatch"] == kpis["above_ucl"] == (1, 1) and kpis["below_lcl"] == (0, 0)
    assert integrity.issue_list(out, "fk_mismatch").columns == ["file_name", "column_name", "record_cnt", "value_cnt", "null_cnt", "master", "matched_rows_pct", "fk_mismatch"]
    assert integrity.orphans(match.inclusion(pairs, values), tolerance=50.0).first().fk_mismatch == 0
    with pytest.raises(ValueError):
        integrity.date_conflicts(profile.value_counts(facts, ["day"]), {"day": "TEL"})


def test_names_within_two_edits(spark):
    import random

    def distance(a, b):
        row = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    import unicodedata

    rnd = random.Random(4)
    names = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 7))) for _ in range(120)} | {"김철수", "김철우", "긴철수", "이영희", "Jon", "John", "ab", "ba"})
    plain = {n: unicodedata.normalize("NFD", n) for n in names}
    assert {r.name: r.l for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", checks.letters(F.col("name")).alias("l")).collect()} == plain
    for most in (1, 2):
        found = checks.similar_names(spark.createDataFrame([(n,) for n in [*names, None, "ab"]], "n string"), "n", most)
        want = {(a, b, distance(plain[a], plain[b])) for a in names for b in names if a.encode() < b.encode() and distance(plain[a], plain[b]) <= most}
        assert {tuple(r)[:3] for r in found.collect()} == want and found.count() == len(want)
    with pytest.raises(ValueError):
        checks.similar_names(spark.createDataFrame([("a",)], "n string"), "n", 3)


def _migrations():
    base = [(i, f"k{i % 5}", f"x{i}", 100 + i) for i in range(40)]
    cols = ["pos", "k", "x", "m"]
    add = lambda rows: [(*r, "new") for r in rows]
    less = lambda rows: [(r[0], r[1], r[3]) for r in rows]
    both = lambda rows: [(r[0], r[1], r[3], "new") for r in rows]
    split = [(2 * r[0] + j, r[1], r[2], r[3] - 1 if j else 1) for r in base for j in (0, 1)]
    merged = [(i, f"k{i}", f"y{i}", sum(r[3] for r in base if r[1] == f"k{i}")) for i in range(5)]
    nearly = [(*r[:3], r[3] + (r[0] == 7)) for r in base]
    moved = [(r[0], "k9" if r[0] == 3 else r[1], r[2], r[3]) for r in base]
    raised = [(*r[:3], r[3] * 2) for r in base]
    shifted = [(*r[:3], r[3] + (500 if r[0] == 0 else -500 if r[0] == 1 else 0)) for r in base]
    off = lambda rows, by: [(*r[:3], r[3] + (by if k == 0 else -by if k == 2 else 0)) for k, r in enumerate(rows)]
    return {
        1: (cols, base), 2: (["pos", "m", "x", "k"], [(r[0], r[3], r[2], r[1]) for r in base]), 3: (cols, [(39 - r[0], *r[1:]) for r in base]), 4: ([*cols, "z"], add(base)), 5: (["pos", "k", "m"], less(base)),
        6: (["pos", "k", "m", "z"], both(base)), 7: (cols, split), 8: (cols, merged), 9: (cols, nearly), 10: (cols, off(split, 5)), 11: (cols, moved), 12: (cols, raised),
        13: ([*cols, "z"], add([(*r[:3], r[3] + 7) for r in moved])), 14: (["pos", "k", "m"], less(shifted)), 15: (["pos", "k", "m", "z"], both(raised)), 16: (cols, off(split, 500)),
        17: (cols, [(*r[:3], r[3] * 2) for r in split]), 18: (cols, off(merged, 500)), 19: (cols, [(*r[:3], r[3] * 2) for r in merged]), 0: (["pos", "k", "x", "m"], [(*r[:3], r[3] + 900 * (r[1] == "k9")) for r in moved]),
    }, (cols, base)


def test_all_cases_of_a_migration(spark):
    cases, (cols, base) = _migrations()
    before = spark.createDataFrame(base, cols)
    for case, (names, data) in cases.items():
        r = checks.migration_case(before, spark.createDataFrame(data, names), ["k"], ["m"], "pos").first()
        assert (r.case, r.right) == (case, 0 < case <= 10), (case, r)
    assert checks.migration_case(before.limit(0), before.limit(0), ["k"], ["m"]).first().case == 1


def test_slice_is_replaced_without_touching_other_files(spark, tmp_path):
    import os

    path = str(tmp_path / "t")
    df = spark.createDataFrame([(k, "abc"[k % 3], k) for k in range(30)], "id int, part string, v int")
    writers.write_table(df, path, "part")
    files_of = lambda p: {f"{p}/{f}" for f in os.listdir(f"{path}/part={p}") if f.startswith("part-")}
    kept, gone = files_of("a") | files_of("c"), files_of("b")
    table = spark.read.parquet(path)
    writers.replace_partition(table.where("part = 'b' AND id > 10").withColumn("v", F.lit(-1)), path, "part", "b")
    assert files_of("a") | files_of("c") == kept and not files_of("b") & gone
    rows = {tuple(r) for r in spark.read.parquet(path).select("id", "part", "v").collect()}
    assert rows == {(k, "abc"[k % 3], -1 if k % 3 == 1 else k) for k in range(30) if k % 3 != 1 or k > 10}
    writers.replace_partition(spark.read.parquet(path).limit(0), path, "part", "b")
    assert not os.path.exists(f"{path}/part=b") and files_of("a") | files_of("c") == kept
    with pytest.raises(ValueError):
        writers.replace_partition(df.where("part = 'a'"), path, "part", "c")


def test_one_hot_key_is_numbered_over_many_tasks(spark):
    old = spark.createDataFrame([("hot", "x", 7), ("b", "y", 2)], "k string, v string, n int")
    new = [("hot" if i % 10 else None if i % 20 else "b", f"v{i % 400:03d}", None) for i in range(5000)]
    out = valuechain.append_numbered(old, spark.createDataFrame(new, old.schema), "k", "n")
    rows = [tuple(r) for r in out.collect()]
    for key, first in (("hot", 7), ("b", 2), (None, 0)):
        own = sorted((v, n) for k, v, n in rows[2:] if k == key)
        assert sorted(n for _, n in own) == [*range(first + 1, first + 1 + len(own))] and [n for _, n in own] == sorted(n for _, n in own)
    assert len(rows) == 5002


def test_byte_order_mark(spark, tmp_path):
    import glob

    writers.write_csv(spark.createDataFrame([("a", "b")], "`이름` string, k string").coalesce(1), str(tmp_path / "o"), mark=True)
    content = open(glob.glob(str(tmp_path / "o" / "part-*"))[0], "rb").read()
    assert content.startswith(b"\xef\xbb\xbf") and content.decode("utf-8-sig") == "이름,k\na,b\n"


def test_strict_edges_leave_out_reference_and_common_columns(spark):
    names = "file_name string, column_name string, master_type string, code_file_1 string, code_column_1 string, code_type_1 string, matched_pct_1 double"
    rows = [("a", "x", "Master", "b", "y", "Master", 90.0), ("a", "z", "Master", "r", "y", "Reference", 90.0), ("c", "k", "Common", "b", "y", "Master", 90.0), ("a", "u", "Master", "", "URL", "Rule", 99.0), ("b", "y", "Master", "d", "w", "Master", 80.0)]
    mapping = spark.createDataFrame(rows, names)
    ends = lambda strict: sorted((r.src.file, r.src.column, r.dst.file) for r in lineage.edges_of(mapping, strict).collect())
    assert ends(False) == [("a", "x", "b"), ("a", "z", "r"), ("b", "y", "d"), ("c", "k", "b")] and ends(True) == [("a", "x", "b"), ("b", "y", "d")]
    found = {r.relationship for r in lineage.levels(lineage.chains(lineage.edges_of(mapping, strict=True))).collect()}
    assert found == {"a.x -> b.y -> d.w", "b.y -> d.w"}


def test_contract_files(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(
        "data_contract:\n  defaults:\n    severity: low\n    null: {max_pct: 50}\n  columns:\n    - {file: '*', column: 'Zip*', severity: high, importance: 3, rules: {null: {max_pct: 0}, pattern: {regex: '^[0-9]{5}$', fixed_length: 5, allow_leading_zero: false}}}\n"
        "    - {file: other, column: '*', rules: {numeric: {min: 0}}}\n    - {column: kind, rules: {domain: {values: [a, b]}}}\n"
    )
    config = readers.read_config(str(tmp_path / "c.yaml"))
    df = spark.createDataFrame([("12345", "a"), ("01234", "b"), ("1234", None), (None, "x")], "ZipCode string, kind string")
    rows = {(r.column_name, r.rule): (r.severity, r.failed, r.passed, r.importance, r.weighted_pct) for r in checks.contract_report(df, "people", config).collect()}
    assert rows == {
        ("ZipCode", "max_null_pct"): ("high", 1, False, 3.0, 75.0), ("ZipCode", "regex"): ("high", 1, False, 3.0, 75.0), ("ZipCode", "fixed_length"): ("high", 1, False, 3.0, 75.0), ("ZipCode", "leading_zero"): ("high", 1, False, 3.0, 75.0),
        ("kind", "max_null_pct"): ("low", 1, True, 1.0, 25.0), ("kind", "values"): ("low", 1, False, 1.0, 25.0),
    }


def _graph_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.mark.parametrize("seed", range(3))
def test_strongly_connected_components(spark, seed):
    import random

    rnd = random.Random(seed)
    nodes = [f"n{k:02d}" for k in range(14)]
    pairs = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(19)} - {(n, n) for n in nodes})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    want = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    groups = {n for n in nodes if sum(v == want[n] for v in want.values()) > 1}
    assert {r.node: r.component for r in lineage.cycles(_graph_of(spark, pairs)).collect()} == {n: want[n] for n in groups}


def test_dense_cyclic_graphs_are_counted_not_listed(spark):
    kind = "struct<file:string,column:string,type:string>"
    dense = [((f"t{a:02d}", "c", "Master"), (f"t{b:02d}", "c", "Master"), 100.0) for a in range(40) for b in range(40) if a != b]
    edges = spark.createDataFrame([*dense, (("x", "c", "Master"), ("t00", "c", "Master"), 90.0)], f"src {kind}, dst {kind}, weight double")
    with pytest.raises(lineage.TooManyPaths, match=r"t00.c \(40 nodes\)"):
        lineage.chains(edges)
    few = lineage.walk_counts(_graph_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")]), 3)
    assert {r.node: r.walks for r in few.collect()} == {"a": 3.0, "b": 3.0, "c": 2.0}


def test_streamed_values_equal_the_batch(spark, tmp_path):
    import random

    from metaspan.streaming.profile import windowed_values

    rnd = random.Random(2)
    rows = [(f"2024-01-01 0{rnd.randint(0, 3)}:{rnd.randint(0, 59):02d}:00", rnd.choice("aabcdefg") if rnd.random() > 0.1 else None, rnd.randint(0, 40)) for _ in range(400)]
    rows.sort(key=lambda r: (r[0][:13], rnd.random()))  # late within an hour
    names = "t string, v string, n int"
    for k in range(4):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.createDataFrame(rows, names).select(F.to_timestamp("t").alias("ts"), "v", "n")
    spark.createDataFrame([(f"2024-01-0{d} 00:00:00", None, None) for d in (3, 5, 7)], names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select(F.to_timestamp("t").alias("ts"), "v", "n")
    out = windowed_values(stream, "ts", ["v", "n"], late="2 hours", k=3, parts=2)
    query = out.writeStream.outputMode("append").format("memory").queryName("valued").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((str(r.window.start), r.column_name, r.value_cnt, r.unique_cnt, [tuple(v) for v in r.top_values]) for r in df.collect())
    want = key(windowed_values(batch, "ts", ["v", "n"], k=3, parts=2))
    assert len(want) == 8 and key(spark.table("valued")) == want


@pytest.mark.parametrize("pieces", [1, 4])
def test_places_in_an_order_of_all_rows(spark, pieces):
    data = [(k % 3, f"v{k % 7}", k) for k in range(200)] + [(1, "same", 0)] * 50 + [(None, None, 1)]
    df = spark.createDataFrame(data, "a int, v string, k int").repartition(pieces)
    got = display.placed(df, F.desc_nulls_last("a"), F.asc("v")).collect()
    assert sorted(r.place for r in got) == [*range(1, len(data) + 1)]
    in_order = [(r.a, r.v) for r in sorted(got, key=lambda r: r.place)]
    assert in_order == sorted(((a, v) for a, v, _ in data), key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    assert sorted((r.a or 0, r.v or "", r.k) for r in got) == sorted((a or 0, v or "", k) for a, v, k in data)
    assert display.placed(df.limit(0), F.asc("a")).count() == 0


def test_numbers_are_judged_by_all_rows(spark):
    df = spark.createDataFrame([("x" if k < 150 else "1", "" if k else "7", None) for k in range(1000)], "late string, rare string, none string").repartition(1)
    assert dict(readers.auto_numeric(df).dtypes) == {"late": "double", "rare": "double", "none": "string"}
    assert dict(readers.auto_numeric(df.limit(0)).dtypes) == {"late": "string", "rare": "string", "none": "string"}


def test_patterns_by_characters_equal_the_steps(spark):
    """Texts of ASCII characters alone are encoded by a table, others by the steps; both as the steps say."""
    texts = ["", ".0", "12.0", "1.00", "aB9~", "x" * 19 + ".0", "x" * 25 + ".0", "é1", "가-1", "\t\n_\\^|", "T0T1", "".join(map(chr, range(1, 21))), "".join(map(chr, range(30, 50))), "ß٣X.0", "\x00a"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    steps = F.substring(F.regexp_replace("v", r"\.0\z", ""), 1, patterns.PATTERN_LENGTH)
    for pattern, by in patterns.STEPS:
        steps = F.regexp_replace(steps, pattern, by)
    assert [tuple(r) for r in df.select("v", patterns.format_pattern(F.col("v")), steps).collect() if r[1] != r[2]] == []


def test_alike_texts_have_one_summary(spark):
    """Characters of one class may stand for each other in the summary, and the summary is that of its parts."""
    texts = ["2024-01-31", "2024-01-31T10:20:30.120", "007", "0", "100.50", "+5.0", "x9", "Xy", "T", "가a", "a\tb", "[z]", "🙂", "-q", "", None, " 12 ", "10", "x9"]
    vc = profile.value_counts(spark.createDataFrame([(t, t if t and t[0] in "0127+" else None) for t in texts], "v string, n string"))
    got = {r.column_name: r.asDict() for r in profile.summary(vc).collect()}
    for part in (profile.counts(vc), profile.composition(vc), profile.first_characters(vc), profile.numeric_shape(vc)):
        for row in part.collect():
            assert {k: got[row.column_name][k] for k in row.asDict()} == row.asDict()


def test_leading_values_are_few_and_hold_the_first(spark):
    """Of many values of one count the first ten are found without sorting all."""
    vc = spark.range(20000).select(F.lit("c").alias("column_name"), F.format_string("v%05d", F.col("id")).alias("value"), F.when(F.col("id") % 5000 == 4999, 3).otherwise(1).cast("long").alias("cnt"))
    left = profile._leading(vc, 10)
    want = ["v04999", "v09999", "v14999", "v19999", *[f"v{k:05d}" for k in range(6)]]
    assert left.count() < 200 and {r.value for r in left.collect()} >= set(want)
    assert [v.value for v in profile.top_values(vc).first().top_values] == want


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_equal_percentile(spark, n):
    df = spark.range(n).select(((F.col("id") * 7919) % 101 / 4).alias("a"), F.when(F.col("id") % 3 == 0, -F.col("id") / 8).alias("b"))
    counted = stats.numeric_form(df, ["a", "b"]).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    want = stats.numeric_form(df, ["a", "b"]).groupBy("column_name").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    got = {r.column_name: [r.q25, r.q50, r.q75] for r in stats.quantiles(counted, stats.QUARTILES).collect()}
    assert got == {r.column_name: pytest.approx(r.q) for r in want.collect()}


def test_quartiles_hold_no_column_in_one_task(spark):
    counted = spark.range(1000).select(F.lit("a").alias("column_name"), F.col("id").cast("double").alias("value"), F.lit(1).cast("long").alias("n"))
    plan = stats.quantiles(counted, stats.QUARTILES)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "percentile" not in stats.describe(counted, ["value"])._jdf.queryExecution().optimizedPlan().toString()


def test_more_cells_are_dealt_to_more_tasks(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    before = [spark.conf.get(n, None) for n in names]
    with shared.sized(spark, 10 * shared.CELLS - 1):
        assert spark.conf.get(names[0]) == "10"
    with pytest.raises(ValueError), shared.sized(spark, 1):
        assert spark.conf.get(names[0]) == before[0]
        raise ValueError
    assert [spark.conf.get(n, None) for n in names] == before


def test_inclusion_deals_values_by_their_number(spark, monkeypatch, capsys):
    monkeypatch.setattr(match, "HELD", 10, raising=False)
    rows = [("d", f, c, str(v), 1) for f, c, n in (("a", "x", 60), ("b", "y", 40)) for v in range(n)]
    values = spark.createDataFrame(rows, "file_path string, file_name string, column_name string, value string, cnt long")
    pairs = spark.createDataFrame([("d", "a", "x", "d", "b", "y", 0)], "file_path string, file_name string, column_name string, master_path string, master_file string, master_column string, compare_length int")
    # values may repeat: their rows are added
    found = match.inclusion(pairs, values.union(values), 0.0)
    found.explain()
    plan = capsys.readouterr().out
    assert "20), REPARTITION_BY_NUM" in plan and "hashpartitioning(compare_length" in plan
    got = found.first()
    assert (got.compare_count, got.source_count, got.matched_rows, got.source_rows, got.orphan_rows, got.match_pct) == (40, 60, 80, 120, 40, 66.67)


def test_values_counted_apart_are_the_same(spark):
    """Values that are counted before they become texts: equal texts are one row, different texts of equal numbers are two."""
    df = spark.sql("SELECT * FROM VALUES (1, 0.0D, TIMESTAMP '2024-01-01 00:00:00', 'a', true), (1, -0.0D, TIMESTAMP '2024-01-01 00:00:00', 'a', NULL), (NULL, 2.5D, NULL, '', false), (3, NULL, TIMESTAMP '2024-01-02 10:00:00.5', NULL, true) AS t(n, d, t, s, b)")
    rows = lambda found: sorted(map(tuple, found.collect()), key=repr)
    assert rows(profile.value_counts_apart(df)) == rows(profile.value_counts(df))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # one hour has the same texts twice
    try:
        twice = spark.sql("SELECT timestamp_seconds(s) AS t FROM VALUES (1729987200), (1729990800) AS v(s)")
        assert rows(profile.value_counts_apart(twice)) == rows(profile.value_counts(twice)) and profile.value_counts_apart(twice).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_profile_of_many_ranges_equals_sorting(spark, monkeypatch, capsys):
    """Medians, ends and most frequent values of columns and formats, found by ranges; the rows per column are joined without sorts."""
    import random

    monkeypatch.setattr(profile, "DEALT", 25)
    rnd = random.Random(3)
    made = {"numbers": [str(rnd.randint(0, 3000)) for _ in range(900)], "texts": [rnd.choice(["ab", "Ab", "é🙂", "x-1", ""]) + str(rnd.randint(0, 99)) for _ in range(500)], "one": ["v"] * 9, "none": [None] * 3}
    rows = [(c, v) for c, vs in made.items() for v in vs]
    vc = spark.createDataFrame(rows, "column_name string, value string").groupBy("column_name", "value").agg(F.count("*").alias("cnt")).localCheckpoint()
    found = profile.dealt(vc)
    assert found.select("range").distinct().count() > 10
    out = profile.assembled(vc)
    got = {r.column_name: r for r in out.collect()}
    assert got["none"].null_cnt == 3 and got["none"].median_string is None and got["none"].top_values is None
    for c in ("numbers", "texts", "one"):
        values, count = sorted(made[c], key=str.encode), {v: made[c].count(v) for v in made[c]}
        first = sorted(count, key=lambda v: (-count[v], v.encode()))[:10]
        r = got[c]
        assert (r.min_string, r.max_string, r.median_string, r.mode_string, r.mode_cnt) == (values[0], values[-1], values[len(values) // 2], first[0], count[first[0]])
        assert [(v.value, v.cnt) for v in r.top_values] == [(v, count[v]) for v in first]
        form = {r.value: r.format for r in found.where(F.col("column_name") == c).collect()}
        held = [v for v in values if form[v] == r.format]
        assert (r.format_min, r.format_max, r.format_median, r.format_value) == (held[0], held[-1], held[len(held) // 2], len(held))
    capsys.readouterr()
    out.explain()
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_graph_counts_values_not_texts(spark, tmp_path, monkeypatch):
    """0.0 and -0.0 are one value, as in SQL, though their texts differ: such a column is no key."""
    from metaspan.plans import relations

    monkeypatch.setattr(relations, "GRAPH", {"t": ["t_d", "t_s"]})
    spark.sql("SELECT * FROM VALUES (0.0D, 'abc'), (-0.0D, 'b') AS t(t_d, t_s)").write.parquet(str(tmp_path / "t.parquet"))
    assert sorted(map(tuple, relations._graph(spark, str(tmp_path)).collect())) == [("t", "d", 0, "NUMBER"), ("t", "s", 1, "VARCHAR2(3)")]


def test_control_limits_of_counted_values_are_those_of_the_rows(spark):
    """Of two tables at once, with texts that are the same number, fractions of four bytes, both zeros, and values that are no number or without end."""
    inf = float("inf")
    rows = [(f"{k % 7}.5", 0.1 * k, k * 1.25) for k in range(40)] + [("0.50", 0.1, 0.0), ("x", None, -0.0), (None, 9e3, float("nan")), (" 7e5 ", -9e3, 5e5)]
    df = spark.createDataFrame(rows, "t string, f float, d double")
    other = spark.createDataFrame([(1,), (None,)], "one int").withColumn("endless", F.lit(inf))
    vc = shared.stored(profile.value_counts(df).unionByName(profile.value_counts(other)), "values")
    got = stats.control_limits_counted(vc, dict(df.dtypes + other.dtypes)).collect()
    want = {r.column_name: r for table in (df, other) for r in stats.control_limits(table, table.columns).collect()}
    assert {r.column_name for r in got} == set(want) == {"t", "f", "d", "one", "endless"}
    for r in got:
        for name, value in want[r.column_name].asDict().items():
            assert r[name] == (value if value is None or isinstance(value, (str, int)) else pytest.approx(value, rel=1e-12, nan_ok=True)), (r.column_name, name)


def test_integrity_kpis_counts_each_column_once(spark, monkeypatch):
    """The profile of both tables, the orphans, the dates and the limits come from one table of counted values."""
    from metaspan.plans import columns, relations

    made = []
    for module in (profile, stats, columns, relations):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, real=real: made.append(name) or real(df, name))
    rows = relations.integrity_kpis(spark, "/root/testdata/sf0.001").collect()
    assert {r.issue: r["columns"] for r in rows} == {"fk_mismatch": 1, "date_mismatch": 1, "below_lcl": 0, "above_ucl": 0}
    assert sorted(made) == ["dealt", "most", "numbers", "numbers-dealt", "values"]
