"""Declared checks: contracts of columns, ambiguous codes, required columns, outcomes of migrations."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contract(df: DataFrame, file_name: str, rules: list[dict]) -> DataFrame:
    """column_name, rule, checked, failed, passed of a contract's rules, in one aggregation.

    A rule: {file, column (globs; a name with exact), max_null_pct, min_length, max_length, fixed_length, regex, values, leading_zero (False: none), min, max, severity}; which apply is decided by names.
    """
    cells = []
    for r in rules:
        if not fnmatchcase(file_name, r.get("file", "*")):
            continue
        for c in df.columns:
            if not (c == r["column"] if r.get("exact") else fnmatchcase(c, r.get("column", "*"))):
                continue
            v = F.col(f"`{c}`").cast("string")
            number = v.try_cast("double")
            tests = {
                "max_null_pct": (lambda x: v.isNull(), "null"), "min_length": (lambda x: F.length(v) < x, "fail"), "max_length": (lambda x: F.length(v) > x, "fail"),
                "regex": (lambda x: ~v.rlike(x), "fail"), "fixed_length": (lambda x: F.length(v) != x, "fail"),
                "values": (lambda x: ~v.isin([str(y) for y in x]), "fail"), "leading_zero": (lambda x: v.rlike("^0[0-9]") if x is False else F.lit(False), "fail"),
                "min": (lambda x: number.isNull() | (number < x), "fail"), "max": (lambda x: number.isNull() | (number > x), "fail"),
            }
            for key, (test, kind) in tests.items():
                if key in r:
                    bad = F.coalesce(test(r[key]) & (v.isNotNull() if kind == "fail" else F.lit(True)), F.lit(False))
                    cells.append((c, key, r[key], r.get("severity", "error"), F.count_if(bad)))
    if not cells:
        return df.sparkSession.createDataFrame([], "column_name string, rule string, severity string, checked long, failed long, passed boolean")
    wide = df.agg(F.count("*").alias("n"), *[x.alias(f"c{i}") for i, (*_, x) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("rule"), F.lit(s).alias("severity"), F.lit(float(x) if k == "max_null_pct" else 0.0).alias("most_pct"), F.col(f"c{i}").alias("failed")) for i, (c, k, x, s, _) in enumerate(cells)])
    long = wide.select("n", F.inline(rows))
    return long.select("column_name", "rule", "severity", F.col("n").alias("checked"), "failed", (F.col("failed") * 100 <= F.col("most_pct") * F.col("n")).alias("passed"))


def _flat_rule(tree: dict) -> dict:
    """The rule keys of contract() from the groups null, length, pattern, numeric and domain."""
    tree = {"null" if k is None else k: v for k, v in tree.items()}  # an unquoted null is no text in YAML
    part = lambda name: tree.get(name) or {}
    named = {
        "max_null_pct": part("null").get("max_pct"), "min_length": part("length").get("min"), "max_length": part("length").get("max"), "regex": part("pattern").get("regex"),
        "fixed_length": part("pattern").get("fixed_length"), "min": part("numeric").get("min"), "max": part("numeric").get("max"), "values": part("domain").get("values"),
    }
    if part("pattern").get("allow_leading_zero") is False:
        named["leading_zero"] = False
    return {k: v for k, v in named.items() if v is not None}


def contract_rules(config: dict, file_name: str, columns: list[str]) -> list[dict]:
    """The rules of a data contract for a file's columns, one for each column, in the form of contract().

    ``config`` is the tree of a contract file (readers.read_config): defaults, and entries with globs of file and column, severity, importance and rules. A column takes
    the defaults, then what each entry that fits it says, later entries over earlier ones. Importance is 1 unless said.
    """
    tree = config.get("data_contract", config)
    defaults = tree.get("defaults") or {}
    out = []
    for column in columns:
        rule = {"column": column, "exact": True, "severity": defaults.get("severity", "medium"), "importance": float(defaults.get("importance", 1.0)), **_flat_rule(defaults)}
        for entry in tree.get("columns") or []:
            if fnmatchcase(file_name, entry.get("file", "*")) and fnmatchcase(column, entry.get("column", "*")):
                rule |= {k: entry[k] for k in ("severity", "importance") if k in entry} | _flat_rule(entry.get("rules") or {})
        out.append(rule)
    return out


def contract_report(df: DataFrame, file_name: str, config: dict) -> DataFrame:
    """contract() by a contract file, with each rule's importance and weighted_pct, the share of failed rows times the importance, at most 100."""
    rules = contract_rules(config, file_name, df.columns)
    found = contract(df, file_name, rules)
    importance = F.create_map(*[F.lit(x) for r in rules for x in (r["column"], float(r["importance"]))])
    share = F.coalesce(F.try_divide(F.col("failed") * 100.0, F.col("checked")), F.lit(0.0))
    out = found.withColumn("importance", F.element_at(importance, F.col("column_name")))
    return out.withColumn("weighted_pct", F.round(F.round(F.least(F.lit(100.0), share * F.col("importance")), 6), 2))


def ambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value: a code with several names; swapped, a name with several codes."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("value_cnt"), F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ", ").alias("value_list")).where("value_cnt > 1")


def letters(name: Column) -> Column:
    """The name with Hangul syllables as the two or three letters that they are made of."""

    def parts(c: Column) -> Column:
        code = F.ascii(c) - 0xAC00
        letter = lambda first, k: F.decode(F.unhex(F.hex(F.lit(first) + k)), "UTF-16BE")
        last = F.when(code % 28 > 0, letter(0x11A7, code % 28)).otherwise("")
        return F.when(code.between(0, 11171), F.concat(letter(0x1100, F.floor(code / 588)), letter(0x1161, F.floor(code % 588 / 28)), last)).otherwise(c)

    return F.when(name.rlike("[가-힣]"), F.array_join(F.transform(F.split(name, ""), parts), "")).otherwise(name)


def _shortened(text: Column, most: int) -> Column:
    """The text, and what is left of it when up to ``most`` of its characters are deleted."""
    out = last = F.array(text)
    for _ in range(most):
        drop = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))
        last = F.array_distinct(F.flatten(F.transform(last, drop)))
        out = F.array_union(out, last)
    return out


def similar_names(df: DataFrame, column: str, most: int = 2) -> DataFrame:
    """a, b, distance, same_sound: pairs of distinct values that differ by at most so many edits of letters (up to 2), and whether they sound alike.

    An index of deletions: two names within ``most`` edits share a form that is left when at most so many letters of each are deleted, so the names meet on hashes of those
    forms and only names near each other do. A name has about half the square of its length in forms, hence names and not texts.
    """
    if most not in (1, 2):
        raise ValueError("one or two edits")
    own = df.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct().withColumn("letters", letters(F.col("name")))
    index = own.select("name", "letters", F.explode(F.array_distinct(F.transform(_shortened(F.col("letters"), most), lambda t: F.xxhash64(t)))).alias("form"))
    other = index.select(F.col("name").alias("b"), F.col("letters").alias("b_letters"), "form")
    pairs = index.withColumnsRenamed({"name": "a", "letters": "a_letters"}).join(other, "form").where("a < b").select("a", "b", "a_letters", "b_letters").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("a_letters", "b_letters", most)).where("distance >= 0")
    return pairs.select("a", "b", "distance", (F.soundex("a") == F.soundex("b")).alias("same_sound"))


def standard_differences(df: DataFrame, standard: DataFrame) -> DataFrame:
    """Codes whose meaning is not the standard's. df: code, meaning; standard: code, standard_meaning."""
    return df.join(standard, "code", "left").where(F.col("meaning") != F.col("standard_meaning"))


def missing_columns(present: DataFrame, required: DataFrame) -> DataFrame:
    """Required (master_type, column_name) that a master's files lack."""
    return required.join(present, ["master_type", "column_name"], "left_anti")


#: The cases of a migration's outcome, whether it counts as right, and how the tables relate. Conditions on them follow in _cases().
CASES = [
    (1, True, "identical in columns, their order, rows and their order"), (2, True, "columns in another order"), (3, True, "rows in another order"), (4, True, "columns added"), (5, True, "columns deleted"),
    (6, True, "columns added and deleted"), (7, True, "1:n, measures agree by key"), (8, True, "n:1, measures agree by key"), (9, True, "1:1, measures agree within the tolerance"),
    (10, True, "1:n or n:1, measures agree within the tolerance"), (11, False, "1:1, totals agree, keys differ"), (12, False, "1:1, keys agree, totals differ"), (13, False, "1:1, columns added, keys and totals differ"),
    (14, False, "1:1, columns deleted, totals agree, measures differ by key"), (15, False, "1:1, columns changed, totals differ"), (16, False, "1:n, totals agree, measures differ by key"),
    (17, False, "1:n, totals differ"), (18, False, "n:1, totals agree, measures differ by key"), (19, False, "n:1, totals differ"),
]


def _cases() -> list[Column]:
    c = F.col
    same, other = ~c("columns_changed"), c("columns_changed")
    more, fewer, even = c("rows_after") > c("rows_before"), c("rows_after") < c("rows_before"), c("rows_after") == c("rows_before")
    return [
        c("identical"), c("rows_in_order") & same, ~c("rows_in_order") & same & c("rows_agree"), c("rows_in_order") & c("rows_agree") & (c("added") > 0) & (c("deleted") == 0),
        c("rows_in_order") & c("rows_agree") & (c("added") == 0) & (c("deleted") > 0), c("rows_in_order") & c("rows_agree") & (c("added") > 0) & (c("deleted") > 0),
        c("keys_agree") & ~c("rows_in_order") & more, c("keys_agree") & ~c("rows_in_order") & fewer, c("near") & (c("keys_changed") == 0) & even, c("near") & (c("keys_changed") == 0) & ~even,
        ~c("keys_agree") & even & same & c("totals_agree") & (c("keys_changed") > 0), ~c("keys_agree") & even & same & ~c("totals_agree") & (c("keys_changed") == 0) & (c("measures_changed") > 0),
        ~c("keys_agree") & even & other & ~c("totals_agree") & (c("keys_changed") > 0) & (c("added") > 0) & (c("deleted") == 0),
        ~c("keys_agree") & even & other & c("totals_agree") & (c("keys_changed") == 0) & (c("added") == 0) & (c("deleted") > 0), ~c("keys_agree") & even & other & ~c("totals_agree") & (c("keys_changed") == 0),
        ~c("keys_agree") & more & c("totals_agree"), ~c("keys_agree") & more & ~c("totals_agree"), ~c("keys_agree") & fewer & c("totals_agree"), ~c("keys_agree") & fewer & ~c("totals_agree"),
    ]


def migration_case(before: DataFrame, after: DataFrame, keys: list[str], measures: list[str], position: str | None = None, tolerance: float = 0.01) -> DataFrame:
    """One row: which of CASES a migrated table is, 0 for none, with the findings that decide it.

    Each table is aggregated once, by ``keys`` (columns of both): rows, sums of the ``measures`` (exact, as decimals), and sums of row hashes over the common columns, of which one
    takes the row's ``position`` (a column of its number in the table, which is not compared itself) and so depends on the order. All findings follow from these sums. Tables without a
    position have no order. Measures are near if those of every key differ by at most ``tolerance`` of the earlier ones.
    """
    skipped = {position} if position else set()
    a, b = ([c for c in df.columns if c not in skipped] for df in (before, after))
    common, added, deleted = [c for c in a if c in b], [c for c in b if c not in a], [c for c in a if c not in b]
    at = [F.col(position)] if position else []
    money = "decimal(38,6)"

    def summed(df: DataFrame, tag: int) -> DataFrame:
        row = [F.col(c).cast("string") for c in sorted(common)]
        big = lambda h: F.sum(h.cast("decimal(20,0)"))
        by = df.groupBy(*keys).agg(F.count("*").alias("n"), big(F.xxhash64(*row)).alias("free"), big(F.xxhash64(*at, *row)).alias("bound"), *[F.sum(F.col(m).cast("decimal(28,6)")).alias(f"m{k}") for k, m in enumerate(measures)])
        return by.select(*keys, *[F.when(F.lit(tag == t), F.col(c)).alias(f"{c}_{t}") for t in (0, 1) for c in ("n", "free", "bound", *[f"m{k}" for k in range(len(measures))])])

    ms = [f"m{k}" for k in range(len(measures))]
    both = summed(before, 0).unionByName(summed(after, 1)).groupBy(*keys).agg(*[F.sum(f"{c}_{t}").alias(f"{c}_{t}") for t in (0, 1) for c in ("n", "free", "bound", *ms)])
    there = F.col("n_0").isNotNull() & F.col("n_1").isNotNull()
    equal = lambda cs: F.forall(F.array(*[F.col(f"{c}_0").eqNullSafe(F.col(f"{c}_1")) for c in cs]), lambda x: x) if cs else F.lit(True)
    close = F.forall(F.array(*[F.coalesce(F.abs(F.col(f"{m}_1") - F.col(f"{m}_0")) <= F.abs(F.col(f"{m}_0")) * tolerance, F.col(f"{m}_0").eqNullSafe(F.col(f"{m}_1"))) for m in ms]), lambda x: x) if ms else F.lit(True)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast(money))
    total = both.agg(
        F.coalesce(F.sum("n_0"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("n_1"), F.lit(0)).alias("rows_after"), F.count_if(~there).alias("keys_changed"), F.count_if(there & ~equal(ms)).alias("measures_changed"),
        F.coalesce(F.bool_and(equal(["n", "free"])), F.lit(True)).alias("rows_agree"), F.coalesce(F.bool_and(equal(["n", "bound"])), F.lit(True)).alias("rows_in_order"), F.coalesce(F.bool_and(there & close), F.lit(True)).alias("near"),
        F.forall(F.array(F.lit(True), *[zero(f"{m}_0") == zero(f"{m}_1") for m in ms]), lambda x: x).alias("totals_agree"),
    )
    total = total.withColumns(
        {
            "keys_agree": (F.col("keys_changed") == 0) & (F.col("measures_changed") == 0), "added": F.lit(len(added)), "deleted": F.lit(len(deleted)), "columns_changed": F.lit(bool(added or deleted)),
            "identical": F.col("rows_in_order") & F.lit(a == b),
        }
    )
    case = F.coalesce(*[F.when(c, k) for (k, _, _), c in zip(CASES, _cases())], F.lit(0))
    told = lambda i: F.element_at(F.create_map(*[F.lit(x) for row in [(0, False, "none of the cases"), *CASES] for x in (row[0], row[i])]), F.col("case"))
    return total.withColumn("case", case).select("case", told(1).alias("right"), told(2).alias("relation"), *[c for c in total.columns])


def migration_outcome(before: DataFrame, after: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """One row: whether rows, columns, sums and distinct keys agree between two tables."""
    def measure(df, tag):
        return df.agg(F.count("*").alias(f"{tag}_rows"), F.countDistinct(*keys).alias(f"{tag}_keys"), *[F.sum(c).alias(f"{tag}_sum_{c}") for c in sums])

    both = measure(before, "a").withColumn("one", F.lit(1)).join(measure(after, "b").withColumn("one", F.lit(1)), "one")
    same = lambda n: F.when(F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}")), "same").otherwise("differs")
    sums_same = F.when(F.forall(F.array(*[F.col(f"a_sum_{c}").eqNullSafe(F.col(f"b_sum_{c}")) for c in sums]), lambda x: x), "same").otherwise("differs") if sums else F.lit("same")
    return both.select(same("rows").alias("row_status"), F.lit("same" if before.columns == after.columns else "differs").alias("column_status"), sums_same.alias("sum_status"), same("keys").alias("dimension_status"))
