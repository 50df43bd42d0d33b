"""Relations between columns, inferred from values: blocking by format, then inclusion of value sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaspan.operators.profile import rounded
from metaspan.sources.shared import materialised, tasks_for

FILE = ["file_path", "file_name", "column_name", "master_type"]
#: Semantic types that are never keys of a relation. Spelling counts, so Kor_Flag and KOR_NAME may be keys.
NEVER_JOINED = [
    "Time", "Timestamp", "Date", "DateTime", "DATECHAR", "TIME", "TIMESTAMP", "DATE", "DATETIME", "YEAR", "YEARMONTH", "YYMMDD", "LATITUDE", "LONGITUDE", "TEL", "CELLPHONE", "ADDRESS",
    "Alpha_Flag", "Num_Flag", "YN_Flag", "NUM_Flag", "KOR_Flag", "KOR_Name",
]
#: Types that are hardly ever keys, for callers that want fewer candidates: joinable(..., NEVER_JOINED + SELDOM_JOINED).
SELDOM_JOINED = ["Text", "CLOB", "True_False_Flag", "Kor_Flag", "NULL", "SINGLE VALUE"]
LEAST_FORMAT_PCT, LEAST_UNIQUE, LEAST_VALUES, LEAST_MATCH = 10.0, 10, 10, 20.0
PIVOT_MATCH, PIVOT_RANK = 10.0, 3


def expand_formats(profile: DataFrame) -> DataFrame:
    """A row for each of a column's up to three formats, blank ones left out: match_no, format and its figures."""
    names = ("format", "format_value", "format_pct", "format_min", "format_max", "format_mode", "format_median")
    cell = lambda r: F.struct(F.lit(r).alias("match_no"), *[F.col(n if r == 1 else f"{n}_{r}").alias(n) for n in names])
    keep = [c for c in ("file_path", "file_name", "column_name", "master_type", "detail_type", "unique_cnt", "value_cnt", "format_cnt", "pk") if c in profile.columns]
    long = profile.select(*keep, F.inline(F.array(cell(1), cell(2), cell(3))))
    return long.where((F.trim("format") != "") & (F.col("format_pct") > LEAST_FORMAT_PCT)).distinct()


def joinable(expanded: DataFrame, never: list[str] = NEVER_JOINED) -> DataFrame:
    return expanded.where(~F.coalesce(F.col("detail_type"), F.lit("")).isin(never))


def compare_length(column: Column) -> Column:
    """Characters of a reference column's values that count: the digit that ends its name, else all (0)."""
    return F.coalesce(F.nullif(F.regexp_extract(column, r"([0-9])\z", 1), F.lit("")), F.lit("0")).cast("int")


#: Bytes of a text that place it on the line of its format, beyond what all texts of the format begin with.
PLACED = 7


def _places(formats: DataFrame) -> DataFrame:
    """format, skip: the number of characters that all least, greatest and median values of a format share."""
    low = F.least(F.min("format_min"), F.min("format_median"))
    high = F.greatest(F.max("format_max"), F.max("format_median"))
    ends = formats.groupBy("format").agg(low.alias("low"), high.alias("high"))
    same = F.zip_with(F.split("low", ""), F.split("high", ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
    return ends.select("format", F.greatest(F.array_position(same, False) - 1, F.lit(0)).cast("int").alias("skip"))


def _place(value: Column) -> Column:
    """A number that orders texts as their first bytes do."""
    code = F.rpad(F.substring(F.hex(F.encode(F.substr(value, F.col("skip") + 1), "UTF-8")), 1, 2 * PLACED), 2 * PLACED, "0")
    return F.conv(code, 16, 10).cast("long")


def ranges_met(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """``points`` (format, point, ...) joined to the ``ranges`` (format, low, high, ...) of their format that they lie in.

    An interval join. Values become places on a line, as long as an integer of PLACED bytes has; a range becomes the few aligned blocks, of sizes that are powers of two,
    that make it up, a point the one block of each size that it lies in. A point and a range that holds it share exactly one block, so the join is on
    format, size and block and its rows are the pairs that meet, however many columns a format has. Texts that agree in all placed bytes are compared themselves.
    """
    both = points.select("format", F.col("point").alias("format_min"), F.col("point").alias("format_max"), F.col("point").alias("format_median"))
    both = both.union(ranges.select("format", F.col("low"), F.col("high"), F.col("low")))
    skip = _places(both)
    bits = 8 * PLACED
    at = points.join(skip, "format").withColumn("at", _place(F.col("point"))).drop("skip")
    at = at.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.struct(k.alias("size"), F.call_function("shiftright", F.col("at"), k).alias("block")))).alias("node")).drop("at")
    span = ranges.where("low <= high").join(skip, "format").withColumns({"first": _place(F.col("low")), "end": _place(F.col("high")) + 1}).drop("skip")

    def blocks(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first, end = F.call_function("shiftright", F.col("first") + width - 1, k), F.call_function("shiftright", F.col("end"), k)
        node = lambda hit, block: F.when(hit & (first < end), F.struct(k.alias("size"), block.alias("block")))
        return F.array_compact(F.array(node(first % 2 == 1, first), node(end % 2 == 1, end - 1)))

    span = span.select("*", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), blocks))).alias("node")).drop("first", "end")
    return at.join(span, ["format", "node"]).where("point BETWEEN low AND high").drop("node")


def candidate_pairs(sources: DataFrame, masters: DataFrame) -> DataFrame:
    """Source and master columns of one format whose ranges and sizes allow an inclusion.

    The source's median lies in the master's range (see ranges_met()); the rest are conditions on the pairs that meet. Of several formats the one with
    the largest share in the source decides.
    """
    renamed = masters.select(
        F.col("format"), F.col("file_path").alias("master_path"), F.col("file_name").alias("master_file"), F.col("column_name").alias("master_column"), F.col("master_type").alias("reference_type"),
        F.col("format_min").alias("low"), F.col("format_max").alias("high"), F.col("format_value").alias("master_value"), F.col("format_cnt").alias("master_format_cnt"),
    )
    size = compare_length(F.col("master_column"))
    large = (F.col("unique_cnt") >= LEAST_UNIQUE) & (F.col("format_value") >= LEAST_VALUES)
    gates = (
        (F.col("format_cnt") < F.col("master_value"))
        & ~((F.col("format_cnt") >= 1.5 * F.col("master_format_cnt")) & (F.col("format_cnt") >= 5) & (size == 0))
        & ~((F.col("file_path") == F.col("master_path")) & (F.col("file_name") == F.col("master_file")) & (F.col("column_name") == F.col("master_column")))
    )
    met = ranges_met(sources.where(large).withColumn("point", F.col("format_median")), renamed)
    pairs = met.where(gates).withColumn("compare_length", size).withColumnsRenamed({"low": "master_min", "high": "master_max"}).drop("point")
    w = Window.partitionBy("file_path", "file_name", "column_name", "master_file", "master_column").orderBy(F.desc("format_pct"), "match_no")
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def distinct_values(tables: dict[tuple[str, str], DataFrame], columns: dict[tuple[str, str], list[str]]) -> DataFrame:
    """file_path, file_name, column_name, value, cnt: distinct trimmed values of the columns with their rows, blank ones left out."""
    out = None
    for (path, name), df in tables.items():
        wanted = columns.get((path, name))
        if not wanted:
            continue
        cells = [F.struct(F.lit(c).alias("column_name"), F.trim(F.col(f"`{c}`").cast("string")).alias("value")) for c in wanted]
        part = df.select(F.lit(path).alias("file_path"), F.lit(name).alias("file_name"), F.inline(F.array(*cells))).where("value IS NOT NULL AND value <> ''")
        part = part.groupBy("file_path", "file_name", "column_name", "value").agg(F.count("*").alias("cnt"))
        out = part if out is None else out.unionByName(part)
    return out


#: Values whose holders a task puts together.
HELD = 1 << 20

#: Columns of pairs up to which their list is broadcast; beyond it the same joins shuffle.
MOST_LISTED = 500_000


def _listed(metadata: DataFrame) -> DataFrame:
    return F.broadcast(metadata) if metadata.limit(MOST_LISTED + 1).count() <= MOST_LISTED else metadata


def inclusion(pairs: DataFrame, values: DataFrame, least: float = LEAST_MATCH) -> DataFrame:
    """compare_count (values of both), source_count (values of the source) and match_pct of each pair, from `least` on; and in rows
    instead of values: matched_rows, source_rows and orphan_rows, those whose value the master lacks.

    Each value is shuffled once, to the other columns that hold it, to as many tasks as there are HELD of them. Then values are no longer looked at: those that are held by the same set of columns
    count alike for every pair, so they are summed by set and holder, a row for each holder of a value, combined before they move. Pairs meet the sums
    of sets, of which there are few. ``values`` are as of distinct_values(), read twice, and may repeat; without cnt each counts as one row. Values of a pair with a compare length are cut to it first,
    so a value has a copy for each length that its column needs.
    """
    source = ["file_path", "file_name", "column_name"]
    master = ["master_path", "master_file", "master_column"]
    name = lambda columns: F.xxhash64(*columns)  # noqa: E731  of metadata: some thousands of columns
    short = materialised(pairs.select(*source, *master, "compare_length", name(source).alias("s"), name(master).alias("m")).distinct(), "pairs")
    kinds = short.select(F.col("s").alias("held"), "compare_length").union(short.select("m", "compare_length")).distinct()
    cut = F.when(F.col("compare_length") > 0, F.expr("left(value, compare_length)")).otherwise(F.col("value")).alias("value")
    rows = F.col("cnt") if "cnt" in values.columns else F.lit(1)
    held = values.select(name(source).alias("held"), "value", rows.cast("long").alias("cnt")).join(_listed(kinds), "held").select("compare_length", cut, "held", "cnt")
    # dealt by value alone, so that what follows finds each value's holders together and moves nothing
    held = held.repartition(tasks_for(values.sparkSession, values.count(), HELD), "compare_length", "value")
    held = held.groupBy("compare_length", "value", "held").agg(F.sum("cnt").alias("cnt"))
    together = Window.partitionBy("compare_length", "value").orderBy("held").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alike = held.withColumn("holders", F.collect_list("held").over(together))
    alike = alike.groupBy("compare_length", "holders", F.col("held").alias("s")).agg(F.count("*").alias("n"), F.sum("cnt").alias("rows"))
    both = F.array_contains("holders", F.col("m"))
    counts = alike.join(_listed(short.select("s", "m", "compare_length")), ["s", "compare_length"]).groupBy("s", "m", "compare_length").agg(
        F.sum(F.when(both, F.col("n")).otherwise(0)).alias("compare_count"), F.sum("n").alias("source_count"), F.sum(F.when(both, F.col("rows")).otherwise(0)).alias("matched_rows"), F.sum("rows").alias("source_rows")
    )
    out = counts.join(short, ["s", "m", "compare_length"]).select(*source, *master, "compare_length", "compare_count", "source_count", "matched_rows", "source_rows")
    out = out.withColumns({"match_pct": rounded(F.col("compare_count") / F.col("source_count") * 100), "orphan_rows": F.col("source_rows") - F.col("matched_rows")})
    return out.where(F.col("match_pct") >= least)


def _mapping(pairs: DataFrame, values: DataFrame) -> DataFrame:
    pairs = materialised(pairs, "candidates")  # metadata that is used twice
    found = inclusion(pairs, values).where(F.col("match_pct") > LEAST_MATCH)
    kinds = pairs.select("file_path", "file_name", "column_name", "master_path", "master_file", "master_column", "master_type", "reference_type").distinct()
    return found.join(kinds, ["file_path", "file_name", "column_name", "master_path", "master_file", "master_column"])


def reference_mapping(profile: DataFrame, values: DataFrame) -> DataFrame:
    """Columns of data files whose values lie in a reference list."""
    long = joinable(expand_formats(profile))
    return _mapping(candidate_pairs(long.where("master_type <> 'Reference'"), long.where("master_type = 'Reference'")), values)


def internal_mapping(profile: DataFrame, values: DataFrame) -> DataFrame:
    """Columns of data files whose values lie in another column of the data files."""
    long = joinable(expand_formats(profile)).where("master_type <> 'Reference'")
    return _mapping(candidate_pairs(long, long), values)


def rule_mapping(profile: DataFrame, rates: DataFrame) -> DataFrame:
    """Validator rates in the shape of the other mappings: the validator is the master column of type Rule."""
    return rates.join(profile.select(*FILE), "column_name").select(
        *FILE, F.lit("").alias("master_path"), F.lit("").alias("master_file"), F.col("validator").alias("master_column"), F.lit("Rule").alias("reference_type"),
        F.col("valid_cnt").alias("compare_count"), F.col("value_cnt").alias("source_count"), F.col("valid_pct").alias("match_pct"),
    ).where(F.col("match_pct") > LEAST_MATCH)


def concat_mappings(**kinds: DataFrame) -> DataFrame:
    """All mappings, tagged by kind, with the columns of any."""
    out = None
    for kind, df in kinds.items():
        tagged = df.withColumn("mapping_kind", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def rank_matches(mapping: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("match_pct"), F.desc("compare_count"), "master_path", "master_file", "master_column")
    return mapping.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pivot_mapping(mapping: DataFrame, least: float = PIVOT_MATCH, k: int = PIVOT_RANK) -> DataFrame:
    """One row per column with its k best matches side by side."""
    top = rank_matches(mapping.where(F.col("match_pct") >= least), FILE, k)
    fields = {"code_path": "master_path", "code_file": "master_file", "code_column": "master_column", "code_type": "reference_type", "matched": "compare_count", "matched_pct": "match_pct"}
    cells = [F.first(F.when(F.col("rank") == r, F.col(c)), ignorenulls=True).alias(f"{n}_{r}") for r in range(1, k + 1) for n, c in fields.items()]
    return top.groupBy(*FILE).agg(*cells)


def final_mapping(profile: DataFrame, pivot: DataFrame, reference: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The profile with internal matches 1-3, the best reference match as 4, attribute and foreign-key flag.

    attribute is the first matched rule, else the reference column; fk is set if match 1 is a key candidate of its file.
    """
    best = rank_matches(reference, ["file_path", "column_name"], 1).select(
        "file_path", "column_name", F.col("master_path").alias("code_path_4"), F.col("master_file").alias("code_file_4"), F.col("master_column").alias("code_column_4"),
        F.col("reference_type").alias("code_type_4"), F.col("compare_count").alias("matched_4"), F.col("match_pct").alias("matched_pct_4"),
    )
    out = profile.join(pivot, FILE, "left").join(best, ["file_path", "column_name"], "left")
    out = out.join(rules.select(*FILE, "rule"), FILE, "left") if rules is not None else out.withColumn("rule", F.lit("").cast("string"))
    keys = profile.where("pk = 1").select(F.col("file_path").alias("code_path_1"), F.col("column_name").alias("code_column_1"), F.lit(1).alias("fk")).distinct()
    first = F.nullif(F.trim(F.substring_index("rule", ";", 1)), F.lit(""))
    return out.withColumn("attribute", F.coalesce(first, F.col("code_column_4"), F.lit(""))).join(keys, ["code_path_1", "code_column_1"], "left").withColumn("fk", F.coalesce("fk", F.lit(0)))


def join_types(types: DataFrame, profile: DataFrame) -> DataFrame:
    """Types with profiles on path, file and column; the type's master type wins. Paths are compared with forward slashes."""
    same = F.regexp_replace("file_path", r"\\+", "/")
    left = types.withColumn("file_path", same).withColumnRenamed("master_type", "own_type")
    return left.join(profile.withColumn("file_path", same), ["file_path", "file_name", "column_name"]).withColumn("master_type", F.coalesce("own_type", "master_type")).drop("own_type")
