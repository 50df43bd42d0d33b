"""Column profiles by one shuffle.

All columns go to long form (column, value) and are counted once; every statistic
of values, lengths, formats, edges and composition is then an aggregation of the counted distinct values. A frequent
value is combined before the shuffle, so it is no hot spot; no column is collected or sampled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaspan.functions import patterns
from metaspan.sources.shared import materialised, stored, tasks_for

COLUMN = "column_name"


def rounded(c: Column, digits: int = 2) -> Column:
    """Rounded half up, after what binary fractions add beyond six digits is gone."""
    return F.round(F.round(c, 6), digits)


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per cell: column_name, value as text."""
    cells = [F.struct(F.lit(c).alias(COLUMN), F.col(f"`{c}`").cast("string").alias("value")) for c in columns or df.columns]
    return df.select(F.inline(F.array(*cells)))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values of each column with their counts: column_name, value, cnt (null is a value)."""
    return long_form(df, columns).groupBy(COLUMN, "value").agg(F.count("*").alias("cnt"))


#: Types of which different values have different texts, so that values may be counted before they become texts.
TEXT_TELLS = r"tinyint|smallint|int|bigint|decimal\(.*|date|timestamp_ntz|boolean|string"


def value_counts_apart(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """value_counts() with an aggregation for each column, of the values themselves where their type allows: cheaper a cell, but ``df`` is read once for each column. For sources that read a column by itself."""
    kinds = dict(df.dtypes)

    def part(c: str) -> DataFrame:
        text = F.col("value").cast("string").alias("value")
        plain = re.fullmatch(TEXT_TELLS, kinds[c])
        # the same time may have one text for two moments, so those are counted once more; of fractions, 0.0 and -0.0 are equal with different texts
        value = F.col(f"`{c}`") if plain or kinds[c] == "timestamp" else F.col(f"`{c}`").cast("string")
        out = df.groupBy(value.alias("value")).agg(F.count("*").alias("cnt"))
        if kinds[c] == "timestamp":
            out = out.groupBy(text).agg(F.sum("cnt").alias("cnt"))
        return out.select(F.lit(c).alias(COLUMN), text, "cnt")

    return reduce(DataFrame.unionByName, [part(c) for c in columns or df.columns])


def _present(counts: DataFrame) -> DataFrame:
    return counts.where("value IS NOT NULL")


def _count_cells() -> list[Column]:
    return [
        F.sum("cnt").alias("record_cnt"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("cnt"))), F.lit(0)).alias("value_cnt"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("different"))), F.lit(0)).alias("unique_cnt"),
    ]


def hashed(c: Column) -> Column:
    """An aggregate of texts that is kept in a table of keys; alone, Spark would sort all rows by key for it. For few keys, as columns are."""
    return F.when(F.size(F.collect_set(F.lit(True))) > 0, c)


def _with_shares(out: DataFrame) -> DataFrame:
    return out.withColumns(
        {
            "null_cnt": F.col("record_cnt") - F.col("value_cnt"),
            "null_pct": rounded((F.col("record_cnt") - F.col("value_cnt")) / F.col("record_cnt") * 100),
            "unique_pct": rounded(F.try_divide(F.col("unique_cnt"), F.col("value_cnt")) * 100),
        }
    )


def counts(vc: DataFrame) -> DataFrame:
    """Rows, values, nulls, distinct values and their shares."""
    return _with_shares(vc.withColumn("different", F.lit(1)).groupBy(COLUMN).agg(*_count_cells()))


def lengths(vc: DataFrame) -> DataFrame:
    """Lengths in characters: number of values, of distinct lengths, least, most, mean, mode (ties: least), median."""
    by = _present(vc).groupBy(COLUMN, F.length("value").alias("len")).agg(F.sum("cnt").alias("n"))
    # as many rows as there are distinct lengths
    w = Window.partitionBy(COLUMN).orderBy("len")
    by = by.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(COLUMN))})
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("len")))
    return by.groupBy(COLUMN).agg(
        F.sum("n").alias("len_cnt"),
        F.count("*").alias("len_distinct"),
        F.min("len").alias("len_min"),
        F.max("len").alias("len_max"),
        rounded(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 1).alias("len_avg"),
        F.max_by("len", F.struct("n", -F.col("len"))).alias("len_mode"),
        ((at(F.floor((F.col("total") - 1) / 2)) + at(F.floor(F.col("total") / 2))) / 2).alias("len_median"),
    )


#: Different values of a key that are ordered in one task to find its median; more are narrowed down first.
ORDERED = 1 << 16
#: Characters by which the beginning of the median is lengthened in a round.
STEP = 2


def _shared(low: str, high: str) -> Column:
    """The number of characters that all texts between two begin with."""
    same = F.zip_with(F.split(low, ""), F.split(high, ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
    # texts without a difference are equal, or one begins with the other
    return F.when(F.col(low) == F.col(high), F.length(low)).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.length(low))).cast("int")


def weighted_medians(vc: DataFrame, keys: list[str], ordered: int = ORDERED) -> DataFrame:
    """keys, median: the value at position floor(n / 2) of the sorted values, with repeats.

    Selection by beginnings, for all keys at once. Of each key one group of values is held, those that begin as the median does, with the
    number of values before it. While a group has more than ``ordered`` different values, its beginnings of STEP characters beyond what all its
    values share are counted, and the one in which the median falls is the next group. So what is ever ordered within a key is the beginnings of one
    round or the values of a small group, however the values are distributed; each round reads the values once and moves counts only.
    """
    at = F.struct(F.lit("").alias("head"), F.lit(0).cast("long").alias("before"))
    sizes = [F.sum("cnt").alias("n"), F.count("*").alias("different")]
    ends = [hashed(F.min("value")).alias("low"), hashed(F.max("value")).alias("high")]
    held = materialised(vc.groupBy(*keys).agg(*sizes, *ends).withColumns({"at": at, "middle": F.floor(F.col("n") / 2)}), "medians")
    while True:
        large = held.where(f"different > {ordered}")
        if large.isEmpty():
            break
        # the values of a group are those from its low to its high one; both are its own
        large = large.select(*keys, "middle", "at", "low", "high", (_shared("low", "high") + STEP).alias("size"))
        inside = vc.join(large, keys).where("value >= low AND value <= high").withColumn("head", F.expr("left(value, size)"))
        heads = inside.groupBy(*keys, "middle", "at", "head").agg(*sizes)
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("at.before")
        found = heads.withColumn("first", before).where((F.col("first") <= F.col("middle")) & (F.col("middle") < F.col("first") + F.col("n")))
        found = materialised(found.select(*keys, "n", "different", F.struct("head", F.col("first").alias("before")).alias("at"), "middle", "head"), "heads")
        # least and greatest value of the one group of each key that is kept
        found = found.join(inside.select(*keys, "head", "value").join(F.broadcast(found.select(*keys, "head")), [*keys, "head"]).groupBy(*keys).agg(*ends), keys)
        found = found.select(*keys, "n", "different", "low", "high", "at", "middle")
        held = materialised(held.where(f"different <= {ordered}").unionByName(found), "medians")
    near = vc.join(held.select(*keys, "low", "high", "middle", "at.before"), keys).where("value >= low AND value <= high")
    upto = F.col("before") + F.sum("cnt").over(Window.partitionBy(*keys).orderBy("value"))
    return near.withColumn("upto", upto).where(F.col("upto") > F.col("middle")).groupBy(*keys).agg(F.min("value").alias("median"))


#: Values of a range of dealt().
DEALT = 1 << 18


def dealt(vc: DataFrame) -> DataFrame:
    """The values that are there, with their format and the number of a range of their order in their column: column_name, value, cnt, format, range.

    A range has some DEALT values, however many a column has. Of two values of a column the one in the lower range is the less, so what is asked of an
    order is found by sums of ranges and by ordering one range; that serves the order of a column and, as they are parts of it, the orders of its formats.
    """
    if "range" in vc.columns:
        return vc
    ranges = vc.repartitionByRange(tasks_for(vc.sparkSession, vc.count(), DEALT), COLUMN, "value").withColumn("range", F.spark_partition_id())
    # the pattern is five regexes long: made once per distinct value, after the ranges were sought
    return stored(_present(ranges).withColumn("format", patterns.format_pattern(F.col("value"))), "dealt")


def _ends() -> list[Column]:
    mode = F.min_by("value", F.struct(-F.col("cnt"), "value"))
    return [F.sum("cnt").alias("n"), hashed(F.min("value")).alias("low"), hashed(F.max("value")).alias("high"), hashed(mode).alias("mode"), F.max("cnt").alias("mode_cnt")]


def _ends_of_ranges() -> list[Column]:
    """_ends() of a whole from those of its ranges."""
    mode = F.min_by("mode", F.struct(-F.col("mode_cnt"), "mode"))
    return [F.sum("n").alias("n"), hashed(F.min("low")).alias("low"), hashed(F.max("high")).alias("high"), hashed(mode).alias("mode"), F.max("mode_cnt").alias("mode_cnt")]


def _medians(found: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median: the value at position floor(n / 2) of the sorted values, with repeats. ``found`` as of dealt(), ``sums`` its numbers of values (n) by keys and range."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sums.withColumns({"before": before, "middle": F.floor(F.sum("n").over(Window.partitionBy(*keys)) / 2)})
    held = materialised(places.where("before <= middle AND middle < before + n").select(*keys, "range", "before", "middle"), "medians")
    near = found.join(F.broadcast(held), [*keys, "range"])  # a row for each key
    upto = F.col("before") + F.sum("cnt").over(Window.partitionBy(*keys).orderBy("value"))
    return near.withColumn("upto", upto).where(F.col("upto") > F.col("middle")).groupBy(*keys).agg(hashed(F.min("value")).alias("median"))


def _value_stats(found: DataFrame, ranges: DataFrame) -> DataFrame:
    ends = ranges.groupBy(COLUMN).agg(*_ends_of_ranges())
    medians = _medians(found, ranges.groupBy(COLUMN, "range").agg(F.sum("n").alias("n")), [COLUMN])
    return ends.join(F.broadcast(medians), COLUMN).select(
        COLUMN, F.col("low").alias("min_string"), F.col("high").alias("max_string"), F.col("mode").alias("mode_string"), "mode_cnt", F.col("median").alias("median_string")
    )


def value_stats(vc: DataFrame) -> DataFrame:
    """Least, greatest, median and most frequent value (ties: least) with its count. ``vc`` is as of value_counts() or dealt()."""
    found = dealt(vc)
    return _value_stats(found, materialised(found.groupBy(COLUMN, "range").agg(*_ends()), "ranges"))


def ranked(counted: DataFrame, keys: list[str], k: int, by: str = "value") -> DataFrame:
    """The k most frequent of each key, ties by value, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc("cnt"), by)
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Groups of values, by hash, whose first ones bound the rank of others.
GROUPS = 24


def _leading(counted: DataFrame, k: int) -> DataFrame:
    """The values that may be among the k most frequent of their column (ties by value): those up to the k-th of the first ones of GROUPS groups of values.

    So few are left to be sorted. With fewer groups filled than k, all are left.
    """
    place = F.struct((-F.col("cnt")).alias("by"), "value")
    group = F.pmod(F.xxhash64("value"), F.lit(GROUPS))
    firsts = counted.withColumn("group", group).groupBy(COLUMN).agg(F.array_sort(F.array_compact(F.array(*[hashed(F.min(F.when(F.col("group") == g, place))) for g in range(GROUPS)]))).alias("firsts"))
    bound = firsts.select(COLUMN, F.get("firsts", F.lit(k - 1)).alias("bound"))
    return counted.join(F.broadcast(bound), COLUMN).where(F.col("bound").isNull() | (place <= F.col("bound"))).drop("bound")


def _most(found: DataFrame, k: int) -> DataFrame:
    """The values of dealt() that may be among the k most frequent of their column (ties by value), as their count and their range tell: of each column those of k counts and ranges at most."""
    cells = found.groupBy(COLUMN, "cnt", "range").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(COLUMN).orderBy(F.desc("cnt"), "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(F.broadcast(cells.withColumn("before", before).where(F.col("before") < k).select(COLUMN, "cnt", "range")), [COLUMN, "cnt", "range"])


def top_values(vc: DataFrame, k: int = 10) -> DataFrame:
    """column_name, top_values (array of value and count, most frequent first), top_pct. ``vc`` is as of value_counts() or dealt()."""
    found = dealt(vc)
    total = found.groupBy(COLUMN).agg(F.sum("cnt").alias("n"))
    top = ranked(_leading(stored(_most(found, k).select(COLUMN, "value", "cnt"), "most"), k), [COLUMN], k).groupBy(COLUMN).agg(F.sort_array(F.collect_list(F.struct("rank", "value", "cnt"))).alias("ranked"), F.sum("cnt").alias("top_cnt"))
    return top.join(total, COLUMN).select(
        COLUMN, F.transform("ranked", lambda r: F.struct(r.value.alias("value"), r.cnt.alias("cnt"))).alias("top_values"), rounded(F.col("top_cnt") / F.col("n") * 100).alias("top_pct")
    )


def _top_formats(found: DataFrame, k: int) -> DataFrame:
    """column_name, rank, format, cnt, value_cnt, format_cnt as a table."""
    by = found.groupBy(COLUMN, "format").agg(F.sum("cnt").alias("cnt"))
    total = by.groupBy(COLUMN).agg(F.sum("cnt").alias("value_cnt"), F.count("*").alias("format_cnt"))
    return materialised(ranked(by, [COLUMN], k, "format").join(F.broadcast(total), COLUMN), "formats-kept")


def _formats(found: DataFrame, top: DataFrame, ranges: DataFrame) -> DataFrame:
    keys = [COLUMN, "format"]
    ends, few = ranges.groupBy(*keys).agg(*_ends_of_ranges()), found.join(F.broadcast(top.select(*keys)), keys)
    return (
        top.join(F.broadcast(ends), keys)
        .join(F.broadcast(_medians(few, ranges, keys)), keys)
        .select(
            COLUMN, "rank", "format", "format_cnt", F.col("cnt").alias("format_value"), rounded(F.col("cnt") / F.col("value_cnt") * 100).alias("format_pct"),
            F.col("low").alias("format_min"), F.col("high").alias("format_max"), F.col("mode").alias("format_mode"), F.col("median").alias("format_median"),
        )
    )


def formats(vc: DataFrame, k: int = 3) -> DataFrame:
    """Per column and rank: pattern, number of patterns, values with it, share, least, greatest, most frequent and median value. ``vc`` is as of value_counts() or dealt()."""
    found = dealt(vc)
    top = _top_formats(found, k)
    few = found.join(F.broadcast(top.select(COLUMN, "format")), [COLUMN, "format"])
    return _formats(found, top, materialised(few.groupBy(COLUMN, "format", "range").agg(*_ends()), "ranges"))


def edges(vc: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent beginnings and ends of one to three characters: column_name, side, n, rank, value, cnt."""
    parts = [F.struct(F.lit(side).alias("side"), F.lit(n).alias("n"), patterns.edge(F.col("value"), side, n).alias("part")) for side in ("first", "last") for n in (1, 2, 3)]
    spread = _present(vc).select(COLUMN, "cnt", F.inline(F.array(*parts)))
    by = spread.groupBy(COLUMN, "side", "n", F.col("part").alias("value")).agg(F.sum("cnt").alias("cnt"))
    return ranked(by, [COLUMN, "side", "n"], k).select(COLUMN, "side", "n", "rank", "value", "cnt")


def edge_lists(vc: DataFrame, k: int = 10) -> DataFrame:
    """first1_top10 to last3_top10: the values of edges() of each side and length, most frequent first."""
    found = edges(vc, k)
    cells = [
        F.transform(F.sort_array(F.collect_list(F.when((F.col("side") == side) & (F.col("n") == n), F.struct("rank", "value")))), lambda r: r.value).alias(f"{side}{n}_top{k}")
        for side in ("first", "last") for n in (1, 2, 3)
    ]
    return found.groupBy(COLUMN).agg(*cells)


def _composition_cells() -> list[Column]:
    how = {"any": F.max, "all": F.min}
    return [how[q](F.col("value").rlike(p).cast("int")).alias(name) for name, p, q in patterns.FLAGS]


def composition(vc: DataFrame) -> DataFrame:
    """0/1 flags of what characters the values hold."""
    return _present(vc).groupBy(COLUMN).agg(*_composition_cells())


def _first_cells() -> list[Column]:
    """Counts by the first character; null without values."""
    present = F.col("value").isNotNull()
    each = {name: F.sum(F.when(present, F.when(F.col("value").rlike(p), F.col("cnt")).otherwise(0))) for name, p in patterns.FIRST_CHARACTERS}
    rest = F.sum(F.when(present, F.col("cnt"))) - sum(each.values())
    return [*[c.alias(name) for name, c in each.items()], rest.alias("first_special")]


def first_characters(vc: DataFrame) -> DataFrame:
    """Values that begin with Hangul, a digit, a Latin letter, or anything else."""
    return _present(vc).groupBy(COLUMN).agg(*_first_cells())


def wide_formats(found: DataFrame, k: int = 3) -> DataFrame:
    """formats() with one row per column: format, format_2, format_3 and so on."""
    names = ("format", "format_value", "format_pct", "format_min", "format_max", "format_mode", "format_median")
    cells = [F.first(F.when(F.col("rank") == r, F.col(n)), ignorenulls=True).alias(n if r == 1 else f"{n}_{r}") for r in range(1, k + 1) for n in names]
    return found.groupBy(COLUMN).agg(F.first("format_cnt").alias("format_cnt"), *cells)


def assembled(vc: DataFrame, k: int = 3) -> DataFrame:
    """summary(), lengths(), value_stats(), top_values() and formats() side by side, a row per column. ``vc`` is read several times, so it is a table."""
    found = dealt(vc)
    top = _top_formats(found, k)
    # one pass for the ends of columns and of their first formats; the other formats, which may be as many as the values, count as none
    kept = top.select(COLUMN, "format", F.col("format").alias("kept"))
    ranges = materialised(found.join(F.broadcast(kept), [COLUMN, "format"], "left").groupBy(COLUMN, F.col("kept").alias("format"), "range").agg(*_ends()), "ranges")
    parts = {"lengths": lengths(vc), "ends": _value_stats(found, ranges), "top": top_values(found), "formats": wide_formats(_formats(found, top, ranges.where("format IS NOT NULL")))}
    out = summary(vc)
    for name, part in parts.items():
        # tables of a row per column: put together in one task without sorts, each of which would hold pages of its own
        out = out.join(F.broadcast(materialised(part, name)), COLUMN, "left")
    return out


def profile(df: DataFrame, columns: list[str] | None = None, file_name: str | None = None, master_type: str | None = None) -> DataFrame:
    """The whole profile: one row per column. All-null columns keep their counts, the rest is null."""
    types = {c: t for c, t in df.dtypes}
    vc = stored(value_counts(df, columns), "values")
    return profile_counted(vc, {c: types[c] for c in columns or df.columns}, None if file_name is None else F.lit(file_name), master_type)


def profile_counted(vc: DataFrame, types: dict[str, str], file_name: Column | None = None, master_type: str | None = None) -> DataFrame:
    """profile() of values that are counted, of one table or several at once: ``vc`` as of value_counts(), a table, and the data type of each column; ``file_name`` may depend on column_name."""
    from metaspan.functions.types import with_types
    from metaspan.operators.score import with_scores

    out = assembled(vc).join(edge_lists(vc), COLUMN, "left")
    kinds = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    out = out.withColumn("data_type", F.element_at(kinds, F.col(COLUMN)))
    out = with_scores(with_types(out))
    if file_name is not None:
        out = out.withColumns({"file_name": file_name, "master_type": F.lit(master_type)})
    # a row per column: small, and used many times by what follows
    return materialised(out, "profile")


def _shape_cells() -> list[Column]:
    value = F.trim("value")
    number = value.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?\z")
    share = lambda c: F.sum(F.when(F.col("value").isNotNull(), F.when(c, F.col("cnt")).otherwise(0))) / F.sum(F.when(F.col("value").isNotNull(), F.col("cnt")))
    whole = F.regexp_replace(F.regexp_extract(value, r"^[+-]?([0-9]+)", 1), "^0+(?=[0-9])", "")
    fraction = F.regexp_replace(F.regexp_extract(value, r"^[+-]?[0-9]+\.([0-9]+)\z", 1), r"0+\z", "")
    return [
        share(value.rlike(r"^[0-9]{4}[-/.]?[0-9]{2}[-/.]?[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?\z")).alias("date_share"),
        share(number).alias("number_share"),
        F.max(value.rlike(r"^0[0-9]+\z")).alias("leading_zero"),
        # a set of lengths is small, and needs no aggregation of its own as counting distinct ones does
        F.size(F.collect_set(F.length(value))).cast("long").alias("trimmed_lengths"),
        F.max(F.length(value)).alias("trimmed_max"),
        F.max(F.when(number, F.length(whole))).alias("whole_digits"),
        F.max(F.when(number, F.length(fraction))).alias("fraction_digits"),
    ]


def numeric_shape(vc: DataFrame) -> DataFrame:
    """What physical types are read off: shares of date-like and number-like values, leading zeros, lengths, digits."""
    return _present(vc).groupBy(COLUMN).agg(*_shape_cells())


def summary(vc: DataFrame) -> DataFrame:
    """counts(), composition(), first_characters() and numeric_shape() in one aggregation."""
    # what the cells say of a value they say of all that are alike, so each kind is looked at once
    kinds = vc.groupBy(COLUMN, patterns.alike(F.col("value")).alias("value")).agg(F.sum("cnt").alias("cnt"), F.count("*").alias("different"))
    return _with_shares(kinds.groupBy(COLUMN).agg(*_count_cells(), *_composition_cells(), *_first_cells(), *_shape_cells()))
