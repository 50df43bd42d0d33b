"""Lineage: chains of foreign keys, paths and their levels, neighbourhoods and edges of table graphs.

Graphs stay DataFrames. Iterations are bounded by a depth; each joins the frontier only and may cut its plan at a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaspan.sources.shared import materialised

ARROW = " -> "
MAX_DEPTH, LEAST_WEIGHT = 10, 50.0
#: Master types that are left out of internal relationships.
OUTSIDE = ("Rule", "Reference", "Validation", "Common")


def edges_of(mapping: DataFrame, strict: bool = False) -> DataFrame:
    """src, dst (structs of file, column, type) and weight of each column's best match; rules are no edges, in strict mode neither are reference, validation and common columns."""
    out = mapping.select(
        F.struct(F.col("file_name").alias("file"), F.col("column_name").alias("column"), F.col("master_type").alias("type")).alias("src"),
        F.struct(F.col("code_file_1").alias("file"), F.col("code_column_1").alias("column"), F.col("code_type_1").alias("type")).alias("dst"),
        F.col("matched_pct_1").alias("weight"),
    ).where("dst.file IS NOT NULL AND trim(dst.file) <> '' AND dst.column IS NOT NULL")
    left_out = list(OUTSIDE) if strict else ["Rule"]
    return out.where(~F.coalesce(F.col("src.type"), F.lit("")).isin(left_out) & ~F.coalesce(F.col("dst.type"), F.lit("")).isin(left_out)).distinct()


class TooManyPaths(ValueError):
    """A graph has more walks than may be listed; says from which nodes most start and which nodes lie on cycles."""


def strong_edges(edges: DataFrame, least: float = LEAST_WEIGHT) -> DataFrame:
    """src, dst of the edges heavier than `least` or without a weight, each once."""
    return edges.where(F.col("weight").isNull() | (F.col("weight") > least)).select("src", "dst").where("src <> dst").distinct()


def cycles(strong: DataFrame) -> DataFrame:
    """node, component: the strongly connected components of more than one node, each named by its least node.

    Nodes that no edge enters or none leaves are on no cycle and go first, round by round. What is left takes colours: the least node that reaches
    it. A colour's own node and all that reach it within the colour are a component, which is set aside before the next colours are taken.
    """
    found = None
    while True:
        before = -1
        strong = materialised(strong, "cyclic")
        while (n := strong.count()) != before:  # ends that lead nowhere
            before = n
            inner = strong.join(strong.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            strong = materialised(inner.join(inner.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "cyclic")
        if not before:
            break
        colours = _spread(strong, strong.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct())
        c = lambda side: colours.select(F.col("node").alias(side), F.col("colour").alias(f"{side}_colour"))
        same = materialised(strong.join(c("src"), "src").join(c("dst"), "dst").where("src_colour = dst_colour").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("src_colour").alias("colour")), "coloured")
        # against the edges from each colour's own node
        back = _spread(same.select("src", "dst"), same.select(F.col("colour").alias("node"), F.col("colour")).distinct(), only_new=True)
        own = colours.join(back.select("node", F.col("colour").alias("component")), "node").where("colour = component").select("node", "component")
        own = materialised(own.join(own.groupBy("component").count().where("count > 1"), "component", "left_semi").select("node", "component"), "components")
        found = own if found is None else found.unionByName(own)
        done = materialised(colours.join(back.select("node").distinct(), "node", "left_semi").select("node"), "done")
        strong = strong.join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    return found if found is not None else strong.select(F.col("src").alias("node"), F.col("dst").alias("component"))


def _spread(edges: DataFrame, start: DataFrame, only_new: bool = False) -> DataFrame:
    """node, colour: the least colour of the nodes of ``start`` that edges lead from, itself included; with only_new, a node that has one keeps it and the others get the one that reaches them."""
    held = materialised(start, "colours")
    while True:
        sent = edges.join(held.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
        sent = sent.join(held.select("node"), "node", "left_anti") if only_new else sent
        now = materialised(held.unionByName(sent).groupBy("node").agg(F.min("colour").alias("colour")), "colours")
        if now.join(held, ["node", "colour"], "left_anti").isEmpty():
            return now
        held = now


def walk_counts(strong: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """node, walks: for each node the number of walks of two to max_depth nodes from it, which no number of paths exceeds.

    Counted, not listed: an edge is a walk, and so is it followed by any walk from its end. Each step is one join and a row a node.
    """
    ways = strong.select(F.col("src").alias("node"), "dst")
    walks = ways.groupBy("node").agg(F.count("*").cast("double").alias("walks"))
    for _ in range(max_depth - 2):
        walks = ways.join(walks.withColumnRenamed("node", "dst"), "dst", "left").groupBy("node").agg(F.sum(1 + F.coalesce("walks", F.lit(0.0))).alias("walks"))
    return walks


#: Walks beyond which paths are not listed.
MOST_WALKS = 10_000_000


def chains(edges: DataFrame, max_depth: int = MAX_DEPTH, least: float = LEAST_WEIGHT, most: float = MOST_WALKS) -> DataFrame:
    """path: every longest cycle-free path from every node, of at most max_depth nodes, along edges heavier than `least` (or without a weight).

    A path ends where no edge leads on to a node that is not on it. Longer ones are left out. Paths can be exponentially many, so walks are counted before paths are listed:
    beyond `most` this raises TooManyPaths, which names the nodes to look at.
    """
    strong = materialised(strong_edges(edges, least), "strong")
    size = strong.groupBy("src").count().agg(F.count("*").alias("nodes"), F.max("count").alias("widest")).first()
    wide = (size.nodes or 0) * float(size.widest or 0) ** (max_depth - 1) > most / 2  # else there cannot be too many
    walks = walk_counts(strong, max_depth)
    if wide and (count := walks.agg(F.sum("walks")).first()[0]) > most:
        name = lambda n: f"{n.file}.{n.column}" if hasattr(n, "file") else str(n)
        tops = ", ".join(name(r.node) for r in walks.orderBy(F.desc("walks")).limit(5).collect())
        loops = [f"{name(r.component)} ({r['count']} nodes)" for r in cycles(strong).groupBy("component").count().orderBy(F.desc("count")).limit(5).collect()]
        raise TooManyPaths(f"up to {count:.3g} paths, most from {tops}; cycles through {', '.join(loops) or 'none'}")
    # a node's edges side by side: each step is one join and nothing is used twice
    leads_to = materialised(strong.groupBy("src").agg(F.collect_list("dst").alias("nexts")), "leads-to")
    walks = leads_to.select(F.array("src").alias("path"), F.lit(True).alias("open"))
    for _ in range(max_depth):
        step = walks.withColumn("src", F.when(F.col("open"), F.element_at("path", -1))).join(leads_to, "src", "left")
        ahead = F.filter(F.coalesce("nexts", F.array().cast(leads_to.schema["nexts"].dataType)), lambda n: ~F.array_contains(F.col("path"), n))
        step = step.select("path", F.explode_outer(F.when(F.size(ahead) > 0, ahead)).alias("next"))
        walks = step.select(F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path"), F.col("next").isNotNull().alias("open"))
    return walks.where(F.size("path").between(2, max_depth)).select("path").distinct()


def name_of(node: Column) -> Column:
    return F.concat_ws(".", node["file"], node["column"])


def levels(paths: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """A path as level_0.. columns, its text, its text without outside nodes, and both depths."""
    inside = F.filter("path", lambda n: ~F.coalesce(n["type"], F.lit("")).isin(*OUTSIDE))
    text = lambda nodes: F.array_join(F.transform(nodes, name_of), ARROW)
    out = paths.withColumn("inside", inside)
    return out.select(
        F.element_at("path", 1).alias("node"),
        *[name_of(F.try_element_at("path", F.lit(k + 1))).alias(f"level_{k}") if k == 0 else F.when(F.size("path") > k, name_of(F.try_element_at("path", F.lit(k + 1)))).alias(f"level_{k}") for k in range(depth)],
        text("path").alias("relationship"),
        text("inside").alias("relationship_internal"),
        (F.size("path") - 1).alias("depth"),
        F.greatest(F.size("inside") - 1, F.lit(0)).alias("depth_internal"),
    )


def erd_mapping(final: DataFrame, max_depth: int = MAX_DEPTH, strict: bool = False) -> DataFrame:
    """The final mapping with the chains of its columns; without a chain the filled code slots, closed up, are the levels.

    level_1..4 come from the chain, then from the slots not yet shown; depth and relationship are those of the levels.
    """
    final = materialised(final, "final")
    found = levels(chains(edges_of(final, strict), max_depth), max_depth).withColumns({"file_name": F.col("node.file"), "column_name": F.col("node.column"), "master_type": F.col("node.type")}).drop("node")
    slots = F.filter(
        F.array(*[F.when(F.trim(F.col(f"code_file_{k}")) != "", F.concat_ws(".", F.col(f"code_file_{k}"), F.col(f"code_column_{k}"))) for k in (1, 2, 3, 4)]), lambda s: s.isNotNull()
    )
    out = final.join(found, ["file_name", "column_name", "master_type"], "left")
    own = F.filter(F.array(*[F.col(f"level_{k}") for k in range(1, 5)]), lambda s: s.isNotNull())
    shown = F.slice(F.concat(own, F.when(F.size(own) == 0, slots).otherwise(F.array().cast("array<string>"))), 1, 4)
    root = F.concat_ws(".", "file_name", "column_name")
    out = out.withColumns({"level_0": root, "shown": shown})
    return out.withColumns(
        {
            **{f"level_{k}": F.try_element_at("shown", F.lit(k)) for k in range(1, 5)},
            "relationship": F.array_join(F.concat(F.array(root), F.col("shown")), ARROW),
            "depth": F.size("shown"),
        }
    ).drop("shown")


def parse_relationships(df: DataFrame, column: str = "relationship") -> DataFrame:
    """child_file, child_column, parent_file, parent_column of each step of path texts; a column follows the last dot."""
    steps = df.select(F.posexplode(F.split(F.col(column), ARROW)).alias("pos", "node"), F.xxhash64(column).alias("text"), F.col(column).alias("path")).distinct()
    file, name = F.regexp_extract("node", r"^(.*)\.([^.]*)\z", 1), F.regexp_extract("node", r"^(.*)\.([^.]*)\z", 2)
    steps = steps.select("path", "pos", file.alias("file"), name.alias("name"))
    w = Window.partitionBy("path").orderBy("pos")
    pairs = steps.select(F.col("file").alias("child_file"), F.col("name").alias("child_column"), F.lead("file").over(w).alias("parent_file"), F.lead("name").over(w).alias("parent_column"))
    return pairs.where("parent_file IS NOT NULL").distinct()


def table_pairs(relations: DataFrame) -> DataFrame:
    """Foreign-key and key columns of each pair of tables."""
    return relations.groupBy("child_file", "parent_file").agg(
        F.array_join(F.array_sort(F.collect_set("child_column")), ", ").alias("fk_columns"), F.array_join(F.array_sort(F.collect_set("parent_column")), ", ").alias("pk_columns")
    )


def column_roles(relations: DataFrame) -> DataFrame:
    """file, column, is_fk, is_pk: which side of relations a column is on."""
    child = relations.select(F.col("child_file").alias("file"), F.col("child_column").alias("column"), F.lit(1).alias("fk"), F.lit(0).alias("pk"))
    parent = relations.select(F.col("parent_file").alias("file"), F.col("parent_column").alias("column"), F.lit(0).alias("fk"), F.lit(1).alias("pk"))
    return child.unionByName(parent).groupBy("file", "column").agg(F.max("fk").alias("is_fk"), F.max("pk").alias("is_pk"))


def related_files(relations: DataFrame) -> DataFrame:
    """Per file: number and sorted names of the files it has relations with."""
    both = relations.select(F.col("child_file").alias("file"), F.col("parent_file").alias("other")).union(relations.select("parent_file", "child_file")).where("file <> other")
    return both.groupBy("file").agg(F.countDistinct("other").alias("related_cnt"), F.array_join(F.array_sort(F.collect_set("other")), ", ").alias("related_files"))


def table_summary(relations: DataFrame) -> DataFrame:
    """Per table: foreign-key columns, parents, children, edges."""
    child = relations.select(F.col("child_file").alias("file"), F.col("child_column").alias("fk"), F.col("parent_file").alias("parent"), F.lit(None).cast("string").alias("child"))
    parent = relations.select(F.col("parent_file").alias("file"), F.lit(None).cast("string").alias("fk"), F.lit(None).cast("string").alias("parent"), F.col("child_file").alias("child"))
    name = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return child.unionByName(parent).groupBy("file").agg(name("fk").alias("fk_columns"), name("parent").alias("parents"), name("child").alias("children"), F.count("*").alias("edge_cnt"))


def neighbourhood(links: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """start, table, level: tables within so many undirected hops of each start (level 0), by their least level.

    links has columns a and b; start has a column start. Each step joins the last frontier with its neighbours, kept side by side.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    nearby = materialised(both.groupBy("a").agg(F.collect_list("b").alias("nearby")), "nearby")
    reached = start.select("start", F.col("start").alias("table"), F.lit(0).alias("level")).distinct()
    for level in range(1, hops + 1):
        step = reached.withColumn("a", F.when(F.col("level") == level - 1, F.col("table"))).join(nearby, "a", "left")
        own = F.array(F.struct("table", "level"))
        new = F.transform(F.coalesce("nearby", F.array().cast("array<string>")), lambda t: F.struct(t.alias("table"), F.lit(level).alias("level")))
        reached = step.select("start", F.inline(F.concat(own, new))).groupBy("start", "table").agg(F.min("level").alias("level"))
    return reached


def shared_columns(columns: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """a, b, column: pairs of tables (a < b) that share a column name of which at least one side is a key. columns: file, column, pk."""
    own = columns.select("file", "column", "pk").distinct()
    if excluded is not None:
        own = own.join(excluded.select("column"), "column", "left_anti")
    other = own.select(F.col("file").alias("b"), "column", F.col("pk").alias("b_pk"))
    pairs = own.withColumnRenamed("file", "a").join(other, "column").where((F.col("a") < F.col("b")) & ((F.col("pk") == 1) | (F.col("b_pk") == 1)))
    return pairs.select("a", "b", "column", F.col("pk").alias("a_pk"), "b_pk")


def physical_hierarchy(columns: DataFrame, levels_up_to: int = 3, listed: int = 5) -> DataFrame:
    """Per table: tables reached at each level, and the first names of all of them in alphabetical order."""
    links = shared_columns(columns).select("a", "b").distinct()
    found = neighbourhood(links, columns.select(F.col("file").alias("start")).distinct(), levels_up_to)
    counts = [F.count_if(F.col("level") == k).alias(f"level_{k}_cnt") for k in range(1, levels_up_to + 1)]
    names = F.array_sort(F.collect_set(F.when(F.col("level") > 0, F.col("table"))))
    return found.groupBy("start").agg(*counts, F.array_join(F.slice(names, 1, listed), ", ").alias("related_list")).withColumnRenamed("start", "file")


def physical_edges(columns: DataFrame, table_levels: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """src, dst, column between tables whose levels differ by one at most.

    The side with the key is dst; of two keys the lower level is src; of equal levels the first name.
    """
    pairs = shared_columns(columns, excluded)
    la, lb = table_levels.select(F.col("table").alias("a"), F.col("level").alias("a_level")), table_levels.select(F.col("table").alias("b"), F.col("level").alias("b_level"))
    near = pairs.join(la, "a").join(lb, "b").where(F.abs(F.col("a_level") - F.col("b_level")) <= 1)
    forward = F.when((F.col("b_pk") == 1) & (F.col("a_pk") == 0), True).when((F.col("a_pk") == 1) & (F.col("b_pk") == 0), False).otherwise(F.col("a_level") <= F.col("b_level"))
    return near.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("dst"), "column").distinct()


def classify_edges(physical: DataFrame, logical: DataFrame) -> DataFrame:
    """a, b, edge_kind (physical, logical, both) of undirected table pairs."""
    tagged = physical.select("src", "dst", F.lit(1).alias("p"), F.lit(0).alias("l")).unionByName(logical.select("src", "dst", F.lit(0).alias("p"), F.lit(1).alias("l")))
    out = tagged.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("p").alias("p"), F.max("l").alias("l"))
    return out.select("a", "b", F.when((F.col("p") == 1) & (F.col("l") == 1), "both").when(F.col("p") == 1, "physical").otherwise("logical").alias("edge_kind"))


def shown_columns(columns: DataFrame, involved: DataFrame, anchors: DataFrame) -> DataFrame:
    """file, column of a diagram: keys, columns of edges, and all columns of anchors."""
    keys = columns.where("pk = 1").select("file", "column")
    return keys.union(involved.select("file", "column")).union(columns.join(anchors.select("file"), "file", "left_semi").select("file", "column")).distinct()


def erd_info(columns: DataFrame, physical: DataFrame, logical: DataFrame) -> DataFrame:
    """Per column: whether edges of either kind use it; check marks columns of logical edges that no physical edge uses."""
    p = physical.select(F.explode(F.array("src", "dst")).alias("file"), "column", F.lit(1).alias("physical")).distinct()
    edge = logical.select(F.inline(F.array(F.struct(F.col("child_file").alias("file"), F.col("child_column").alias("column")), F.struct(F.col("parent_file").alias("file"), F.col("parent_column").alias("column")))))
    out = columns.join(p, ["file", "column"], "left").join(edge.distinct().withColumn("logical", F.lit(1)), ["file", "column"], "left")
    out = out.withColumns({"physical": F.coalesce("physical", F.lit(0)), "logical": F.coalesce("logical", F.lit(0))})
    return out.withColumn("check", ((F.col("logical") == 1) & (F.col("physical") == 0)).cast("int"))


#: Which edges a diagram shows.
ERD_MODES = ("physical", "logical", "both")


def erd_frame(columns: DataFrame, physical: DataFrame, logical: DataFrame, anchors: DataFrame, mode: str = "both") -> DataFrame:
    """A row for each column that a diagram shows and each column that it is related to ('' where to none).

    Shown are columns of edges of the mode, keys, and all columns of anchors (file). ``physical`` has src, dst and column, ``logical`` child_file, child_column,
    parent_file and parent_column. fk: the row has a relation; physical, logical, both: of which kinds; check: of the logical kind only.
    """
    if mode not in ERD_MODES:
        raise ValueError(f"mode is one of {', '.join(ERD_MODES)}")
    side = lambda a, ac, b, bc, p: F.struct(F.col(a).alias("file"), F.col(ac).alias("column"), F.col(b).alias("related_file"), F.col(bc).alias("related_column"), F.lit(p).alias("physical"), F.lit(1 - p).alias("logical"))
    ways = {
        "physical": physical.select(F.inline(F.array(side("src", "column", "dst", "column", 1), side("dst", "column", "src", "column", 1)))),
        "logical": logical.select(F.inline(F.array(side("child_file", "child_column", "parent_file", "parent_column", 0), side("parent_file", "parent_column", "child_file", "child_column", 0)))),
    }
    relations = ways["physical"].unionByName(ways["logical"]) if mode == "both" else ways[mode]
    relations = relations.groupBy("file", "column", "related_file", "related_column").agg(F.max("physical").alias("physical"), F.max("logical").alias("logical"))
    out = columns.select("file", "column", "pk").join(relations, ["file", "column"], "left").join(anchors.select("file", F.lit(1).alias("anchor")).distinct(), "file", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    related = F.col("related_file").isNotNull()
    out = out.where(related | (F.col("pk") == 1) | F.col("anchor").isNotNull()).select(
        "file", "column", "pk", related.cast("int").alias("fk"), zero("physical"), zero("logical"), F.coalesce("related_file", F.lit("")).alias("related_file"), F.coalesce("related_column", F.lit("")).alias("related_column"), zero("anchor")
    )
    return out.withColumns({"both": F.col("physical") * F.col("logical"), "check": F.col("logical") * (1 - F.col("physical"))})


def type_consistency(columns: DataFrame) -> DataFrame:
    """Column names with more than one type: column, type, table_cnt, tables."""
    by = columns.groupBy("column", "type").agg(F.countDistinct("file").alias("table_cnt"), F.array_join(F.array_sort(F.collect_set("file")), ", ").alias("tables"))
    return by.withColumn("types", F.count("*").over(Window.partitionBy("column"))).where("types > 1").drop("types")


def connection_counts(columns: DataFrame) -> DataFrame:
    """Per column name: tables that have it, and its type: a date type if any, else the commonest."""
    by = columns.groupBy("column", "type").agg(F.countDistinct("file").alias("n"))
    total = columns.groupBy("column").agg(F.countDistinct("file").alias("connection_cnt"))
    w = Window.partitionBy("column").orderBy(F.desc(F.col("type").isin("DATE", "TIMESTAMP")), F.desc("n"), "type")
    first = by.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("column", "type")
    return total.join(first, "column")


def with_types(columns: DataFrame, types: DataFrame) -> DataFrame:
    """Columns (file, column) with their type from ``types`` (file_name, column_name, oracle_type); a type that they have already stays."""
    known = types.select(F.col("file_name").alias("file"), F.col("column_name").alias("column"), F.col("oracle_type").alias("_type")).distinct()
    out = columns.join(known, ["file", "column"], "left")
    own = F.nullif(F.trim("type"), F.lit("")) if "type" in columns.columns else F.lit(None).cast("string")
    return out.withColumn("type", F.coalesce(own, "_type")).drop("_type")


def exclusions(connections: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """The exclusion list anew: a column keeps its old flag, a new one is excluded if it is of a date type."""
    initial = F.when(F.col("type").isin("DATE", "TIMESTAMP"), 1).otherwise(0)
    out = connections.withColumn("initial", initial)
    if kept is None:
        return out.withColumnRenamed("initial", "exclusive")
    return out.join(kept.select("column", F.col("exclusive").alias("old")), "column", "left").withColumn("exclusive", F.coalesce("old", "initial")).drop("old", "initial")


def to_dot(nodes: list[str], edges: list[tuple[str, str, str]], name: str = "erd") -> str:
    """DOT text of small graphs for display; names and labels are quoted."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"digraph {quote(name)} {{", "  rankdir=LR;", *[f"  {quote(n)} [shape=box];" for n in sorted(nodes)]]
    lines += [f"  {quote(a)} -> {quote(b)} [label={quote(label)}];" for a, b, label in sorted(edges)]
    return "\n".join([*lines, "}"])
