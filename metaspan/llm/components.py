"""Connected components without collecting links: contraction inside partitions, then
alternating large and small stars until every node points at the smallest of its component."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the partition's links, each node pointing at its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a) if parent.setdefault(a, a) != a else a, root(b) if parent.setdefault(b, b) != b else b
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    for at in range(0, len(nodes), 50_000):
        own = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([root(x) for x in own], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b) that are not themselves the smallest of their component.

    A node that is absent from the result is its own component. Links may repeat, go either way, or be loops.
    """
    edges = frames.written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(frames.tidy(_contract), "a long, b long"), "links")
    while True:
        # a > b everywhere; done if every a has one b and no b is an a.
        state = edges.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if state <= 1 and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = frames.split_join(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = frames.written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = frames.split_join(large, least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = frames.written(small.mapInArrow(frames.tidy(_contract), "a long, b long"), "stars")
