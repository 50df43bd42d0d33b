"""Exact metric range join of embeddings of equal label, down to components.

Vectors are scaled to unit length; cosine >= t is a distance of at most r = sqrt(2 - 2 t). Equal vectors
are one class with a count. Pivots, a bounded number of vectors, partition the classes of a label: a class
lives in the cell of its nearest pivot, and nowhere else. The cells are the parts of one table, written once; every two cells
of a label are a tile, whose task reads both parts. So vectors are shuffled once and stored once, however many cells there are.
Two linked classes of the cells of p and q lie on either side of the plane between p and q, so their distances from it add up to at most r: the others of
the tile are left out. Of the rest, shadows in few dimensions are compared first (no projection makes distances longer), and what is near there
is compared in full. A tile gives its classes a count of links, and links that span its components, not all pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without label or id
link with nothing; vectors of different length do not link; repeated rows are copies that link; an id-less row has no
component; an empty table gives no rows; other columns are ignored whatever their names. A pair links if the dot product of its
unit vectors in double precision, as computed, is at least the limit: at exactly 0.98 rounding decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .components import components

#: Classes that a cell should hold, pivots at most, classes of a cell that are compared at once.
CELL, MOST_PIVOTS, BLOCK = 16384, 4096, 32768
#: Classes of labels without pivots that share a part of the table.
SHARED = 4096
#: Dimensions of a shadow; what single precision may add to a squared distance there.
SHADOW, SLACK = 18, 1e-4
#: Bytes of vectors that a task holds back to count equal ones before they are shuffled.
HELD = 32 << 20

Name = tuple[int, int]


def unit(values: list | None) -> np.ndarray | None:
    """The vector at unit length in double precision, or None if it has no direction."""
    if not values or any(v is None for v in values):
        return None
    found, x = units(np.array([values], dtype=np.float64))
    return x[0] if found[0] else None


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a direction, and these at unit length."""
    most = np.abs(x).max(axis=1)
    found = np.isfinite(most) & (most > 0)
    x = x[found] / most[found][:, None]
    return found, x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0


def _directed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[Name]]]:
    """Places, vectors as given, unit vectors and 128-bit names of these, for the rows of each length that link with anything. ``batch`` has id, label and vector first."""
    vectors = batch.column(2)
    whole = np.logical_and.reduce([np.asarray(batch.column(k).is_valid()) for k in range(3)])
    offsets, flat = vectors.offsets.to_numpy(), vectors.values
    bad = np.asarray(flat.is_null())
    flat = flat.fill_null(0).to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for size in np.unique(lengths[whole & (lengths > 0)]):
        at = np.flatnonzero(whole & (lengths == size))
        cells = offsets[at][:, None] + np.arange(size)
        at, cells = at[~(none := bad[cells].any(axis=1))], cells[~none]
        found, x = units(flat[cells].astype(np.float64))
        names = [xxhash.xxh128_intdigest(u.tobytes()) for u in x]
        yield at[found], flat[cells][found], x, [((n >> 64) - (1 << 63), (n & ((1 << 64) - 1)) - (1 << 63)) for n in names]


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the name of their unit vector; without it where a row links with nothing."""
    for batch in batches:
        high, low = [None] * batch.num_rows, [None] * batch.num_rows
        for at, _, _, names in _directed(batch):
            for i, (a, b) in zip(at.tolist(), names):
                high[i], low[i] = a, b
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["vec_id", "label", "high", "low"])


_DEALT = "part int, label long, size int, high long, low long, id long, n long, raw binary"


@lru_cache(8)
def _plane(size: int) -> np.ndarray:
    """A projection to SHADOW dimensions, of orthonormal columns; vectors of no more are their own shadows."""
    return np.eye(size) if size <= SHADOW else np.linalg.qr(np.random.default_rng(size).normal(size=(size, SHADOW)))[0]


def _shadows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two forms of the shadows of unit vectors, whose dot product is minus half their squared distance."""
    z = x @ _plane(x.shape[1])
    half, one = (z * z).sum(axis=1)[:, None] / 2, np.ones((len(z), 1))
    return np.hstack([z, -half, one]).astype(np.float32), np.hstack([z, one, -half]).astype(np.float32)


def near_pairs(a: np.ndarray, b: np.ndarray, least: float, from_a: np.ndarray, from_b: np.ndarray, reach: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b``, unit vectors, of pairs whose dot product is at least ``least``, by the places in ``a``.

    ``from_a``, ``from_b``: least lengths whose sum no distance of a pair falls below. If both are the ``same`` rows, each pair once and none of a row with itself.
    """
    order_a, order_b = (np.arange(len(f)) if same else (o := np.argsort(f, kind="stable"))[: np.searchsorted(f[o], reach, side="right")] for f in (from_a, from_b))
    a, b, from_a, from_b = a[order_a], b[order_b], from_a[order_a], from_b[order_b]
    if not len(a) or not len(b):
        return
    left, right = _shadows(a)[0], _shadows(b)[1]
    limit = np.float32(-(reach * reach + SLACK) / 2)
    for i in range(0, len(a), 256):
        # rows are in the order of their lengths, so the first has the least of the chunk
        last = len(b) if same else int(np.searchsorted(from_b, reach - from_a[i], side="right"))
        for j in range(i if same else 0, last, 4096):
            near = left[i : i + 256] @ right[j : min(j + 4096, last)].T
            if near.max() < limit:
                continue
            r, c = np.nonzero(near >= limit)
            rows, cols = np.unique(r), np.unique(c)
            if 16 * len(r) > len(rows) * len(cols):
                r, c = np.nonzero(a[i + rows] @ b[j + cols].T >= least)
                r, c = rows[r] + i, cols[c] + j
            else:
                r, c = r + i, c + j
                hit = np.concatenate([np.einsum("ij,ij->i", a[r[k : k + 8192]], b[c[k : k + 8192]]) >= least for k in range(0, len(r), 8192)])
                r, c = r[hit], c[hit]
            if same:
                r, c = r[r < c], c[r < c]
            if len(r):
                yield order_a[r], order_b[c]


class Spans:
    """Components of numbered nodes, joined a row of links at a time."""

    def __init__(self, nodes: int) -> None:
        self.of = np.arange(nodes)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Links x - y, those of one x together."""
        ends = np.flatnonzero(np.diff(x, append=-1)) + 1
        begin = 0
        for end in ends.tolist():
            own, others = self.of[x[begin]], self.of[y[begin:end]]
            begin = end
            if (others != own).any():
                every = np.unique(np.append(others, own))
                self.of[np.isin(self.of, every)] = every[0]


class Part:
    """Classes of one label and length."""

    def __init__(self, table: pa.Table, kind: str) -> None:
        self.id, self.n = table["id"].to_numpy(), table["n"].to_numpy()
        raw = table["raw"].combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        body = np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(len(raw), -1)
        self.x = units(body.astype(np.float64))[1]


def _parts(table: pa.Table, kind: str) -> dict[tuple[int, int], Part]:
    """The classes of a table by label and length."""
    label, size = table["label"].to_numpy(), table["size"].to_numpy()
    order = np.lexsort((size, label))
    cuts = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(size[order]) != 0)) + 1
    return {(int(label[o[0]]), int(size[o[0]])): Part(table.take(pa.array(o)), kind) for o in np.split(order, cuts) if len(o)}


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = df.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    single = df.select(df[vector_col]).dtypes[0][1] == "array<float>"
    kind = "<f4" if single else "<f8"
    given = df.select(frames.long_id(df, id_col).alias("vec_id"), df[label_col].cast("long").alias("label"), df[vector_col].cast("array<float>" if single else "array<double>").alias("vector"))
    rows = frames.written(given.mapInArrow(frames.tidy(_named), "vec_id long, label long, high long, low long"), "names")
    keys = ["label", "high", "low"]
    linking = rows.where("high IS NOT NULL")
    many, different = linking.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*keys))).first()
    most = min(MOST_PIVOTS, -(-different // CELL))
    pivots: dict[tuple[int, int], np.ndarray] = {}
    if most > 1:
        # few by their hashes, before any are ordered: which they are decides what work there is, never a result
        place = F.xxhash64("vec_id", "label")
        few = given.where(f"vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0 AND pmod(xxhash64(vec_id, label), 1048576) <= {1048576 * 4 * most // many}")
        found: dict[tuple[int, int], dict[bytes, np.ndarray]] = {}
        for r in few.orderBy(place, "vec_id", "label").limit(most).select("label", "vector").collect():
            x = unit(r.vector)
            if x is not None:
                found.setdefault((r.label, len(x)), {})[x.tobytes()] = x
        pivots = {k: np.stack(list(own.values())) for k, own in found.items() if len(own) > 1}
    first, free = {}, 0
    for k in sorted(pivots):
        first[k], free = free, free + len(pivots[k])
    # labels without pivots share parts
    shared = max(frames.pieces(spark), -(-different // SHARED))
    known = spark.sparkContext.broadcast((pivots, first))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each class of the task, with the part of its cell."""
        tables, begins = known.value
        held: dict[tuple[int, int, int], list] = {}
        size_held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*((part, k[0], size, k[1], k[2], i, n, raw) for k, (part, size, i, n, raw) in held.items())))
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()))], names=["part", "label", "size", "high", "low", "id", "n", "raw"])
            held.clear()
            return out

        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, raw, x, names in _directed(batch):
                size, of = x.shape[1], [labels[i] for i in at.tolist()]
                part, by = np.empty(len(at), np.int64), {}
                for k, label in enumerate(of):
                    by.setdefault(label, []).append(k)
                for label, own in by.items():
                    if (label, size) in tables:
                        part[own] = begins[label, size] + (x[own] @ tables[label, size].T).argmax(axis=1)
                    else:
                        part[own] = free + xxhash.xxh64_intdigest(f"{label},{size}") % shared
                for k, (i, label, (high, low)) in enumerate(zip(at.tolist(), of, names)):
                    old = held.get((label, high, low))
                    if old:
                        old[2], old[3] = min(old[2], ids[i]), old[3] + 1
                    else:
                        held[label, high, low] = [int(part[k]), size, ids[i], 1, raw[k].tobytes()]
                        size_held += raw[k].nbytes + 300
                if size_held > HELD:
                    yield flush()
                    size_held = 0
        if held:
            yield flush()

    def merged(dealt: DataFrame) -> DataFrame:
        return dealt.groupBy("part", "size", *keys).agg(F.min("id").alias("id"), F.sum("n").alias("n"), F.first("raw").alias("raw"))

    dealt = given.mapInArrow(frames.tidy(deal), _DEALT)
    if many > 2 * different:
        dealt = merged(dealt)  # by names first, so that copies of a few vectors don't meet in a few tasks
    classes = frames.written(merged(dealt.repartition(frames.pieces(spark), "part")), "classes", by="part")
    # the files of each part, one as Spark is set; of files with more than BLOCK classes, slices
    files = classes.groupBy("part", F.input_file_name().alias("path")).agg(F.count("*").alias("rows"))
    slices = files.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(BLOCK).cast("long"))))
    owner = [(begin + k, begin, str(label), size, k) for (label, size), begin in first.items() for k in range(len(pivots[label, size]))]
    owners = spark.createDataFrame(owner, "part int, family int, label string, size int, cell int")
    slices = frames.written(slices.join(F.broadcast(owners), "part", "left").select(F.coalesce("family", "part").alias("family"), "part", "path", "at", F.col("label").cast("long").alias("label"), "size", "cell"), "slices")
    other = slices.select("family", *[F.col(c).alias(f"{c}_2") for c in ("part", "path", "at", "cell")])
    tiles = slices.join(other, "family").where("part < part_2 OR part = part_2 AND (path < path_2 OR path = path_2 AND at <= at_2)")
    tiles = frames.written(tiles, "tiles")
    tasks = max(frames.pieces(spark), -(-tiles.count() // 16))
    tiles = tiles.repartitionByRange(tasks, "part", "path", "at", "part_2", "at_2").sortWithinPartitions("part", "path", "at").select("path", "at", "path_2", "at_2", "label", "size", "cell", "cell_2")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, _ = known.value

        def read(path: str, at: int) -> dict[tuple[int, int], Part]:
            system, inner = pf.FileSystem.from_uri(path)
            table = pq.read_table(inner, filesystem=system, columns=["label", "size", "id", "n", "raw"], use_threads=False, partitioning=None)
            return _parts(table.slice(at, BLOCK), kind)

        kept: dict[tuple[str, int], dict[tuple[int, int], Part]] = {}
        for batch in batches:
            for path, at, path_2, at_2, label, size, cell, cell_2 in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, at) not in kept:
                    kept = {(path, at): read(path, at)}
                mine, same = kept[path, at], (path, at) == (path_2, at_2)
                others = mine if same else read(path_2, at_2)
                for key in mine.keys() & others.keys():
                    a, b = mine[key], others[key]
                    between = None if cell is None or cell == cell_2 else tables[label, size][cell] - tables[label, size][cell_2]
                    yield from _linked(a, b, between, least, reach, same)

    joined = frames.written(tiles.mapInArrow(frames.tidy(join), "a long, b long, links long"), "joined")
    parts = components(joined.where("b IS NOT NULL").select("a", "b"))
    links = joined.where("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("others"))
    found = (
        classes.select(*keys, "id", "n")
        .join(links, F.col("id") == F.col("a"), "left")
        .join(parts, F.col("id") == F.col("node"), "left")
        .select(*keys, (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    # a vector as near to one pivot as to another may be a class of either cell, by rounding; both say the same
    found = found.groupBy(*keys).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return rows.join(found, keys, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def _linked(a: Part, b: Part, between: np.ndarray | None, least: float, reach: float, same: bool) -> Iterator[pa.RecordBatch]:
    """Counts of links (a, null, links) and links that span components (a, b, null) of the classes of two cells, or of one. ``between``: the difference of their pivots."""
    from_a, from_b = np.zeros(len(a.id)), np.zeros(len(b.id))
    if between is not None:
        normal = between / np.sqrt((between * between).sum())
        from_a, from_b = a.x @ normal - 1e-9, -(b.x @ normal) - 1e-9
    shift = 0 if same else len(a.id)
    ids = a.id if same else np.concatenate([a.id, b.id])
    links, spans = np.zeros(len(ids), np.int64), Spans(len(ids))
    for r, c in near_pairs(a.x, b.x, least, from_a, from_b, reach, same):
        differ = a.id[r] != b.id[c]
        r, c = r[differ], c[differ]
        np.add.at(links, r, b.n[c])
        np.add.at(links, shift + c, a.n[r])
        spans.join(r, shift + c)
    some = np.flatnonzero(links)
    if not len(some):
        return
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, spans.of, ids)
    root = smallest[spans.of]
    tied = np.flatnonzero(root != ids)
    none = lambda n: pa.nulls(n, pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), none(len(some)), pa.array(links[some])], names=["a", "b", "links"])
    yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(root[tied]), none(len(tied))], names=["a", "b", "links"])


def oracle() -> str:
    """The same in DuckDB SQL over the view ``embeddings``."""
    return """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.x, reach.c FROM reach JOIN links ON links.y = reach.x),
part AS (SELECT x, min(c) AS c FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN part ON part.x = vec_id LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = vec_id"""
