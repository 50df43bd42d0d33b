"""Exact n-gram Jaccard self-join of documents, down to components of near copies.

Equal shingle sets are one node. Shingles are ordered rarest first by a count sketch of all documents; two sets
with Jaccard similarity t share one of their first n - ceil(t n) + 1 shingles in any common order (prefix
filter). Nodes that share such a shingle meet in the group of the shingle's leader, its smallest node of a
fitting size band; shingles with one leader make one group, so that a pair meets once and not once for each shingle.

A task compares a tile: nodes of one group, of bounded number and weight. Sizes and hashed parity bitmaps bound the
overlap from above by bit counts; pairs that pass are decided exactly by intersecting sorted arrays. A tile gives
nodes or the links that join its components, never all its pairs, so what it gives is linear in its nodes.

1. Every group in parts, each with the group's centre, the node that shares most shingles: the bitmaps tell which
   nodes may link at all, and only their sets are fetched; each node's sets meet in one of its groups.
2. Groups that are then still in several components: blocks of the nodes outside a group's usual component against
   blocks of all its nodes, first by bitmaps, then by the sets that they leave. This completes the join.

A pair whose nodes are already connected needs no comparison, so groups of copies cost no
pairs, and no link that joins two components is lost.

Defined results: null or wordless texts have no shingles and link with nothing; under five words the whole
sequence is one shingle; repeated rows are copies; a row without an id belongs to no component (null), nor
does it connect others; an empty table gives no rows; other columns are ignored whatever their names. Texts are
taken whole however long. Whether a pair at exactly 0.75 links is decided in integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames, shingles
from .components import components

#: log2 of the sketch's cells, and of the cells that are summed together. The sketch only orders and finds very common shingles.
SKETCH_BITS, CHUNK_BITS = 21, 12
#: Documents of a shingle that one bucket takes.
HEAVY = 200_000
#: Nodes of a block when bitmaps and when sets are compared, and the mean shingles of a node from which blocks have fewer.
NODES, SETS, SHINGLES = 2048, 512, 2048
#: 100 * intersection >= 75 * union.
PART, WHOLE = 75, 100


def node_of(own: np.ndarray) -> int:
    """One 63-bit name of a set of sorted distinct hashes."""
    salt = shingles.mix(own + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(own))
    return int(shingles.mix(np.array([salt], np.uint64))[0] >> np.uint64(1))


def required(a, b):
    """Least overlap of sets of sizes a and b that link."""
    return -(-PART * (a + b) // (PART + WHOLE))


def bitmap(own: np.ndarray) -> bytes:
    """Parities of the hashes by their low bits; twice as many bits as the set has members, a power of two from 64 to 32768."""
    bits = min(max(64, 2 << int(len(own) - 1).bit_length()), 32768) if len(own) else 64
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) with fewer words, as bitmap() makes them for that length."""
    while words.shape[-1] > to:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def most_overlap(a: np.ndarray, na: int, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of one set (bitmap a) with several (rows of b): what differs in parity is in one set only."""
    n = min(a.shape[-1], b.shape[-1])
    differ = np.bitwise_count(folded(a, n) ^ folded(b, n)).sum(axis=-1, dtype=np.int64)
    return (na + nb - differ) // 2


def _chunks(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    step = 1 << CHUNK_BITS
    for i in range(0, len(cells), step):
        part = cells[i : i + step]
        if part.any():
            yield i >> CHUNK_BITS, zlib.compress(part.astype("<u8").tobytes(), 1)


def _summed(rows: DataFrame) -> np.ndarray:
    """The cell-wise sum of the tasks' sketches, whose (fixed) size is all the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(blob), "<u8")
                held[i] = held[i] + part if i in held else part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], names=["chunk", "cells"])

    # a chunk's parts are summed in groups first, as many as keep all tasks busy, then the groups' sums
    pieces, chunks = frames.pieces(rows.sparkSession), 1 << (SKETCH_BITS - CHUNK_BITS)
    grouped = rows.withColumn("group", F.pmod(F.xxhash64("cells"), F.lit(max(1, pieces // chunks)))).repartition(pieces, "chunk", "group").select("chunk", "cells")
    summed = grouped.mapInArrow(frames.tidy(run), "chunk int, cells binary").repartition(min(chunks, pieces), "chunk").mapInArrow(frames.tidy(run), "chunk int, cells binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint64)
    for r in summed.collect():
        out[r.chunk << CHUNK_BITS : (r.chunk + 1) << CHUNK_BITS] = np.frombuffer(zlib.decompress(bytes(r.cells)), "<u8")
    return out


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for doc_id, hashes in zip(batch.column(0).to_pylist(), shingles.of_rows(frames.texts(batch.column(1)))):
        yield doc_id, np.unique(hashes)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size, node and bitmap; at the end the task's sketch of shingle counts."""
    sketch = np.zeros(1 << SKETCH_BITS, np.uint64)
    shift = np.uint64(64 - SKETCH_BITS)
    names = ["doc_id", "n_shingles", "node", "bitmap", "chunk", "cells"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    for batch in batches:
        rows, seen, size = [], [], 0
        for doc_id, own in _sets(batch):
            rows.append((doc_id, len(own), node_of(own) if len(own) and doc_id is not None else None, bitmap(own) if len(own) else None, None, None))
            seen.append(own)
            size += len(own)
            if size > 1 << 18:
                sketch += np.bincount((np.concatenate(seen) >> shift).astype(np.int64), minlength=len(sketch)).astype(np.uint64)
                seen, size = [], 0
        if size:
            sketch += np.bincount((np.concatenate(seen) >> shift).astype(np.int64), minlength=len(sketch)).astype(np.uint64)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    rows = [(None, None, None, None, i, cells) for i, cells in _chunks(sketch)]
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), types)], names=names)


def _grouped(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal sorted values begin, and how long they are."""
    begins = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    return begins, np.diff(np.append(begins, len(tokens)))


@dataclass(frozen=True)
class Order:
    """What the sketch says of shingles. ``code``: their order, rarest first. ``heavy``, ``salts``: the cells that exceed the
    mean by more than HEAVY, and over how many buckets their shingles are dealt. Both are of bounded size."""

    code: np.ndarray
    heavy: np.ndarray
    salts: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Order:
        code = np.minimum(np.round(8 * np.log2(1.0 + counts)), 255).astype(np.uint8)
        more = np.maximum(counts.astype(np.float64) - counts.mean(), 0) // HEAVY
        heavy = np.flatnonzero(more)
        return Order(code, heavy, 1 + more[heavy].astype(np.int64))

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        return self.code[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]

    def dealt(self, tokens: np.ndarray) -> np.ndarray:
        """Buckets of each shingle."""
        out = np.ones(len(tokens), np.int64)
        if len(self.heavy) and len(tokens):
            cell = (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            at = np.minimum(np.searchsorted(self.heavy, cell), len(self.heavy) - 1)
            out = np.where(self.heavy[at] == cell, self.salts[at], out)
        return out


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among ``ids``: one shuffle of the rows at every size, dealt by the id or, without one, by the text."""
    gone = ids.select(F.col(id_col).cast("long").alias("_gone")).distinct().withColumn("_same", F.col("_gone")).hint("shuffle_hash")
    keyed = docs.withColumn("_key", F.coalesce(docs[id_col].cast("long"), F.xxhash64(*docs.columns)))
    return keyed.join(gone, (keyed["_key"] == gone["_gone"]) & (keyed[id_col] == gone["_same"]), "left_anti").select(*docs.columns)


def _members(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, members) of the wanted (doc_id, wanted): one shuffle of the texts at every size."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeats of a row meet here, as they have one id; one set of a node is enough
        for batch in batches:
            rows = (
                (wanted, own) for wanted, (_, own) in zip(batch.column(2).to_pylist(), _sets(batch)) if len(own) and wanted not in seen and node_of(own) == wanted and not seen.add(wanted)
            )
            while part := list(islice(rows, 256)):
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([s.tobytes() for _, s in part], pa.binary())], names=["node", "members"])

    return docs.join(ids.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "wanted").mapInArrow(frames.tidy(emit), "node long, members binary")


class _Tile:
    """Nodes of one group that one task compares: pairs of an active node and any other, of different components.

    Rows are (node, size, component, total, active, bitmap[, members])."""

    def __init__(self, rows: list[tuple]):
        rows = sorted({r[0]: r for r in sorted(rows, key=lambda r: r[4])}.values(), key=lambda r: (r[1], r[0]))
        self.rows = rows
        self.node, self.size, self.comp = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        self.active = np.array([r[4] for r in rows], bool)
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        length = np.array([len(r[5]) for r in rows])
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            self.words.append((at, np.stack([np.frombuffer(rows[i][5], np.uint64) for i in at])))
        self.low = np.searchsorted(self.size, -(-self.size * PART // WHOLE), side="left")
        self.high = np.searchsorted(self.size, self.size * WHOLE // PART, side="right")

    def centre_first(self) -> list[int]:
        """The active nodes, the one that shares most shingles with others first: it is the likeliest to link."""
        order = np.flatnonzero(self.active).tolist()
        best = max(range(len(self.rows)), key=lambda i: (self.rows[i][3], -self.rows[i][0]))
        return [best, *(i for i in order if i != best)]

    def partners(self, i: int, open_: np.ndarray) -> np.ndarray:
        """Those of ``open_`` that sizes and bitmaps let link with i."""
        own, out = np.frombuffer(self.rows[i][5], np.uint64), []
        for at, bits in self.words:
            take = open_[at] & (at >= self.low[i]) & (at < self.high[i])
            if take.any():
                near = at[take]
                out.append(near[most_overlap(own, int(self.size[i]), bits[take], self.size[near]) >= required(int(self.size[i]), self.size[near])])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def candidates(self, every: bool) -> list[int]:
        """Nodes with a possible partner of another component: with ``every``, all of them, else at least one of each pair's ends' groups."""
        found = np.zeros(len(self.rows), bool)
        for i in self.centre_first():
            if every or not found[i]:
                near = self.partners(i, self.comp != self.comp[i])
                if len(near):
                    found[near] = found[i] = True
        return self.node[found].tolist()

    def links(self) -> list[tuple[int, int]]:
        """Pairs that link and join components, at most as many as there are nodes."""
        comp, out = self.comp.copy(), []
        sets = [np.frombuffer(r[6], np.uint64) for r in self.rows]
        for i in self.centre_first():
            for j in self.partners(i, comp != comp[i]).tolist():
                if comp[j] == comp[i]:
                    continue
                x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if WHOLE * both >= PART * (len(x) + len(y) - both):
                    comp[comp == comp[j]] = comp[i]
                    out.append((int(self.node[i]), int(self.node[j])))
        return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Tile]]:
    """Lead and nodes of each tile with two components; rows come sorted by their tile, the first three columns."""
    key, held = None, []
    for batch in batches:
        for lead, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (lead, i, j) != key:
                if len({r[2] for r in held}) > 1:
                    yield key[0], _Tile(held)
                key, held = (lead, i, j), []
            held.append(row)
    if len({r[2] for r in held}) > 1:
        yield key[0], _Tile(held)


def _pairs(rows: Iterator[tuple[int, int]], names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 50_000)):
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], pa.int64()) for k in (0, 1)], names=list(names))


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _pairs(((lead, node) for lead, tile in _tiles(batches) for node in tile.candidates(False)), ("lead", "node"))


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _pairs(((lead, node) for lead, tile in _tiles(batches) for node in tile.candidates(True)), ("lead", "node"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _pairs((link for _, tile in _tiles(batches) for link in tile.links()), ("a", "b"))


def _blocks(n: str, weight: str, most: int) -> Column:
    return F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(weight) / (most * SHINGLES)), F.lit(1)).cast("int")


_ROW = ("node", "size", "component", "total", "active", "bitmap")


def _sorted_tiles(rows: DataFrame) -> DataFrame:
    keys = ("lead", "i", "j")
    kept = [*keys, *_ROW, *(["members"] if "members" in rows.columns else [])]
    return rows.select(*kept).repartition(frames.pieces(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _round_one(rows: DataFrame, most: int) -> DataFrame:
    """Tiles of groups in parts of bounded weight, each with the group's centre: linear in the rows, decides most."""
    top = F.max(F.struct("total", F.negative("node").alias("last"))).alias("top")
    groups = rows.groupBy("lead").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), top).where("n > 1")
    groups = groups.select("lead", _blocks("n", "weight", most).alias("parts"), F.negative(F.col("top.last")).alias("centre"))
    dealt = frames.split_join(rows, groups, "lead")
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.when(F.col("node") == F.col("centre"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
    return _sorted_tiles(dealt.withColumns({"i": F.explode(every), "j": F.lit(0), "component": F.col("node"), "active": F.lit(True)}))


def _round_two(rows: DataFrame, most: int) -> DataFrame:
    """Tiles of groups in several components, whose usual component needs no comparison within itself: blocks of the others against blocks of all."""
    kinds = rows.groupBy("lead", "component").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    top = F.max(F.struct("n", "component", "weight")).alias("top")
    groups = kinds.groupBy("lead").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), top).where("kinds > 1")
    groups = groups.withColumns({"n_out": F.col("n") - F.col("top.n"), "weight_out": F.col("weight") - F.col("top.weight"), "usual": F.col("top.component")})
    groups = groups.select("lead", "usual", _blocks("n", "weight", most).alias("all"), _blocks("n_out", "weight_out", most).alias("out"))
    dealt = frames.split_join(rows, groups, "lead").withColumn("active", F.col("component") != F.col("usual"))
    i, j = (F.pmod(F.xxhash64("node"), F.col(c)).cast("int") for c in ("out", "all"))
    passive = F.transform(F.sequence(F.lit(0), F.col("out") - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(False).alias("active")))
    active = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(True).alias("active")))
    alone = (F.col("all") == 1) & (F.col("out") == 1)  # one tile: an active row need not stand in it twice
    placed = F.when(~F.col("active"), passive).when(alone, active).otherwise(F.concat(passive, active))
    return _sorted_tiles(dealt.withColumn("at", F.explode(placed)).drop("active").select("*", "at.*"))


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id reachable by links, of every row."""
    spark = df.sparkSession
    docs = df.select(frames.long_id(df, id_col).alias("doc_id"), df[text_col].alias("text"))
    described = frames.written(docs.mapInArrow(frames.tidy(_describe), "doc_id long, n_shingles long, node long, bitmap binary, chunk int, cells binary"), "described")
    shared = spark.sparkContext.broadcast(Order.of(_summed(described.where("chunk IS NOT NULL").select("chunk", "cells"))))
    n_buckets = 4 * frames.pieces(spark)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = shared.value
        tokens, owners, sizes, held = [], [], [], 0
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            token, owner, size = np.concatenate(tokens), np.concatenate(owners), np.concatenate(sizes)
            salt = shingles.mix(owner.view(np.uint64)).view(np.int64) % order_of.dealt(token)
            bucket = ((shingles.mix(token) >> np.uint64(33)).astype(np.int64) + salt) % n_buckets
            order = np.argsort(bucket, kind="stable")
            token, owner, size, bucket = token[order], owner[order], size[order], bucket[order]
            begins, lengths = _grouped(bucket)
            parts = [(int(bucket[a]), token[a : a + n].tobytes(), owner[a : a + n].tobytes(), size[a : a + n].tobytes()) for a, n in zip(begins, lengths)]
            tokens.clear(), owners.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "tokens", "owners", "sizes"])

        for batch in batches:
            for doc_id, own in _sets(batch):
                if doc_id is None or not len(own):
                    continue
                node = node_of(own)
                if node in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                n = len(own) + (-PART * len(own)) // WHOLE + 1
                code = order_of.rank(own)
                # own is sorted by hash; a stable sort by code gives the common order
                first = own[np.argsort(code, kind="stable")[:n]]
                tokens.append(first)
                owners.append(np.full(n, node, np.int64))
                sizes.append(np.full(n, len(own), np.uint32))
                held += n
                if held > 1 << 18:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of shingles that two or more nodes of fitting sizes share, with the smallest such node. Rows come sorted by bucket."""
        order_of = shared.value

        def shares(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            token = np.concatenate([np.frombuffer(p[0], np.uint64) for p in parts])
            owner = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts])
            size = np.concatenate([np.frombuffer(p[2], np.uint32) for p in parts]).astype(np.int64)
            order = np.lexsort((owner, size, token))
            token, owner, size = token[order], owner[order], size[order]
            fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
            token, owner, size = token[fresh], owner[fresh], size[fresh]
            near = (token[1:] == token[:-1]) & (WHOLE * size[:-1] >= PART * size[1:])
            keep = np.concatenate([near, [False]]) | np.concatenate([[False], near])
            keep |= order_of.dealt(token) > 1
            chain = np.concatenate([[0], np.cumsum(~near)])[keep]  # runs of a shingle's nodes, each of a size that fits the next
            token, owner, size = token[keep], owner[keep], size[keep]
            if not len(token):
                return
            begins, lengths = _grouped(chain)
            lead = np.repeat(np.minimum.reduceat(owner, begins), lengths)
            # a shingle that is dealt to several buckets has a leader in each, and a name for all
            heavy = np.flatnonzero(order_of.dealt(token) > 1)
            owner, size = np.append(owner, owner[heavy]), np.append(size, size[heavy])
            lead = np.append(lead, -1 - (shingles.mix(token[heavy]) >> np.uint64(1)).astype(np.int64))
            order = np.lexsort((owner, lead))
            owner, size, lead = owner[order], size[order], lead[order]
            begins = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (owner[1:] != owner[:-1])]))
            votes = np.diff(np.append(begins, len(lead)))
            owner, size, lead = owner[begins], size[begins], lead[begins]
            for at in range(0, len(lead), 100_000):
                own = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(owner[own]), pa.array(size[own]), pa.array(lead[own]), pa.array(votes[own])], names=["node", "size", "lead", "votes"])

        bucket, parts = None, []
        for batch in batches:
            for b, *part in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket and parts:
                    yield from shares(parts)
                    parts = []
                bucket = b
                parts.append(part)
        if parts:
            yield from shares(parts)

    packed = docs.mapInArrow(frames.tidy(prefixes), "bucket int, tokens binary, owners binary, sizes binary")
    met = packed.repartition(frames.pieces(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(frames.tidy(meet), "node long, size long, lead long, votes long")
    met = frames.written(met.groupBy("node", "size", "lead").agg(F.sum("votes").alias("votes")), "met")

    rows = described.where("chunk IS NULL").select("doc_id", "n_shingles", "node", "bitmap")
    nodes = frames.written(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bitmap").alias("bitmap")), "nodes")
    total = met.groupBy("node").agg(F.sum("votes").alias("total"))
    groups = frames.written(met.select("lead", "node", "size").join(total, "node").join(nodes.select("node", "bitmap"), "node"), "groups")

    def fetched(wanted: DataFrame, name: str) -> DataFrame:
        ids = wanted.select("node").distinct().join(nodes, "node").select(F.col("first_id").alias("doc_id"), F.col("node").alias("wanted"))
        return frames.written(_members(docs, ids), name)

    # 1. parts of groups: which nodes may link, then, in one group of each node, which do
    found = _round_one(groups, NODES).mapInArrow(frames.tidy(_some), "lead long, node long").distinct()
    found = frames.written(found.join(groups, ["lead", "node"]), "candidates")
    members = fetched(found, "members")
    chosen = found.groupBy("node").agg(F.min(F.struct(F.col("lead") < 0, "lead")).alias("best")).select("node", "best.lead")
    first = frames.written(found.join(chosen, ["lead", "node"]).join(members, "node"), "first")
    links = frames.written(_round_one(first, SETS).mapInArrow(frames.tidy(_joined), "a long, b long"), "links")
    parts = components(links)

    # 2. groups that are still in several components
    now = frames.written(groups.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "now")
    left = _round_two(now, NODES).mapInArrow(frames.tidy(_every), "lead long, node long").distinct()
    left = frames.written(now.join(left, ["lead", "node"]), "left")
    unknown = frames.written(left.select("node").distinct().join(members, "node", "left_anti"), "unknown")
    if not unknown.isEmpty():
        members = members.union(fetched(unknown, "more-members"))
    second = frames.written(left.join(members, "node"), "second")
    more = frames.written(_round_two(second, SETS).mapInArrow(frames.tidy(_joined), "a long, b long"), "more-links")
    if not more.isEmpty():
        parts = components(links.union(more))

    whole = nodes.join(parts, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    whole = frames.written(whole, "whole")
    least = whole.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = frames.split_join(whole, least, "component").select("node", "component_id")
    return frames.split_join(rows.select("doc_id", "n_shingles", "node"), named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def oracle() -> str:
    """The same in DuckDB SQL over the view ``documents`` with distinct ids, comparing all pairs that share a shingle."""
    return r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach(x, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.x, reach.c FROM reach JOIN links ON links.y = reach.x),
part AS (SELECT x, min(c) AS component_id FROM reach GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, component_id FROM n JOIN part ON part.x = n.doc_id"""
