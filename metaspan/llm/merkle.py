"""Merkle manifest of a table: a tree of digests for each source, one over all sources, and what tampering does to it.

The tree is persistent. Its nodes lie in aligned blocks of ``SPAN`` leaves, five levels high; a block is one row and is built
in one task. A changed leaf is a version of its own: it copies the ancestors of that leaf and shares every other
node. Inside a block the copies are made from the block's own nodes; above it, from the path of the block's top, which
the tree over all tops gives in the same way, blocks of tops and so on, until a tree has one node. So no task holds more
than a block however large a source is, and a version costs a digest for each level.

Nulls: every column may be null and counts as ``-``; the null source is the first source, null ids are the first leaves. Equal
ids of a source are ordered by leaf; rows that are equal throughout are leaves each. An empty table gives no rows, a
very long text is hashed whole, columns other than the five are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames

FANOUT = 3
#: Levels and leaves of a block.
HEIGHT = 5
SPAN = FANOUT**HEIGHT


def digest(parts: list[bytes]) -> bytes:
    """The digest of digests, which go in as hexadecimal text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf(*values: Column) -> Column:
    """Digest of values, each ``-`` or its UTF-8 length and itself."""

    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, values)), 256))


class Block:
    """The nodes of an aligned block, level by level. ``whole``: it is all of its tree, which ends at the first single node."""

    def __init__(self, leaves: list[bytes], whole: bool):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 if whole else len(self.levels) <= HEIGHT:
            below = self.levels[-1]
            self.levels.append([digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[list[bytes], list[bytes]]]:
        """For each level from the leaf at ``at`` to the top: the siblings left and right of it."""
        found = []
        for nodes in self.levels[:-1]:
            begin = at // FANOUT * FANOUT
            found.append((nodes[begin:at], nodes[at + 1 : begin + FANOUT]))
            at //= FANOUT
        return found


def version(changed: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> list[bytes]:
    """The ancestors that a changed leaf copies, from its parent to the root; all other nodes stay shared."""
    copies = []
    for left, right in path:
        changed = digest([*left, changed, *right])
        copies.append(changed)
    return copies


def packed(path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """For each level a byte, FANOUT times the number of left siblings plus that of right ones, and the siblings."""
    return b"".join(bytes([FANOUT * len(left) + len(right)]) + b"".join(left) + b"".join(right) for left, right in path)


def unpacked(path: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    found, at = [], 0
    while at < len(path):
        left, right = divmod(path[at], FANOUT)
        nodes = [path[at + 1 + 32 * k : at + 33 + 32 * k] for k in range(left + right)]
        found.append((nodes[:left], nodes[left:]))
        at += 1 + 32 * (left + right)
    return found


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows``, a table, with ``pos``: from 0 within ``tree``, a column without nulls, by ``order``.

    Rows are dealt to ranges of (tree, order), so a large tree is many tasks; equal rows are told apart by where they
    stand, so any number of them can be dealt. Each range numbers the rows of its trees; only its first tree can have begun before, so what is carried from
    range to range is one number. Ranges, not rows, are listed on the driver: one for each shuffle partition.
    """
    spark = rows.sparkSession
    keys = [tree, *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(frames.pieces(spark), *keys).sortWithinPartitions(*keys)
    names = [f.name for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_no, local, last = -1, 0, None
        for batch in batches:
            runs, locals_ = [], []
            for name in batch.column(names.index(tree)).to_pylist():
                if name != last or run_no < 0:
                    run_no, local, last = run_no + 1, 0, name
                runs.append(run_no)
                locals_.append(local)
                local += 1
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(runs, pa.int64()), pa.array(locals_, pa.int64())], names=[*names, "_run", "_local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranged = dealt.drop("_row").mapInArrow(run, f"{schema}, _run long, _local long").withColumn("_range", F.spark_partition_id())
    ranged = frames.written(ranged, "numbered")
    at = F.struct("_run", "_local", F.col(tree).alias("tree"))
    ends = ranged.groupBy("_range").agg(F.min(at).alias("first"), F.max(at).alias("last")).orderBy("_range").collect()
    carried, before, held = [], None, 0
    for r in ends:
        carry = held if before is not None and before == r["first"]["tree"] else 0
        carried.append((r["_range"], carry))
        held = r["last"]["_local"] + 1 + (carry if r["last"]["_run"] == 0 else 0)
        before = r["last"]["tree"]
    carry = F.broadcast(spark.createDataFrame(carried, "_range int, _carry long"))
    pos = F.col("_local") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)
    return ranged.join(carry, "_range").select(*names, pos.alias("pos"))


def blocks_of(nodes: DataFrame, *columns: str) -> DataFrame:
    """(tree, block, nodes): the rows of an aligned block in order, as a table."""
    found = nodes.groupBy("tree", F.expr(f"pos div {SPAN}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("nodes"))
    return frames.written(found, "blocks")


def _block(number: int, nodes: list[dict]) -> Block:
    # a first block that is not full is all of its tree; a full one ends at one node either way
    return Block([n["digest"] for n in nodes], whole=number == 0 and len(nodes) < SPAN)


def tops_of(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [_block(b, nodes).top for b, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tops, pa.binary())], names=["tree", "pos", "digest"])

    bare = blocks.select("tree", "block", F.transform("nodes", lambda n: F.struct(n["digest"].alias("digest"))).alias("nodes"))
    return frames.written(bare.mapInArrow(run, "tree string, pos long, digest binary"), "tops")


def ascend(nodes: DataFrame) -> DataFrame:
    """For nodes (tree, pos, digest), each tree numbered from 0: (tree, pos, root, path), the path packed."""
    if nodes.where("pos > 0").isEmpty():
        return nodes.select("tree", "pos", F.col("digest").alias("root"), F.lit(b"").alias("path"))
    blocks = blocks_of(nodes, "digest")
    above = ascend(tops_of(blocks)).withColumnRenamed("pos", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, number, own, root, path in zip(*[c.to_pylist() for c in batch.columns]):
                block = _block(number, own)
                rows += [(tree, n["pos"], root, packed(block.path(k)) + path) for k, n in enumerate(own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["tree", "pos", "root", "path"])

    joined = blocks.join(above, ["tree", "block"]).select("tree", "block", "nodes", "root", "path")
    return frames.written(joined.mapInArrow(run, "tree string, pos long, root binary, path binary"), "paths")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Per document: its leaf, the roots of its source and of the table, its proof, and the version that tampering makes.

    ``tampered`` is the text after tampering, the text itself (the default) where there is none. Columns: doc_id, source, leaf,
    subroot, root, proof (packed siblings, see packed()), proof_sha256, tampered_leaf (null if it is the leaf), copied (the nodes
    that the tampered version copies, up to its root; null if it copies none), folded_root, verified. Digests are binary but for proof_sha256.
    """
    doc_id, text = frames.long_id(docs, "doc_id"), docs.text
    own = (doc_id, docs.source, docs.lang, docs.n_chars)
    other = text if tampered is None else tampered
    changed = F.when(text.eqNullSafe(other), F.lit(None).cast("binary")).otherwise(leaf(*own, other))
    # a name without nulls in the same order: the null source first
    tree = F.coalesce(F.concat(F.lit("="), docs.source.cast("string")), F.lit(""))
    leaves = frames.written(docs.select(tree.alias("tree"), doc_id.alias("doc_id"), leaf(*own, text).alias("digest"), changed.alias("changed")), "leaves")
    blocks = blocks_of(numbered(leaves, "tree", "doc_id", "digest"), "doc_id", "digest", "changed")
    within = ascend(tops_of(blocks)).withColumnsRenamed({"pos": "block", "root": "subroot"})
    subroots = frames.written(within.where("block = 0").select(F.lit("").alias("all"), F.col("tree").alias("name"), F.col("subroot").alias("digest")), "subroots")
    ordered = frames.written(numbered(subroots, "all", "name"), "sources")
    top = ascend(ordered.select(F.col("all").alias("tree"), "pos", "digest")).select("pos", "root", F.col("path").alias("over"))
    sources = ordered.join(top, "pos").select(F.col("name").alias("tree"), "root", "over")
    above = frames.split_join(within, sources, "tree").select("tree", "block", "subroot", "root", F.concat("path", "over").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, number, own, subroot, root, path in zip(*[c.to_pylist() for c in batch.columns]):
                block, above = _block(number, own), unpacked(path)
                rest = "".join(x.hex() for left, right in above for x in (*left, *right)).encode()
                for k, n in enumerate(own):
                    inner = block.path(k)
                    proof = hashlib.sha256("".join(x.hex() for left, right in inner for x in (*left, *right)).encode() + rest).hexdigest()
                    copies = version(n["changed"] or n["digest"], [*inner, *above])
                    folded = copies[-1] if copies else n["changed"] or n["digest"]
                    rows.append((
                        n["doc_id"], tree[1:] or ("" if tree else None), n["digest"], subroot, root, packed(inner) + path, proof, n["changed"],
                        copies if n["changed"] else None, folded, folded == root,
                    ))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["doc_id", "source", "leaf", "subroot", "root", "proof", "proof_sha256", "tampered_leaf", "copied", "folded_root", "verified"]
    raw = pa.binary()
    types = [pa.int64(), pa.string(), raw, raw, raw, raw, pa.string(), raw, pa.list_(raw), raw, pa.bool_()]
    joined = blocks.join(above, ["tree", "block"]).select("tree", "block", "nodes", "subroot", "root", "path")
    return joined.mapInArrow(
        frames.tidy(run),
        "doc_id long, source string, leaf binary, subroot binary, root binary, proof binary, proof_sha256 string, tampered_leaf binary, copied array<binary>, folded_root binary, verified boolean",
    )


def without_line_ends(docs: DataFrame) -> Column:
    """The text as the query tampers with it: without line feeds where 2 divides the checksum of the id."""
    even = F.crc32(frames.long_id(docs, "doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(docs.text, F.lit("\n"), F.lit(""))).otherwise(docs.text)


def verify_documents(docs: DataFrame) -> DataFrame:
    """The digest columns of the query: every document's proof, and whether it still holds after tampering."""
    found = manifest(docs, without_line_ends(docs))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", text("leaf"), text("subroot"), text("root"), "proof_sha256", text("folded_root"), "verified")


def oracle() -> str:
    """Levels by recursion, a node for each run of three; checksums bit by bit; proofs folded along all levels."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    code = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {code}), lambda c, b: {step}), 4294967295)"
    climb = lambda tree: f"SELECT {tree}, l + 1 AS l, p // 3 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM (SELECT *, count(*) OVER (PARTITION BY {tree}) AS many FROM up) WHERE many > 1 GROUP BY {tree}, l, p // 3"
    kin = lambda side: f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.p) FROM nodes s WHERE s.t = n.t AND s.l = n.l AND s.p // 3 = n.p // 3 AND s.p {side} n.p), '')"
    return f"""
    WITH RECURSIVE made AS (
      SELECT doc_id, source, sha256({head} || {part('text')}) AS leaf,
             sha256({head} || {part(f"CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS tampered
      FROM documents
    ), leaves AS (
      SELECT *, coalesce('=' || source, '') AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, row_number() OVER () AS rid FROM made
    ), up AS (
      SELECT t, 0 AS l, p, leaf AS h FROM leaves UNION ALL {climb('t')}
    ), subroots AS (
      SELECT t, max(l) AS l, arg_max(h, l) AS h, row_number() OVER (ORDER BY t) - 1 AS p FROM up GROUP BY t
    ), over AS (
      WITH RECURSIVE up AS (SELECT 0 AS a, 0 AS l, p, h FROM subroots UNION ALL {climb('a')}) SELECT * FROM up
    ), nodes AS (
      SELECT t, l, p, h FROM up UNION ALL SELECT '/' AS t, l, p, h FROM over
    ), tops AS (SELECT t, max(l) AS l FROM nodes GROUP BY t), kin AS (
      SELECT n.t, n.l, n.p, {kin('<')} AS a, {kin('>')} AS b FROM nodes n JOIN tops USING (t) WHERE n.l < tops.l
    ), steps AS (
      SELECT d.rid, k.l AS i, k.a, k.b FROM leaves d JOIN kin k ON k.t = d.t AND k.p = d.p // CAST(pow(3, k.l) AS BIGINT)
      UNION ALL
      SELECT d.rid, s.l + k.l AS i, k.a, k.b FROM leaves d JOIN subroots s USING (t) JOIN kin k ON k.t = '/' AND k.p = s.p // CAST(pow(3, k.l) AS BIGINT)
    ), proofs AS (
      SELECT rid, sha256(string_agg(a || b, '' ORDER BY i)) AS proof, list(struct_pack(a := a, b := b) ORDER BY i) AS way FROM steps GROUP BY rid
    ), folded AS (
      SELECT rid, 0 AS i, tampered AS h FROM leaves
      UNION ALL
      SELECT f.rid, f.i + 1, sha256(q.way[f.i + 1].a || f.h || q.way[f.i + 1].b) FROM folded f JOIN proofs q USING (rid) WHERE f.i < len(q.way)
    ), ends AS (SELECT rid, arg_max(h, i) AS h FROM folded GROUP BY rid), whole AS (SELECT arg_max(h, l) AS h FROM over)
    SELECT d.doc_id, d.leaf, s.h AS subroot, w.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = w.h AS verified
    FROM leaves d JOIN subroots s USING (t) CROSS JOIN whole w LEFT JOIN proofs q USING (rid) JOIN ends e USING (rid)
    """
