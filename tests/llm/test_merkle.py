"""The manifest against a plain recursive tree, on odd rows and on trees of many shapes."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from metaspan.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root, and for each node its siblings as (left, right) level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            b = p // 3 * 3
            ways[k].append((nodes[b:p], nodes[p + 1 : b + 3]))
        nodes, at = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], ways


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(((r[0] is not None, r[0] or 0), leaf(r[0], r[3], r[2], r[4], r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        by[s].sort(key=lambda x: x[:2])
        built[s] = tree([x[1] for x in by[s]])
    root, over = tree([built[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (_, own, r), way in zip(by[s], built[s][1]):
            h = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                h = leaf(r[0], r[3], r[2], r[4], r[1].replace("\n", ""))
            proof = ""
            for left, right in way + over[k]:
                h = sha("".join([*left, h, *right]))
                proof += "".join([*left, *right])
            out.append((r[0], own, built[s][0], root, sha(proof), h, h == root))
    return sorted(out, key=repr)


def got(spark, rows):
    df = merkle.verify_documents(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=repr)


ODD = [
    (1, "a\nb", "en", "s", 3), (2, None, None, "s", None), (None, "x\ny", "en", "s", 3), (None, "x\ny", "en", "s", 3), (3, "", "de", "", 0),
    (4, "ä\n" * 50_000, "fr", "Z", 100_000), (4, "other", "fr", "Z", 5), (5, "\n", None, None, 1), (6, "q\n", None, "é", 2), (7, "q\n", None, "z", 2), (8, None, None, None, None),
]


def test_odd_rows(spark):
    assert got(spark, ODD) == plain(ODD)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 243, 244])
def test_tree_shapes(spark, n):
    rows = [(i, f"t{i}\n{i}", "en", "only", i) for i in range(n)]
    assert got(spark, rows) == plain(rows)


def test_large_and_small_sources(spark):
    rows = [(i, f"t{i}\n{i}", "en", "hot" if i % 3 else f"s{i % 700}", i) for i in range(2500)]
    rows += [(77, "same\ntext", "en", "hot", 9)] * 300
    assert got(spark, rows) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame(ODD, SCHEMA)
    more = df.withColumns({c: F.lit("x") for c in ("tree", "pos", "digest", "block", "nodes", "root", "path", "leaf", "changed", "_row", "_run")})
    assert sorted(map(tuple, merkle.verify_documents(more).collect()), key=repr) == plain(ODD)


def test_versions_share_all_but_the_ancestors(spark):
    rows = [(i, f"t{i}\n", "en", "a" if i < 400 else "b", i) for i in range(800)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(docs, merkle.without_line_ends(docs)).collect()
    for r in found:
        assert (r.copied is None) == r.verified == (r.tampered_leaf is None)
        way = merkle.unpacked(bytes(r.proof))
        assert len(way) == 6 + 1  # 400 leaves are six levels, two sources one
        assert merkle.version(bytes(r.leaf), way)[-1] == r.root
        if r.copied:
            assert [bytes(c) for c in r.copied] == merkle.version(bytes(r.tampered_leaf), way) and r.copied[-1] == r.folded_root
    assert 300 < sum(not r.verified for r in found) < 500


def test_untampered_tables_verify(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    assert all(r.verified and r.copied is None for r in merkle.manifest(docs).collect())
