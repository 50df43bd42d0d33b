import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from metaspan.llm import components as c
from metaspan.llm import ngram_join as n


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(texts):
    """texts: list of (doc_id, text) with distinct ids."""
    sets = {i: shingle_set(t) for i, t in texts}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {p for own in where.values() for p in combinations(sorted(own), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed=1, groups=25):
    rng, texts = random.Random(seed), []
    words = [f"w{k}" for k in range(400)]
    shared = " ".join(rng.choices(words, k=60))
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([3, 5, 9, 30, 120, 300]))
        for _ in range(rng.choice([1, 2, 3, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own) + (" " + shared if rng.random() < 0.3 else "")
            texts.append(text.upper() if rng.random() < 0.1 else text)
    rng.shuffle(texts)
    return list(enumerate(texts + [None, "", " \n", "one", "ONE", "a b c d", "a b  c d", "a b c d e"]))


@pytest.mark.parametrize("sizes", [(200_000, 2048, 512), (3, 4, 3)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(n, "HEAVY", sizes[0])
    monkeypatch.setattr(n, "NODES", sizes[1])
    monkeypatch.setattr(n, "SETS", sizes[2])
    texts = corpus()
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS token").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in n.ngram_components(df).collect()}
    assert got == brute(texts)


def test_documents_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in n.ngram_components(df).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (5, "A b c d e f"), (9, None)], "doc_id long, text string")
    rows = n.ngram_components(df).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 2, -1), (5, 2, 5), (7, 2, 5), (7, 2, 5), (9, 0, 9)]
    assert n.ngram_components(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(5, 5)]
    got = {r.node: r.component for r in c.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {x: got.get(x, x) for x in parent} == {x: root(x) for x in parent}


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 600, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, int(k))) for k in rng.integers(1, 500, 2))
        bits = [np.frombuffer(n.bitmap(x), np.uint64) for x in (a, b)]
        assert n.most_overlap(bits[0], len(a), bits[1][None, :], np.array([len(b)]))[0] >= len(np.intersect1d(a, b))


def near_copies(count, seed=3):
    """One large group of near copies: most pairs do not link, but all are connected."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(count):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    return list(enumerate(texts))


@pytest.mark.parametrize("sizes", [(2048, 512), (50, 20)])
def test_a_large_group_of_near_copies_gives_linear_rows(spark, monkeypatch, sizes):
    monkeypatch.setattr(n, "NODES", sizes[0])
    monkeypatch.setattr(n, "SETS", sizes[1])
    made = {}
    written = n.frames.written

    def counted(df, name):
        out = written(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(n.frames, "written", counted)
    texts = near_copies(400)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in n.ngram_components(df).collect()}
    assert got == brute(texts)
    assert made["links"] < 2 * 400 and made["more-links"] < 400 and made["candidates"] <= made["met"]


def test_very_long_text_and_extra_columns(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    rows = [(1, long), (2, long + " and one more"), (3, "short"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS lead", "'x' AS component_id", "2 AS _part")
    got = {r.doc_id: r.component_id for r in n.ngram_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_the_order_counts_beyond_bytes_and_deals_only_what_exceeds_the_mean():
    counts = np.full(1 << n.SKETCH_BITS, 5 * n.HEAVY, np.uint64)  # every cell is full: no shingle is common
    counts[7] = 2**33
    order = n.Order.of(counts)
    token = np.array([7 << (64 - n.SKETCH_BITS), 9 << (64 - n.SKETCH_BITS)], np.uint64)
    assert order.rank(token)[0] > order.rank(token)[1] and order.dealt(token)[1] == 1
    assert order.dealt(token)[0] == 1 + (2**33 - int(counts.mean())) // n.HEAVY


def test_without_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "d")], "doc_id long, text string").selectExpr("*", "3 AS _id")
    left = n.without_ids(df, spark.createDataFrame([(2,), (9,)], "doc_id long"))
    assert left.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "d"), (0, "d"), (1, "a")]


def test_one_row_repeated_many_times_is_one_node(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(7, base)] * 3000 + [(3, base + " x"), (9, "y " + base), (1, "quite another text of some words"), (1, "quite another text of some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = n.ngram_components(docs)
    assert {tuple(r) for r in found.distinct().collect()} == {(7, 56, 3), (3, 57, 3), (9, 57, 3), (1, 2, 1)} and found.count() == len(rows)
    node = spark.createDataFrame([(7, n.node_of(next(n._sets(pa.RecordBatch.from_pydict({"doc_id": [7], "text": [base]})))[1]))], "doc_id long, wanted long")
    assert n._members(docs, node).count() == 1
