import hashlib
from collections import Counter

import numpy as np

from metaspan.llm import fingerprint as f


def similarity(a, b):
    return sum(min(a[u], b[u]) for u in a.keys() | b.keys()) / sum(max(a[u], b[u]) for u in a.keys() | b.keys())


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng, errors = np.random.default_rng(3), []
    for share in (0.2, 0.5, 0.8) * 20:
        terms = rng.integers(0, 2**63, 300, dtype=np.uint64).tolist()
        a = Counter({u: int(rng.integers(1, 6)) for u in terms})
        b = Counter({u: a[u] if rng.random() < share else int(rng.integers(0, 6)) for u in terms})
        bags = [np.array(list(x.elements()), np.uint64) for x in (a, b)]
        errors.append((f.sample(bags[0]) == f.sample(bags[1])).mean() - similarity(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_rows_against_the_definition(spark):
    texts = {3: "a b c d e f", 9: None, 4: "", 12: "x", 20: "é" * 11, 21: "one two three four five six seven " * 40, 22: "one two three four five six seven " * 40}
    df = spark.createDataFrame(list(texts.items()) + [(21, texts[21])], "doc_id long, text string").selectExpr("*", "1 AS range", "2 AS tail")
    rows = sorted(f.fingerprint_documents(df).collect())
    ids = sorted([*texts, 21])
    assert [r.doc_id for r in rows] == ids
    for k, r in enumerate(rows):
        text, other = texts[r.doc_id] or "", texts[ids[(k + 1) % len(ids)]] or ""
        n = len(text) // 2
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - n] + other[:n]).encode()).hexdigest()
    by = {r.doc_id: r for r in rows}
    assert by[9].fingerprint == by[4].fingerprint and by[4].near_next == 1.0
    assert by[21].fingerprint == by[22].fingerprint and by[21].near_next == 1.0 and by[12].near_next == 0.0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in f.fingerprint_documents(df.repartition(7)).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for a, b in zip(ids, ids[1:] + ids[:1]):
        n = len(texts[a]) // 2
        assert rows[a].edited_sha256 == hashlib.sha256((texts[a][: len(texts[a]) - n] + texts[b][:n]).encode()).hexdigest()
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()]) + 0.2


def test_rows_without_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "c d"), (None, None)], "doc_id long, text string")
    rows = f.fingerprint_documents(df).collect()
    assert len(rows) == 3 and sum(r.near_next is None for r in rows) == 2
    assert f.fingerprint_documents(df.limit(0)).count() == 0


def test_many_ranges_give_the_same(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id * 7 - 300 AS doc_id", "text", "1 AS own", "2 AS at")
    expected = sorted(f.fingerprint_documents(df).collect())
    monkeypatch.setattr(f, "RANGES", 40)
    assert sorted(f.fingerprint_documents(df.repartition(3)).collect()) == expected


def test_signatures_equal_the_plain_definition():
    """Sample by sample and term by term: level floor(ln S / r + beta), value ln c - r (level - beta + 1), the least value wins."""
    import math

    (r, log_c, beta), _, multipliers, salt = f._table()
    word = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & word
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & word
        return x ^ x >> 31

    rng = np.random.default_rng(11)
    for n in (1, 2, 40, 300):
        bag = Counter({int(h): int(rng.choice([1, 1, 1, 2, 3, 50])) for h in rng.integers(0, 2**63, n, dtype=np.uint64)})
        want = []
        for m in multipliers.tolist():
            least = None
            for h, weight in bag.items():
                place = h * m & word
                i = place >> (64 - f.TABLE_BITS)
                level = math.floor(math.log(weight) / r[i] + beta[i])
                value = log_c[i] - r[i] * (level - beta[i] + 1)
                if least is None or value < least[0]:
                    least = value, place + level * int(salt[0]) & word
            want.append(mixed(least[1] ^ int(salt[1])) >> 48)
        assert f.sample(np.array(list(bag.elements()), np.uint64)).tolist() == want
