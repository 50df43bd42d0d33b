"""Collocations against plain counting, and the summary's guarantee."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaspan.llm import collocations as co

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string"


def counts_of(rows, threshold):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang or "und", " ".join(w[i : i + m])] += 1
    return {k: v for k, v in f.items() if v >= threshold}, n


def plain(rows, threshold=100, best=2000):
    f, n = counts_of(rows, threshold)
    found = {}
    for (lang, phrase), a in f.items():
        w = phrase.split(" ")
        inside = any(f" {phrase} " in f" {other} " and 100 * b >= 100 * a for (g, other), b in f.items() if g == lang and len(other.split(" ")) > len(w))
        if len(w) > 1 and not inside:
            cut = min((1000 * a * n[lang] // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w)))
            k = cut[1]
            found.setdefault(lang, []).append((-cut[0], -a, phrase.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:best], 1))


def texts(n, seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "naïve", "日本語", "x" * 40, "a\x00b", "q-r"]
    out = []
    for i in range(n):
        w = [rnd.choice(words[: rnd.choice((4, 12, 66))]) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.3:
            w += ["New", "York", "stock", "exchange"]
        out.append((i if i % 7 else None, rnd.choice((" ", "  ", "\t")).join(x + rnd.choice(("", "", "", ".", ", ", "\n", "\x0b", "!?")) for x in w), rnd.choice(("en", "en", "en", None, "de"))))
    return out + [(1, None, "en"), (2, "", "fr"), (3, " .,", "it")]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_mine_equals_plain_counting(spark):
    own = texts(600, 1) + [(5, "same words in a row here", "en"), (6, "New York", None), (7, "guten Tag", "de")] * 150
    found = co.mine(spark.createDataFrame(own, SCHEMA).repartition(3))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows(found) == plain(own)
    assert {"en", "und", "de"} <= {r[0] for r in plain(own)}


@pytest.mark.parametrize(("threshold", "best"), [(3, 50), (20, 5)])
def test_thresholds_and_ties(spark, threshold, best):
    own = texts(150, 2)
    found = co.collocations(co.phrase_counts(spark.createDataFrame(own, SCHEMA), threshold=threshold), threshold, best)
    assert rows(found) == plain(own, threshold, best)


def test_phrase_counts_over_many_tasks(spark):
    own = texts(80, 3)
    f, n = counts_of(own, 5)
    got = {(r.lang, r.phrase): r.f for r in co.phrase_counts(spark.createDataFrame(own, SCHEMA).repartition(8), threshold=5).collect() if r.size}
    assert got == f


def test_exact_arithmetic_beyond_64_bits(spark):
    big = 4 * 10**12
    counts = spark.createDataFrame([("en", "", 0, 10**13), ("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1)], "lang string, phrase string, size int, f long")
    r = co.collocations(counts).first()
    assert r.score == 1000 * (big - 1) * 10**13 // (big * (big + 1)) and (r.l, r.r) == (big, big + 1)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame(texts(200, 4), SCHEMA)
    assert rows(co.mine(df.limit(0))) == []
    more = df.withColumns({c: F.lit("x") for c in ("phrase", "size", "f", "part", "kind", "mass", "keys", "n", "rank")})
    assert rows(co.mine(more)) == rows(co.mine(df))


def test_long_text(spark):
    own = [(1, "one two three four five six " * 40_000, "en")]
    assert rows(co.mine(spark.createDataFrame(own, SCHEMA))) == plain(own)


@pytest.mark.parametrize("seed", range(6))
def test_summaries_never_lose_a_frequent_key(seed, monkeypatch):
    monkeypatch.setattr(co, "GATHERED", 50)
    rng = np.random.default_rng(seed)
    parts = [rng.zipf(1.3, 400).astype(np.uint64) % np.uint64(5000) for _ in range(25)]
    every = np.concatenate(parts)
    threshold = 40
    summary = co.Summary(len(every) // threshold + 1)
    for p in parts:
        summary.merge(*co.counted(p))
    summary.cut()
    keys, counts = co.counted(every)
    assert summary.lost < threshold and len(summary.keys) <= summary.capacity
    assert set(keys[counts >= threshold]) <= set(summary.survivors(threshold))


def test_varints():
    x = np.array([0, 1, 127, 128, 300, 2**35, 2**63 - 1], np.uint64)
    assert (co._integers(co._varints(x)) == x).all() and len(co._integers(b"")) == 0
