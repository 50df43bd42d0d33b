import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from metaspan.llm import frames
from metaspan.llm import toxicity as t


def folds(rows):
    held = [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows]
    return held


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.1"
    return t.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def test_held_out_rows(spark, model):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = t.score_toxicity(spark.read.parquet(f"{d}/documents.parquet"), model).join(labels, "doc_id").collect()
    assert [r.held_out for r in rows] == folds(rows)
    rows = [r for r in rows if r.held_out]
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.75
    assert hit / sum(r.toxic for r in rows) > 0.65
    assert all((r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "x" * 300_000), (5, "you stupid pathetic worthless clown and idiot " * 3), (5, "you stupid pathetic worthless clown and idiot " * 3), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS predicted")
    got = t.score_toxicity(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score and by[1].predicted == 0 and by[5].predicted == 1 and by[4].predicted == 0
    kept = t.keep_clean(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4]
    assert t.score_toxicity(df.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = t.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert t.score_toxicity(docs, model).first().score == 0.0


def test_window_distances_equal_brute_force(model):
    """Windows cut and compressed one by one, each on its own, by freshly made compressors."""
    texts = ["The idiot, a pathetic clown! " * 9 + "and some quiet ordinary words follow here", "", " a b c", "word " * 25, "Straße ÄÖ éÉ " * 14]
    how = zstandard.ZstdCompressionParameters(
        compression_level=3, strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=6, window_log=19, hash_log=18, chain_log=19, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    both = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for c in (model.ordinary, model.toxic)]
    expected = []
    for row, text in enumerate(texts):
        form = frames.formed(np.frombuffer(text.encode(), np.uint8)).tobytes() if text else b""
        starts = [m.start() for m in re.finditer(rb"[^ ]+", form)][:: t.WINDOW]
        cuts = [s - (s > 0) for s in starts] + [len(form)]
        for a, b in zip(cuts, cuts[1:]):
            sizes = [len(c.compress(form[a:b])) for c in both]
            expected.append((sizes[0] - sizes[1], row))
    body, at = frames.raw(pa.array(texts))
    distance, row = model.distances(body[: at[-1]], at)
    assert list(zip(distance.tolist(), row.tolist())) == expected


def test_thresholds_are_exceeded_by_the_set_shares():
    ordinary = np.array([0] * 900 + [1] * 60 + [2] * 30 + [4] * 9 + [9])
    levels = t.calibrated(ordinary)
    assert all((ordinary >= level).mean() <= share for level, share in zip(levels, t.EXCEED)) and levels == sorted(set(levels))
    assert t.calibrated(np.zeros(0)) == [1, 2, 3]


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(8)] + [(1, "repeat")], "doc_id long, text string")
    for toxic in (0, 1):
        labels = spark.createDataFrame([(i, 1, toxic) for i in range(8)], "doc_id long, quality int, toxic int")
        assert {r.score for r in t.score_toxicity(docs, t.train(docs, labels)).collect()} == {float(toxic)}
