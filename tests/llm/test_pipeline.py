import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from metaspan.llm import language_id, secret_scan, toxicity

from .test_ngram_join import brute as brute_components
from .test_secret_scan import brute as brute_spans

D = "/root/testdata/sf0.01"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    judged = {r.doc_id: r.accepted for r in language_id.identify_languages(docs, language_id.train(docs), declared=docs.lang, host=docs.source).collect()}
    kept = [r for r in docs.collect() if judged[r.doc_id]]
    model = toxicity.train(spark.createDataFrame(kept, docs.schema), spark.read.parquet(f"{D}/labels.parquet"))
    clean = model.scores(pa.array([r.text for r in kept])) < 0.3
    kept = [r for r, c in zip(kept, clean) if c]
    parts = brute_components([(r.doc_id, r.text) for r in kept])
    texts = {}
    for r in kept:
        if parts[r.doc_id][1] == r.doc_id:
            spans = [s.split(":") for s in brute_spans(r.text)]
            texts[r.doc_id] = secret_scan.redacted(r.text, [(int(a), int(b), k) for k, a, b in spans])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, D).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, rows in by_doc.items():
        ids, at = t.encode(texts[doc_id], add_special_tokens=False).ids + [1], 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert all(sum(r.length for r in rows) <= 2048 for rows in by_sequence.values())


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, "the and of that was for with", "en", "s", 28), (1, "the and of that was for with", "en", "s", 28), (2, None, None, None, None), (None, "the of", "en", "s", 6), (3, "The and of that was for with", "en", "s", 28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS node", "2 AS host", "3 AS text_hash", "4 AS _id")
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, D)
        assert out.columns == docs.columns, name
        got = sorted((r.doc_id or 0) for r in out.collect())
        assert got == ([0, 1, 2] if name == "ngram_join" else [0, 1, 1, 2, 3]) or name == "language_id", (name, got)
        assert f(spark, docs.limit(0), D).count() == 0


def test_rejection_takes_effect_without_ids(spark):
    """Rows without an id are dropped by the first stage like others if their own text, language and source are rejected."""
    good = spark.read.parquet(f"{D}/documents.parquet").limit(100)
    strange = "Привет мир это другой язык " * 20
    odd = spark.createDataFrame([(None, strange, None, "s", 1), (-1, strange, None, None, 1), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = good.unionByName(odd.select(*good.columns))
    out = stage("language_id")(spark, docs, D)
    left = out.collect()
    assert not any(r.text == strange for r in left) and sum(r.doc_id is not None for r in left) > 95
