import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from metaspan.llm import packing

PATH = P.path("byte_bpe_50k.json")


def check(rows, texts):
    t = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = t.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
    return len(by_sequence)


def test_small_texts(spark):
    texts = dict(enumerate([None, "", "a", "hello  world ", "x y z " * 3000, "<|endoftext|> t", "a <|endoftext|> b", "a<|ENDOFTEXT|>", "long " * 50_000, "a\x1cb \x85c\u2003 d\u200be", "tab\t b\n  c don't", "🙂日本\u0301 x", " " * 5000] + ["word " * k for k in range(200)]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "3 AS start", "4 AS part").repartition(5)
    check(packing.pack_documents(df, PATH).collect(), texts)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(df.repartition(4), PATH).collect()
    n = check(rows, {r.doc_id: r.text for r in df.collect()})
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 2


def test_ids_of_the_faster_library_are_those_of_the_file():
    tokens, t = packing._tokens(PATH), Tokenizer.from_file(PATH)
    assert tokens.ranked is not None
    for code in [*range(0x300), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1680]:
        text = f"a{chr(code)}b {chr(code)} c{chr(code)}{chr(code)}'s"
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, hex(code)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "same text " * 700)] * 3 + [(None, "x")], "doc_id long, text string").repartition(2)
    rows = packing.pack_documents(df, PATH).collect()
    per_row = {r.doc_tokens for r in rows if r.doc_id == 1}
    assert len(per_row) == 1 and sum(r.length for r in rows if r.doc_id == 1) == 3 * per_row.pop()
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
