import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from metaspan.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "Hello  world \n\n x", "tab\t b\n  c", "é" * 300, "don't  stop", "　x   y ", "a" * 5000, "日本語 text 12345", "x\x1c y \x1d z",
    "<|endoftext|>", "trailing ", "🙂" * 40 + " end", " " * 3000,
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "0 AS ids", "1 AS n_tokens")
    rows = bpe.encode_documents(df, PATH, P.PATTERN, with_ids=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(text), text[:20]
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_documents_equal_the_library(reference):
    import pyarrow.parquet as pq

    encoder = bpe.PrefixEncoder.load(PATH, P.PATTERN)
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert encoder.encode(text).tolist() == reference.encode_ordinary(text)


def test_random_bytes_appends_and_edits():
    encoder, rng = bpe.PrefixEncoder.load(PATH, P.PATTERN), random.Random(5)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcdethen \xc3\xa9") for _ in range(rng.randint(1, 40)))
        grown = bpe.Growing(encoder, piece[:7])
        grown.append(piece[7:])
        assert grown.ids() == encoder.merged(piece)
        a = rng.randint(0, len(piece))
        b = rng.randint(a, len(piece))
        grown.replace(a, b, b"the")
        assert grown.ids() == encoder.merged(piece[:a] + b"the" + piece[b:])


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
