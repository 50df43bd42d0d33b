import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from metaspan.llm import language_id as g
from metaspan.llm import queries

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return g.train(spark.read.parquet(f"{D}/documents.parquet"))


def test_documents_get_their_language(spark, model):
    assert model.languages == ["de", "en", "es", "fr"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = queries.op2_language_id(spark, D).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert np.mean([r.lang_id == r.lang for r in rows]) > 0.98 and np.mean([r.accepted for r in rows]) > 0.99


def test_pages(spark):
    rows = queries.pages_language_id(spark, D).collect()
    assert len(rows) == 250 and np.mean([r.lang_id == r.text_lang for r in rows]) > 0.9


def test_fusion_follows_bayes_rule(spark, model):
    rows = [(1, "", "fr", "a"), (2, None, None, "b"), (3, "the and that with", None, "b"), (4, "the and of", "en-US", "b"), (4, "the and of", "en-US", "b"), (5, "", "zz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, h string").selectExpr("*", "1 AS score", "2 AS prior")
    got = {r.doc_id: r for r in g.identify_languages(df, model, declared=F.col("d"), host=F.col("h")).collect()}
    assert len(got) == 5 and got[3].lang_id == got[4].lang_id == "en" and got[2].text_lang == "und"
    # counts of text decisions: host a none, host b three English; all hosts have one suffix
    base = {k: ((3 if k == "en" else 0) + 1) / 7 for k in model.languages}
    suffix = {k: ((3 if k == "en" else 0) + 5 * base[k]) / 8 for k in model.languages}
    host = {k: ((3 if k == "en" else 0) + 5 * suffix[k]) / 8 for k in model.languages}
    assert got[2].lang_id == "en" and math.isclose(got[2].confidence, host["en"], abs_tol=1e-5)
    worth = {k: 1 / (6 if k == "en" else 4) for k in model.languages}
    total = sum(suffix[k] * worth[k] for k in model.languages)
    assert math.isclose(got[1].confidence, suffix["en"] * worth["en"] / total, abs_tol=1e-5)


def test_strange_text_and_empty_table(spark, model):
    df = spark.createDataFrame([(1, "Привет мир это другой язык " * 20)], "doc_id long, text string")
    assert not g.identify_languages(df, model).first().accepted
    assert g.identify_languages(df.limit(0), model).count() == 0


def test_every_declared_language_is_learnt(spark):
    """However many languages are declared, each is in the model; spellings of one language are one."""
    rows = [(2 * k + j, " ".join(chr(97 + k // 6) * 2 + chr(97 + k % 6) * 2 + w for w in "abcdefghij"), f"{'x' if j else 'X'}{chr(97 + k // 6)}{chr(97 + k % 6)}{'-ZZ' if j else ''}") for k in range(36) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = g.train(docs)
    assert model.languages == sorted({r[2][:3].lower() for r in rows}) and len(model.languages) == 36
    got = g.identify_languages(docs, model, declared=docs.lang).join(docs, "doc_id").collect()
    assert all(r.lang_id == r.lang[:3].lower() and r.accepted for r in got)


def test_sample_is_the_least_hashes(spark):
    """The ranked draw takes the documents that ordering all of them would take."""
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "'en' AS lang")
    seen = []
    fitted, g.fit_parts = g.fit_parts, lambda languages, part: seen.extend(part(languages))
    try:
        g.train(docs)
    finally:
        g.fit_parts = fitted
    want = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(g.MOST_PER_LANGUAGE).collect()
    assert seen == sorted(("en", r.text) for r in want)


def test_text_alone_tells_the_language_of_documents_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(g, "MOST_PER_LANGUAGE", 100)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    fitted = g.train(docs)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    unseen = docs.withColumn("rank", rank).where("rank > 100").drop("rank")
    rows = g.identify_languages(unseen, fitted).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 400 and np.mean([r.text_lang == r.lang for r in rows]) > 0.95


def test_pages_with_odd_rows(spark, model):
    """Null and broken pages, repeats, clashing columns, an empty table."""
    rows = [(1, None, None), (2, "", "x"), (3, "<html lang='fr'>", "http://a.fr/"), (3, "<html lang='fr'>", "http://a.fr/"), (None, "<p>the and of", "http://b.org/"), (4, "<html lang=de>" + "und der die das nicht " * 15_000, "http://c.de")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").selectExpr("*", "1 AS host", "2 AS place", "3 AS d")
    host = F.regexp_extract("url", "://([^/]*)", 1)
    judge = lambda df: g.identify_languages(df, model, keys=("page_id",), text=g.visible_text(df.html), declared=g.markup_language(df.html), host=host, suffix=F.substring_index(host, ".", -1))
    got = judge(pages).collect()
    assert len(got) == len(rows) and {r.lang_id for r in got} <= set(model.languages) and {r.lang_id for r in got if r.page_id == 4} == {"de"}
    assert judge(pages.limit(0)).count() == 0


def test_dirty_languages_do_not_become_classes(spark):
    """Thousands of odd declared values leave the model with the languages of some weight."""
    rows = [(i, "the cat and the dog in the house with the garden " * 3, "en") for i in range(3000)] + [(5000 + i, "le chat et le chien dans la maison avec le jardin " * 3, "fr") for i in range(3000)]
    rows += [(10_000 + i, "noise", f"x{i}") for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = g.train(docs)
    assert model.languages == ["en", "fr"]
    found = g.identify_languages(docs.where("doc_id >= 5000 AND doc_id < 5010"), model, declared=docs.lang)
    assert {r.lang_id for r in found.collect()} == {"fr"}
