"""The registered ``opN_`` queries and the SQL that DuckDB can check them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, collocations, fingerprint, html_extract, language_id, license_scan, merkle, ngram_join, packing, secret_scan, toxicity, url_filter, vector_join
from .frames import table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify_languages(docs, language_id.train(docs), declared=docs.lang, host=docs.source)


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where markup and addresses exist: the text model is that of ``documents``."""
    pages = table(spark, sf_dir, "pages")
    host = url_filter.host_of(pages.url)
    return language_id.identify_languages(
        pages, language_id.train(table(spark, sf_dir, "documents")), keys=("page_id",), text=language_id.visible_text(pages.html),
        declared=language_id.markup_language(pages.html), host=host, suffix=F.substring_index(host, ".", -1),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op5_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.link_vectors(table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), keep=("page_id",)).select("page_id", "host", "path", "rule", "verdict")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_language_id": op2_language_id,
    "pages_language_id": pages_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_vector_join": op5_vector_join,
    "op6_bpe": op6_bpe,
    "op7_packing": op7_packing,
    "op8_ngram_join": op8_ngram_join,
    "op9_html_extract": op9_html_extract,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_license_scan": op12_license_scan,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op5_vector_join": vector_join.oracle,
    "op8_ngram_join": ngram_join.oracle,
    "op10_url_filter": url_filter.oracle,
    "op11_collocations": collocations.oracle,
    "op12_license_scan": license_scan.oracle,
    "op13_merkle_manifest": merkle.oracle,
}
