"""The corpus pipeline: documents in, packed training sequences out.

Language ID -> toxicity -> n-gram Jaccard join -> secret scan -> packing. Each stage takes all
that its predecessor kept; between stages the documents are a Parquet table in the shared folder.

A document is dropped by the first stage if its language is not accepted, by the second if it is predicted toxic, by
the third if a document with a smaller id is in its component (of repeated ids, one row of each text
stays). The fourth replaces secrets in the text and corrects n_chars. Rows without an id are never dropped by
the third stage, null texts are empty documents; an empty table gives no sequences. Texts are judged, compared and packed
whole however long; a document longer than a sequence is packed in pieces. Repeats of one id and text become one row in the
third stage. Extra columns of the documents are carried, but for one named ``_key``, which the third stage needs. The first stage joins its rejections on id, text hash,
language and source, null-safely: rejections are few where a corpus is in its languages, and Spark shuffles both sides where they are not.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaspan.llm import frames, language_id, ngram_join, packing, secret_scan, toxicity

#: Some stages are judged against brute force, not SQL.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark = "text_hash"
    while mark in docs.columns:
        mark = f"_{mark}"
    named = docs.withColumn(mark, F.xxhash64("text"))
    # what the decision depends on, and the id; null is a value like others
    keys = ("doc_id", mark, "lang", "source")
    judged = language_id.identify_languages(named, language_id.train(docs), keys=keys, declared=named.lang, host=named.source)
    rejected = frames.written(judged.where(~F.col("accepted")).select(*keys).distinct(), "rejected")
    equal = reduce(and_, [named[k].eqNullSafe(rejected[k]) for k in keys])
    return named.join(rejected, equal, "left_anti").select(*docs.columns)


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = frames.written(ngram_join.ngram_components(docs).select("doc_id", "component_id"), "components")
    copies = found.where("doc_id <> component_id").select("doc_id")
    repeated = frames.written(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return ngram_join.without_ids(docs, copies)
    kept = ngram_join.without_ids(docs, copies.union(repeated))
    again = docs.join(repeated, "doc_id", "left_semi").join(copies, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(again.select(*docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify),
    ("toxicity", detoxify),
    ("ngram_join", deduplicate),
    ("secret_scan", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = frames.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
