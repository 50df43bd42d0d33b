"""Language identification by fusing evidence with Bayes' rule.

log P(language | all) = text log-likelihood (tempered, for neighbouring trigrams are not independent)
+ log P(declared markup language | language) + log prior of the host, and a constant.

The text model is a naive Bayes over hashed byte trigrams, trained on a bounded sample of documents
of every declared language of some weight (en, en-US and EN are one). What the declared language is worth, and the priors, come from grouped aggregation over
all rows: counts of text decisions by host are smoothed towards those of the address suffix, these towards
those of all rows. The fusion itself is a Catalyst expression.

Defined results: null text is the empty text, whose likelihoods are equal; a missing or unknown declared language,
host or suffix is no evidence (hosts without a name share one prior); repeated rows each get a row; an empty table
gives none; texts are judged whole however long; columns that are not named are ignored, so names may clash; equal
probabilities go to the first language in alphabetical order. A row is accepted if its language is among the
model's, with at least LEAST probability, and its text is not far less likely than any training text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames

#: Documents of a language that are learnt from at most, bytes of the longest one, languages whose documents are read at once. So at most some 200 MB of text are on the driver.
MOST_PER_LANGUAGE, LONGEST_LEARNT, AT_ONCE = 800, 1 << 16, 4
#: Share of the documents with a declared language that a value needs to be a language of the model, which so has at most 1 / LEAST_SHARE of them.
LEAST_SHARE = 0.001
BUCKETS = 1 << 14
#: Weight of a trigram's likelihood, trigrams that count, rows that a smoothing level counts as.
TEMPER, MOST_GRAMS, STRENGTH = 0.2, 500, 5.0
LEAST, MARGIN = 0.5, 1.5


def grams(form: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams inside rows, runs of spaces left out, and their rows."""
    if len(form) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = (form[k : len(form) - 2 + k].astype(np.uint32) for k in range(3))
    bucket = ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)) >> np.uint32(16)) & np.uint32(BUCKETS - 1)
    keep = (a != 32) | (b != 32)
    for end in at[1:-1]:
        keep[max(end - 2, 0) : end] = False
    where = np.flatnonzero(keep)
    return bucket[where].astype(np.int64), np.searchsorted(at, where, side="right") - 1


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    table: np.ndarray | None = None  # log-likelihoods, bucket by language
    floor: float = -1e9  # mean log-likelihood under which a text is in no known language

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood of each row's trigrams in each language, and the number of trigrams."""
        body, at = frames.raw(column)
        sums, counts = np.zeros((len(column), len(self.languages))), np.zeros(len(column), np.int64)
        for a, b in frames.slices(at):
            bucket, row = grams(frames.formed(body[at[a] : at[b]]), at[a : b + 1] - at[a])
            counts[a:b] = np.bincount(row, minlength=b - a)
            values = self.table[bucket]
            for k in range(len(self.languages)):
                sums[a:b, k] = np.bincount(row, values[:, k], b - a)
        return sums / np.maximum(counts, 1)[:, None], counts


def _counted(rows: list[tuple[str, str]], language: str) -> np.ndarray:
    body, at = frames.raw(pa.array([t for s, t in rows if s == language], pa.string()))
    bucket, _ = grams(frames.formed(body[at[0] : at[-1]]), at)
    return np.bincount(bucket, minlength=BUCKETS)


def fit_parts(languages: list[str], part: Callable[[list[str]], list[tuple[str, str]]]) -> Model:
    """A model of the languages; ``part`` gives the (language, text) rows of some of them, so that few are held at once."""
    if not languages:
        return Model()
    counts = np.full((BUCKETS, len(languages)), 0.5, np.float32)
    groups = [languages[k : k + AT_ONCE] for k in range(0, len(languages), AT_ONCE)]
    held = []
    for k, group in enumerate(groups):
        held = part(group)
        for j, language in enumerate(group):
            counts[:, k * AT_ONCE + j] += _counted(held, language)
    table = np.log(counts / counts.sum(axis=0, dtype=np.float64)).astype(np.float32)
    model = Model(languages, table)
    worst = []
    for group in groups:
        rows = held if len(groups) == 1 else part(group)
        mean, n = model.likelihoods(pa.array([t for _, t in rows], pa.string()))
        worst += mean.max(axis=1)[n >= 20].tolist()
    model.floor = min(worst) - MARGIN if worst else -1e9
    return model


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (language, text) rows."""
    return fit_parts(sorted({r[0] for r in rows}), lambda group: [r for r in rows if r[0] in group])


def spelt(declared: Column | str) -> Column:
    """The language of a declared value: en of en-US, EN and en_GB."""
    return F.lower(F.substring_index(F.substring_index(F.trim(declared), "-", 1), "_", 1))


def train(docs: DataFrame) -> Model:
    """A model of the declared languages of ``docs`` (doc_id, text, lang) from a bounded sample: some documents of each.

    Values that under LEAST_SHARE of the documents declare are no languages of the model: their documents are judged by the other evidence. Documents over LONGEST_LEARNT bytes are not learnt from.
    """
    known = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(spelt("lang").alias("lang"), F.col("doc_id").alias("id"), "text").where("lang IS NOT NULL AND lang <> ''")
    sizes = frames.written(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    languages = sorted(r.lang for r in sizes.where(F.col("n") >= LEAST_SHARE * total).select("lang").collect())
    if not languages:
        return Model()
    # twice the wanted share by hash first, so that few rows are ranked, whatever the size of a language
    place = F.xxhash64("id").cast("double") / 2.0**64 + 0.5
    short = known.where((F.octet_length("text") <= LONGEST_LEARNT) & F.col("lang").isin(languages))
    drawn = short.join(F.broadcast(sizes.where(F.col("lang").isin(languages))), "lang").where(place * F.col("n") <= 2 * MOST_PER_LANGUAGE + 1)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")))
    sample = frames.written(drawn.withColumn("rank", rank).where(F.col("rank") <= MOST_PER_LANGUAGE).select("lang", "text"), "sample")

    def part(group: list[str]) -> list[tuple[str, str]]:
        rows = sample.where(F.col("lang").isin(group)).toArrow()
        return sorted(zip(*(c.to_pylist() for c in rows.columns)))

    return fit_parts(languages, part)


def _prior(counts: Column, above: Column, n: int) -> Column:
    """Counts smoothed towards the probabilities of the level above."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, above, lambda c, p: (c + STRENGTH * p) / (total + STRENGTH))


def identify_languages(df: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",), text: str | Column = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None) -> DataFrame:
    """keys, lang_id, confidence, text_lang (by text alone), accepted, of every row."""
    text = df[text] if isinstance(text, str) else text
    names, n = model.languages, len(model.languages)
    given = lambda c: (F.lit(None) if c is None else c).cast("string")
    narrow = df.select(*[df[k].alias(f"key{i}") for i, k in enumerate(keys)], given(declared).alias("declared"), F.coalesce(given(host), F.lit("")).alias("host"), F.coalesce(given(suffix), F.lit("")).alias("suffix"), text.alias("text"))
    kept = narrow.drop("text").schema
    if not n:
        return narrow.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], F.lit("und").alias("lang_id"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), F.lit(False).alias("accepted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, count = model.likelihoods(frames.texts(batch.column("text")))
            score = TEMPER * mean * np.minimum(count, MOST_GRAMS)[:, None]
            score -= score.max(axis=1, keepdims=True)
            strange = (count >= 20) & (mean.max(axis=1) < model.floor)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(list(score), pa.list_(pa.float64())), pa.array(np.where(count > 0, score.argmax(axis=1), -1), pa.int32()), pa.array(strange)],
                names=[*(f.name for f in kept), "score", "best", "strange"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", score array<double>, best int, strange boolean"
    scored = frames.written(narrow.mapInArrow(frames.tidy(run), schema), "language")
    tally = lambda prefix="": F.array(*[F.sum(F.when(F.col("best") == k, F.col("n")).otherwise(0)).cast("double") for k in range(n)])
    added = lambda: F.array(*[F.sum(F.col("counts")[k]) for k in range(n)])
    counted = scored.groupBy("host", "suffix", "declared", "best").agg(F.count("*").alias("n"))
    hosts = counted.groupBy("host", "suffix").agg(tally().alias("counts"))
    suffixes = hosts.groupBy("suffix").agg(added().alias("counts"))
    # as many numbers as there are languages, and a table of languages by languages
    whole = suffixes.agg(added().alias("counts")).first().counts
    total = sum(x or 0.0 for x in whole)
    base = F.array(*[F.lit(((x or 0.0) + 1.0) / (total + n)) for x in whole])
    suffixes = suffixes.select("suffix", _prior(F.col("counts"), base, n).alias("above"))
    place = F.struct("host", "suffix").alias("place")
    hosts = hosts.join(suffixes, "suffix").select(place, _prior(F.col("counts"), F.col("above"), n).alias("prior"))
    table = {(r.d, r.best): r.n for r in counted.where("best >= 0").select(spelt("declared").alias("d"), "best", "n").where(F.col("d").isin(names)).groupBy("d", "best").agg(F.sum("n").alias("n")).collect()}
    columns = [sum(table.get((d, k), 0) for d in names) for k in range(n)]
    # as a table, for as an expression it grows with the square of the languages
    worth = [(d, [float(np.log((table.get((d, k), 0) + 1.0) / (columns[k] + n))) for k in range(n)]) for d in names]
    worth = F.broadcast(df.sparkSession.createDataFrame(worth, "d string, worth array<double>"))
    fused = frames.split_join(scored.withColumns({"d": spelt("declared"), "place": F.struct("host", "suffix")}), hosts, "place").join(worth, "d", "left").withColumn("worth", F.coalesce("worth", F.array(*[F.lit(0.0)] * n)))
    z = F.zip_with(F.zip_with("score", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), "worth", lambda a, b: a + b)
    fused = fused.withColumn("z", z).withColumn("top", F.array_max("z"))
    mass = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    by_name = F.array(*[F.lit(x) for x in names])
    fused = fused.withColumn("confidence", F.round(1 / mass, 6)).withColumn("lang_id", F.element_at(by_name, F.array_position("z", F.col("top")).cast("int")))
    return fused.select(
        *[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], "lang_id", "confidence",
        F.when(F.col("best") >= 0, F.element_at(by_name, F.col("best") + 1)).otherwise("und").alias("text_lang"),
        ((F.col("confidence") >= LEAST) & ~F.col("strange")).alias("accepted"),
    )


def markup_language(html: Column) -> Column:
    """The lang attribute of the first <html> tag, null without one."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """The page without scripts, styles, comments and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
