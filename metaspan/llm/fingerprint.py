"""Document fingerprints by consistent weighted sampling.

Terms are five-word shingles, weights their counts. For term t and sample j, the triple
(r ~ Gamma(2, 1), c ~ Gamma(2, 1), beta ~ U(0, 1)) is a fixed function of a hash of (t, j). A term of
weight S has the level k = floor(ln S / r + beta) and the value ln a = ln c - r (k - beta + 1); the
term and level of the smallest value are sample j. Two documents share sample j with the
probability of their generalised Jaccard similarity, sum of minima over sum of maxima.

The triples come from a table that is sorted by the value at weight 1. So for weight 1,
by far the commonest, the order of values is the order of the hashes, and the table is read
for the winner only.

Defined results: null text is the empty text; empty texts share one fingerprint and are alike (1)
to each other and unlike (0) all others; a text with under five words is one term.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames, shingles

#: Samples of a fingerprint, 16 bits each, and the log2 of the number of gamma triples.
SAMPLES, TABLE_BITS = 128, 20
#: Ranges of ids for each shuffle partition; in each the next document is found. How finely their bounds are estimated.
RANGES, ACCURACY = 3, 100_000


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    n = 1 << TABLE_BITS
    r, c, beta = rng.gamma(2.0, 1.0, n), rng.gamma(2.0, 1.0, n), rng.random(n)
    value = np.log(c) - r * (1 - beta)
    order = np.argsort(value)
    multipliers = rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.stack([r, np.log(c), beta])[:, order], value[order], multipliers, rng.integers(1, 2**63, 2, dtype=np.uint64)


def sample(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint (uint16 samples) of the multiset of term hashes."""
    if not len(hashes):
        return np.zeros(SAMPLES, np.uint16)
    (r, log_c, beta), value, multipliers, salt = _table()
    terms, counts = np.unique(hashes, return_counts=True)
    shift = np.uint64(64 - TABLE_BITS)
    best = np.full(SAMPLES, np.inf)
    name = np.zeros(SAMPLES, np.uint64)
    light = terms[counts == 1]
    for a in range(0, len(light), 256):
        low = np.multiply.outer(light[a : a + 256], multipliers).min(axis=0)
        low_value = value[(low >> shift).astype(np.int64)]
        take = (low_value < best) | ((low_value == best) & (low < name))
        best, name = np.where(take, low_value, best), np.where(take, low, name)
    heavy, log_s = terms[counts > 1], np.log(counts[counts > 1])
    for a in range(0, len(heavy), 512):
        h = np.multiply.outer(heavy[a : a + 512], multipliers)
        i = (h >> shift).astype(np.int64)
        own_r, own_beta = r[i], beta[i]
        level = np.floor(log_s[a : a + 512, None] / own_r + own_beta)
        v = log_c[i] - own_r * (level - own_beta + 1)
        at = v.argmin(axis=0)[None, :]
        v, h, level = (np.take_along_axis(x, at, 0)[0] for x in (v, h, level))
        take = v < best
        best, name = np.where(take, v, best), np.where(take, h + level.astype(np.int64).astype(np.uint64) * salt[0], name)
    return (shingles.mix(name ^ salt[1]) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray, a_empty: bool, b_empty: bool) -> float:
    if a_empty or b_empty:
        return float(a_empty and b_empty)
    return float((a == b).mean())


def fingerprints(texts: pa.Array) -> list[tuple[np.ndarray, bool]]:
    """(samples, has no terms) of each row of a string array without nulls."""
    return [(sample(h), not len(h)) for h in shingles.of_rows(texts)]


def edited(text: str, other: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _range_of(key: Column, bounds: Column, n: int) -> Column:
    """The number of the n ascending bounds that are at most ``key``, less one, by bisection; ``key`` is not below the first."""

    def step(at: Column, width: Column) -> Column:
        return F.when((at + width < n) & (F.element_at(bounds, F.least(at + width, F.lit(n - 1)) + 1) <= key), at + width).otherwise(at)

    return F.aggregate(F.lit(np.array([1 << k for k in reversed(range(n.bit_length()))], np.int32)), F.lit(0), step)


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how alike it is to that and to the next document.

    The next document is the one with the next id (equal ids: by text), after the last the first. Rows without an
    id have no next document: its text counts as empty and near_next is null. The documents are dealt to ranges of
    ids, whose bounds are ids of documents; the first document of a range also goes to the range before, as
    the next of its last. So texts are shuffled once and each task streams over sorted rows. Texts are taken whole however long;
    repeated rows each get a row; an empty table gives none; columns other than id and text are ignored whatever their names.
    """
    docs = df.select(frames.long_id(df, id_col).alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    n = RANGES * frames.pieces(df.sparkSession)
    ids = docs.select(F.col("doc_id")).where("doc_id IS NOT NULL")
    bounds = ids.agg(F.percentile_approx("doc_id", F.lit(np.arange(n) / n), ACCURACY), F.min("doc_id")).first()
    bounds = sorted({*(bounds[0] or []), bounds[1]}) if bounds[1] is not None else []
    place = lambda number, tail: F.struct(number.alias("range"), F.lit(tail).alias("tail"))
    if bounds:
        # one literal, whatever the number of ranges
        held, last = F.lit(np.array(bounds, np.int64)), len(bounds) - 1
        docs = docs.withColumn("own", F.when(F.col("doc_id").isNotNull(), _range_of(F.col("doc_id"), held, len(bounds))))
        places = F.array(place(F.coalesce("own", F.lit(-1)), False))
        is_head = F.coalesce(F.element_at(held, F.col("own") + 1) == F.col("doc_id"), F.lit(False))
        before = F.when(F.col("own") == 0, F.lit(last)).otherwise(F.col("own") - 1)
        places = F.when(is_head, F.concat(places, F.array(place(before, True)))).otherwise(places)
    else:
        places = F.array(place(F.lit(-1), False))
    dealt = docs.select("doc_id", "text", F.explode(places).alias("at")).select("at.range", "doc_id", "at.tail", "text")
    # a range is a task; rows without an id, which need no order, go anywhere
    task = F.when(F.col("range") < 0, F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")).otherwise(F.col("range"))
    dealt = dealt.repartitionById(n, task).sortWithinPartitions("range", "tail", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next row has not come: (range, id, text)
        rows: list[tuple] = []  # (id, text, next text or None)

        def result() -> pa.RecordBatch:
            own_texts = [r[1] for r in rows]
            edits = [edited(r[1], r[2] or "") for r in rows]
            after = {}
            prints = fingerprints(pa.array(own_texts, pa.string()))
            edit_prints = fingerprints(pa.array(edits, pa.string()))
            for k, r in enumerate(rows):
                if r[2] is not None and not (k + 1 < len(rows) and rows[k + 1][1] is r[2]):
                    after[k] = fingerprints(pa.array([r[2]], pa.string()))[0]
            out = []
            for k, (doc_id, text, following) in enumerate(rows):
                a, b = prints[k], edit_prints[k]
                nxt = None if following is None else after.get(k) or prints[k + 1]
                out.append(
                    (
                        doc_id, len(text), hashlib.sha256(edits[k].encode()).hexdigest(), a[0].tobytes().hex(), b[0].tobytes().hex(),
                        likeness(a[0], b[0], a[1], b[1]), None if nxt is None else likeness(a[0], nxt[0], a[1], nxt[1]),
                    )
                )
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        size = 0
        for batch in batches:
            for at, doc_id, tail, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if at < 0:
                    rows.append((doc_id, text, None))
                else:
                    if held is not None:
                        rows.append((held[1], held[2], text))
                        size += len(held[2])
                    # After the tail nothing of the range is open; repeats of the first id come as tails too and only the first counts.
                    held = None if tail else (at, doc_id, text)
                if size > frames.SLICE_BYTES or len(rows) >= 4096:
                    yield result()
                    size = 0
        if rows:
            yield result()

    return dealt.mapInArrow(
        frames.tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
