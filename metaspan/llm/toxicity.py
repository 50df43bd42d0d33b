"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one on windows of ordinary documents, one on the passages of
toxic documents that are made of words which stand in significantly more contexts there. (Trained on whole
windows of toxic documents, which are mostly ordinary prose, the dictionaries hardly differ in what is toxic.) Significant words
that the trainer passes over are put in front. Both then hold the same ordinary prose. A
text is cut into windows of twelve words; a window's distance is the length it compresses to with the
ordinary dictionary less that with the toxic one. The thresholds of distances are those that set shares of ordinary
windows exceed; thresholded and averaged distances of a document are turned
into a probability by a logistic regression, both fitted on labelled documents that the dictionaries have not seen.

Training uses a bounded sample of labelled rows (MOST_TOXIC, MOST_ORDINARY; chosen by a hash of
the id); every document is scored whole. Only the text is an input of a score.

Defined results: null, empty and wordless texts have all distances 0 and so the lowest evidence; with labels of one
kind only all scores are the share of toxic labels, 0 or 1, and without labels 0; equal texts have equal scores; repeated rows each get a row, and a
repeated label counts once, toxic if one of its rows is; an empty table gives no rows; very long texts are scored whole, by slices of whole documents;
columns other than id and text are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

#: Labelled documents that are learnt from, at most.
MOST_TOXIC, MOST_ORDINARY = 2500, 4000
#: Words of a window; bytes of ordinary prose in a dictionary, of what is trained, and the trainer's segments and shortest matches.
WINDOW, PROSE, TRAINED, SEGMENT, MATCH = 12, 120_000, 16_384, 24, 8
#: Windows that the trainer sees at most, of the bounded sample's; shares of ordinary windows that exceed the thresholds.
MOST_WINDOWS, EXCEED = 20_000, (0.05, 0.01, 0.002)
#: Likelihood ratio statistic and ratio of document frequencies from which a word is toxic.
LEAST_G, LEAST_RATIO = 12.0, 3.0
#: Of crc32(doc_id as text): rows with this remainder are never learnt from.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3


def windows(form: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each window of the rows that begin at ``at``."""
    if not len(form):
        return (np.zeros(0, np.int64),) * 3
    inside = form != 32
    before = np.concatenate([[False], inside[:-1]])
    before[at[:-1][at[:-1] < len(form)]] = False
    starts = np.flatnonzero(inside & ~before)
    row = np.searchsorted(at, starts, side="right") - 1
    rank = np.arange(len(starts)) - np.searchsorted(row, row)
    first = rank % WINDOW == 0
    starts, row = starts[first], row[first]
    # a window begins with the space before its first word, if that is the row's
    begins = starts - (starts > at[row])
    same = np.concatenate([row[1:] == row[:-1], [False]]) if len(row) else np.zeros(0, bool)
    ends = np.where(same, np.append(begins[1:], 0), at[row + 1]) if len(row) else begins
    return begins, ends, row


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = -1e9
    levels: list[int] = field(default_factory=lambda: [2, 3, 5])
    always: float = 0.0  # the score of every text if nothing could be learnt
    _both: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_both": None}

    def compressors(self) -> tuple:
        if self._both is None:
            how = zstandard.ZstdCompressionParameters(
                compression_level=3, strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=6, window_log=19, hash_log=18, chain_log=19,
                write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            both = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                both.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
            self._both = tuple(both)
        return self._both

    def distances(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window of the rows: its distance and its row."""
        form = frames.formed(body)
        begins, ends, row = windows(form, at)
        if not len(begins):
            return np.zeros(0, np.int64), row
        segments = np.stack([begins, ends - begins], axis=1).astype(np.uint64)
        buffer = zstandard.BufferWithSegments(form.tobytes(), segments.tobytes())
        sizes = [np.fromiter(map(len, c.multi_compress_to_buffer(buffer, threads=1)), np.int64, len(begins)) for c in self.compressors()]
        return sizes[0] - sizes[1], row

    def features(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per row: largest distance, mean of the three largest, log counts of distances from each level, share of windows from the middle one."""
        out = np.zeros((len(at) - 1, 6))
        distance, row = self.distances(body, at)
        if not len(row):
            return out
        order = np.lexsort((-distance, row))
        distance, row = distance[order].astype(float), row[order]
        rows, first, n = np.unique(row, return_index=True, return_counts=True)
        out[rows, 0] = distance[first]
        rank = np.arange(len(row)) - np.repeat(first, n)
        out[rows, 1] = np.bincount(row, np.where(rank < 3, distance, 0), len(out))[rows] / np.minimum(n, 3)
        for k, least in enumerate(self.levels, 2):
            out[:, k] = np.log1p(np.bincount(row, distance >= least, len(out)))
        out[rows, 5] = np.bincount(row, distance >= self.levels[1], len(out))[rows] / n
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        body, at = frames.raw(column)
        out = np.full(len(column), self.always)
        if not self.weights:
            return out
        for a, b in frames.slices(at):
            x = (self.features(body[at[a] : at[b]], at[a : b + 1] - at[a]) - self.mean) / self.scale
            out[a:b] = 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights) + self.bias, -30, 30)))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last column is the intercept."""
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def trained(samples: list[bytes]) -> bytes:
    """The content of a zstandard dictionary trained on the samples, or, where they are too few to train on, the different ones themselves."""
    try:
        return zstandard.train_dictionary(TRAINED, samples, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:TRAINED]


def calibrated(ordinary: np.ndarray) -> list[int]:
    """The least distances, one above the other, that at most the set shares of ordinary windows reach."""
    levels: list[int] = []
    for share in EXCEED:
        least = int(np.sort(ordinary)[-int(len(ordinary) * share) - 1]) + 1 if len(ordinary) else 1
        levels.append(max([1, least, *(x + 1 for x in levels)]))
    return levels


def fit(rows: list[tuple[int, str, int]], share: float | None = None) -> Model:
    """A model from (doc_id, text, toxic) rows; share is that of toxic rows among all labelled ones, if the rows are a sample by class."""
    texts, y = pa.array([t or "" for _, t, _ in rows], pa.string()), np.array([int(t) for *_, t in rows])
    if not y.any() or y.all():
        return Model(always=float(len(y) > 0 and y.all()))
    body, at = frames.raw(texts)
    form = frames.formed(body[: at[-1]])
    shown = np.array([zlib.crc32(str(i).encode()) % FOLDS != FOLDS - 1 for i, *_ in rows])
    if not (y[shown].any() and y[~shown].any() and (1 - y)[shown].any() and (1 - y)[~shown].any()):
        shown[:] = True
    # In how many contexts (words before it) a word occurs, once per document at most: copies of a document add nothing.
    seen, contexts = {0: Counter(), 1: Counter()}, set()
    for k in np.flatnonzero(shown).tolist():
        own = form[at[k] : at[k + 1]].tobytes().split()
        new = set()
        for pair in zip([b"", *own], own):
            if (h := hash((pair, int(y[k])))) not in contexts:
                contexts.add(h)
                new.add(pair[1])
        seen[y[k]].update(new)
    n_toxic, n_ordinary = int(y[shown].sum()), int((1 - y[shown]).sum())

    def g(word: bytes) -> float:
        a, b = seen[1][word], seen[0][word]
        p, term = (a + b) / (n_toxic + n_ordinary), lambda x, e: x * log(x / e) if x else 0.0
        return 2 * (term(a, p * n_toxic) + term(b, p * n_ordinary) + term(n_toxic - a, (1 - p) * n_toxic) + term(n_ordinary - b, (1 - p) * n_ordinary))

    words = {w for w, a in seen[1].items() if a >= 3 and a / n_toxic > LEAST_RATIO * (seen[0][w] + 0.5) / n_ordinary and g(w) > LEAST_G}
    passages: list[bytes] = []
    for k in np.flatnonzero(shown & (y == 1)).tolist():
        run: list[bytes] = []
        for w in [*form[at[k] : at[k + 1]].tobytes().split(), b""]:
            if w in words:
                run.append(w)
            elif run:
                passages.append(b" " + b" ".join(run) + b" ")
                run = []
    toxic = trained(passages)
    left = sorted((w for w in words if b" " + w + b" " not in toxic), key=lambda w: (g(w), w))
    toxic = b" ".join([b"", *left, toxic])
    # ordinary prose: a window of each shown ordinary document in turn, until there is enough
    prose, size, at_docs = [], 0, np.flatnonzero(shown & (y == 0))
    for turn in range(64):
        for k in at_docs.tolist():
            if size >= PROSE:
                break
            own = form[at[k] : at[k + 1]]
            begins, ends, _ = windows(own, np.array([0, len(own)]))
            if turn < len(begins):
                w = (k * 2654435761 + turn) % len(begins)
                prose.append(own[begins[w] : ends[w]].tobytes())
                size += len(prose[-1])
        if size >= PROSE:
            break
    seen_windows = dict.fromkeys(prose)
    for k in at_docs.tolist():
        if len(seen_windows) >= MOST_WINDOWS:
            break
        own = form[at[k] : at[k + 1]]
        seen_windows |= dict.fromkeys(own[a:b].tobytes() for a, b, _ in zip(*windows(own, np.array([0, len(own)]))))
    common = trained(list(seen_windows)[:MOST_WINDOWS]) + b" " + b"".join(prose)[-PROSE:]
    common += b" " * max(0, 64 - len(common))
    model = Model(ordinary=common, toxic=toxic + b" " + common)
    judged = ~shown if not shown.all() else shown
    ordinary = [model.distances(body[at[k] : at[k + 1]], np.array([0, at[k + 1] - at[k]]))[0] for k in np.flatnonzero(judged & (y == 0))]
    model.levels = calibrated(np.concatenate(ordinary))
    model.weights = [0.0] * 6
    model.mean, model.scale = [0.0] * 6, [1.0] * 6
    x = np.concatenate([model.features(body[at[k] : at[k + 1]], np.array([0, at[k + 1] - at[k]])) for k in np.flatnonzero(judged)])
    y = y[judged]
    w = np.ones(len(y))
    if share is not None and 0 < share < 1:
        w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    beta = _logistic(np.column_stack([(x - mean) / scale, np.ones(len(x))]), y.astype(float), w)
    model.mean, model.scale, model.weights, model.bias = mean.tolist(), scale.tolist(), beta[:-1].tolist(), float(beta[-1])
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out: a bounded sample of each class."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = None
    for toxic, most in ((1, MOST_TOXIC), (0, MOST_ORDINARY)):
        part = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    # at most MOST_TOXIC + MOST_ORDINARY ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    # one text of a repeated id, so that the bound on ids bounds the rows
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic").toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in rows.columns)), key=lambda r: (r[0], r[1] or ""))
    total = sum(counts.values())
    return fit(rows, counts.get(1, 0) / total if total else None)


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(frames.texts(batch.column(1)))
            held = [zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT if i is not None else False for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return df.select(frames.long_id(df, id_col).alias("doc_id"), df[text_col].alias("text")).mapInArrow(frames.tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, same columns, whose text is not predicted toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(frames.texts(batch.column(text_col))) < THRESHOLD))

    return df.mapInArrow(frames.tidy(run), df.schema)
