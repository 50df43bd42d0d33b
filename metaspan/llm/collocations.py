"""Phrase collocations: frequent word n-grams of each language, scored by their weakest cut.

First pass. Every n-gram of one to five words, of every text, is a key: the leading bits of a 64-bit hash of language and
words. A task counts the keys of up to ``FLUSH`` n-grams and sends each hash partition its part, sorted, as differences. A partition
merges what it gets into a Misra-Gries summary: a counter for each key, and when there are more counters than its capacity, all lose
what the first one beyond it has. The capacity exceeds the partition's mass (all its n-grams) divided by the threshold, so no key loses
the threshold or more in total, and every n-gram that reaches it survives, in memory that does not depend on the number of
different n-grams. Keys that share their leading bits add up, which may save a rare n-gram but never loses a frequent one.

Second pass. Survivors become a bit map over the leading bits of keys. N-grams whose own bit and those of all their parts are set are
counted exactly, by their words; the map only decides which n-grams are looked at.

Keys have as many bits as the number of the corpus's bytes, so a key has less than one n-gram of noise on average at every size. The bit map has at most
2^MAP_BITS bits, so its size is bounded; when survivors fill it, the second pass looks at more n-grams and its result stays the same.

Words and pieces: A-Z lower-cased, texts split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words. A null text is
empty; the null language is ``und``. Ties are ordered by phrase. Repeated rows count each; texts are taken whole however long; an empty table
gives no rows; columns other than text and lang are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .shingles import mix

#: Words of the longest phrase, occurrences that make one frequent, phrases reported for a language.
LONGEST, THRESHOLD, BEST = 5, 100, 2000
#: N-grams that a task counts before it sends them on.
FLUSH = 1 << 23
#: Entries that a summary gathers, beyond its capacity, before it is cut.
GATHERED = 1 << 22
#: The bit map's size, as a power of two: 16 MB.
MAP_BITS = 27

_rng = np.random.default_rng(20250211)
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAPS = _ENDS.copy()
_GAPS[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ORDER = _rng.integers(1, 2**63, LONGEST, dtype=np.uint64) | np.uint64(1)
_WIDE = _rng.integers(1, 2**63, 9, dtype=np.uint64) | np.uint64(1)


def word_spans(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of text: where words begin and end, and the number of the piece that each lies in (rows are pieces of their own)."""
    n = len(body)
    gap = _GAPS[body]
    fresh = np.zeros(n + 1, bool)  # a row or a piece begins
    fresh[at] = True
    inside = ~gap
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | fresh[:n]))
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    fresh[1:] |= _ENDS[body]
    return starts, ends, np.cumsum(fresh[:n], dtype=np.int64)[starts]


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes, eight at a time."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    at_any = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(body) + 1, 8), (1, 1))
    size = ends - starts
    found = size.astype(np.uint64) * _WIDE[8]
    left, k, rows = size, 0, np.arange(len(starts))
    while len(rows):
        eight = np.ascontiguousarray(at_any[starts[rows] + 8 * k]).view(np.uint64).ravel()
        rest = np.minimum(left[rows] - 8 * k, 8).astype(np.uint64)
        eight &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
        found[rows] = mix(found[rows] * _WIDE[0] + eight)
        k += 1
        rows = rows[left[rows] > 8 * k]
    return found


def gram_hashes(words: np.ndarray, pieces: np.ndarray) -> list[np.ndarray]:
    """For each length from one: hashes of the n-grams that begin at each word, and a mask of those that stay in a piece, as pairs."""
    found = []
    rolled = words * _ORDER[0]
    for m in range(1, LONGEST + 1):
        n = max(0, len(words) - m + 1)
        if m > 1:
            rolled = rolled[:n] + words[m - 1 :][:n] * _ORDER[m - 1]
        found.append((mix(rolled + np.uint64(m)), pieces[:n] == pieces[m - 1 :][:n]))
    return found


def _varints(x: np.ndarray) -> bytes:
    """Unsigned integers, seven bits a byte, the lowest first; all but the last byte of each have the eighth bit."""
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >> np.uint64(7 * k) > 0
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(x) else 0, np.uint8)
    begins = ends - size
    rows = np.arange(len(x))
    for k in range(10):
        out[begins[rows] + k] = (x[rows] >> np.uint64(7 * k)).astype(np.uint8) & 127 | ((size[rows] > k + 1).astype(np.uint8) << 7)
        rows = rows[size[rows] > k + 1]
        if not len(rows):
            break
    return out.tobytes()


def _integers(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    size = ends - begins + 1
    out, rows = np.zeros(len(ends), np.uint64), np.arange(len(ends))
    for k in range(10):
        out[rows] |= (raw[begins[rows] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
        rows = rows[size[rows] > k + 1]
        if not len(rows):
            break
    return out


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each occurs."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.concatenate([first, [len(keys)]])).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class Summary:
    """A mergeable Misra-Gries summary: with a capacity over mass / threshold, no key loses the threshold."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._n += len(keys)
        if self._n > max(GATHERED, self.capacity):
            self.cut()

    def cut(self) -> None:
        every = [(self.keys, self.counts), *self._waiting]
        self._waiting, self._n = [], 0
        self.keys, self.counts = counted(np.concatenate([k for k, _ in every]), np.concatenate([c for _, c in every]))
        if len(self.keys) > self.capacity:
            # the largest count beyond the capacity: to lose it costs more than capacity counters as much each
            beyond = np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1]
            kept = self.counts > beyond
            self.keys, self.counts, self.lost = self.keys[kept], self.counts[kept] - beyond, self.lost + int(beyond)

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys whose count may reach the threshold."""
        self.cut()
        return self.keys[self.counts + self.lost >= threshold]


def _slices_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]]:
    """Slices of a batch (lang, text): lower-cased bytes, the words' begins, ends, pieces and rows, and the languages of the batch's rows."""
    langs = batch.column(0).dictionary_encode()
    body, at = frames.raw(frames.texts(batch.column(1)))
    for a, b in frames.slices(at):
        part = _LOWER[body[at[a] : at[b]]]
        offsets = at[a : b + 1] - at[a]
        starts, ends, pieces = word_spans(part, offsets)
        yield part, starts, ends, pieces, np.searchsorted(offsets, starts, side="right") - 1 + a, langs


def _language_seeds(langs: pa.DictionaryArray) -> np.ndarray:
    return np.array([zlib.crc32(name.encode()) for name in langs.dictionary.to_pylist()], np.uint64) * _WIDE[1]


def _keys_of(part, starts, ends, rows, langs, seeds) -> np.ndarray:
    return mix(word_hashes(part, starts, ends) ^ seeds[np.asarray(langs.indices)[rows]])


def summarise(rows: DataFrame, bits: int) -> DataFrame:
    """First pass: of the n-grams of (lang, text), for each hash partition, what a task has counted: a row of kind 0 with its mass, one of kind 1 with keys and counts."""
    parts = frames.pieces(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            keys, counts = counted(np.concatenate(held))
            held.clear()
            cuts = np.searchsorted(keys, _bounds(parts, bits))
            out = []
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b:
                    out.append((p, 0, int(counts[a:b].sum()), None, None))
                    out.append((p, 1, None, _varints(np.diff(keys[a:b], prepend=np.uint64(0))), _varints(counts[a:b].astype(np.uint64))))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["part", "kind", "mass", "keys", "counts"])

        n = 0
        for batch in batches:
            for part, starts, ends, pieces, at, langs in _slices_of(batch):
                for hashes, valid in gram_hashes(_keys_of(part, starts, ends, at, langs, _language_seeds(langs)), pieces):
                    held.append(hashes[valid] >> np.uint64(64 - bits))
                    n += len(held[-1])
                if n >= FLUSH:
                    yield sent()
                    n = 0
        if n:
            yield sent()

    return rows.mapInArrow(frames.tidy(run), "part int, kind int, mass long, keys binary, counts binary")


def _bounds(parts: int, bits: int) -> np.ndarray:
    """First keys of the hash partitions, and the end of the last."""
    return np.array([(p << bits) // parts for p in range(parts)] + [1 << bits], np.uint64)


def survivors(sent: DataFrame, bits: int, threshold: int) -> DataFrame:
    """Merges each hash partition: (base, bitmap, n), its slice of the bit map of keys that may be frequent, from byte ``base``."""
    parts = frames.pieces(sent.sparkSession)
    # the masses of a part come before its keys, so that its capacity is known before it merges
    dealt = sent.repartitionById(parts, "part").sortWithinPartitions("part", "kind")
    shift, bounds = np.uint64(max(0, bits - MAP_BITS)), _bounds(parts, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mass, summary = None, 0, None

        def result() -> pa.RecordBatch:
            at = (summary.survivors(threshold) >> shift).astype(np.int64)
            base = int(bounds[own] >> shift) >> 3
            bitmap = np.zeros((int(bounds[own + 1] >> shift) >> 3) - base + 1, np.uint8)
            np.bitwise_or.at(bitmap, (at >> 3) - base, (1 << (at & 7)).astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([base], pa.int64()), pa.array([zlib.compress(bitmap.tobytes(), 1)], pa.binary()), pa.array([len(at)], pa.int64())], names=["base", "bitmap", "n"])

        for batch in batches:
            for k in range(batch.num_rows):
                part, kind, more, keys, counts = (c[k].as_py() for c in batch.columns)
                if part != own:
                    if own is not None:
                        yield result()
                    own, mass, summary = part, 0, None
                if kind == 0:
                    mass += more
                else:
                    summary = summary or Summary(mass // threshold + 1)
                    summary.merge(np.cumsum(_integers(keys)), _integers(counts).astype(np.int64))
        if own is not None:
            yield result()

    return dealt.mapInArrow(frames.tidy(run), "base long, bitmap binary, n long")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD) -> DataFrame:
    """(lang, phrase, size, f): exact counts of every phrase of at most LONGEST words with at least ``threshold`` occurrences in its language.

    A row of size 0 and empty phrase has the number of all words of a language.
    """
    spark = docs.sparkSession
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), docs[text_col].alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(60, max(16, int(size).bit_length()))
    shift = max(0, bits - MAP_BITS)
    bitmap = np.zeros((1 << (bits - shift) >> 3) + 1, np.uint8)
    for r in survivors(summarise(rows, bits), bits, threshold).collect():  # slices of one bit map of bounded size
        own = np.frombuffer(zlib.decompress(r.bitmap), np.uint8)
        bitmap[r.base : r.base + len(own)] |= own
    parts = frames.pieces(spark)
    shared = spark.sparkContext.broadcast(zlib.compress(bitmap.tobytes(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        exact = Exact(parts)
        for batch in batches:
            for part, starts, ends, pieces, at, langs in _slices_of(batch):
                hashes = gram_hashes(_keys_of(part, starts, ends, at, langs, _language_seeds(langs)), pieces)
                alive = []
                for h, valid in hashes:
                    bit = (h >> np.uint64(64 - bits + shift)).astype(np.int64)
                    valid = valid & (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                    if alive:  # its first words and its last ones have to be alive
                        valid &= alive[-1][: len(valid)] & alive[-1][1 : len(valid) + 1]
                    alive.append(valid)
                exact.add(part, starts, ends, langs, at, alive)
                if exact.n >= FLUSH // 2:
                    yield from exact.flushed()
        yield from exact.flushed()

    local = rows.mapInArrow(frames.tidy(run), "part int, lang string, size int, phrases binary, counts binary")
    return frames.written(summed(local, threshold), "phrases")


def summed(local: DataFrame, threshold: int) -> DataFrame:
    """Sums what tasks have counted: a hash partition's phrases of one language and size at a time, of which those that reach the threshold are kept."""
    dealt = local.repartitionById(frames.pieces(local.sparkSession), "part").sortWithinPartitions("part", "lang", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = None, Counter()

        def result() -> Iterator[pa.RecordBatch]:
            _, lang, size = own
            kept = [(p, n) for p, n in found.items() if n >= threshold or size == 0]
            for a in range(0, len(kept), 1 << 16):
                some = kept[a : a + (1 << 16)]
                columns = [pa.array([lang] * len(some), pa.string()), pa.array([p.decode() for p, _ in some], pa.string()), pa.array([size] * len(some), pa.int32()), pa.array([n for _, n in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "f"])
            found.clear()

        for batch in batches:
            for part, lang, size, phrases, counts in zip(*[c.to_pylist() for c in batch.columns]):
                if (part, lang, size) != own:
                    if own is not None:
                        yield from result()
                    own = (part, lang, size)
                for phrase, n in zip(zlib.decompress(phrases).split(b"\n"), _integers(counts).tolist()):
                    found[phrase] += n
        if own is not None:
            yield from result()

    return dealt.mapInArrow(frames.tidy(run), "lang string, phrase string, size int, f long")


class Exact:
    """Counts of phrases by their words: every different word has a number, every phrase the numbers of its first words and of its last.

    What it has counted goes out by hash partition, language and size, as the phrases between line ends (no word holds one) and their counts.
    """

    def __init__(self, parts: int):
        self.parts = parts
        self.words: dict[tuple[str, bytes], int] = {}
        self.names: list[tuple[str, bytes]] = []
        self.slices: list[list[tuple[np.ndarray, ...]]] = []
        self.totals: dict[str, int] = {}
        self.n = 0

    def add(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: pa.DictionaryArray, rows: np.ndarray, alive: list[np.ndarray]) -> None:
        """Words of a slice, and for each length which of them begin a phrase to be counted."""
        kept = np.flatnonzero(alive[0])
        offsets = np.concatenate([[0], np.cumsum((ends - starts)[kept])])
        size = (ends - starts)[kept]
        body = part[np.repeat(starts[kept] - offsets[:-1], size) + np.arange(offsets[-1])]
        words = pa.Array.from_buffers(pa.large_binary(), len(kept), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
        names, at = langs.dictionary.to_pylist(), np.asarray(langs.indices)[rows]
        for name, n in zip(names, np.bincount(at, minlength=len(names)).tolist()):
            self.totals[name] = self.totals.get(name, 0) + n
        at = at[kept]
        pair = at.astype(np.int64) << 32 | np.asarray(words.indices)
        different, inverse = np.unique(pair, return_inverse=True)
        own = words.dictionary.to_pylist()
        known, before = self.words, len(self.names)
        numbers = np.empty(len(different), np.int64)
        for k, p in enumerate(different.tolist()):
            key = (names[p >> 32], own[p & 0xFFFFFFFF])
            if (number := known.get(key)) is None:
                number = known[key] = len(self.names)
                self.names.append(key)
            numbers[k] = number
        number = np.full(len(starts) + 1, -1, np.int64)
        number[kept] = numbers[inverse]
        self.slices.append((number, alive))
        self.n += len(starts) + len(self.names) - before

    def flushed(self) -> Iterator[pa.RecordBatch]:
        """Counts so far; then it starts anew."""
        if not self.slices:
            return
        yield self._batch([*self.totals], [b""] * len(self.totals), 0, [*self.totals.values()])
        words = np.concatenate([s[0] for s in self.slices])  # a -1 ends each slice
        ids = words
        for m in range(1, LONGEST + 1):
            begins = np.concatenate([np.concatenate([s[1][m - 1], np.zeros(len(s[0]) - len(s[1][m - 1]), bool)]) for s in self.slices])
            at = np.flatnonzero(begins)
            if m == 1:
                counts = np.bincount(words[at], minlength=len(self.names))
                texts = [w for _, w in self.names]
                owner = np.arange(len(self.names))
            else:
                pair = ids[at].astype(np.uint64) << np.uint64(32) | words[at + m - 1].astype(np.uint64)
                different, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
                first, last = (different >> np.uint64(32)).astype(np.int64), (different & np.uint64(0xFFFFFFFF)).astype(np.int64)
                texts = [texts[a] + b" " + self.names[b][1] for a, b in zip(first.tolist(), last.tolist())]
                owner = owner[first]
                ids = np.full(len(words), -1, np.int64)
                ids[at] = inverse
            langs = [self.names[k][0] for k in owner.tolist()]
            yield self._batch(langs, texts, m, counts.tolist())
        self.__init__(self.parts)

    def _batch(self, langs: list[str], phrases: list[bytes], size: int, counts: list[int]) -> pa.RecordBatch:
        cells: dict[tuple[int, str], tuple[list[bytes], list[int]]] = {}
        for lang, phrase, n in zip(langs, phrases, counts):
            cell = cells.setdefault((zlib.crc32(phrase) % self.parts, lang), ([], []))
            cell[0].append(phrase)
            cell[1].append(n)
        columns = [
            pa.array([p for p, _ in cells], pa.int32()), pa.array([g for _, g in cells], pa.string()), pa.array([size] * len(cells), pa.int32()),
            pa.array([zlib.compress(b"\n".join(t), 1) for t, _ in cells.values()], pa.binary()), pa.array([_varints(np.array(n, np.uint64)) for _, n in cells.values()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "lang", "size", "phrases", "counts"])


def collocations(counts: DataFrame, threshold: int = THRESHOLD, best: int = BEST) -> DataFrame:
    """From exact counts as of phrase_counts(): lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    Counts hold every part of every phrase, as a part is at least as frequent. A phrase that stands as often in a longer one is dropped;
    one with a word more is enough to look at, as what lies between has the same count.
    """
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    counts = counts.where("size > 0")
    ours = counts.where((F.col("size") > 1) & (F.col("f") >= threshold)).withColumnRenamed("f", "a")
    cut = lambda a, b: F.array_join(F.slice(F.split("phrase", " ", -1), a, b), " ")
    longer = ours.where("size > 2").select("lang", F.col("a").alias("within"), F.explode(F.array(cut(F.lit(1), F.col("size") - 1), cut(F.lit(2), F.col("size") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    kept = ours.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("within") < 100 * F.col("a"), F.lit(True))).drop("within")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("*", cut(F.lit(1), F.col("k")).alias("head"), cut(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    part = lambda key, f: counts.select(F.col("lang"), F.col("phrase").alias(key), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n")).withColumn("below", whole("l") * whole("r")).withColumn("score", F.expr("above div below"))
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    return collocations(phrase_counts(docs))


def oracle() -> str:
    """All n-grams by joins of neighbouring words, all cuts by joins of counts."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    phrase = "array_to_string(w[p : p + m - 1], ' ')"
    return f"""
    WITH pieces AS (
      SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w
      FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
    ), totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
    starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM pieces),
    counts AS (
      SELECT lang, m, {phrase} AS phrase, count(*) AS f FROM starts, range(1, {LONGEST + 1}) AS lengths(m) WHERE p + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {THRESHOLD}
    ), split AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS v FROM counts WHERE m > 1),
    longer AS (SELECT lang, unnest([array_to_string(v[1 : m - 1], ' '), array_to_string(v[2 : m], ' ')]) AS phrase, f AS within FROM split WHERE m > 2),
    kept AS (SELECT * FROM split s WHERE NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = s.lang AND o.phrase = s.phrase AND 100 * within >= 100 * f)),
    cuts AS (SELECT lang, m, phrase, f AS a, v, unnest(range(1, m)) AS k FROM kept),
    scored AS (
      SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, k, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(v[1 : k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(v[k + 1 : c.m], ' ') JOIN totals t ON t.lang = c.lang
    ), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= {BEST}
    """
