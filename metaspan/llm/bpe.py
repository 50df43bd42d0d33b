"""Byte-level BPE by prefix dynamic programming.

For each prefix of a pre-token there is one last token of its encoding. A token t that ends
at byte i is that token exactly if t encodes alone to itself and the pair (last token of the
prefix before t, t) encodes to itself. Storing the last token of each prefix gives the encoding
by walking back, lets bytes be appended without touching what is stored, and lets an edit
re-encode from the edit on only.

Defined results: null text is the empty text (no ids; hashes of no bytes); special-token strings
are ordinary text; any length is encoded whole; repeated rows each get a row; an empty table gives none; other columns
are ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import frames
from .word_ids import PartCache

#: Pairs whose compatibility is remembered.
CACHE_PAIRS = 1_000_000


class PrefixEncoder:
    """Ranks (bytes -> id), the pattern that splits texts, and encodings of byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        self.split_of: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        n = max(self.bytes_of) + 1
        self.sizes = np.zeros(n, np.int64)
        self.sizes[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        self.size_of = self.sizes.tolist()
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), np.uint8)
        # All tokens that end at each byte, the longest first; one that its bytes do not encode to is never a last token.
        words = ahocorasick.Automaton()
        for b, i in ranks.items():
            if self.stands(i):
                words.add_word(b.decode("latin-1"), i)
        words.make_automaton()
        self.found = words.iter
        self.parts = PartCache(self._encode_parts, self._encode_whole)
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> PrefixEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merged(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first: the definition, for short strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def parts_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of the token's bytes joins; None for a byte or a token that its bytes do not encode to."""
        known = self.split_of.get(token, -1)
        if known == -1:
            piece = self.bytes_of[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self.split_of[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return known

    def stands(self, token: int) -> bool:
        """Whether the token's bytes encode to the token."""
        return len(self.bytes_of[token]) == 1 or self.parts_of(token) is not None

    def _edge(self, token: int, side: int) -> list[int]:
        """The token, its outer part on one side, that part's outer part, down to a byte."""
        known = self.edges[side].get(token)
        if known is None:
            known = [token]
            while (parts := self.parts_of(known[-1])) is not None:
                known.append(parts[side])
            self.edges[side][token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes encode to the two tokens.

        They do unless a merge across the border comes before the merges that use up the tokens on both of its
        sides. Going back in time, the younger of the two border tokens is undone; of equal ranks the left is
        merged first, so the right is younger.
        """
        key = (left << 32) | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        used_a = used_b = 1 << 60
        get, text, fits = self.ranks.get, self.bytes_of, True
        while True:
            across = get(text[a[i]] + text[b[j]])
            if across is not None and across < used_a and across <= used_b:
                fits = False
                break
            more_a, more_b = i + 1 < len(a), j + 1 < len(b)
            if more_b and (b[j] >= a[i] or not more_a):
                used_b, j = b[j], j + 1
            elif more_a:
                used_a, i = a[i], i + 1
            else:
                break
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def extend(self, last: list[int], piece: bytes) -> list[int]:
        """Fill ``last`` (last token of each non-empty prefix) from where it ends up to all of ``piece``."""
        done = len(last)
        look = max(0, done + 1 - self.longest)
        size, fits, known, add, at = self.size_of, self.fits, self.pairs.get, last.append, done
        for end, token in self.found((piece[look:] if look else piece).decode("latin-1")):
            end += look
            if end < at:
                continue
            begin = end - size[token]
            if begin == -1:
                add(token)
                at = end + 1
            elif begin >= 0:
                key = (last[begin] << 32) | token
                fit = known(key)
                if fit is None:
                    fit = fits(last[begin], token)
                if fit:
                    add(token)
                    at = end + 1
        return last

    def walk(self, last: list[int]) -> list[int]:
        ids, at, size = [], len(last) - 1, self.size_of
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= size[token]
        ids.reverse()
        return ids

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; one that is a token itself is that token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.extend([], piece))

    def _piece(self, piece: str) -> bytes:
        ids = self.piece(piece.encode())
        return pack(f"<{len(ids)}I", *ids)

    def _encode_whole(self, text: str) -> bytes:
        out = []
        for p in self.split(text):
            ids = self.pieces.get(p)
            if ids is None:
                ids = self._piece(p)
                if len(p) <= 64:
                    if len(self.pieces) >= 100_000:
                        self.pieces.clear()
                    self.pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        return [self._encode_whole(p) for p in parts]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.parts.ids(text), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for a in range(0, len(ids), 1 << 16):
            own = ids[a : a + (1 << 16)]
            sizes = self.sizes[own]
            shift = self.starts[own] - (np.cumsum(sizes) - sizes)
            out.append(self.blob[np.arange(sizes.sum()) + np.repeat(shift, sizes)].tobytes())
        return b"".join(out)


class Growing:
    """The encoding of one byte string that is appended to or edited."""

    def __init__(self, encoder: PrefixEncoder, piece: bytes = b""):
        self.encoder, self.piece = encoder, piece
        self.last = encoder.extend([], piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.encoder.extend(self.last, self.piece)

    def replace(self, begin: int, end: int, by: bytes) -> None:
        """Bytes begin..end become ``by``; what is stored for prefixes up to ``begin`` stays."""
        self.piece = self.piece[:begin] + by + self.piece[end:]
        del self.last[begin:]
        self.encoder.extend(self.last, self.piece)

    def ids(self) -> list[int]:
        return self.encoder.walk(self.last)


_ENCODERS: dict[tuple[str, str], PrefixEncoder] = {}


def _encoder(path: str, pattern: str) -> PrefixEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = PrefixEncoder.load(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row the number of ids, a hash of the ids, a hash of the bytes that they decode to and, if asked, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            counts, hashes, decoded, kept = [], [], [], []
            for text in frames.texts(batch.column(1)):
                ids = encoder.encode(text.as_py())
                counts.append(len(ids))
                hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids.astype(np.int32))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(frames.long_id(df, id_col).alias("doc_id"), df[text_col].alias("text")).mapInArrow(
        frames.tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    )
