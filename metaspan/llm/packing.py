"""Bounded-space online packing of tokenised documents into sequences.

Each partition keeps a fixed number of open windows. A document is cut into full sequences and
a rest; the rest goes to the window that it fills best, or to a new window; if none fits and all
windows are open, the fullest is emitted. What is open at the end of the partitions is merged between
neighbouring partitions: best fit again, and what is still not full is laid end to end and cut.

Defined results: null text is the empty text, whose document is the end id alone; ids are cut
anywhere; every id lies in one piece; repeated rows are packed each, so that their pieces share doc_id and start; an empty table gives no pieces; very long texts
are packed whole; of windows with equal room the older is filled, of equally full ones the older is closed; other columns are ignored
whatever their names. sequence_id is unique, not dense.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

#: Ids of a sequence, windows that a partition keeps open, neighbouring partitions whose rests are merged.
LENGTH, WINDOWS, MERGED = 2048, 64, 8
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids as ``tokenizers`` gives them for the file with add_special_tokens=False: nothing is added, and strings of
    the file's added tokens in a text are those tokens.

    If the file is plain byte-level BPE whose ids are in the order of its merges, ids and ranks are the same thing
    and the faster tiktoken gives the same ids for texts without such strings; any other file or text is left to tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(Path(path).read_text())
        added = [re.escape(t["content"]) for t in file.get("added_tokens") or ()]
        self.added = re.compile("|".join(added), re.I) if added else None
        self.ranked = self._ranked(file)

    @staticmethod
    def _ranked(file: dict):
        model, byte_of = file["model"], _byte_of()
        pre = file.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or file.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if len(model["vocab"]) != 256 + len(merges) or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.ranked is not None and not (self.added and self.added.search(text)):
            return self.ranked.encode_to_numpy(text, disallowed_special=()).tobytes()
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)


class Windows:
    """Open windows by free space. ``put`` returns the windows that it closes."""

    def __init__(self, most: int, length: int = LENGTH):
        self.most, self.length, self.number = most, length, 0
        self.free: list[tuple[int, int]] = []  # (free ids, number), ascending
        self.held: dict[int, list] = {}

    def put(self, size: int, item) -> list[tuple[int, list]]:
        closed = []
        i = bisect_left(self.free, (size, -1))
        if i < len(self.free):
            free, number = self.free.pop(i)
        else:
            if len(self.free) >= self.most:
                closed.append(self._close(*self.free.pop(0)))
            self.number += 1
            free, number = self.length, self.number
            self.held[number] = []
        self.held[number].append((self.length - free, item))
        if free == size:
            closed.append(self._close(0, number))
        else:
            insort(self.free, (free - size, number))
        return closed

    def _close(self, free: int, number: int) -> tuple[int, list]:
        return number, self.held.pop(number)

    def rest(self) -> list[tuple[int, list]]:
        out = [self._close(*x) for x in self.free]
        self.free = []
        return out


_TOKENS: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def pack_documents(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = LENGTH, windows: int = WINDOWS, with_ids: bool = False
) -> DataFrame:
    """One row per piece; with_ids adds the piece's ids."""
    schema = PIECE + ", ids binary" * with_ids

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = _tokens(tokenizer_path), TaskContext.get().partitionId()
        open_windows, full, end = Windows(windows, length), 0, pack("<I", end_id)
        rows: list[tuple] = []

        def emit(number: int, held: list, is_open: bool) -> None:
            rows.extend((*piece[:5], (part << 32) | number, offset, is_open, part, piece[5] if is_open or with_ids else None) for offset, piece in held)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names=names)
            rows.clear()
            return out

        types = [*[pa.int64()] * 7, pa.bool_(), pa.int32(), pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "is_open", "part", "ids"]
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), frames.texts(batch.column(1))):
                ids = tokens.ids(text.as_py()) + end
                total = len(ids) // 4
                for at in range(0, total, length):
                    own = ids[4 * at : 4 * (at + length)]
                    piece = (doc_id, at, len(own) // 4, zlib.crc32(own), total, own)
                    if piece[2] == length:
                        full += 1
                        emit((1 << 31) + full, [(0, piece)], False)
                    else:
                        for number, held in open_windows.put(piece[2], piece):
                            emit(number, held, False)
            if rows:
                yield flush()
        for number, held in open_windows.rest():
            emit(number, held, True)
        if rows:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        window, begins = np.unique(table["sequence_id"].to_numpy(), return_index=True)
        held_rows = np.split(np.arange(len(table)), begins[1:])
        lengths, rows = table["length"].to_numpy(), table.to_pylist()
        merged = Windows(len(window) + 1, length)
        sizes = np.array([lengths[r].sum() for r in held_rows])
        closed = [w for i in np.argsort(-sizes, kind="stable").tolist() for w in merged.put(int(sizes[i]), i)]
        group, out, number = int(rows[0]["part"]) // MERGED, [], 0

        def put(row: dict, ids: bytes, start: int, at: int) -> None:
            out.append(row | {"start": start, "length": len(ids) // 4, "ids_crc32": zlib.crc32(ids), "sequence_id": (1 << 62) | (group << 32) | number, "offset": at, "ids": ids})

        for _, held in closed:
            number, at = number + 1, 0
            for _, i in held:
                for r in held_rows[i].tolist():
                    put(rows[r], rows[r]["ids"], rows[r]["start"], at)
                    at += rows[r]["length"]
        number, at = number + 1, 0
        for _, held in merged.rest():
            for _, i in held:
                for r in held_rows[i].tolist():
                    row, ids, start = rows[r], rows[r]["ids"], rows[r]["start"]
                    while ids:
                        own = ids[: 4 * (length - at)]
                        put(row, own, start, at)
                        ids, start, at = ids[len(own) :], start + len(own) // 4, at + len(own) // 4
                        if at == length:
                            number, at = number + 1, 0
        return pa.Table.from_pylist(out, schema=table.schema).select(columns)

    columns = [c.split()[0] for c in schema.split(", ")]
    first = PIECE + ", is_open boolean, part int, ids binary"
    packed = frames.written(df.select(frames.long_id(df, id_col).alias("doc_id"), df[text_col].alias("text")).mapInArrow(frames.tidy(pieces_of), first), "packed")
    done = packed.where(~F.col("is_open")).select(*columns)
    rests = packed.where("is_open").groupBy(F.floor(F.col("part") / MERGED).alias("near")).applyInArrow(merge, schema)
    return done.unionByName(rests)
