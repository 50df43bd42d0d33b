"""Secret scan through a trigram inverted index.

Each rule's regex is parsed and reduced to a Boolean query over trigrams that every
match must contain: an AND of groups, a group being an OR of literals, a literal an AND
of its trigrams. A batch of documents gets an inverted index (trigram -> rows) of the
trigrams that occur in queries; posting lists are united and intersected, and only the
candidate rows are verified by the regex. A rule without mandatory trigrams scans all rows.
The index is local to a batch, so nothing is shuffled and no posting list grows with the corpus.

Defined results: null text is the empty text (no spans); matches are leftmost and
non-overlapping per kind; offsets count code points, the end is exclusive; repeated rows each
get a row; an empty table gives none; other columns are ignored whatever their names; matches of several kinds at one place all
count, in the order of the kinds; texts are scanned whole whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames

#: Literals that a group may grow to before it is closed.
MOST_LITERALS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    #: Says whether a match counts; one that does not is dropped, its text stays used.
    holds: Callable[[re.Match], bool] = lambda m: True


BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE, lambda m: m.end(2) - m.start(2) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, lambda m: m.end() - m.start() >= 18),
    Rule("hex", r"[0-9a-f]+", re.ASCII, lambda m: m.end() - m.start() >= 16),
)
#: Formats that are secrets by themselves.
MORE_RULES = (
    # to the END line, or without one to the end of the headers and base64 lines; line ends may be escaped
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*-----END [A-Z ]{0,24}PRIVATE KEY-----"
        r"|(?:\s*(?:Proc-Type|DEK-Info):[^\n]*)*(?:(?:\s|\\[rn])*[A-Za-z0-9+/=]{20,})*(?:(?:\s|\\[rn])*[A-Za-z0-9+/]+={1,2})?)",
    ),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str, flags: int = 0) -> list[frozenset[str]]:
    """Groups of lower-case literals; a match contains one literal of each group. Empty: no mandatory trigram."""
    groups: list[frozenset[str]] = []
    run = {""}

    def close() -> None:
        nonlocal run
        if min(map(len, run)) >= 3:
            groups.append(frozenset(s for s in run if not any(o != s and o in s for o in run)))
        run = {""}

    def exact(items) -> set[str] | None:
        """All strings that the items match, if these are few."""
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                more = {chr(arg)}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                more = {chr(a) for _, a in arg}
            elif op is sre.SUBPATTERN:
                more = exact(arg[-1])
            elif op is sre.BRANCH:
                parts = [exact(x) for x in arg[1]]
                more = None if any(p is None for p in parts) else set().union(*parts)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
                more = exact(arg[2])
                more = None if more is None else more | {""}
            else:
                more = None
            if more is None or len(out) * len(more) > MOST_LITERALS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items) -> None:
        nonlocal run
        for item in items:
            op, arg = item
            strings = exact([item])
            if strings is not None:
                strings = {s.lower() for s in strings}
                if len(run) * len(strings) <= MOST_LITERALS:
                    run = {a + b for a in run for b in strings}
                else:
                    close()
                    run = strings
                continue
            close()
            if op is sre.SUBPATTERN:
                walk(arg[-1])
                close()
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
                close()

    walk(sre_parser.parse(pattern, flags))
    close()
    return groups


class Scanner:
    """Rules with their compiled regexes and queries, and the index of a batch."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.regexes = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        grams = sorted({s[i : i + 3] for q in self.queries for g in q for s in g for i in range(len(s) - 2)})
        self.grams = {g.encode(): i for i, g in enumerate(grams) if g.isascii()}
        self.codes = np.array(sorted((g[0] << 16) | (g[1] << 8) | g[2] for g in self.grams), dtype=np.uint32)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self._short(self.codes >> 16, (self.codes >> 8) & 255, self.codes & 255)] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    @staticmethod
    def _short(a, b, c):
        return ((a.astype(np.uint16) * np.uint16(31321)) ^ (b.astype(np.uint16) * np.uint16(7919)) ^ (c.astype(np.uint16) * np.uint16(257))).astype(np.uint16)

    def index(self, body: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
        """Trigram code -> ascending row numbers of the batch, for trigrams that queries use."""
        low = self.lower[body]
        if len(low) < 3:
            return {}
        near = np.flatnonzero(self.maybe[self._short(low[:-2], low[1:-1], low[2:])])
        code = (low[near].astype(np.uint32) << 16) | (low[near + 1].astype(np.uint32) << 8) | low[near + 2]
        hit = np.isin(code, self.codes)
        near, code = near[hit], code[hit]
        row = np.searchsorted(at, near, side="right") - 1
        inside = near + 2 < at[row + 1]
        code, row = code[inside], row[inside]
        return {int(c): np.unique(row[code == c]) for c in np.unique(code)}

    def candidates(self, rule: int, postings: dict[int, np.ndarray], rows: int) -> np.ndarray:
        query = self.queries[rule]
        found = np.arange(rows)
        nothing = np.zeros(0, np.int64)
        for group in query:
            either = nothing
            for literal in group:
                both = None
                for i in range(len(literal) - 2):
                    g = literal[i : i + 3].encode()
                    if len(g) != 3:
                        continue
                    p = postings.get((g[0] << 16) | (g[1] << 8) | g[2], nothing)
                    both = p if both is None else np.intersect1d(both, p, assume_unique=True)
                either = np.union1d(either, found if both is None else both)
            found = np.intersect1d(found, either, assume_unique=True)
        return found

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, str]]]:
        """Per row the (start, end, kind) spans by start, then kind in the rules' order."""
        body, at = frames.raw(column)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        for a, b in frames.slices(at):
            local = at[a : b + 1] - at[a]
            postings = self.index(body[at[a] : at[b]], local)
            strings: dict[int, str] = {}
            for k, regex in enumerate(self.regexes):
                holds = self.rules[k].holds
                for row in self.candidates(k, postings, b - a).tolist():
                    text = strings.get(row)
                    if text is None:
                        text = strings[row] = column[a + row].as_py()
                    own = spans[a + row]
                    for m in regex.finditer(text):
                        if holds(m):
                            own.append((m.start(), k, m.end()))
        return [[(s, e, self.rules[k].kind) for s, k, e in sorted(own)] for own in spans]


_SCANNERS: dict[int, Scanner] = {}


def _scanner(base_only: bool) -> Scanner:
    if base_only not in _SCANNERS:
        _SCANNERS[base_only] = Scanner(BASE_RULES if base_only else RULES)
    return _SCANNERS[base_only]


def _joined(spans: list[tuple[int, int, str]], kinds: set[str] | None = None) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans if kinds is None or k in kinds)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by a mark that names its kind."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind} removed]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, counts of the base kinds, a hash of the base spans, all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, base = _scanner(False), {r.kind for r in BASE_RULES}
        for batch in batches:
            found = scanner.scan(frames.texts(batch.column(1)))
            count = lambda kind: pa.array([sum(k == kind for _, _, k in x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), count("assign"), count("access"), count("hex"),
                    pa.array([hashlib.sha256(_joined(x, base).encode()).hexdigest() for x in found], pa.string()),
                    pa.array([_joined(x) for x in found], pa.string()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return df.select(frames.long_id(df, id_col).alias("doc_id"), df[text_col].alias("text")).mapInArrow(
        frames.tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``df``, same columns, with secrets in the text replaced; null texts stay null."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(False)
        for batch in batches:
            column = batch.column(text_col)
            found = scanner.scan(frames.texts(column))
            clean = [t if not s or t is None else redacted(t, s) for t, s in zip(column.to_pylist(), found)]
            arrays = {n: batch.column(n) for n in names}
            arrays[text_col] = pa.array(clean, pa.string())
            if length_col in arrays:
                arrays[length_col] = pa.array([len(t) if s and t is not None else n for t, s, n in zip(clean, found, batch.column(length_col).to_pylist())], batch.column(length_col).type)
            yield pa.RecordBatch.from_arrays([arrays[n] for n in names], names=names)

    return df.mapInArrow(frames.tidy(run), df.schema)
