"""Fast exact pre-splitting of texts for byte-level BPE, with a bounded cache.

A space before a non-space always begins a new pre-token, whatever stands before it. So a text
in which every space is followed by a non-space may be split at spaces, and the ids of the parts
may be cached and joined. Other texts take the slow, whole path.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_UNSAFE = re.compile(r" (?:\s|\Z)")
#: Parts kept in a worker's cache, in two generations, and the longest part that is kept.
CACHE_PARTS = 500_000
LONGEST_PART = 120


class PartCache:
    """Ids, as little-endian 32-bit bytes, of parts; ``encode`` and ``whole`` give those of a part and of a text."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], most: int = CACHE_PARTS):
        self.encode, self.whole, self.most = encode, whole, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if _UNSAFE.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        head = self.encode([first])[0] if first else b""
        found = list(map(self.young.get, rest))
        if None in found:
            missing = {p for p, ids in zip(rest, found) if ids is None}
            known = {p: ids for p in missing if (ids := self.old.get(p)) is not None}
            new = [p for p in missing if p not in known]
            known.update(zip(new, self.encode([" " + p for p in new])))
            found = [known[p] if ids is None else ids for p, ids in zip(rest, found)]
            if len(self.young) > self.most:
                self.old, self.young = self.young, {}
            self.young.update((p, ids) for p, ids in known.items() if len(p) <= LONGEST_PART)
        return head + b"".join(found)
