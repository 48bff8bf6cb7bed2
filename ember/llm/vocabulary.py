"""Vocabulary files of byte-level BPE tokenizers and the merge of one string."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import regex

#: Unicode white space, as the vocabulary files' ``\\s`` has it.
WHITE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """Printable stand-in of every byte: itself if printable, else 256 + n."""
    shown = [b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


@dataclass
class Vocabulary:
    """Ids of pieces, ranked merges ``(left, right) -> (rank, merged)`` and special strings."""

    ids: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    specials: dict[str, int]
    first: list[int]
    last: list[int]

    def special_pattern(self):
        names = sorted(self.specials, key=len, reverse=True)
        return regex.compile("(" + "|".join(regex.escape(n) for n in names) + ")") if names else None

    def symbols(self, data: bytes) -> list[int]:
        out = [self.first[b] for b in data]
        if out:
            out[-1] = self.last[data[-1]]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        return merged(self.symbols(text.encode("utf-8")), self.merges)

    def pieces(self) -> list[tuple[int, str]]:
        return sorted((i, p) for p, i in {**self.ids, **self.specials}.items())


def read_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file; its size is fixed, so it is parsed on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
    symbols = byte_symbols()
    return Vocabulary(
        ids, merges, {t["content"]: t["id"] for t in spec["added_tokens"]}, [ids[s] for s in symbols], [ids[s + suffix] for s in symbols]
    )


def merged(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges by rank, leftmost first.

    Short strings rescan the pairs; long ones use a heap over a linked list, so
    a word of any length takes ``n log n`` steps.
    """
    if len(symbols) > 40:
        return _merged_long(symbols, merges)
    while len(symbols) > 1:
        best, at, new = None, 0, 0
        left = symbols[0]
        for i in range(1, len(symbols)):
            right = symbols[i]
            found = merges.get((left, right))
            if found is not None and (best is None or found[0] < best):
                best, at, new = found[0], i - 1, found[1]
            left = right
        if best is None:
            break
        symbols[at : at + 2] = [new]
    return symbols


def _merged_long(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    n = len(symbols)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (found := merges.get((symbols[i], symbols[j]))):
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if not live[i] or j >= n or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i], live[j] = new, False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            push(before[i])
        push(i)
    return [s for s, kept in zip(symbols, live, strict=True) if kept]
