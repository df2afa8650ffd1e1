"""Vectorised pre-tokenisation of byte-level BPE, and byte tables of a vocabulary.

The split is that of the public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, found from runs of character classes in arrays.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np

from quarry.llm.text import span_hashes

OTHER, LETTER, NUMBER, SPACE = range(4)
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CONTRACTED = {ord(c): 1 for c in "sdmt"}
_PAIRS = [(ord("l"), ord("l")), (ord("v"), ord("e")), (ord("r"), ord("e"))]


@lru_cache(1)
def classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[_SPACES] = SPACE
    return table


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, byte spans of all pre-tokens, and offsets of each text's pre-tokens."""
    whole = "".join(texts)
    data = np.frombuffer(whole.encode("utf-8"), np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    n = int(at[-1])
    none = np.zeros(0, np.int64)
    if not n:
        return data, none, none, np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    fresh = np.zeros(n + 1, bool)  # starts of texts
    fresh[at] = True
    cut = np.ones(n + 1, bool)  # starts of runs, then of pre-tokens
    cut[1:n] = kind[1:] != kind[:-1]
    cut |= fresh
    runs = np.flatnonzero(cut)
    start, end = runs[:-1], runs[1:]
    spaces = kind[start] == SPACE
    led = spaces & ~fresh[end]  # white space before something else in the same text
    last = end[led] - 1
    cut[last] = True
    cut[end[led]] = points[last] != 32
    # A lone apostrophe that isn't led by a blank, before letters of the same text.
    lone = start[(end - start == 1) & (points[start] == 39) & ~fresh[end]]
    lone = lone[cut[lone]]
    lone = lone[kind[lone + 1] == LETTER]
    if len(lone):
        first = points[lone + 1]
        second = np.where(lone + 2 < n, points[np.minimum(lone + 2, n - 1)], 0)
        second = np.where(fresh[np.minimum(lone + 2, n)], 0, second)
        one = np.isin(first, list(_CONTRACTED))
        two = np.zeros(len(lone), bool)
        for a, b in _PAIRS:
            two |= (first == a) & (second == b)
        cut[lone[one | two] + 1] = False
        cut[lone[one] + 2] = True
        cut[lone[two] + 3] = True
    places = np.flatnonzero(cut)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=byte_at[1:])
    spans = byte_at[places]
    return data, spans[:-1], spans[1:], np.searchsorted(places, at)


def unique_pretokens(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Hashes and bytes of distinct pre-tokens, the place of each pre-token among them, and offsets by text."""
    data, start, end, offsets = pretokens(texts)
    if not len(start):
        return np.zeros(0, np.uint64), [], start, offsets
    hashes, first, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    raw = data.tobytes()
    return hashes, [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], inverse, offsets


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a vocabulary file by rank; ranks run from 0 without gaps."""
    out: dict[int, bytes] = {}
    with open(path, "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                out[int(rank)] = base64.b64decode(token)
    if sorted(out) != list(range(len(out))):
        raise ValueError("ranks of the vocabulary have gaps")
    return [out[k] for k in range(len(out))]


class Memo:
    """Values by hash of a pre-token; emptied when it holds too many."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.known = most, {}

    def get(self, hashes: np.ndarray, pieces: list[bytes], make) -> list:
        """Values of all pieces; ``make`` gets those that aren't known."""
        if len(self.known) > self.most:
            self.known = {}
        known, keys = self.known, hashes.tolist()
        new = [k for k, h in enumerate(keys) if h not in known]
        if new:
            known.update(zip((keys[k] for k in new), make([pieces[k] for k in new]), strict=True))
        return [known[h] for h in keys]
