"""Vectorised text primitives shared by the operators: chunking, word hashes, shingles.

Texts are joined into one byte buffer per chunk, and every word gets a 64-bit hash from
prefix sums of a polynomial, so that no Python code runs per word. A word is a maximal
run of letters and digits (lower case), or one wide East Asian character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_ROOT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ROOT, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes that belong to words: ASCII letters and digits, and all bytes of other scripts.
WORD_BYTE = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTE[_a:_b] = True
#: Leading bytes of East Asian characters, each of which is a word.
WIDE_BYTE = np.zeros(256, bool)
WIDE_BYTE[0xE3:0xEE] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over 64 bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, root in enumerate((_ROOT, _INVERSE)):
            steps = np.full(size, root, U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=U64)
    return _POWERS[0][:n], _POWERS[1][:n]


def chunks(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``most`` in all, single rows if larger."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans [start, end) of a uint8 buffer."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer of texts with a newline after each, and each text's start (and the end)."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), starts


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, offsets of each text's words (one more than texts), and byte spans."""
    data, starts = joined([t.lower() for t in texts])
    inside = WORD_BYTE[data]
    before = np.concatenate(([False], inside[:-1]))
    wide = WIDE_BYTE[data]
    last = np.concatenate((np.zeros(min(3, len(wide)), bool), wide[:-3]))
    first = np.flatnonzero(inside & (~before | wide | last))
    if not len(first):
        none = np.zeros(0, np.int64)
        return none.astype(U64), np.zeros(len(texts) + 1, np.int64), none, none
    stop = np.flatnonzero(~inside)
    end = np.minimum(stop[np.searchsorted(stop, first)], np.append(first[1:], len(data)))
    return span_hashes(data, first, end), np.searchsorted(first, starts), first, end


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words within texts; a shorter text has one run of all its words."""
    count = np.diff(offsets)
    number = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out = np.zeros(len(number) + 1, np.int64)
    np.cumsum(number, out=out[1:])
    if not out[-1]:
        return np.zeros(0, U64), out
    owner = np.repeat(np.arange(len(number)), number)
    at = np.arange(out[-1]) - out[owner] + offsets[owner]
    padded = np.concatenate((hashes, np.zeros(width, U64)))
    end = offsets[owner + 1]
    total = np.zeros(len(at), U64)
    for k in range(width):
        total = total * U64(_ROOT) + np.where(at + k < end, padded[at + k], U64(0))
    return mix(total), out
