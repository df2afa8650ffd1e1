"""Token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch lie end to end in one array of symbols. In each round every
sequence finds its lowest-ranked adjacent pair and all sequences merge theirs at once;
sequences without a pair drop out. What survives are the tokens. Sequences longer than
``LONG`` symbols would need as many rounds and are merged with a heap instead.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import added, texts_of, tokenizer_file
from quarry.llm.pretokens import Memo, read_ranks, unique_pretokens
from quarry.llm.text import chunks

VOCABULARY, LONG = "byte_bpe_50k.tiktoken", 128
NONE = np.iinfo(np.int64).max


class Merges:
    """Ranks of pairs of symbols, in an open-addressed table of arrays."""

    def __init__(self, tokens: list[bytes]):
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for k, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = k
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        left, at = keys, self._home(keys)
        worth = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[at] == -1
            self.keys[at[free]], self.values[at[free]] = left[free], worth[free]
            stay = self.keys[at] != left
            left, worth, at = left[stay], worth[stay], (at[stay] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        ask = np.flatnonzero((found != keys) & (found != -1))
        at = at[ask]
        while len(ask):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[ask]
            out[ask[hit]] = self.values[at[hit]]
            more = ~hit & (found != -1)
            ask, at = ask[more], at[more]
        return out

    def long_count(self, piece: bytes) -> int:
        """Symbols left of one long piece: pairs in a heap, symbols in a linked list."""
        symbol = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := self.pairs.get(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if symbol[i] == a else n
            if j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j], left = r, -1, left - 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := self.pairs.get(symbol[x] << 32 | symbol[y])) is not None:
                    heapq.heappush(heap, (s, x, symbol[x], symbol[y]))
        return left

    def counts(self, pieces: list[bytes]) -> list[int]:
        """Numbers of tokens of all pieces."""
        sizes = np.fromiter((len(p) for p in pieces), np.int64, len(pieces))
        out = sizes.copy()
        for k in np.flatnonzero(sizes > LONG):
            out[k] = self.long_count(pieces[k])
        short = np.flatnonzero((sizes > 1) & (sizes <= LONG))
        symbol = self.byte[np.frombuffer(b"".join([pieces[k] for k in short]), np.uint8)]
        owner, length = short, sizes[short]
        while len(owner):
            end = np.cumsum(length)
            start = end - length
            rank = self.ranks(symbol, np.append(symbol[1:], 0))
            rank[end - 1] = NONE
            best = np.minimum.reduceat(rank, start)
            live = best != NONE
            out[owner[~live]] = length[~live]
            # The first place of the lowest rank in each live sequence.
            places = np.flatnonzero((rank == np.repeat(best, length)) & np.repeat(live, length))
            of = np.searchsorted(end, places, "right")
            places = places[np.concatenate(([True], of[1:] != of[:-1]))] if len(places) else places
            symbol[places] = rank[places]
            keep = np.repeat(live, length)
            keep[places + 1] = False
            symbol, owner, length = symbol[keep], owner[live], length[live] - 1
        return out.tolist()


@lru_cache(2)
def merges(path: str) -> tuple[Merges, Memo]:
    return Merges(read_ranks(path)), Memo()


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Numbers of tokens of texts."""
    table, memo = merges(path)
    out = np.zeros(len(texts), np.int64)
    for a, b in chunks(np.fromiter((len(t) for t in texts), np.int64, len(texts))):
        hashes, pieces, inverse, offsets = unique_pretokens(texts[a:b])
        each = np.array(memo.get(hashes, pieces, table.counts), np.int64)
        sums = np.concatenate(([0], np.cumsum(each[inverse]))) if len(inverse) else np.zeros(1, np.int64)
        out[a:b] = np.diff(sums[offsets])
    return out


def count_tokens(docs: DataFrame, text_col: str = "text", count_col: str = "n_tokens", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """``docs`` with the number of byte-level BPE tokens of each whole text.

    Null texts have null tokens, empty ones 0; strings of special tokens count as ordinary
    text. Repeated rows each get the same count. An empty table gives an empty table. Other
    columns are kept; one that is named like ``count_col`` is replaced.
    """
    path = tokenizer_file(vocabulary, folder)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        null = batch.column(batch.schema.get_field_index(text_col)).is_null().to_numpy(zero_copy_only=False)
        return [pa.array(count_texts(texts_of(batch, text_col), path), pa.int64(), mask=null)]

    if text_col.lower() == count_col.lower():
        raise ValueError("the count needs a column of its own")
    return added(docs, run, [(count_col, "bigint")])


def op6_token_counts(spark, sf_dir):
    """Token counts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).drop("text")


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE: dict[str, str] = {}
