"""Byte-level BPE through sentencepiece: encoding of pre-tokens and decoding by inverse mapping.

The vocabulary is written out as a sentencepiece model: each token's bytes are mapped to
printable characters, its score is its negative rank, normalisation is the identity, and
white space isn't treated specially. Merging by highest score then is merging by lowest
rank. Distinct pre-tokens of a chunk are encoded once.
"""

from __future__ import annotations

import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quarry.llm.common import added, texts_of, tokenizer_file
from quarry.llm.pretokens import Memo, read_ranks, unique_pretokens
from quarry.llm.text import chunks

VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(1)
def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable, else one above 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _integer(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised BPE model whose ids are the ranks; the unknown piece comes last."""
    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _message(1, _message(1, piece) + b"\x15" + struct.pack("<f", -rank) + _integer(3, 1))
    out += _message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", -len(tokens)) + _integer(3, 2))
    trainer = _integer(3, 2) + _integer(4, len(tokens) + 1) + _integer(40, len(tokens))
    out += _message(2, trainer + _integer(41, -1) + _integer(42, -1) + _integer(43, -1))
    out += _message(3, _message(1, b"identity") + _integer(3, 0) + _integer(4, 0) + _integer(5, 0))
    return bytes(out)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str):
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.memo = Memo(300_000)

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as the bytes of 32-bit numbers, which take far less memory than lists."""
        return [array("i", ids).tobytes() for ids in self.model.encode([p.decode("latin-1").translate(self.letters) for p in pieces], num_threads=1)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and offsets by text."""
        hashes, pieces, inverse, offsets = unique_pretokens(texts)
        if not len(inverse):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        lists = self.memo.get(hashes, pieces, self._pieces)
        size = np.fromiter((len(x) // 4 for x in lists), np.int64, len(lists))
        flat = np.frombuffer(b"".join(lists), np.int32)
        sums = np.concatenate(([0], np.cumsum(size[inverse])))
        return flat[ragged((np.cumsum(size) - size)[inverse], size[inverse])], sums[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Bytes of each row of ids."""
        size = self.size[ids]
        raw = self.bytes[ragged(self.start[ids], size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[offsets].tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the spans, on end."""
    if not len(size):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(start - (ends - size), size)


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter((len(t) for t in texts), np.int64, len(texts))


def encode_documents(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", check_col: str | None = "round_trip", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each whole text, and whether decoding them gives the text again.

    Null texts have null ids and a null check, empty ones an empty list. Strings of special
    tokens are ordinary text. Repeated rows get the same ids. An empty table gives an empty
    table. Other columns are kept; those named like the new ones are replaced.
    check_col=None leaves the check out.
    """
    path = tokenizer_file(vocabulary, folder)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        null = batch.column(batch.schema.get_field_index(text_col)).is_null().to_numpy(zero_copy_only=False)
        texts, tool = texts_of(batch, text_col), codec(path)
        parts, counts, same = [], [np.zeros(1, np.int64)], []
        for a, b in chunks(_lengths(texts), 1 << 18):
            ids, offsets = tool.encode(texts[a:b])
            parts.append(ids)
            counts.append(np.diff(offsets))
            if check_col:
                same += [x == t.encode() for x, t in zip(tool.decode(ids, offsets), texts[a:b], strict=True)]
        offsets = pa.array(np.cumsum(np.concatenate(counts)), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()), mask=pa.array(null))
        return [lists] + ([pa.array(same, pa.bool_(), mask=null)] if check_col else [])

    names = [(ids_col, "array<int>")] + ([(check_col, "boolean")] if check_col else [])
    if text_col.lower() in {n.lower() for n, _ in names}:
        raise ValueError("the ids need a column of their own")
    return added(docs, run, names)


def decode_documents(df: DataFrame, ids_col: str = "token_ids", text_col: str = "decoded", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """``df`` with the text that each list of ids stands for.

    Null lists give null, empty ones "". Ids out of range or null within a list make the row
    null; bytes that aren't UTF-8 become replacement characters. Other columns are kept; one
    named like ``text_col`` is replaced.
    """
    path = tokenizer_file(vocabulary, folder)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        tool, out = codec(path), []
        for row in batch.column(batch.schema.get_field_index(ids_col)):
            ids = None if not row.is_valid else row.values.to_numpy(zero_copy_only=False)
            if ids is None or row.values.null_count or (len(ids) and (ids.min() < 0 or ids.max() >= len(tool.size))):
                out.append(None)
            else:
                out.append(tool.decode(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace"))
        return [pa.array(out, pa.string())]

    return added(df, run, [(text_col, "string")])


def op7_bpe(spark, sf_dir):
    """Token ids of all documents, each checked by decoding."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs).drop("text")


QUERIES = {"op7_bpe": op7_bpe}
ORACLE: dict[str, str] = {}
