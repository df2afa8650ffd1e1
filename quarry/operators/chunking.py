"""From documents to chunks: token windows built in, packing of units through Arrow."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quarry.functions.text import let, words


def token_windows(text: Column | str, size: int = 450, overlap: int = 50) -> Column:
    """Arrays of at most ``size`` words that start every ``size - overlap`` words; a short text is one."""
    step = size - overlap
    last = lambda w: F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step).cast("int"))
    cut = lambda w: F.transform(F.sequence(F.lit(0), last(w)), lambda i: F.slice(w, i * step + 1, size))
    return let(words(text), lambda w: F.when(F.size(w) > 0, cut(w)).otherwise(F.array().cast("array<array<string>>")))


def expand_tokens(df: DataFrame, text_col: str, size: int = 450, overlap: int = 50) -> DataFrame:
    """A row for each window: chunk_id, chunk, total_chunks, original_tokens, chunk_tokens."""
    made = df.withColumn("_chunks", token_windows(text_col, size, overlap))
    return made.select(*df.columns, F.posexplode("_chunks").alias("chunk_id", "_c"), F.size("_chunks").alias("total_chunks"), F.size(words(text_col)).alias("original_tokens")).withColumns(
        {"chunk": F.array_join("_c", " "), "chunk_tokens": F.size("_c")}
    ).drop("_c")


def expand_pairs(df: DataFrame, source: str, target: str, size: int = 450, overlap: int = 50) -> DataFrame:
    """Each source window with the target's window of the same number, or its last."""
    made = df.withColumns({"_s": token_windows(source, size, overlap), "_t": token_windows(target, size, overlap)})
    out = made.select(*df.columns, "_t", F.posexplode("_s").alias("chunk_id", "_c"), F.size("_s").alias("total_chunks"))
    mate = F.when(F.size("_t") > 0, F.array_join(F.element_at("_t", F.least(F.col("chunk_id") + 1, F.size("_t"))), " ")).otherwise("")
    return out.withColumns({"source_chunk": F.array_join("_c", " "), "target_chunk": mate}).drop("_c", "_t")


def _count(text: str) -> int:
    return len(text.split())


def split_sentences(text: str, keep_tail: bool = True) -> list[str]:
    ends = [0, *(m.end() for m in re.finditer(r"[.!?]\s+", text))]  # one pass, also where no sentence ends
    parts, tail = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)], text[ends[-1] :]
    found = [p.strip() for p in parts + ([tail] if keep_tail else []) if _count(p) >= 3]
    return found or ([text] if text.strip() else [])


def pack(text: str, most: int = 400, least_words: int = 5, keep_tail: bool = True) -> list[str]:
    """Paragraphs packed greedily into chunks of at most ``most`` words; the last unit of a chunk of several is carried on.

    A paragraph that is too long is packed by sentences, a sentence that is too long by words.
    """
    if not text or not text.strip():
        return []
    if _count(text) <= most:
        return [text]
    units: list[tuple[str, int]] = []
    for p in [q.strip() for q in re.split(r"\n\s*\n+", text) if _count(q) >= least_words] or [text]:
        for s in [p] if _count(p) <= most else split_sentences(p, keep_tail):
            w = s.split()
            units += [(s, len(w))] if len(w) <= most else [(" ".join(w[k : k + most]), len(w[k : k + most])) for k in range(0, len(w), most)]
    chunks, held, size = [], [], 0
    for u in units:
        if held and size + u[1] > most:
            chunks.append(" ".join(s for s, _ in held))
            held = held[-1:] if len(held) > 1 and held[-1][1] + u[1] <= most else []
            size = sum(n for _, n in held)
        held.append(u)
        size += u[1]
    return chunks + ([" ".join(s for s, _ in held)] if held else [])


def pack_semantic(text: str, most: int = 400, overlap: int = 50) -> list[str]:
    """Sentences packed to ``most`` words; each chunk begins with the last sentences of the one before, up to ``overlap`` words."""
    units = [s for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]
    chunks, held, size = [], [], 0
    for u in units:
        n = _count(u)
        if held and size + n > most:
            chunks.append(" ".join(held))
            back, total = [], 0
            for s in reversed(held):
                if total + _count(s) > min(overlap, most - n):
                    break
                back.insert(0, s)
                total += _count(s)
            held, size = back, total
        held.append(u)
        size += n
    return chunks + ([" ".join(held)] if held else [])


def split_recursive(text: str, most: int = 400, overlap: int = 50, marks: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Splits at the coarsest mark that occurs and joins parts up to ``most`` characters, carrying up to ``overlap``."""
    if len(text) <= most:
        return [text] if text.strip() else []
    mark = next((m for m in marks if m in text), "")
    parts = text.split(mark) if mark else [text[k : k + most] for k in range(0, len(text), most)]
    rest = marks[marks.index(mark) + 1 :] if mark else ()
    out, held, size = [], [], 0  # size: characters of what is held, with the marks between
    for p in parts:
        if len(p) > most:
            out += [mark.join(held)] if held else []
            held, size = [], 0
            out += split_recursive(p, most, overlap, rest)
            continue
        if held and size + len(mark) + len(p) > most:
            out.append(mark.join(held))
            gone = 0
            while gone < len(held) and (size > overlap or size + len(mark) + len(p) > most):
                gone += 1
                size -= len(held[gone - 1]) + (len(mark) if gone < len(held) else 0)
            held = held[gone:]
        size += len(p) + (len(mark) if held else 0)
        held.append(p)
    return [c for c in out + ([mark.join(held)] if held else []) if c.strip()]


def _slices(batch: pa.RecordBatch, col: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of some ``most`` bytes of text or one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[col]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def chunked(df: DataFrame, text_col: str, how: str = "paragraphs", keep_text: bool = True, **options) -> DataFrame:
    """A row for each chunk (chunk_id, chunk) by "paragraphs", "semantic" or "recursive" packing; Python holds the chunks of about a megabyte of text at a time."""
    function = {"paragraphs": pack, "semantic": pack_semantic, "recursive": split_recursive}[how]
    kept = [c for c in df.columns if keep_text or c != text_col]
    schema = StructType([*[df.schema[c] for c in kept], StructField("chunk_id", IntegerType(), False), StructField("chunk", StringType())])

    def run(batches):
        for batch in batches:
            for part in _slices(batch, text_col):
                made = [function(t or "", **options) for t in part[text_col].to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]), pa.int64())
                ids = pa.array([k for m in made for k in range(len(m))], pa.int32())
                yield pa.RecordBatch.from_arrays([*(part[c].take(owner) for c in kept), ids, pa.array([c for m in made for c in m], pa.string())], names=[*kept, "chunk_id", "chunk"])

    return df.mapInArrow(run, schema)


def merged(df: DataFrame, keys: list[str], index: str, chunk: str, first_only: bool = False) -> DataFrame:
    """One text for each parent: its first chunk, or all in order."""
    if first_only:
        return df.groupBy(*keys).agg(F.min_by(chunk, index).alias("text"))
    rows = F.array_sort(F.collect_list(F.struct(index, chunk)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r[chunk]), " ").alias("text"))


def map_chunks(df: DataFrame, text_col: str, f: Callable[[Column], Column], out: str = "processed", size: int = 400, overlap: int = 50) -> DataFrame:
    """``df`` with the results of a Column function over each window of the text, joined by blanks."""
    windows = F.transform(token_windows(text_col, size, overlap), lambda w: F.array_join(w, " "))
    return df.withColumn(out, F.array_join(F.transform(windows, f), " "))


def expand_same_target(df: DataFrame, source: str, target: str, prompt: str = "", most: int = 512, size: int = 400, overlap: int = 50) -> DataFrame:
    """One row where prompt and source fit into ``most`` words, else a row for each window, all with the same target: input, target, chunk_id, total_chunks."""
    fits = F.size(words(F.concat(F.lit(prompt), F.coalesce(F.col(source), F.lit(""))))) <= most
    parts = F.when(fits, F.array(F.coalesce(F.col(source), F.lit("")))).otherwise(F.transform(token_windows(source, size, overlap), lambda w: F.array_join(w, " ")))
    kept = [c for c in df.columns if c not in (source, target)]
    made = df.select(*kept, F.col(target).alias("target"), parts.alias("_p"))
    return made.select(*kept, "target", F.size("_p").alias("total_chunks"), F.posexplode("_p").alias("chunk_id", "input"))


def expand_mixed(df: DataFrame, source: str, target: str, most: int = 400, overlap: int = 50) -> DataFrame:
    """Pairs whose source fits stay as they are; longer ones give a row for each packed chunk, with the target's chunk of that number (or the last) where the target exceeds twice ``most`` words."""

    @F.pandas_udf("array<string>")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pack(t or "", most) or [t or ""])

    whole = lambda c: F.array(F.coalesce(F.col(c), F.lit("")))
    n = lambda c: F.size(words(c))
    made = df.withColumns({"_a": F.when(n(source) <= most, whole(source)).otherwise(packed(F.col(source))), "_b": F.when((n(source) > most) & (n(target) > 2 * most), packed(F.col(target))).otherwise(whole(target))})
    kept = [c for c in df.columns if c not in (source, target)]
    rows = made.select(*kept, "_b", (F.size("_a") > 1).alias("is_chunk"), F.size("_a").alias("total_chunks"), F.posexplode("_a").alias("chunk_idx", source))
    return rows.withColumn(target, F.element_at("_b", F.least(F.col("chunk_idx") + 1, F.size("_b")))).drop("_b")


def expand_prompted(df: DataFrame, source: str, prompt: str, most: int = 512, spare: int = 15, overlap: int = 50) -> DataFrame:
    """A row for each chunk of whole sentences that fits beside the prompt; a sentence that is longer is cut: original_idx is the caller's, chunk_id, chunk."""
    room = max(1, most - len(prompt.split()) - spare)
    out = chunked(df, source, "semantic", most=room, overlap=overlap)
    return out.withColumn("chunk", F.array_join(F.slice(words("chunk"), 1, room), " "))


def with_originals(chunks: DataFrame, originals: DataFrame, index: str, text: str, out: str = "original") -> DataFrame:
    """``chunks`` with the text of the document that each came from, "" where there is none."""
    known = originals.select(F.col(index).alias("_i"), F.col(text).alias("_t"))
    return chunks.join(known, F.col(index) == F.col("_i"), "left").withColumn(out, F.coalesce("_t", F.lit(""))).drop("_i", "_t")


def token_ids(tokens: Column, vocabulary: int = 32_000) -> Column:
    """Default tokenizer: an id for each word from its MD5, 0 being the padding."""
    return F.transform(tokens, lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("bigint") % F.lit(vocabulary - 1) + 1).cast("int"))


def tokenised(df: DataFrame, source: str, target: str, prompt: str = "", most_source: int = 512, most_target: int = 256, encode: Callable[[Column], Column] = token_ids) -> DataFrame:
    """``df`` with input_ids, attention_mask and labels of fixed lengths; padding is 0, and -100 in labels."""
    ids = lambda t, most: F.slice(encode(words(t)), 1, most)
    pad = lambda a, most, value: let(a, lambda x: F.concat(x, F.array_repeat(F.lit(value), most - F.size(x))))
    s, t = ids(F.concat(F.lit(prompt), F.coalesce(F.col(source), F.lit(""))), most_source), ids(F.col(target), most_target)
    return df.withColumns({"input_ids": pad(s, most_source, 0), "attention_mask": pad(F.transform(s, lambda x: F.lit(1)), most_source, 0), "labels": pad(t, most_target, -100)})
