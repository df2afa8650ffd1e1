"""Repeated passages by suffix arrays of shards, built by external induced sorting.

Every window of ``least`` words is named by the least hash among its short runs of words, so
equal windows have equal names, wherever they are. Neighbouring windows of one name form a
stretch of text. Stretches whose name occurs once can't hold a repetition and go, unless the
run that names them occurs in them again. Equal stretches are folded into one, with their
number, before the rest are dealt to shards by name, so that equal windows meet. Where a name
is left with one stretch, and no text has the naming run twice, all its windows are equal ones
of that stretch, and nothing needs sorting. A shard's other stretches are streamed to disk, where their suffixes are sorted, and its spans are streamed
back; neighbours with ``least`` words in common are repetitions. Spans of folded stretches
and from all shards are then united by document.
"""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cleared, mark, mounted, shared_folder, table, texts_of, written
from quarry.llm.induced import MEMORY, Numbers, Queue, suffix_file
from quarry.llm.simhash import _keyed, _sized
from quarry.llm.text import U64, chunks, mix, shingles, words

#: Production parameters: words of a repetition, words of the runs that name windows, words of a shard.
LEAST, RUN, SHARD_WORDS = 50, 8, 1_000_000


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    pad = -len(values) % width
    blocks = np.concatenate((values, np.full(pad, ~U64(0)))).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: len(values) - width + 1], left[width - 1 : len(values)])


def stretches(hashes: np.ndarray, offsets: np.ndarray, least: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, name, first and last word (not included) of all stretches, and whether their texts have the naming run twice."""
    none = np.zeros(0, np.int64)
    count = np.diff(offsets)
    if not (count >= least).any():
        return none, none.astype(U64), none, none, none.astype(bool)
    # Runs by their first word; those that reach beyond their text are never asked for.
    padded = np.concatenate((hashes, np.zeros(run, U64)))
    total = np.zeros(len(hashes), U64)
    for k in range(run):
        total = total * U64(0x9E3779B97F4A7C15) + padded[k : k + len(hashes)]
    names, _ = shingles(total, np.array([0, len(total)]), 1)
    salt = mix(np.arange(len(count)).astype(U64))
    own = np.sort(names + np.repeat(salt, count))
    twice = np.unique(own[1:][own[1:] == own[:-1]])
    names = _least_of(np.concatenate((names, np.full(least, ~U64(0)))), least - run + 1)
    windows = np.maximum(count - least + 1, 0)
    owner = np.repeat(np.arange(len(count)), windows)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    name = names[first + offsets[owner]]
    new = np.ones(len(owner), bool)
    new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(owner)) - 1
    return owner[start], name[start], first[start], first[last] + least, np.isin(name[start] + salt[owner[start]], twice)


def _named(keyed: DataFrame, least: int, run: int) -> DataFrame:
    def find(batches):
        for batch in batches:
            texts, keys = texts_of(batch, "text"), batch.column(0)
            for a, b in chunks(np.fromiter((len(t) for t in texts), np.int64, len(texts)), 1 << 18):
                hashes, offsets, _, _ = words(texts[a:b])
                owner, name, first, last, twice = stretches(hashes, offsets, least, run)
                if len(owner):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner + a)), pa.array(name.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(twice)], names=["key", "name", "first", "last", "twice"])

    return keyed.select("key", "text").mapInArrow(find, "key binary, name bigint, first int, last int, twice boolean")


#: Symbols of words come after those of the separators.
_WORD = 1 << 32


class Shard:
    """Stretches on disk, one after the other with a separator of its own after each, and where they repeat."""

    def __init__(self, folder: Path, memory: int = MEMORY):
        self.folder, self.memory, self.many = folder, memory, 0
        self.text = Numbers(folder, 1, memory // 8)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """flat: 32-bit hashes of the words of some stretches, end to end."""
        n = len(sizes)
        symbols = np.empty(len(flat) + n, np.int64)
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(symbols), bool)
        inside[ends] = False
        symbols[inside] = flat.astype(np.uint32).astype(np.int64) + _WORD
        symbols[ends] = np.arange(self.many + 1, self.many + n + 1)
        self.many += n
        for at in range(0, len(symbols), 1 << 15):
            self.text.append(symbols[at : at + (1 << 15)])

    def sort(self, least: int) -> None:
        """Notes the places at which ``least`` words begin that occur again, and the first of each set of equals."""
        self.text.append(np.zeros(1, np.int64))
        self.text.spill()
        rows = suffix_file(self.text, self.folder, self.memory)
        self.width = max(self.memory // 8, 1 << 12, -(-self.text.rows // (1 << 12)))
        self.flags = Queue(np.arange(0, self.text.rows, self.width), self.folder, 2, self.memory)
        step, first = max(4, self.memory // 32), -1
        for at in range(0, rows.rows, step):
            part = rows.read(at, at + step + 1)
            place, alike = part[:, 0], part[:, 1] >= least
            n = min(step, rows.rows - at)
            with_next = np.append(alike[1:], False)[:n]
            again = alike[:n] | with_next
            self.flags.push(np.stack([place[:n][again], np.zeros(again.sum(), np.int64)], axis=1))
            # Sets of equals end where the next row isn't alike; one may go on from the rows before.
            start = np.flatnonzero(~alike[:n])
            cuts = np.unique(np.append(0, start))
            low = np.minimum.reduceat(place[:n], cuts)
            if alike[0] and first >= 0:
                low[0] = min(low[0], first)
            last = np.append(cuts[1:], n) - 1
            closed = ~with_next[last]
            real = closed & again[last]
            self.flags.push(np.stack([low[real], np.ones(real.sum(), np.int64)], axis=1))
            first = -1 if closed[-1] else int(low[-1])
        rows.close()
        self.text.close()
        self.now, self.loaded = -1, None

    def marks(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each place from a to b, later than those asked before, repeats, and whether it is the first of its equals."""
        out = np.zeros((2, b - a), bool)
        for k in range(a // self.width, -(-b // self.width)):
            if k != self.now:
                block = self.flags.open(k)
                rows = block.read(0, block.rows)
                self.now, self.loaded = k, np.zeros((2, self.width), bool)
                self.loaded[0, rows[rows[:, 1] == 0, 0] - k * self.width] = True
                self.loaded[1, rows[rows[:, 1] == 1, 0] - k * self.width] = True
                block.close()
            low, high = max(a, k * self.width), min(b, (k + 1) * self.width)
            out[:, low - a : high - a] = self.loaded[:, low - k * self.width : high - k * self.width]
        return out[0], out[1]


def alone_spans(batches, found: list[pa.RecordBatch]):
    """Passes on the stretches that need sorting; of those alone with their name the spans go to ``found``, as ``stretch_spans`` gives them."""
    for batch in batches:
        digest, key, first, many, alone, column = (batch.column(batch.schema.get_field_index(n)) for n in ("digest", "key", "first", "many", "alone", "words"))
        single = alone.to_numpy(zero_copy_only=False).astype(bool)
        at = np.flatnonzero(single & many.to_numpy(zero_copy_only=False).astype(bool))
        if len(at):
            of, begin, size = pa.array(np.tile(at, 2)), first.to_numpy()[at], column.value_lengths().to_numpy()[at]
            again = pa.array([False] * len(at) + [None] * len(at), pa.bool_())
            low, high = (np.concatenate(x).astype(np.int32) for x in ((begin, 0 * begin), (begin + size, size)))
            found.append(pa.RecordBatch.from_arrays([digest.take(of), key.take(of), first.take(of), again, pa.array(low), pa.array(high)], names=["digest", "key", "first", "again", "first_word", "last_word"]))
        yield batch.filter(pa.array(~single))


def stretch_spans(batches, folder: Path, least: int, memory: int):
    """Spans of folded stretches, which come in the order of their first places: batches of digest, key, first, many and words.

    Yields digest, key, first, again (null for what holds for all other places), first_word
    and last_word, which count within the document, or within the stretch where again is null.
    """
    folder.mkdir(parents=True)
    try:
        shard, notes = Shard(folder, memory), folder / "notes"
        kept = ("digest", "key", "first", "many")
        schema = pa.schema([("digest", pa.binary()), ("key", pa.binary()), ("first", pa.int32()), ("many", pa.bool_()), ("size", pa.int64())])
        with pa.OSFile(str(notes), "wb") as sink, pa.ipc.new_stream(sink, schema) as out:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("words"))
                sizes = column.value_lengths().to_numpy().astype(np.int64)
                if len(sizes):
                    shard.add(column.flatten().to_numpy(), sizes)
                    out.write_batch(pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).cast(schema.field(n).type) for n in kept), pa.array(sizes)], schema=schema))
        if not shard.many:
            return
        shard.sort(least)
        at = 0
        with pa.OSFile(str(notes), "rb") as source, pa.ipc.open_stream(source) as reader:
            for batch in reader:
                sizes, first, many = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 2, 3))
                begin = np.cumsum(sizes + 1) - sizes - 1
                again, earliest = shard.marks(at, at + int((sizes + 1).sum()))
                place = np.arange(len(again)) - np.repeat(begin, sizes + 1)
                folded = np.repeat(many, sizes + 1) & (place + least <= np.repeat(sizes, sizes + 1))
                earliest = (again & earliest) | (folded & ~again)
                repeated = again | folded
                at += len(again)
                rows = []
                for kind, marked in ((False, earliest), (True, repeated & ~earliest), (None, repeated & np.repeat(many, sizes + 1))):
                    spans = np.array(_spans(marked, least), np.int64).reshape(-1, 2)
                    of = np.searchsorted(begin, spans[:, 0], "right") - 1
                    shift = begin[of] - (0 if kind is None else first[of])
                    rows.append((of, [kind] * len(of), spans[:, 0] - shift, spans[:, 1] - shift))
                of = pa.array(np.concatenate([r[0] for r in rows]))
                arrays = [batch.column(k).take(of) for k in range(3)]
                arrays += [pa.array(sum((r[1] for r in rows), []), pa.bool_()), *(pa.array(np.concatenate([r[k] for r in rows]).astype(np.int32)) for k in (2, 3))]
                yield pa.RecordBatch.from_arrays(arrays, names=["digest", "key", "first", "again", "first_word", "last_word"])
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _spans(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Unions of the windows that start where a flag is set."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > least)
    return list(zip(at[np.concatenate(([0], cut + 1))].tolist(), (at[np.append(cut, len(at) - 1)] + least).tolist(), strict=True))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, shard_words: int = SHARD_WORDS, memory: int = MEMORY) -> DataFrame:
    """Spans of words that occur again, in another document or the same: id, again, first_word, last_word, first_char, last_char.

    A span unites overlapping windows of ``least`` words that occur more than once. again:
    whether earlier occurrences exist (such spans can be cut out), earlier meaning a lesser id
    (nulls come first), then a hash, then a lesser place; where spans of both kinds overlap,
    both are given. Words count from 0 and compare in lower case; ends aren't included.
    first_char and last_char are bounds in characters of the text.

    Null and empty texts and those of fewer words have no spans. Rows with the same id and
    text are one document. Texts of any length are searched whole; text that repeats a word
    without end repeats itself. Other columns play no part. An empty table gives no spans.
    """
    spark = docs.sparkSession
    scratch, since = shared_folder(spark), mark()
    keyed = _keyed(docs, id_col, text_col)
    found = written(_named(keyed, least, min(RUN, least)), "stretches")
    names = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.bool_or("twice").alias("twice")).filter("n > 1 OR twice").select("name", "twice")
    kept = written(found.drop("twice").join(names, "name").distinct(), "repeated")
    row = kept.agg(F.sum(F.col("last") - F.col("first"))).first()
    shards = max(1, -(-(row[0] or 0) // shard_words))
    wanted = written(kept.groupBy("key").agg(F.collect_list(F.struct("name", "first", "last", "twice")).alias("parts")), "wanted")
    some = keyed.join(_sized(wanted.select("key"), wanted.count()), "key", "left_semi").dropDuplicates(["key"])
    holders = some.join(wanted, "key")

    def cut(batches):
        for batch in batches:
            texts = texts_of(batch, "text")
            parts = batch.column(batch.schema.get_field_index("parts")).to_pylist()
            for a, b in chunks(np.fromiter((len(t) for t in texts), np.int64, len(texts)), 1 << 18):
                hashes, offsets, _, _ = words(texts[a:b])
                short = (hashes >> U64(32)).astype(np.uint32).view(np.int32)
                rows = [(k, p) for k in range(a, b) for p in parts[k]]
                which = pa.array([k for k, _ in rows], pa.int64())
                values = [short[offsets[k - a] + p["first"] : offsets[k - a] + p["last"]] for k, p in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), batch.column(1).take(which), pa.array([p["name"] for _, p in rows], pa.int64()), pa.array([p["first"] for _, p in rows], pa.int32()), pa.array([p["twice"] for _, p in rows], pa.bool_()),
                     pa.array([xxhash.xxh3_128_digest(v) for v in values], pa.binary()), pa.array(values, pa.list_(pa.int32()))],
                    names=["key", "id", "name", "first", "twice", "digest", "words"],
                )

    id_type = keyed.schema["id"].dataType.simpleString()
    cuts = holders.select("key", "id", "text", "parts").mapInArrow(cut, f"key binary, id {id_type}, name bigint, first int, twice boolean, digest binary, words array<int>")
    pieces = written(cuts, "pieces")
    # Equal stretches are one, at their first place: the least id (nulls come first), key and place.
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "key", "first")
    folded = pieces.groupBy("name", "digest").agg(F.min(place).alias("own"), (F.count(F.lit(1)) > 1).alias("many"), F.first("words").alias("words"), F.bool_or("twice").alias("twice"))
    alone = ~F.col("twice") & (F.count(F.lit(1)).over(Window.partitionBy("name")) == 1)
    dealt = folded.repartition(shards, "name").withColumn("alone", alone).sortWithinPartitions("own").select("digest", "own.key", "own.first", "many", "alone", "words")

    def sort(batches):
        whole: list[pa.RecordBatch] = []
        yield from stretch_spans(alone_spans(batches, whole), mounted(scratch) / f"suffixes-{uuid.uuid4().hex}", least, memory)
        yield from whole

    found_spans = written(dealt.mapInArrow(sort, "digest binary, key binary, first int, again boolean, first_word int, last_word int"), "stretch_spans")
    own = found_spans.filter("again IS NOT NULL").select("key", "again", "first_word", "last_word")
    shared = found_spans.filter("again IS NULL").select("digest", F.col("key").alias("own_key"), F.col("first").alias("own_first"), "first_word", "last_word")
    others = pieces.select("digest", "key", "first").join(shared, "digest").filter("key != own_key OR first != own_first")
    spans = own.unionByName(others.select("key", F.lit(True).alias("again"), (F.col("first") + F.col("first_word")).alias("first_word"), (F.col("first") + F.col("last_word")).alias("last_word")))
    by_text = spans.groupBy("key").agg(F.collect_list(F.struct("again", "first_word", "last_word")).alias("spans"))

    def unite(batches):
        for batch in batches:
            texts = texts_of(batch, "text")
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            rows = []
            for k, t in enumerate(texts):
                _, _, begin, end = words([t])
                # Bytes of the lower-case text give characters of it, which are those of the text but for rare letters that grow.
                lower = t.lower().encode("utf-8", "replace")
                chars = np.cumsum((np.frombuffer(lower, np.uint8) & 0xC0) != 0x80)
                if chars[-1] != len(t):
                    chars = np.minimum(chars, len(t))
                for again in (False, True):
                    reach = -1
                    merged: list[list[int]] = []
                    for a, b in sorted((s["first_word"], s["last_word"]) for s in spans[k] if s["again"] == again):
                        if merged and a <= reach:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                        reach = merged[-1][1]
                    rows += [(k, again, a, b, int(chars[begin[a]]) - 1, int(chars[end[b - 1] - 1])) for a, b in merged]
            which, *rest = zip(*rows, strict=True)
            kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))], names=["id", "again", "first_word", "last_word", "first_char", "last_char"])

    made = some.join(by_text, "key").select("id", "text", "spans").mapInArrow(unite, f"id {id_type}, again boolean, first_word int, last_word int, first_char int, last_char int")
    out = written(made, "passages")
    cleared(since, out)
    return out


def op10_suffix(spark, sf_dir):
    """All repeated passages of all documents."""
    return repeated_passages(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_suffix": op10_suffix}
ORACLE: dict[str, str] = {}
