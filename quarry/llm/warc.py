"""WARC records in seekable Zstandard bundles.

Records of a bundle are grouped into frames that decompress on their own; the bundle ends
with a seek table (a skippable frame of frame sizes and checksums). An index maps record
identifiers to the frame and the offset within it, so that one record costs one frame:
``read_records`` reads no more of a file than the frames that it needs.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable
from functools import lru_cache
from urllib.parse import unquote

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import column, removed, table, written

#: Uncompressed bytes of a bundle (on average) and of a frame, and the level of compression.
BUNDLE_BYTES, FRAME_BYTES, LEVEL = 8 << 20, 128 << 10, 6
#: Payload bytes of a task that packs.
TASK_BYTES = 64 << 20
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_HEAD = ("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:", ">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n", "WARC-Target-URI: ", "Content-Type: text/html; charset=utf-8\r\n", "Content-Length: ")
INDEX = "array<struct<record_id:string,frame:int,frame_offset:bigint,record_bytes:bigint>>"


def seek_table(sizes: list[tuple[int, int, int]]) -> bytes:
    """Entries are compressed size, size and checksum of each frame."""
    body = b"".join(struct.pack("<III", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0x80, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int, int]]:
    """Place, compressed size, size and checksum of each frame, from the end of a bundle."""
    count, descriptor, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end")
    entry = 12 if descriptor & 0x80 else 8
    at, place, out = len(data) - 9 - count * entry, 0, []
    for k in range(count):
        packed, size = struct.unpack_from("<II", data, at + k * entry)
        check = struct.unpack_from("<I", data, at + k * entry + 8)[0] if entry == 12 else -1
        out.append((place, packed, size, check))
        place += packed
    return out


def read_frame(data: bytes, entry: tuple[int, int, int, int]) -> bytes:
    place, packed, size, check = entry
    out = zstandard.ZstdDecompressor().decompress(data[place : place + packed], max_output_size=max(size, 1))
    if check >= 0 and xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
        raise ValueError("a frame doesn't match its checksum")
    return out


def parse_record(record: bytes) -> tuple[str | None, str | None, str | None]:
    """Identifier, address and payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    ident = unquote(fields["WARC-Record-ID"][len("<urn:record:") : -1])
    body = None if "WARC-Truncated" in fields else rest[: int(fields["Content-Length"])].decode("utf-8")
    return ident or None, fields.get("WARC-Target-URI"), body


def _escaped(value, signs: str):
    for sign in signs:
        value = F.replace(value, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return value


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    ident, url, payload = column(pages, id_col).cast("string"), column(pages, url_col), column(pages, payload_col)
    head = F.concat(
        F.lit(_HEAD[0]), F.coalesce(_escaped(ident, "%\r\n>"), F.lit("")), F.lit(_HEAD[1]),
        F.coalesce(F.concat(F.lit(_HEAD[2]), _escaped(url, "\r\n"), F.lit("\r\n")), F.lit("")),
        F.lit(_HEAD[3]), F.when(payload.isNull(), F.lit("WARC-Truncated: unspecified\r\n")).otherwise(F.lit("")),
        F.lit(_HEAD[4]), F.octet_length(F.coalesce(payload, F.lit(""))).cast("string"), F.lit("\r\n\r\n"),
    )
    # Rows without an identifier are dealt out by what they hold, so that they don't make one bundle.
    dealt = F.coalesce(ident, F.concat(F.lit("null "), F.coalesce(F.md5(payload), F.lit(""))))
    return pages.select(ident.alias("record_id"), dealt.alias("dealt"), F.encode(F.concat(head, F.coalesce(payload, F.lit("")), F.lit("\r\n\r\n")), "utf-8").alias("record"))


def pack(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """A row for each bundle: bundle, data (the file) and index (record_id, frame, frame_offset, record_bytes).

    Records are dealt to bundles by a hash of the identifier, or else of the payload; the number
    of bundles follows the sum of payload bytes. Within a bundle they lie by identifier and content; a frame holds those
    that start within the same ``frame_bytes``, so a record never spans frames, and a longer
    one ends its frame. Identifiers of any signs are escaped. Null ones become empty ones; null addresses have no
    header; null payloads are marked and read back as null, apart from empty ones. Line ends
    in addresses are percent-encoded. Repeated rows are separate records. Other columns
    aren't packed. An empty table gives no bundle.
    """
    total = pages.agg(F.sum(F.octet_length(column(pages, payload_col)))).first()[0] or 0
    bundles = max(1, -(-total // bundle_bytes))
    rows = _records(pages, id_col, url_col, payload_col).withColumn("bundle", bundle_of(F.col("dealt"), bundles)).drop("dealt")

    def run(group: pa.Table) -> pa.Table:
        bundle = group["bundle"][0].as_py()
        rows = sorted(zip(group["record_id"].to_pylist(), group["record"].to_pylist(), strict=True), key=lambda r: (r[0] or "", r[1]))
        press = zstandard.ZstdCompressor(level=LEVEL)
        out, sizes, index = [], [], []
        block, held, at, start = -1, [], 0, 0

        def close() -> None:
            raw = b"".join(held)
            out.append(press.compress(raw))
            sizes.append((len(out[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            held.clear()

        for ident, record in rows:
            if at // frame_bytes != block:
                if held:
                    close()
                block, start = at // frame_bytes, at
            index.append({"record_id": ident, "frame": len(sizes), "frame_offset": at - start, "record_bytes": len(record)})
            held.append(record)
            at += len(record)
        close()
        return pa.table({"bundle": pa.array([bundle], pa.int64()), "data": pa.array([b"".join(out) + seek_table(sizes)], pa.binary()), "index": pa.array([index], _INDEX)})

    # Tasks of a few bundles each, however many there are.
    return rows.repartition(max(1, -(-total // TASK_BYTES)), "bundle").groupBy("bundle").applyInArrow(run, f"bundle bigint, data binary, index {INDEX}")


_INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("record_bytes", pa.int64())]))


def bundle_of(dealt, bundles: int):
    return F.pmod(F.conv(F.substring(F.md5(dealt), 1, 12), 16, 10).cast("bigint"), F.lit(bundles))


def unpack(bundles: DataFrame) -> DataFrame:
    """All records named in the indexes, each read by its frame and offset: bundle, record_id, frame, frame_offset, record_bytes, url, payload, payload_md5.

    A bundle's frames are decompressed once each, checked against the seek table, and kept no
    longer than needed. Records that don't hold the identifier of the index are an error.
    """

    def run(batches):
        for batch in batches:
            for bundle, data, index in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("bundle", "data", "index")), strict=True):
                raw, rows = data.as_py(), index.as_py() or []
                frames = read_seek_table(raw)

                @lru_cache(1)
                def frame(k: int, raw=raw, frames=frames) -> bytes:
                    return read_frame(raw, frames[k])

                for a in range(0, len(rows), 256):
                    part, found = rows[a : a + 256], []
                    for r in part:
                        name, url, payload = parse_record(frame(r["frame"])[r["frame_offset"] : r["frame_offset"] + r["record_bytes"]])
                        if (name or "") != (r["record_id"] or ""):
                            raise ValueError("the index names another record")
                        found.append((url, payload, None if payload is None else hashlib.md5(payload.encode()).hexdigest()))
                    urls, payloads, sums = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bundle.as_py()] * len(part), pa.int64()), pa.array([r["record_id"] for r in part], pa.string()), pa.array([r["frame"] for r in part], pa.int32()), *(pa.array([r[n] for r in part], pa.int64()) for n in ("frame_offset", "record_bytes")), pa.array(urls, pa.string()), pa.array(payloads, pa.string()), pa.array(sums, pa.string())],
                        names=["bundle", "record_id", "frame", "frame_offset", "record_bytes", "url", "payload", "payload_md5"],
                    )

    return bundles.select("bundle", "data", "index").mapInArrow(run, "bundle bigint, record_id string, frame int, frame_offset bigint, record_bytes bigint, url string, payload string, payload_md5 string")


RECORDS = "record_id string, bundle bigint, frame int, frame_offset bigint, record_bytes bigint, frame_at bigint, frame_packed bigint, frame_bytes bigint, frame_check bigint"


def _file(base: str, bundle: int) -> str:
    return f"{base}/bundle-{bundle:08d}.warc.zst"


def save_bundles(bundles: DataFrame, folder: str) -> None:
    """Writes each bundle as ``bundle-N.warc.zst`` below ``folder`` (a URI that all executors reach), and an index of all records.

    The index, Parquet in the order of identifiers, has each record's bundle, frame and offset,
    and the frame's place in the file. Files appear by renaming, so that a task that runs
    again replaces its own files; bundles are made once.
    """

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for bundle, data, index in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("bundle", "data", "index")), strict=True):
                part = f"{base}/.{uuid.uuid4().hex}.part"
                raw = data.as_py()
                with system.open_output_stream(part) as out:
                    out.write(raw)
                system.move(part, _file(base, bundle.as_py()))
                frames, rows = read_seek_table(raw), index.as_py() or []
                columns = [[r["record_id"] for r in rows], [bundle.as_py()] * len(rows), *([r[n] for r in rows] for n in ("frame", "frame_offset", "record_bytes")), *([frames[r["frame"]][k] for r in rows] for k in range(4))]
                types = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in RECORDS.split(", ")])

    made = written(bundles.select("bundle", "data", "index").mapInArrow(write, RECORDS), "records")
    made.orderBy("record_id").write.mode("overwrite").parquet(f"{folder}/index")
    removed(made)


def open_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles that ``save_bundles`` wrote, whole, as ``unpack`` takes them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = files.select(F.regexp_extract("path", r"bundle-(\d+)\.warc\.zst$", 1).cast("bigint").alias("bundle"), F.col("content").alias("data"))
    records = spark.read.schema(RECORDS).parquet(f"{folder}/index")
    index = records.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "frame_offset", "record_id", "record_bytes"))).alias("index"))
    return named.join(index, "bundle").withColumn("index", F.transform("index", lambda r: F.struct(r.record_id.alias("record_id"), r.frame.alias("frame"), r.frame_offset.alias("frame_offset"), r.record_bytes.alias("record_bytes"))))


def read_records(spark: SparkSession, folder: str, ids: DataFrame | Iterable[str]) -> DataFrame:
    """The records with the given identifiers: record_id, bundle, url, payload; all of them where one occurs again.

    ids: a few identifiers, which then prune the index, or a table whose first column holds
    them, which is joined with it. Only the frames that hold a record asked for are read, by
    their ranges of the files, once each. Identifiers that don't occur, and null ones, have no row.
    """
    records = spark.read.schema(RECORDS).parquet(f"{folder}/index")
    if isinstance(ids, DataFrame):
        wanted = records.join(ids.select(ids[ids.columns[0]].cast("string").alias("record_id")).distinct(), "record_id", "left_semi")
    else:
        wanted = records.filter(F.col("record_id").isin([str(i) for i in ids if i is not None]))

    def read(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = sorted(batch.to_pylist(), key=lambda r: (r["bundle"], r["frame"], r["frame_offset"]))
            out, now, frame, file = [], None, b"", None
            for r in rows:
                if now != (r["bundle"], r["frame"]):
                    if now is None or now[0] != r["bundle"]:
                        file = system.open_input_file(_file(base, r["bundle"]))
                    now = (r["bundle"], r["frame"])
                    frame = read_frame(file.read_at(r["frame_packed"], r["frame_at"]), (0, r["frame_packed"], r["frame_bytes"], r["frame_check"]))
                name, url, payload = parse_record(frame[r["frame_offset"] : r["frame_offset"] + r["record_bytes"]])
                if (name or "") != (r["record_id"] or ""):
                    raise ValueError("the index names another record")
                out.append((r["record_id"], r["bundle"], url, payload))
            if out:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["record_id", "bundle", "url", "payload"])

    return wanted.repartition("bundle").sortWithinPartitions("bundle", "frame").mapInArrow(read, "record_id string, bundle bigint, url string, payload string")


def op3_warc(spark, sf_dir):
    """All pages, packed into bundles and read back by frame and offset."""
    read = unpack(pack(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return read.select(F.col("record_id").cast("bigint").alias("page_id"), "url", "bundle", "frame", "frame_offset", "record_bytes", "payload_md5")


SQL = f"""
WITH r AS (SELECT page_id, url, html, md5(html) AS payload_md5, coalesce(CAST(page_id AS VARCHAR), '') AS k, coalesce(CAST(page_id AS VARCHAR), 'null ' || coalesce(md5(html), '')) AS dealt,
    strlen(concat('{_HEAD[0]}', CAST(page_id AS VARCHAR), '{_HEAD[1]}', '{_HEAD[2]}' || url || chr(13) || chr(10), '{_HEAD[3]}', '{_HEAD[4]}', CAST(strlen(html) AS VARCHAR)))
        + strlen(html) + 8 AS record_bytes FROM pages),
b AS (SELECT *, CAST('0x' || substr(md5(dealt), 1, 12) AS BIGINT) % (SELECT greatest(1, CAST((sum(strlen(html)) + {BUNDLE_BYTES - 1}) // {BUNDLE_BYTES} AS BIGINT)) FROM pages) AS bundle FROM r),
s AS (SELECT *, CAST(sum(record_bytes) OVER (PARTITION BY bundle ORDER BY k, url, html ROWS UNBOUNDED PRECEDING) AS BIGINT) - record_bytes AS start FROM b),
f AS (SELECT *, start // {FRAME_BYTES} AS block FROM s)
SELECT page_id, url, bundle, CAST(dense_rank() OVER (PARTITION BY bundle ORDER BY block) - 1 AS INTEGER) AS frame,
    start - min(start) OVER (PARTITION BY bundle, block) AS frame_offset, record_bytes, payload_md5 FROM f
"""
SQL = SQL.replace("\r\n", "' || chr(13) || chr(10) || '")
QUERIES = {"op3_warc": op3_warc}
ORACLE = {"op3_warc": SQL}
