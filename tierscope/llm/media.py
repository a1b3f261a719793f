"""Media columns: content-addressed payloads in tar shards.

A payload is a text's UTF-8 bytes, zero-padded to whole rows of 64, as an 8-bit
greyscale PNG 64 pixels wide (lossless, and readable by any image library).
Equal texts have equal payloads: each task stores one once, under the SHA-256 of its
stored form, as one member of a plain tar file (ustar), and all rows of all tasks
refer to one of those members. Rows keep the digest, the
shard, and the offset and length of the member's data; width, height and depth
come from a range read of just the first 33 bytes, and the pixels from a second
range read where features are wanted.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm import common, shared_files

ROW, LEVEL, HEADER = 64, 6, 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
STORED = "t1 long, t2 long, n_bytes long, shard string, media_sha256 string, media_offset long, media_bytes long"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def to_png(payload: bytes) -> bytes:
    """8-bit greyscale, 64 wide, no filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes, with their check sum."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", first[16:25])


def from_png(data: bytes) -> bytes:
    """Samples of a file that ``to_png`` wrote."""
    width, height, _ = png_header(data[:HEADER])
    at, body = 8, b""
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Height, mean, deviation, entropy in bits (3 decimals), and the mean
    brightness of four equal bands, as one string of numbers."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    mean = float(x.mean())
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    bands = [float(b.mean()) for b in np.array_split(x, 4)]
    return ",".join([str(len(x) // ROW), *(f"{v:.3f}" for v in (mean, float(x.std()), entropy, *bands))])


def store(docs: DataFrame) -> DataFrame:
    """Write each different payload of docs (t1, t2, text) into tar shards.

    Columns: see STORED. A task streams one shard under a new name; of repeated
    tasks only the one whose rows are kept counts. Texts aren't shuffled: a text
    may be stored by several tasks, at most once by each.
    """
    spark = docs.sparkSession
    folder = common.fresh_dir(spark, "media")

    def run(batches):
        out, uri, at, seen = None, f"{folder}/{uuid.uuid4().hex}.tar", 0, set()
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for t1, t2, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (t1, t2) in seen:
                    continue
                seen.add((t1, t2))
                raw = (text or "").encode()
                data = to_png(padded(raw))
                digest = hashlib.sha256(data).hexdigest()
                info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
                info.size = len(data)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                out = out or shared_files.created(uri)
                out.write(head + data + bytes(-len(data) % 512))
                for x, v in zip(rows, (t1, t2, len(raw), uri, digest, at + len(head), len(data)), strict=True):
                    x.append(v)
                at += len(head) + len(data) + -len(data) % 512
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=[c.split()[0] for c in STORED.split(", ")])
        if out:
            out.write(bytes(1024))
            out.close()

    return common.written(docs.select("t1", "t2", "text").mapInArrow(run, STORED), "media-index")


def read_back(index: DataFrame) -> DataFrame:
    """index plus width, height, bits, payload_bytes, payload_sha256, tail_crc32
    and feature, all from the stored bytes.

    Rows of a shard are read in order of their offsets with one open file.
    """
    more = "width int, height int, bits int, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    ordered = index.repartition(common.salts(index), "shard").sortWithinPartitions("shard", "media_offset")

    def run(batches):
        name, file = None, None
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for uri, digest, at, n in zip(*(b.column(i).to_pylist() for i in (3, 4, 5, 6)), strict=True):
                if uri != name:
                    if file:
                        file.close()
                    name, file = uri, shared_files.opened(uri)
                width, height, bits = png_header(file.read_at(HEADER, at))
                data = file.read_at(n, at)
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"stored bytes differ from their digest: {uri} at {at}")
                payload = from_png(data)
                for x, v in zip(rows, (width, height, bits, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), features(payload)), strict=True):
                    x.append(v)
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            columns = [*b.columns, *(pa.array(x, t) for x, t in zip(rows, types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in f"{STORED}, {more}".split(", ")])
        if file:
            file.close()

    return ordered.mapInArrow(run, f"{STORED}, {more}")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id and its payload's place, digests, metadata and feature, by row.

    Null and empty texts have a payload of 64 zero bytes. Equal texts share one
    stored payload and have equal values. Very long texts are held one at a time.
    """
    common.tune(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.withColumns(dict(zip(("t1", "t2"), common.text_hash(), strict=True)))
    index = store(src)
    kept = index.groupBy("t1", "t2").agg(F.min(F.struct(*index.columns[2:])).alias("x")).select("t1", "t2", "x.*")
    values = read_back(common.written(kept.select(*index.columns), "media-kept"))
    out = src.select("doc_id", "t1", "t2").join(values, ["t1", "t2"])
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits", "shard", "media_offset")
