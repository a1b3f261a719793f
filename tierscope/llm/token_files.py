"""Token-id files: patched frame-of-reference blocks with an index of starts.

File: magic "PFOR1" + 3 zero bytes; blocks; block index (start of each block,
u64); documents (doc_id i64, 1 + first id's position u64, null flag u8);
trailer of six u64: ids, blocks, documents, start of the block index, start of
the documents, block length. All little-endian.

Block: minimum u32, width u8 (bits), exceptions u16; ids minus minimum, low
``width`` bits each, packed; exceptions: positions u16, then full values u32.
The width holds a chosen percentile of the block; larger values are patched in.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm import common, shared_files, tokens

MAGIC, BLOCK, PERCENTILE = b"PFOR1\0\0\0", 256, 90
_HEAD, _TRAILER = struct.Struct("<IBH"), struct.Struct("<6Q")


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of (n, BLOCK) u32 ids."""
    low = ids.min(1)
    rest = ids - low[:, None]
    k = min(ids.shape[1] - 1, ids.shape[1] * percentile // 100)
    typical = np.partition(rest, k, axis=1)[:, k]
    width = np.where(typical > 0, np.floor(np.log2(np.maximum(typical, 1))).astype(int) + 1, 0)
    # patching costs 6 bytes a value: keep all bits where that is smaller
    most = np.floor(np.log2(np.maximum(rest.max(1), 1))).astype(int) + (rest.max(1) > 0)
    over = (rest >> width[:, None].astype(np.uint32) > 0) & (width[:, None] < 32)
    plain = (most - width) * ids.shape[1] / 8 <= over.sum(1) * 6
    width = np.where(plain, most, width)
    over[plain] = False
    packed: list[bytes] = [b""] * len(ids)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, max(1, len(rows) // 2048)):
            bits = np.unpackbits(rest[part].astype("<u4").view(np.uint8), axis=1, bitorder="little").reshape(len(part), -1, 32)[:, :, :w]
            for r, p in zip(part, np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little"), strict=True):
                packed[r] = p.tobytes()
    out = []
    for i, body in enumerate(packed):
        at = np.flatnonzero(over[i])
        out.append(_HEAD.pack(int(low[i]), int(width[i]), len(at)) + body + at.astype("<u2").tobytes() + ids[i, at].astype("<u4").tobytes())
    return out


def decode_blocks(raw: bytes, starts: np.ndarray, n: int = BLOCK) -> np.ndarray:
    """(len(starts), n) ids of the blocks that start at ``starts`` in raw."""
    heads = [_HEAD.unpack_from(raw, s) for s in starts]
    out = np.zeros((len(starts), n), np.uint32)
    widths = np.array([h[1] for h in heads])
    for w in np.unique(widths):
        rows, size = np.flatnonzero(widths == w), n * int(w) // 8
        if w:
            body = np.frombuffer(b"".join(raw[starts[r] + 7 : starts[r] + 7 + size] for r in rows), np.uint8).reshape(len(rows), -1)
            bits = np.zeros((len(rows), n, 32), np.uint8)
            bits[:, :, :w] = np.unpackbits(body, axis=1, bitorder="little").reshape(len(rows), n, w)
            out[rows] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view("<u4")
    out += np.array([h[0] for h in heads], np.uint32)[:, None]
    for i, (_, w, k) in enumerate(heads):
        if k:
            s = starts[i] + 7 + n * w // 8
            out[i, np.frombuffer(raw, "<u2", k, s)] = np.frombuffer(raw, "<u4", k, s + 2 * k)
    return out


class Writer:
    """Streams ids of one document after another into a file."""

    def __init__(self, uri: str):
        self.out = shared_files.created(uri)
        self.out.write(MAGIC)
        self.at, self.n, self.starts, self.docs, self.wait, self.waiting = len(MAGIC), 0, [], [], [], 0

    def _flush(self, ids: np.ndarray) -> None:
        for lo in range(0, len(ids), BLOCK * 4096):
            for b in encode_blocks(ids[lo : lo + BLOCK * 4096].reshape(-1, BLOCK)):
                self.out.write(b)
                self.starts.append(self.at)
                self.at += len(b)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, self.n, doc_id is None))
        self.wait.append(ids.astype(np.uint32))
        self.n, self.waiting = self.n + len(ids), self.waiting + len(ids)
        if self.waiting >= BLOCK * 2048:
            ids = np.concatenate(self.wait)
            cut = len(ids) // BLOCK * BLOCK
            self._flush(ids[:cut])
            self.wait, self.waiting = [ids[cut:]], len(ids) - cut

    def close(self) -> None:
        ids = np.concatenate([*self.wait, np.zeros(0, np.uint32)])
        if len(ids):  # the last block repeats its last id; the trailer has the count
            self._flush(np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[-1])]))
        index = np.array(self.starts, "<u8").tobytes()
        docs = b"".join(np.array([d[i] for d in self.docs], t).tobytes() for i, t in enumerate(("<i8", "<u8", "u1")))
        self.out.write(index + docs + _TRAILER.pack(self.n, len(self.starts), len(self.docs), self.at, self.at + len(index), BLOCK))
        self.out.close()


def read_documents(uri: str, blocks: int = 4096):
    """Yields (doc_id, first id's position, ids) of a file, some blocks at a time."""
    with shared_files.opened(uri) as f:
        size = f.size()
        n, n_blocks, n_docs, index_at, docs_at, block = _TRAILER.unpack(f.read_at(_TRAILER.size, size - _TRAILER.size))
        if f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        starts = np.frombuffer(f.read_at(8 * n_blocks, index_at), "<u8").astype(np.int64)
        raw = f.read_at(17 * n_docs, docs_at)
        doc_ids, first, null = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, "<u8", n_docs, 8 * n_docs).astype(np.int64), np.frombuffer(raw, "u1", n_docs, 16 * n_docs)
        ends = np.r_[first[1:], n]
        have, have_from, d = np.zeros(0, np.uint32), 0, 0
        for lo in range(0, n_blocks, blocks):
            hi = min(lo + blocks, n_blocks)
            stop = int(starts[hi]) if hi < n_blocks else index_at
            body = f.read_at(stop - int(starts[lo]), int(starts[lo]))
            have = np.concatenate([have, decode_blocks(body, starts[lo:hi] - starts[lo], block).ravel()])
            while d < n_docs and ends[d] <= min(have_from + len(have), n):
                yield None if null[d] else int(doc_ids[d]), int(first[d]), have[first[d] - have_from : ends[d] - have_from]
                d += 1
            keep = first[d] if d < n_docs else n
            have, have_from = have[keep - have_from :], keep


def write_files(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool) -> DataFrame:
    """Write all documents in ascending doc_id order; returns one row per file.

    Files: uri, part (their order), n_ids. Each task writes under a new name, so
    a repeated task leaves the rows of just one attempt. Null ids come first;
    rows with the same id are in the order of their texts' hashes.
    """
    spark = docs.sparkSession
    common.tune(spark)
    folder = common.fresh_dir(spark, "token-files")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *common.text_hash())
    src = src.repartitionByRange(common.salts(docs), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "t1", "t2").select("doc_id", "text")

    def run(batches):
        enc = tokens.encoder(tokenizer, spaced)
        uri, out = f"{folder}/{uuid.uuid4().hex}.pfor", None
        end = np.array([end_id], enc.dtype)
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                out = out or Writer(uri)
                out.add(i, np.concatenate([np.frombuffer(raw, enc.dtype), end]))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([out.n])], names=["uri", "n_ids"])

    return common.written(src.mapInArrow(run, "uri string, n_ids long").withColumn("part", F.spark_partition_id()), "token-manifest")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = files.sparkSession
    rows, at = [], 0
    for r in files.orderBy("part").collect():  # one row per file
        rows.append((r["uri"], at))
        at += r["n_ids"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    schema = ", ".join(f"{n} long" for n in names)
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "uri string, base long").repartition(len(rows))

    def run(batches):
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: list[list] = [[] for _ in names]
                for i, first, ids in read_documents(uri):
                    for x, v in zip(out, (i, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        x.append(v)
                    if len(out[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)
                        out = [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    return listed.mapInArrow(run, schema)


def token_documents(docs: DataFrame) -> DataFrame:
    """Write with the 50k byte vocabulary and end id 0, then read back."""
    return read_files(write_files(docs, tokens.tokenizer_path("byte_bpe_50k.json"), 0, True))
