"""Sequence packing by non-negative least squares over a length histogram.

Whole windows are cut off first; what is left of each document is a remainder
shorter than the window. Only the histogram of the remainders (at most one count
per length) reaches the driver, which
  1. enumerates shallow combinations (two or three lengths) that fill a window,
  2. solves for their repeat counts, min |A x - histogram|, x >= 0,
  3. rounds them without using more remainders than there are, and
  4. packs what remains greedily: any enumerated combination that still fits,
     then the rest end to end, longest first, cut where a window is full.
So only the last sequence of all has padding. The plan maps (length, rank within
length) to (sequence, offset) and has a bounded size; each document finds its
pieces with it alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tierscope.llm import common, shared_files, tokens

WINDOW = 2048
#: Input parts whose ranks share a folder.
SLOT = 256


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """(m, 3) rows of all two or three of ``lengths`` (0: none) that add up to
    window: about window² / 12 rows at most."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    pairs = lengths[(lengths * 2 <= window) & have[window - lengths]]
    out = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1)]
    for i in lengths[lengths * 3 <= window]:
        j = lengths[(lengths >= i) & (lengths * 2 <= window - i)]
        j = j[have[window - i - j]]
        out.append(np.stack([np.full_like(j, i), j, window - i - j], 1))
    return np.concatenate(out)


def solve(combos: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients.

    Column s of A counts each length in combination s; A is never stored.
    """
    size, flat = len(counts), combos.ravel()

    def times(x: np.ndarray) -> np.ndarray:
        y = np.bincount(flat, np.repeat(x, 3), size)
        y[0] = 0
        return y

    def transposed(y: np.ndarray) -> np.ndarray:
        return y[combos].sum(1)

    target = counts.astype(float)
    target[0] = 0
    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        u = transposed(times(v))
        norm = np.linalg.norm(u)
        v = u / max(norm, 1e-300)
    step = 1 / (norm * 1.01 + 1e-12)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - step * transposed(times(y) - target))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = z + (t - 1) / s * (z - x), z, s
    return x


class Plan:
    """Where the r-th remainder of each length goes; see ``place``."""

    def __init__(self, counts: np.ndarray, window: int = WINDOW):
        self.window = window
        left = counts.astype(np.int64).copy()
        left[0] = 0
        combos = combinations(np.flatnonzero(left), window)
        repeats = np.zeros(len(combos), np.int64)
        if len(combos):
            x = solve(combos, left)
            avail = left.tolist()

            def take(s: int, most: int) -> None:
                need = [k for k in combos[s].tolist() if k]
                n = min(most, *(avail[k] // need.count(k) for k in need))
                if n > 0:
                    repeats[s] += n
                    for k in need:
                        avail[k] -= n

            for s in np.argsort(-x, kind="stable")[: int((x >= 1).sum())]:
                take(s, int(x[s]))
            part = x - np.floor(x)
            for s in np.argsort(-part, kind="stable")[: int((part > 1e-9).sum())]:
                take(s, 1)
            # then any combination that still fits, those with the largest share first
            order = np.argsort(-x, kind="stable")
            have = np.array(avail, np.int64)
            have[0] = 1 << 60
            for s in order[(have[combos[order]] > 0).all(1)]:
                take(s, 1 << 60)
            left = np.array(avail, np.int64)
        used = np.flatnonzero(repeats)
        base = np.cumsum(repeats[used]) - repeats[used]
        self.whole = int(repeats.sum())  # sequences filled by combinations
        slots: dict[int, list[tuple[int, int, int]]] = {}
        for s, b in zip(used, base, strict=True):
            at = 0
            for k in combos[s].tolist():
                if k:
                    slots.setdefault(k, []).append((int(repeats[s]), int(b), at))
                    at += k
        self.slots = {}
        for k, rows in slots.items():
            n, b, at = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            self.slots[k] = (np.cumsum(n), np.cumsum(n) - n, b, at)
        # the rest end to end, longest first: where each length begins
        order = np.flatnonzero(left)[::-1]
        ends = np.cumsum(order * left[order])
        self.rest = dict(zip(order.tolist(), (ends - order * left[order]).tolist(), strict=True))
        self.tail = int(ends[-1]) if len(ends) else 0

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the one or two pieces of a remainder."""
        taken = 0
        if length in self.slots:
            ends, starts, base, at = self.slots[length]
            taken = int(ends[-1])
            if rank < taken:
                i = int(np.searchsorted(ends, rank, "right"))
                return [(int(base[i] + rank - starts[i]), int(at[i]), length)]
        pos = self.rest[length] + (rank - taken) * length
        seq, off = self.whole + pos // self.window, pos % self.window
        first = min(length, self.window - off)
        return [(seq, off, first)] + [(seq + 1, 0, length - first)] * (first < length)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, spaced: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null or empty text is its end id alone. Repeated rows are packed each.
    Sequences hold ``window`` ids without gaps, except one last sequence.
    """
    spark = docs.sparkSession
    common.tune(spark)

    def encode(batches):
        enc = tokens.encoder(tokenizer, spaced)
        end, size = np.array([end_id], enc.dtype).tobytes(), np.dtype(enc.dtype).itemsize
        full_before, seen = 0, np.zeros(window, np.int64)
        for b in batches:
            ids = [x + end for x in enc.encode(b.column(1).to_pylist())]
            n = [len(x) // size for x in ids]
            before, ranks = [], []
            for k in n:
                before.append(full_before), ranks.append(int(seen[k % window]))
                full_before += k // window
                seen[k % window] += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array(ranks, pa.int64()), pa.array([size] * len(n), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "n", "full_before", "rank", "size", "ids"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = src.mapInArrow(encode, "doc_id long, n long, full_before long, rank long, size int, ids binary").withColumn("part", F.spark_partition_id())
    table = common.written(table, "tokens").withColumn("rem", F.col("n") % window)
    # counts per part and length; at most one histogram per input part
    cells = common.written(table.groupBy("part", "rem").agg(F.count("*").alias("c"), F.max(F.col("full_before") + (F.col("n") / window).cast("long")).alias("f")), "cells")
    counts = np.zeros(window, np.int64)
    for rem, c in cells.groupBy("rem").agg(F.sum("c")).collect():  # at most ``window`` rows
        counts[rem] = c
    plan = spark.sparkContext.broadcast(Plan(counts, window))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    fulls = cells.groupBy("part").agg(F.max("f").alias("f"))
    total_full = fulls.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    fulls = fulls.select("part", F.coalesce(F.sum("f").over(before.orderBy("part")), F.lit(0)).alias("full_base"))
    bases = cells.select("part", "rem", F.coalesce(F.sum("c").over(before.partitionBy("rem").orderBy("part")), F.lit(0)).alias("base")).join(fulls, "part")
    # ranks of a part's first remainders: a row for each part and length, which grow
    # with the input. They aren't joined or broadcast: a task reads those of its parts
    # from the shared folder, one folder for a bounded number of parts.
    folder = common.fresh_dir(spark, "bases")
    bases.withColumn("slot", (F.col("part") / SLOT).cast("int")).repartition("slot").write.partitionBy("slot").parquet(folder)

    def bases_of(part: int) -> tuple[int, dict[int, int]]:
        import pyarrow.parquet as pq

        fs, path = shared_files.file_system(f"{folder}/slot={part // SLOT}")
        rows = pq.read_table(path, columns=["rem", "base", "full_base"], filesystem=fs, filters=[("part", "=", part)], partitioning=None)
        return rows.column("full_base")[0].as_py(), dict(zip(rows.column("rem").to_pylist(), rows.column("base").to_pylist(), strict=True))

    def pieces(batches):
        p, names = plan.value, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        now, base, full_base = None, {}, 0
        for b in batches:
            rows: list[list[int]] = [[] for _ in names]
            for doc, n, full, rank, size, raw, part, rem in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if part != now:
                    now, (full_base, base) = part, bases_of(part)
                full, rank = full + full_base, rank + base[rem]
                ids, at = np.frombuffer(raw, np.uint16 if size == 2 else np.uint32).astype("<u4"), 0
                where = [(full + i, 0, window) for i in range(n // window)]
                if n % window:
                    where += [(total_full + s, o, k) for s, o, k in p.place(n % window, rank)]
                for seq, off, k in where:
                    for out, v in zip(rows, (doc, at, k, zlib.crc32(ids[at : at + k].tobytes()), n, seq, off), strict=True):
                        out.append(v)
                    at += k
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=names)

    return table.select("doc_id", "n", "full_before", "rank", "size", "ids", "part", "rem").mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    """``pack`` with the 49k word vocabulary, end id 1 and windows of 2048."""
    return pack(docs, tokens.tokenizer_path("word_bpe_49k.json"))
