"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are sorted by their rank in the Gray code, so neighbours differ in
few bits. Runs of neighbours hang below a node that keeps the bits on which the
whole run agrees (mask and pattern); parents factor out what their children
share. A query adds up its differences on the way down, each bit counted once at
the highest node that fixes it, and a node past the radius drops its whole run.

Distribution: the top of the index is the set of tables, each keyed by some bits
of the fingerprint. A pair within the radius agrees on all bits of at least one
table (for three disjoint segments and radius 2 always; for sampled bits with
a stated probability), so it meets in one group; each group builds the lower
levels and reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm import common

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Words of a text that are hashed at once.
PIECE = 1 << 16
SEGMENTS = [list(range(0, 21)), list(range(21, 42)), list(range(42, 64))]


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased runs of bytes other than ASCII white space."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    digest, out = xxhash.xxh64_intdigest, []
    if len(words) <= width:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    for lo in range(0, len(words) - width + 1, PIECE):
        part = words[lo : lo + PIECE + width - 1]
        out.append(np.fromiter((digest(b" ".join(x), 42) for x in zip(*(part[i:] for i in range(width)), strict=False)), np.uint64))
    return np.concatenate(out)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash made from h (the first is h itself)."""
    if not k:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(h: np.ndarray, n_words: int = 1) -> np.ndarray:
    """Bits set in over half of the hashes, as n_words 64-bit words."""
    out = np.zeros(n_words, np.uint64)
    for k in range(n_words if len(h) else 0):
        b = np.ascontiguousarray(_mixed(h, k)).view(np.uint8).reshape(-1, 8)
        if len(h) <= 256:
            ones = np.unpackbits(b, axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            ones = np.concatenate([np.bincount(np.ascontiguousarray(b[:, i]), minlength=256) @ _BITS for i in range(8)])
        out[k] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, width: int = 3, n_words: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``: n_words little-endian 64-bit words (binary)."""
    common.tune(docs.sparkSession)
    src = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = src.select(*keep, F.lit(b"").alias("fp")).schema

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            fp = [fingerprint(shingle_hashes(words_of(t), width), n_words).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(fp, pa.binary())], names=[*keep, "fp"])

    return src.mapInArrow(run, schema)


# ---- the index within one group -------------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Rank words of (n, w) fingerprints in the reflected Gray code."""
    out, odd = np.empty_like(fp), np.zeros(len(fp), bool)
    for k in range(fp.shape[1]):
        g = fp[:, k].copy()
        for s in (1, 2, 4, 8, 16, 32):
            g ^= g >> np.uint64(s)
        g[odd] ^= FULL
        out[:, k] = g
        odd = (g & np.uint64(1)).astype(bool)
    return out


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int32)


def build(fp: np.ndarray, fan: int = 16) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the leaves up: (pattern, mask) of every node, fan children each."""
    every, some = fp, fp
    levels = [(fp, np.full_like(fp, FULL))]
    while len(every) > fan:
        at = np.arange(0, len(every), fan)
        every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
        mask = ~(every ^ some)
        levels.append((every & mask, mask))
    return levels


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the classes of a[i] and b[i]; labels are the least member."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        lo = np.minimum(x, y)
        np.minimum.at(label, x, lo)
        np.minimum.at(label, y, lo)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def link_group(fp: np.ndarray, radius: int, fan: int = 16, block: int = 256) -> np.ndarray:
    """Class labels (least position) of rows linked within ``radius`` bits."""
    order = np.lexsort(gray_rank(fp).T[::-1])
    s, m = fp[order], len(fp)
    levels = build(s, fan)
    label = np.arange(m)
    step = block if fp.shape[1] == 1 else max(16, block // 4)
    for lo in range(0, m, step):
        hi = min(lo + step, m)
        top, (pattern, mask) = len(levels) - 1, levels[-1]
        q = np.repeat(np.arange(lo, hi), len(pattern))
        node = np.tile(np.arange(len(pattern)), hi - lo)
        diff = _count((s[q] ^ pattern[node]) & mask[node])
        for level in range(top, -1, -1):
            keep = (diff <= radius) & ((node + 1) * fan**level - 1 > q)
            q, node, diff = q[keep], node[keep], diff[keep]
            if not level or not len(q):
                break
            above = mask[node]
            pattern, mask = levels[level - 1]
            child = (node[:, None] * fan + np.arange(fan)).ravel()
            q, diff, above = np.repeat(q, fan), np.repeat(diff, fan), np.repeat(above, fan, axis=0)
            real = child < len(pattern)
            q, node, diff, above = q[real], child[real], diff[real], above[real]
            diff = diff + _count((s[q] ^ pattern[node]) & mask[node] & ~above)
        if len(q):
            label = merge_labels(label, q, node)
    out = np.empty(m, np.int64)
    # back to input positions: the class's least input position
    first = np.full(m, m)
    np.minimum.at(first, label, order)
    out[order] = first[label]
    return out


# ---- the distributed index ------------------------------------------------------


def sampled_tables(bits: int, tables: int, total: int, seed: int = 20240607) -> list[list[int]]:
    """Bit samples for fingerprints whose links differ in many bits."""
    rng = np.random.default_rng(seed)
    return [sorted(int(x) for x in rng.choice(total, bits, replace=False)) for _ in range(tables)]


def _keys(fp: np.ndarray, tables: list[list[int]]) -> list[np.ndarray]:
    out = []
    for j, bits in enumerate(tables):
        v = np.zeros(len(fp), np.uint64)
        for b in bits:
            v = (v << np.uint64(1)) | ((fp[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1))
        out.append((v * np.uint64(len(tables)) + np.uint64(j)).view(np.int64))
    return out


def gray_links(nodes: DataFrame, radius: int = 2, tables: list[list[int]] = SEGMENTS, n_words: int = 1, cap: int = 20_000, group_rows: int = 20_000) -> DataFrame:
    """Spanning links (a, b) of nodes (node long, fp binary) within ``radius`` bits.

    Nodes should have distinct fingerprints. Groups of one key with over
    ``cap`` rows are cut into chunks whose pairs are all compared.
    """
    n_tables = len(tables)

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, raw = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            fp = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, n_words)
            fpa = pa.array(raw, pa.binary())
            for key in _keys(fp, tables):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), fpa], names=["key", "node", "fp"])

    rows = nodes.select("node", "fp").mapInArrow(spread, "key long, node long, fp binary")
    rows = common.in_blocks(rows, ["key"], "node", cap)
    total = nodes.count() * n_tables
    groups = max(common.salts(nodes), total // group_rows + 1)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(groups)))

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "bi", "bj", "node"], kind="stable")
        k = pdf[["key", "bi", "bj"]].to_numpy()
        node = pdf["node"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)]) if len(k) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(k)]
        a, b, raw = [], [], pdf["fp"].to_numpy()
        for lo, hi in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            fp = np.frombuffer(b"".join(raw[lo:hi]), np.uint64).reshape(-1, n_words)
            if hi - lo == 2:
                if int(np.bitwise_count(fp[0] ^ fp[1]).sum()) <= radius:
                    a.append(node[lo : lo + 1]), b.append(node[lo + 1 : lo + 2])
                continue
            label = link_group(fp, radius)
            far = label != np.arange(hi - lo)
            a.append(node[lo:hi][far]), b.append(node[lo:hi][label[far]])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"a": cat(a), "b": cat(b)})

    return rows.select("bucket", "key", "bi", "bj", "node", "fp").groupBy("bucket").applyInPandas(links, "a long, b long").where("a <> b")


def simhash_classes(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Texts are taken whole; null counts as empty and gets fingerprint zero, which
    links like any other. component_id is the least doc_id reachable (null ids
    are passed over; null if a component has no id). Repeated rows stay.
    """
    ids = docs.select("doc_id", "text")
    fps = common.written(fingerprints(ids, width), "simhash")
    # little-endian bytes to a long: reverse the hex digits by pairs
    hexes = F.hex("fp")
    big = F.lower(F.concat(*[F.substring(hexes, 2 * i + 1, 2) for i in range(7, -1, -1)]))
    fps = fps.select("doc_id", "fp", F.xxhash64("fp").alias("node"), big.alias("fingerprint"))
    distinct = common.written(fps.groupBy("fp", "node").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = common.connected(gray_links(distinct, radius), "simhash-cc")
    named = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fingerprint", "component_id")
