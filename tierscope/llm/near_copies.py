"""Near copies at a Jaccard similarity: SimHash candidates, exact check.

A pair at the similarity differs in many of 64 bits, so this use of the SimHash
index takes 256-bit fingerprints of word 5-grams, tables of sampled bits, and a
radius that most such pairs keep to. The number of sampled bits follows the number
of documents, and the number of tables follows the bits and the spread of the
differing bits, so that a pair *at* the similarity is missed, by the radius or by
all tables, with a probability of at most ``MISS``; more similar pairs are missed
far less often. Fingerprints of few 5-grams differ more than that, so pairs of
which one text has at most ``SHORT`` different 5-grams are found exactly, by the
prefixes of their sorted gram hashes. Candidate links only say which documents
must be looked at together: within a class of such links, all pairs are compared
by their whole 5-gram sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm import common, simhash

WIDTH, SIMILARITY, WORDS, RADIUS, MISS = 5, 0.8, 4, 58, 0.005
#: Pairs whose smaller set has at most this many grams don't rely on fingerprints.
SHORT = 32
#: Largest share of bits in which a longer pair at the similarity differs on average.
APART = 0.1552


def longest_partner(n: int) -> int:
    """Grams that a set can have at most to be close to one of n."""
    return math.floor(n / SIMILARITY + 1e-9)


def missed(apart: float, bits: int, tables: int) -> float:
    """Probability that a pair whose bits differ with probability ``apart`` is
    beyond the radius or meets in none of the tables."""
    total, out = 64 * WORDS, 0.0
    for k in range(total + 1):
        meets = math.comb(total - k, bits) / math.comb(total, bits) if k <= RADIUS else 0.0
        out += math.comb(total, k) * apart**k * (1 - apart) ** (total - k) * (1 - meets) ** tables
    return out


def tables_for(n: int) -> list[list[int]]:
    """Sampled bits for n documents: groups stay small, and misses rare."""
    bits = max(12, math.ceil(math.log2(max(n, 2))) - 6)
    low, high = 0, 1
    while missed(APART, bits, high) > MISS:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if missed(APART, bits, mid) > MISS else (low, mid)
    return simhash.sampled_tables(bits, high, 64 * WORDS)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, fp, size (of the 5-gram set) and, for sets that a short one
    can be close to, the sorted set (grams)."""
    common.tune(docs.sparkSession)

    def run(batches):
        names = ["doc_id", "t1", "t2", "fp", "size", "grams"]
        for b in batches:
            sets = [np.unique(simhash.shingle_hashes(simhash.words_of(t), WIDTH)) for t in b.column(3).to_pylist()]
            fp = [simhash.fingerprint(x, WORDS).tobytes() for x in sets]
            grams = [x.tobytes() if len(x) <= longest_partner(SHORT) else None for x in sets]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(fp, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(grams, pa.binary())], names=names)

    src = docs.select("doc_id", "t1", "t2", F.col("text").cast("string").alias("text"))
    schema = src.select("doc_id", "t1", "t2", F.lit(b"").alias("fp"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("grams")).schema
    return src.mapInArrow(run, schema)


def short_links(texts: DataFrame, cap: int = 4_000) -> DataFrame:
    """Links (a, b) that span all close pairs of the given texts (node, grams).

    Two close sets of n and m grams share at least ``SIMILARITY`` of either, so
    their least shared gram is among the first n - ceil(SIMILARITY * n) + 1 of
    one and the like of the other: one row for each of these grams lets every
    such pair meet. Keys with over ``cap`` rows are cut into chunks of which
    every pair is compared.
    """

    def spread(batches):
        for b in batches:
            keys, at, raw = [], [], b.column(1).to_pylist()
            for i, x in enumerate(raw):
                g = np.frombuffer(x, np.int64)
                first = g[: len(g) - math.ceil(SIMILARITY * len(g) - 1e-9) + 1] if len(g) else np.zeros(1, np.int64)
                keys.append(first), at.append(np.full(len(first), i))
            if keys:
                at = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), b.column(0).take(at), b.column(1).take(at)], names=["key", "node", "grams"])

    rows = texts.select("node", "grams").mapInArrow(spread, "key long, node long, grams binary")
    rows = common.in_blocks(rows, ["key"], "node", cap)
    groups = max(common.salts(texts), texts.count() // 2_000 + 1)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(groups)))

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        pdf = pdf[pdf.duplicated(["key", "bi", "bj"], keep=False)]
        for _, g in pdf.groupby(["key", "bi", "bj"], sort=False):
            label = linked([np.frombuffer(x, np.uint64) for x in g["grams"]])
            far, node = label != np.arange(len(g)), g["node"].to_numpy()
            a.append(node[far]), b.append(node[label[far]])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"a": cat(a), "b": cat(b)})

    return rows.groupBy("bucket").applyInPandas(links, "a long, b long")


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Class labels (least position) of sets with a Jaccard similarity of at
    least ``similarity``; empty sets are equal."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.arange(m)
    empty = np.flatnonzero(size == 0)
    if len(empty) > 1:
        label = simhash.merge_labels(label, empty[1:], np.full(len(empty) - 1, empty[0]))
    owner = np.repeat(np.arange(m), size)
    values, ids = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    post, ptr = owner[order], np.searchsorted(ids[order], np.arange(len(values) + 1))
    at = np.cumsum(size) - size
    for i in range(m):
        mine = ids[at[i] : at[i] + size[i]]
        n = ptr[mine + 1] - ptr[mine]
        ends = np.cumsum(n)
        if not len(ends):
            continue
        who = post[np.repeat(ptr[mine] - ends + n, n) + np.arange(ends[-1])]
        both = np.bincount(who, minlength=m)[:i]
        close = np.flatnonzero(both * (1 + similarity) >= similarity * (size[:i] + size[i]) - 1e-9)
        close = close[both[close] > 0]
        if len(close):
            label = simhash.merge_labels(label, close, np.full(len(close), i))
    return label


def near_classes(docs: DataFrame, cap: int = 4_000) -> DataFrame:
    """(t1, t2, least, root): per different text its least doc_id and its class.

    docs has doc_id, t1, t2 and text. Candidate classes over ``cap`` texts are
    cut into chunks of which every pair is compared.
    """
    fps = common.written(described(docs), "near-fps")
    texts = fps.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("fp", "size", "grams")])
    texts = common.written(texts.withColumn("node", F.xxhash64("t1", "t2")), "near-texts")
    loose = simhash.gray_links(texts.where(F.col("size") > SHORT).select("node", "fp"), RADIUS, tables_for(texts.count()), WORDS)
    loose = loose.union(short_links(texts.where("grams IS NOT NULL"), cap))
    loose = common.connected(loose, "near-loose")
    together = loose.union(loose.select(F.col("root").alias("node"), "root")).distinct()
    wanted = texts.join(together, "node").select("node", "root", "least", "t1", "t2")
    d, w = docs.alias("d"), wanted.alias("w")
    same = [F.col("d.t1") == F.col("w.t1"), F.col("d.t2") == F.col("w.t2"), F.col("d.doc_id").eqNullSafe(F.col("w.least"))]

    def sets(batches):
        for b in batches:
            x = [np.unique(simhash.shingle_hashes(simhash.words_of(t), WIDTH)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["node", "root", "grams"])

    rows = d.join(w, same).select("w.node", "w.root", "d.text").mapInArrow(sets, "node long, root long, grams binary")
    rows = common.written(rows, "near-sets")
    blocks = common.in_blocks(rows, ["root"], "node", cap)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, g in pdf.groupby(["root", "bi", "bj"], sort=False):
            g = g.drop_duplicates("node")
            label = linked([np.frombuffer(x, np.uint64) for x in g["grams"]])
            far, node = label != np.arange(len(g)), g["node"].to_numpy()
            a.append(node[far]), b.append(node[label[far]])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"a": cat(a), "b": cat(b)})

    groups = max(common.salts(docs), rows.count() // 500 + 1)
    blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("root", "bi", "bj"), F.lit(groups)))
    exact = common.connected(blocks.groupBy("bucket").applyInPandas(compare, "a long, b long"), "near-exact")
    return texts.join(exact, "node", "left").select("t1", "t2", "least", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each class of near copies: that of the least
    doc_id (null ids last; then by the text's hash).

    A class links texts whose sets of lower-cased word 5-grams have a Jaccard
    similarity of 0.8 or more, directly or over others. Texts without words,
    null among them, are one class. Columns stay as they are.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    src = docs.select(row, F.col("doc_id"), F.col("text"), *common.text_hash())
    slim = src.select("doc_id", "t1", "t2", "text")
    classes = near_classes(slim)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("t1"), F.col("t2")))
    kept = classes.groupBy("root").agg(first.alias("k")).select(F.col("k.least").alias("_keep"), F.col("k.t1").alias("_k1"), F.col("k.t2").alias("_k2"))
    kept = common.written(kept, "near-kept")
    out = src.join(kept, (src["t1"] == kept["_k1"]) & (src["t2"] == kept["_k2"]) & src["doc_id"].eqNullSafe(kept["_keep"]), "left_semi")
    # rows that share the id and the text of a kept one: all but one go, too
    repeated = slim.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_d"), F.col("t1").alias("_r1"), F.col("t2").alias("_r2"))
    repeated = common.written(repeated, "near-repeated")
    if repeated.isEmpty():
        return out.select("_row.*")
    again = (out["t1"] == repeated["_r1"]) & (out["t2"] == repeated["_r2"]) & out["doc_id"].eqNullSafe(repeated["_d"])
    once = out.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "t1", "t2"])
    return out.join(repeated, again, "left_anti").union(once).select("_row.*")
