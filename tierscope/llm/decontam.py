"""Benchmark decontamination: BM25 over test items, searched with block-max WAND.

The index holds the test items. A term's weight for an item is its BM25 weight,
divided by the sum of the item's own, so an item that a passage covers whole
scores 1 whatever its length. Postings are in item order, in blocks, each with
its largest weight; blocks of all terms cover the same ranges of items. A term
also has a bound over its whole list.

Every training text is cut into passages of two steps that overlap by one, so any
item of up to a step's words lies whole in some passage; longer items have an index
of their own with larger steps. Every passage is a query, for *all* items that reach
the threshold:
  1. For all passages of a batch at once: where the list bounds of all terms of a
     passage don't reach the threshold, no pivot exists. Terms up to which the
     sorted bounds don't reach it can't make a pivot either, so only blocks of the
     others are looked up, and their block maxima, with what the passage's other
     terms can add there, leave the few blocks in which an item could reach the
     threshold. No posting is read so far.
  2. A passage with such blocks is searched by block-max WAND within them: the
     cursors are ordered by their items, the pivot is the first item at which the
     list bounds add up to the threshold; if the block maxima there don't, all
     cursors go on behind the block; else they are brought to the pivot, and an
     item that all of them reach is scored in full.
A hit counts if the passage's words also hold most of the word 5-grams of the
item's question and of its answer.

The index goes to the executors in parts of a bounded size: a larger benchmark
is searched in several passes, each with one part. The driver holds one part at a
time, and its broadcast is destroyed when the pass is written.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm import common

#: BM25 constants; least step of passages in words; least score; least share of
#: the 5-grams of question and answer; items per block; bytes of items per pass;
#: words that are searched at once; sums that are made at once.
K1, B, STEP = 1.2, 0.75, 64
SCORE, OVERLAP, GRAM, BLOCK, PART_BYTES, AT_ONCE, CELLS = 0.6, 0.6, 5, 4, 16 << 20, 1 << 17, 1 << 20
HIT = "item_id: bigint, passage: bigint, score: double, question_overlap: double, answer_overlap: double"
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def halves(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the last sentence is the answer; of a single
    sentence, its last third."""
    parts = [w for w in (words_of(x) for x in re.split(r"[.?!]\s+", text.strip())) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def grams(words: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def step_for(n_words: int) -> int:
    """Step of the passages for items of so many words: a power of two."""
    return max(STEP, 1 << (n_words - 1).bit_length() if n_words else 1)


class Index:
    """Inverted index of (item_id, text) pairs, with document frequencies ``df``
    (by word) over ``n`` items of mean length ``mean``."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, mean: float, threshold: float = SCORE, step: int = STEP):
        self.threshold, self.step = threshold, step
        self.items, self.parts, self.length, self.full = [], [], [], []
        weights: list[dict[str, float]] = []
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            tf: dict[str, int] = defaultdict(int)
            for w in words:
                tf[w] += 1
            norm = K1 * (1 - B + B * len(words) / mean)
            raw = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            total = sum(raw.values())
            weights.append({w: float(v / total) for w, v in raw.items()})
            q, a = halves(text)
            self.items.append(item)
            self.parts.append((q, a, grams(q), grams(a)))
            self.length.append(len(words))
        top: dict[str, float] = defaultdict(float)
        for x in weights:
            for w, v in x.items():
                top[w] = max(top[w], v)
        # terms are numbered by their bounds
        self.terms = {w: i for i, w in enumerate(sorted(top, key=lambda w: (top[w], w)))}
        self.weights = [{self.terms[w]: v for w, v in x.items()} for x in weights]
        self.top = np.array(sorted(top.values()))
        self.n_blocks = -(-len(weights) // BLOCK)
        cells = sorted((t, i, v) for i, x in enumerate(self.weights) for t, v in x.items())
        term, self.post = (np.array([c[k] for c in cells], np.int64) for k in (0, 1))
        self.gain = np.array([c[2] for c in cells])
        self.ptr = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # a row for each term and block: term * n_blocks + block, and the largest weight
        block = term * max(1, self.n_blocks) + self.post // BLOCK
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        self.block, self.block_max = block[first], np.maximum.reduceat(self.gain, first) if len(first) else np.zeros(0)
        self.block_ptr = np.searchsorted(self.block, np.arange(len(self.terms) + 1) * max(1, self.n_blocks))
        # the same as a table, if it isn't large: looked up faster
        self.table = None
        if len(self.terms) * self.n_blocks <= 4 * CELLS:
            self.table = np.zeros(len(self.terms) * self.n_blocks)
            self.table[self.block] = self.block_max
        self.stats = {"postings": 0, "read": 0, "passages": 0, "searched": 0}

    def _block_max(self, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        key = term * self.n_blocks + block
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.block, key), len(self.block) - 1)
        return np.where(self.block[at] == key, self.block_max[at], 0.0)

    def _open_blocks(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block): where an item could reach the threshold. The pairs given
        are distinct and in order, so a passage's terms are in order of their bounds."""
        least, none = self.threshold - 1e-9, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not len(term):
            return none
        start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        size = np.diff(np.r_[start, len(term)])
        total = np.cumsum(self.top[term])
        total -= np.repeat((total - self.top[term])[start], size)
        heavy = total >= least
        light = np.repeat(np.add.reduceat(np.where(heavy, 0, self.top[term]), start), size)
        at, t = np.flatnonzero(heavy), term[heavy]
        n = self.block_ptr[t + 1] - self.block_ptr[t]
        done = np.r_[0, np.cumsum(n)]
        # sums by passage and block, for as many passages at once as have a bounded
        # number of sums and of terms in blocks
        local = np.searchsorted(start, at, "right") - 1
        edge = np.searchsorted(local, np.arange(len(start) + 1))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        lo = 0
        while lo < len(start):
            hi = int(np.searchsorted(done[edge], done[edge[lo]] + CELLS, "right")) - 1
            hi = max(lo + 1, min(hi, lo + max(1, CELLS // self.n_blocks), len(start)))
            a, z = int(edge[lo]), int(edge[hi])
            m = n[a:z]
            row = np.repeat(self.block_ptr[t[a:z]] - (done[a:z] - done[a]), m) + np.arange(done[z] - done[a])
            cell = np.repeat((local[a:z] - lo) * self.n_blocks - t[a:z] * self.n_blocks, m) + self.block[row]
            bound = np.bincount(cell, self.block_max[row], (hi - lo) * self.n_blocks).reshape(hi - lo, self.n_blocks)
            some, b = np.nonzero((bound > 0) & (bound + light[start[lo:hi], None] >= least))
            found.append((some + lo, b))
            lo = hi
        k, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(k):
            return none
        p = passage[start[k]]
        # the same with the block maxima of all terms
        ends = np.cumsum(size[k])
        at = np.repeat(start[k] - ends + size[k], size[k]) + np.arange(ends[-1])
        bound = np.add.reduceat(self._block_max(term[at], np.repeat(b, size[k])), ends - size[k])
        return p[bound >= least], b[bound >= least]

    def _wand(self, terms: list[int], blocks: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items in the blocks that reach the threshold."""
        least, out, post, gain = self.threshold - 1e-9, [], self.post, self.gain
        for block in blocks:
            lo, hi = block * BLOCK, (block + 1) * BLOCK
            cursors = []  # [item, position, end, bound]; a list's bound here is its block's
            for t in terms:
                a, z = int(self.ptr[t]), int(self.ptr[t + 1])
                a = a + bisect_left(post[a:z], lo)
                e = a + bisect_left(post[a:z], hi)
                if a < e:
                    cursors.append([int(post[a]), a, e, float(gain[a:e].max())])
            while cursors:
                cursors.sort()
                bound, pivot = 0.0, None
                for c in cursors:
                    bound += c[3]
                    if bound >= least:
                        pivot = c[0]
                        break
                if pivot is None:
                    break
                if cursors[0][0] == pivot:  # all cursors up to the pivot stand there
                    here = [c for c in cursors if c[0] == pivot]
                    self.stats["read"] += len(here)
                    score = sum(float(gain[c[1]]) for c in here)
                    if score >= least:
                        out.append((pivot, score))
                    target = pivot + 1
                else:
                    target = pivot
                for c in cursors:
                    if c[0] < target:
                        c[1] += bisect_left(post[c[1] : c[2]], target)
                        c[0] = int(post[c[1]]) if c[1] < c[2] else -1
                cursors = [c for c in cursors if c[0] >= 0]
        return out

    def search(self, texts: list[list[str]]) -> list[list[tuple[int, int, float]]]:
        """For each text: (item position, first word of the passage, score) of all
        items at the threshold."""
        found: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        if not self.items:
            return found
        # runs of texts of a bounded number of words; longer texts in slices that
        # overlap by a step, as passages do
        most = max(1, AT_ONCE // self.step) * self.step
        run: list[tuple[int, int, list[str], bool]] = []
        size = 0
        for d, words in enumerate(texts):
            for lo in range(0, max(1, len(words)), most):
                part = words[lo : lo + most + self.step] if len(words) > most else words
                if run and size + len(part) > most:
                    self._search(run, found)
                    run, size = [], 0
                run.append((d, lo, part, lo + most < len(words)))
                size += len(part)
        self._search(run, found)
        return found

    def _search(self, run: list[tuple[int, int, list[str], bool]], found: list[list[tuple[int, int, float]]]) -> None:
        get, step = self.terms.get, self.step
        ids = [np.fromiter((get(w, -1) for w in x), np.int64, len(x)) for _, _, x, _ in run]
        if not ids:
            return
        count = np.array([max(1, -(-len(x) // step)) for x in ids])
        first = np.cumsum(count) - count
        t = np.concatenate(ids)
        where = np.concatenate([np.arange(len(x)) // step + f for x, f in zip(ids, first, strict=True)])
        known = t >= 0
        t, where = t[known], where[known]
        begins = np.zeros(int(count.sum()) + 1, bool)
        begins[first] = True
        # a word is in the passage that starts in its step and in the one before
        back = ~begins[where]
        key = np.unique(np.r_[where, where[back] - 1] * len(self.terms) + np.r_[t, t[back]]) if len(t) else np.zeros(0, np.int64)
        passage, term = key // max(1, len(self.terms)), key % max(1, len(self.terms))
        p, b = self._open_blocks(passage, term)
        self.stats["passages"] += int(count.sum())
        self.stats["postings"] += int((self.ptr[term + 1] - self.ptr[term]).sum())
        ends = np.flatnonzero(np.r_[p[1:] != p[:-1], True]) if len(p) else np.zeros(0, np.int64)
        lo = 0
        for hi in (ends + 1).tolist():
            one = int(p[lo])
            k = int(np.searchsorted(first, one, "right")) - 1
            d, offset, _, cut = run[k]
            if not (cut and one - first[k] == count[k] - 1):  # that one is the next slice's first
                a, z = np.searchsorted(passage, [one, one + 1])
                self.stats["searched"] += 1
                found[d] += [(i, offset + int(one - first[k]) * step, score) for i, score in self._wand(term[a:z].tolist(), b[lo:hi].tolist())]
            lo = hi

    def verified(self, words: list[str], hits: list[tuple[int, int, float]], overlap: float = OVERLAP) -> list[tuple]:
        """Hits whose question and answer both overlap, the best of each item."""
        best: dict[int, tuple] = {}
        for i, lo, score in hits:
            _, _, question, answer = self.parts[i]
            around = words[max(0, lo - self.length[i]) : lo + 2 * self.step + self.length[i]]
            near = grams(around)
            share = []
            for part in (question, answer):
                n = len(next(iter(part))) if part else GRAM
                have = near if n == GRAM else grams(around, n)
                share.append(len(part & have) / len(part) if part else 1.0)
            if min(share) >= overlap and (i not in best or score > best[i][2]):
                best[i] = (self.items[i], lo, score, *share)
        return list(best.values())


def _parts(benchmark: DataFrame, part_bytes: int) -> tuple[int, Iterator[tuple[list[tuple[int, str]], dict[str, int], int, float]]]:
    """The number of parts, and items in parts of bounded bytes, one at a time, with
    the frequencies of their words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    items = common.written(items.distinct(), "items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = int(size // part_bytes) + 1
    words = items.select("item_id", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("w"))
    df = common.written(words.groupBy("w").agg(F.count("*").alias("n")), "item-words") if n_parts > 1 else None
    stats = items.agg(F.count("*"), F.avg(F.size(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0))))).first()

    def each():
        for k in range(n_parts):
            rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == k).orderBy("item_id", "text").collect()]  # about part_bytes
            mine = {w for _, x in rows for w in words_of(x)}
            if df is None:
                count: dict[str, int] = defaultdict(int)
                for _, text in rows:
                    for w in set(words_of(text)):
                        count[w] += 1
            else:
                listed = items.sparkSession.createDataFrame([(w,) for w in sorted(mine)], "w string")
                count = dict.fromkeys(mine, 1) | {w: n for w, n in df.join(F.broadcast(listed), "w").collect()}  # words of one part
            yield rows, dict(count), stats[0], max(stats[1] or 1.0, 1.0)

    return n_parts, each()


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = SCORE, overlap: float = OVERLAP, part_bytes: int = PART_BYTES) -> DataFrame:
    """The columns of docs and ``leaks``: verified hits of each row, an array of
    (item_id, passage, score, question_overlap, answer_overlap), by item_id.

    ``passage`` is the number of the word at which the passage starts. Null and
    empty texts and items have no hits. Items with the same id and text count
    once; items that share an id are searched each. Repeated rows stay. A column
    of docs that is called leaks is replaced; others keep their names and values.
    """
    spark = docs.sparkSession
    common.tune(spark)
    names = [c for c in docs.columns if c != "leaks"]
    kind, none = f"array<struct<{HIT}>>", F.array().cast(f"array<struct<{HIT}>>")
    fields = [f.split(":")[0] for f in HIT.split(", ")]
    n_parts, parts = _parts(benchmark, part_bytes)

    def searched(src: DataFrame, part) -> tuple[DataFrame, object]:
        """src (its last column the text), that column replaced by the hits."""
        rows, df, n, mean = part
        steps: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for r in rows:
            steps[step_for(len(words_of(r[1])))].append(r)
        index = spark.sparkContext.broadcast([Index(x, df, n, mean, threshold, k) for k, x in sorted(steps.items())])
        last = src.columns[-1]

        def run(batches):
            for b in batches:
                words = [words_of(t) for t in b.column(b.num_columns - 1).to_pylist()]
                leaks: list[list[dict]] = [[] for _ in words]
                for one in index.value:
                    for h, w, hits in zip(leaks, words, one.search(words), strict=True):
                        if hits:
                            h += [dict(zip(fields, x, strict=True)) for x in one.verified(w, hits, overlap)]
                column = pa.array([sorted(x, key=lambda y: (y["item_id"] is None, y["item_id"], y["passage"])) for x in leaks], pa.list_(pa.struct([("item_id", pa.int64()), ("passage", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], column], schema=pa.schema([*(b.schema.field(i) for i in range(b.num_columns - 1)), pa.field("leaks", column.type)]))

        return src.mapInArrow(run, src.drop(last).withColumn("leaks", F.lit(None).cast(kind)).schema), index

    text = F.col("text").cast("string")
    if n_parts == 1:
        row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
        return searched(docs.select(row, text.alias("text")), next(parts))[0].select("row.*", "leaks")
    # several parts: the hits of each different text, part by part
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], *[h.alias(f"_leaks_{i}") for i, h in enumerate(common.text_hash())])
    every = None
    for part in parts:
        hits, index = searched(docs.select(*common.text_hash(), text.alias("text")), part)
        hits = common.written(hits.where(F.size("leaks") > 0).dropDuplicates(["t1", "t2"]), "hits")
        index.destroy()
        every = hits if every is None else every.union(hits)
    every = every.groupBy(F.col("t1").alias("_leaks_0"), F.col("t2").alias("_leaks_1")).agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    return common.join_few(keyed, common.written(every, "leaks"), ["_leaks_0", "_leaks_1"]).select(*[F.col(f"`{c}`") for c in names], F.coalesce("leaks", none).alias("leaks"))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, passage, score and overlaps of every verified hit."""
    found = contamination(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a verified hit."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return contamination(rows, benchmark).where(F.size("leaks") == 0).select("_row.*")
