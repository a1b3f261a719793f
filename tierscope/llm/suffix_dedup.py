"""Removal of long repeated byte strings with an anchored, enhanced suffix array.

1. Anchors. Each window of ``length`` bytes picks the k-gram of least hash that
   it contains (leftmost on ties), so equal windows pick the same gram at the
   same place, wherever they stand. A text of n bytes has about 2n / (length - k)
   anchors; an anchor owns a run of windows and sees just their bytes (context).
2. Anchors whose gram occurs once own no repeated window. Anchors whose whole
   context occurs again own repeated windows only. Neither needs bytes moved.
3. The remaining different contexts of a gram form a group. The group sorts the
   suffixes that start at the anchor (a sparse suffix array) with their common
   prefix lengths, and scans the array with a stack to get the interval tree.
   Each interval holds *all* occurrences that share its prefix, not only
   neighbours in the array. Within it, the occurrences are taken in the order of
   their reversed left sides, which gives the longest left extension that each
   shares with another; intervals whose occurrences all extend to the same
   window further left are not left-diverse and are left to the tree's other
   nodes. Prefix plus left extension of ``length`` or more is a maximal repeat.
4. Repeated windows per text are merged to spans and cut out.

Matches never cross documents. Everything is exact but for equality of whole
contexts by 64-bit hashes of theirs and of their grams, and of texts by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm import common

LENGTH, GRAM = 400, 64
#: Window starts that are hashed at once in a long text.
PIECE = 1 << 19
#: A passage of this many words counts as shared if another document has it, too;
#: words in the gram that anchors it.
WORDS, WORD_GRAM = 51, 8
_POS = np.uint64((1 << 21) - 1)
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_R = 0x5851F42D4C957F2D
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def _sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums of a rolling hash over 64-bit symbols."""
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _power(_R, len(x)), out=sums[1:])
    return sums


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit rolling hash of each k symbols."""
    sums = _sums(x)
    return _mixed((sums[k:] - sums[:-k]) * _power(_R_INV, len(x) - k + 1))


def word_hashes(raw: bytes, piece: int = PIECE) -> np.ndarray:
    """A 64-bit hash of each run of bytes other than ASCII white space."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        end = min(at + piece, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:  # words stay whole
            end += 1
        data = np.frombuffer(raw, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[data], True]))
        start, stop = edge[::2], edge[1::2]
        sums = _sums(_TABLE[data])
        out.append(_mixed((sums[stop] - sums[start]) * _power(_R_INV, len(data) + 1)[start]))
        at = end
    return np.concatenate(out)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by minima from the ends of blocks of w."""
    n = len(x)
    pad = np.full(-n % w, np.uint64(0xFFFFFFFFFFFFFFFF))
    b = np.concatenate([x, pad]).reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(raw: bytes | np.ndarray, length: int = LENGTH, k: int = GRAM, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(pos, first, last, gram hash): anchors with the window starts they own, of
    a string of bytes or of hashes of words.

    Where a piece ends within an anchor's windows, the anchor comes once for each
    piece, with the windows on either side.
    """
    n_windows, w, out = len(raw) - length + 1, length - k + 1, []
    for lo in range(0, max(n_windows, 0), piece):
        n = min(piece, n_windows - lo) + length - 1
        h = gram_hashes(_TABLE[np.frombuffer(raw, np.uint8, n, lo)] if isinstance(raw, bytes) else raw[lo : lo + n], k)
        at = (_window_min((h & ~_POS) | np.arange(len(h), dtype=np.uint64), w) & _POS).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        pos = at[cut]
        out.append((pos + lo, cut + lo, np.r_[cut[1:], len(at)] - 1 + lo, h[pos].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# ---- one group of contexts ---------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax())


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(i, j, depth) of the common-prefix interval tree, by a scan with a stack.

    lcp[i] is the common prefix of the suffixes of rank i - 1 and i.
    """
    out, stack, n = [], [], len(lcp)
    for i in range(1, n + 1):
        here, lo = (int(lcp[i]) if i < n else -1), i - 1
        while stack and stack[-1][0] > here:
            depth, lo = stack.pop()
            if depth >= least:
                out.append((lo, i - 1, depth))
        if here >= 0 and (not stack or stack[-1][0] < here):
            stack.append((here, lo))
    return out


def repeated_offsets(left: list[bytes], right: list[bytes], length: int = LENGTH, k: int = GRAM) -> list[list[tuple[int, int]]]:
    """For each occurrence of a gram: runs of offsets o (bytes before the anchor)
    at which its ``length``-byte window also stands at another occurrence.

    left: bytes before the anchor; right: bytes from the anchor on.
    """
    m = len(left)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    back = [x[::-1] for x in left]
    suffixes = sorted(range(m), key=right.__getitem__)
    lcp = np.array([0, *(min(_common(right[a], right[b]), length) for a, b in zip(suffixes, suffixes[1:], strict=False))])
    prefixes = sorted(range(m), key=back.__getitem__)
    same = np.array([0, *(_common(back[a], back[b]) for a, b in zip(prefixes, prefixes[1:], strict=False))])
    rank = np.empty(m, np.int64)
    rank[prefixes] = np.arange(m)
    suffixes = np.array(suffixes)
    for i, j, depth in lcp_intervals(lcp, k):
        inside = np.sort(rank[suffixes[i : j + 1]])
        shared = np.minimum.reduceat(same[: inside[-1] + 1], inside[:-1] + 1)
        # left diversity: someone's left side ends or differs before the others'
        if depth + shared.max() < length:
            continue
        extension = np.maximum(np.r_[0, shared], np.r_[shared, 0])
        for r in np.flatnonzero(depth + extension >= length):
            runs[prefixes[inside[r]]].append((length - depth, int(extension[r])))
    return runs


def maximal_repeats(left: list[bytes], right: list[bytes], length: int = LENGTH, k: int = GRAM) -> list[tuple[int, int, list[int]]]:
    """(before, after, occurrences) of every repeat of ``length`` bytes or more
    around a gram that can't be extended to either side for all its occurrences.

    Each interval of the suffix array is scanned again in the order of reversed
    left sides: an interval of that order is left-diverse, as its members' left
    sides differ just beyond the shared part. It is right-diverse unless all its
    members lie in a deeper interval of the suffix array.
    """
    m, back = len(left), [x[::-1] for x in left]
    suffixes = np.array(sorted(range(m), key=right.__getitem__), np.int64)
    place = np.empty(m, np.int64)
    place[suffixes] = np.arange(m)
    lcp = np.array([0, *(_common(right[a], right[b]) for a, b in zip(suffixes, suffixes[1:], strict=False))])
    prefixes = np.array(sorted(range(m), key=back.__getitem__), np.int64)
    rank = np.empty(m, np.int64)
    rank[prefixes] = np.arange(m)
    same = np.array([0, *(_common(back[a], back[b]) for a, b in zip(prefixes, prefixes[1:], strict=False))])
    out = []
    for i, j, depth in lcp_intervals(lcp, k):
        inside = np.sort(rank[suffixes[i : j + 1]])
        shared = np.r_[0, np.minimum.reduceat(same[: inside[-1] + 1], inside[:-1] + 1)]
        for a, b, before in lcp_intervals(shared, max(0, length - depth)):
            who = prefixes[inside[a : b + 1]]
            lo, hi = place[who].min(), place[who].max()
            if lcp[lo + 1 : hi + 1].min() == depth:
                out.append((before, depth, sorted(who.tolist())))
    return out


def _union(runs: list[tuple[int, int]], gap: int = 1) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


# ---- the distributed operator ---------------------------------------------------------


def _contexts(docs: DataFrame, length: int, k: int, words: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors whose gram occurs again (places), their different contexts
    (contexts), and the bytes of those whose gram has several (pieces: h, cx, n,
    left, right).

    With ``words``, anchors of windows of so many words come, too (by_word; their
    gram hashes are odd); their pieces have hashes of the windows (windows) in
    place of bytes. Anchors are written as one row a text; only their hashes,
    row and place are shuffled, once to count grams and once to drop single ones.
    """
    common.tune(docs.sparkSession)
    piece, word_gram = PIECE, min(WORD_GRAM, words)
    if max(length, words) > 0xFFFF:
        raise ValueError("windows of up to 65535")

    def find(batches):
        parts = ("h", "cx", "place")
        for b in batches:
            rows, ends = [[np.zeros(0, np.int64)] for _ in parts], [0]
            for text in b.column(3).to_pylist():
                raw, n = (text or "").encode(), 0
                hashes = word_hashes(raw, piece) if words and len(raw) >= 2 * words - 1 else np.zeros(0, np.uint64)
                for odd, x, size, g in ((0, raw, length, k), (1, hashes, words, word_gram)):
                    if not size or len(x) < size:
                        continue
                    pos, lo, hi, h = anchors(x, size, g, piece)
                    bytes_, unit = (x.tobytes(), 8) if odd else (x, 1)
                    digest = xxhash.xxh3_64_intdigest
                    cx = np.fromiter((digest(bytes_[a * unit : (z + size) * unit], p - a) for p, a, z in zip(pos.tolist(), lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(pos))
                    for out, v in zip(rows, (h & -2 | odd, cx.view(np.int64), pos << 32 | (pos - lo) << 16 | (hi - lo)), strict=True):
                        out.append(v)
                    n += len(pos)
                ends.append(ends[-1] + n)
            struct = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in rows], names=parts)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], names=["t1", "t2", "doc_id", "anchors"])

    found = docs.select("t1", "t2", "doc_id", "text").mapInArrow(find, "t1 long, t2 long, doc_id long, anchors array<struct<h:long,cx:long,place:long>>")
    found = common.written(found, "anchors")
    flat = found.select("t1", "t2", "doc_id", F.explode("anchors").alias("a")).select("t1", "t2", "doc_id", "a.*")
    grams = flat.groupBy("h").agg(F.count("*").alias("n"), (F.min("cx") != F.max("cx")).alias("several")).where("n > 1")
    grams = common.written(grams, "grams")
    common.tidy(docs.sparkSession)
    total = found.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    hot = grams.where(F.col("n") > max(100, total // 1_000)).select("h")
    places = common.join_few(flat, grams.drop("n"), ["h"], "inner", hot=None if hot.isEmpty() else hot)
    at = F.col("place")
    places = places.withColumns({"by_word": F.expr("h & 1 = 1"), "pos": F.shiftright(at, 32), "lo": F.shiftright(at, 32) - F.expr("shiftright(place, 16) & 65535")})
    places = common.written(places.withColumn("hi", F.col("lo") + F.expr("place & 65535")).drop("place"), "places")
    common.forget(found, grams)
    common.tidy(docs.sparkSession)
    who = F.xxhash64("doc_id", "t1", "t2")
    contexts = places.groupBy("by_word", "h", "cx", "several").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t1", "t2", "pos", "lo", "hi")).alias("at"), F.min(who).alias("who"), F.max(who).alias("other"))
    contexts = common.written(contexts.select("by_word", "h", "cx", "n", "several", "who", "other", "at.*"), "contexts")

    # the bytes of one occurrence of each context whose gram has several
    wanted = contexts.where("several").groupBy("doc_id", "t1", "t2").agg(F.collect_list(F.struct("by_word", "h", "cx", "n", "pos", "lo", "hi")).alias("want"))
    d, w = docs.select("doc_id", "t1", "t2", "text").alias("d"), wanted.alias("w")
    texts = d.join(w, [F.col("d.t1") == F.col("w.t1"), F.col("d.t2") == F.col("w.t2"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))]).select("text", "want")

    def cut(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        for b in batches:
            rows: list[list] = [[] for _ in kinds]
            for text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                hashes = word_hashes(raw, piece) if any(x["by_word"] for x in want) else None
                for x in want:
                    if x["by_word"]:
                        part = None, None, gram_hashes(hashes[x["lo"] : x["hi"] + words], words).view(np.int64)
                    else:
                        part = raw[x["lo"] : x["pos"]], raw[x["pos"] : x["hi"] + length], None
                    for out, v in zip(rows, (x["h"], x["cx"], x["n"], *part), strict=True):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["h", "cx", "n", "left", "right", "windows"])

    pieces = common.written(texts.mapInArrow(cut, "h long, cx long, n long, left binary, right binary, windows array<long>"), "pieces")
    common.tidy(docs.sparkSession)
    return places, contexts, pieces


def _bins(length: int, k: int) -> list[int]:
    """Widths of offset ranges into which hot keys are cut, level by level."""
    widths, w = [], length - k + 1
    while w > 1:
        w = max(1, w // 7)
        widths.append(w)
    return widths


def _marks(pieces: DataFrame, length: int, k: int, cap: int) -> DataFrame:
    """(h, cx, near, far): runs of offsets at which a context that occurs once has
    a repeated window.

    Keys of up to ``cap`` contexts are scanned whole. A hot key is cut by the
    offset of the window: all windows of a range of offsets share a core, so
    contexts can only share one of them if they have the same core, which makes
    the new key. Within a passage that all contexts have, their bytes for a range
    are equal and collapse to one row; outside it, cores differ; only the few
    ranges at its ends stay hot and are cut again, down to single offsets, where
    the core is the window itself. So each context makes a bounded number of rows
    a level, however many share its key.
    """
    runs = "near array<long>, far array<long>"

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, rows in pdf.groupby("g", sort=False):
            rows = rows.drop_duplicates("c")  # equal rows of docs bring a context twice
            if len(rows) < 2:
                continue
            found = repeated_offsets(rows["left"].tolist(), rows["right"].tolist(), length, k)
            for c, n, r in zip(rows["c"], rows["n"], found, strict=True):
                if r and n == 1:
                    r = _union(r)
                    out.append((g, c, [x[0] for x in r], [x[1] for x in r]))
        return pd.DataFrame(out, columns=["g", "c", "near", "far"])

    now = pieces.select(F.col("h").alias("g"), F.col("cx").alias("c"), "n", "left", "right")
    members, out = None, None  # members: g, c -> h, cx, at levels below the first
    for width in [*_bins(length, k), 0]:
        hot = now.groupBy("g").agg(F.count("*").alias("_n")).where(F.col("_n") > cap).select("g") if width else None
        hot = common.written(hot, "hot") if hot is not None else None
        last = hot is None or hot.isEmpty()
        cold = now if last else now.join(hot, "g", "left_anti")
        groups = max(common.salts(pieces), now.count() // 2_000 + 1)
        marks = cold.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(groups))).groupBy("bucket").applyInPandas(scan, f"g long, c long, {runs}")
        mine = marks.select(F.col("g").alias("h"), F.col("c").alias("cx"), "near", "far") if members is None else marks.join(members, ["g", "c"]).select("h", "cx", "near", "far")
        out = mine if out is None else out.unionByName(mine)
        if last:
            break

        def cut(batches, width=width):
            names = ["g0", "c0", "g", "c", "n", "left", "right", "lo", "hi"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            for b in batches:
                rows: list[list] = [[] for _ in names]
                for g, c, n, left, right in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    first, last_ = max(0, length - len(right)), len(left)
                    for lo in range(first // width * width, last_ + 1, width):
                        hi = min(lo + width - 1, length - k)
                        core = left[len(left) - lo :] + right[: length - hi] if lo <= len(left) else b""
                        if len(core) < lo + length - hi:
                            continue  # the context is too short for any window here
                        part = left[max(0, len(left) - hi) :], right[: length - lo]
                        key = xxhash.xxh3_64_intdigest(core, seed=lo * 1009 + width) ^ (g & 0xFFFFFFFFFFFFFFFF)
                        key -= (key >> 63) << 64
                        whole = xxhash.xxh3_64_intdigest(b"".join(part), len(part[0]))
                        whole -= (whole >> 63) << 64
                        for x, v in zip(rows, (g, c, key, whole, n, *part, max(lo, first), min(hi, last_)), strict=True):
                            x.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=names)

        big = now.join(hot, "g", "left_semi").select("g", "c", "n", "left", "right").dropDuplicates(["g", "c"])
        made = common.written(big.mapInArrow(cut, "g0 long, c0 long, g long, c long, n long, left binary, right binary, lo long, hi long"), "cut")
        if members is None:
            below = made.select("g", "c", F.col("g0").alias("h"), F.col("c0").alias("cx"))
        else:
            below = made.select("g", "c", "g0", "c0").join(members.select(F.col("g").alias("g0"), F.col("c").alias("c0"), "h", "cx"), ["g0", "c0"]).select("g", "c", "h", "cx")
        members = common.written(below, "members")
        kinds_ = made.groupBy("g", "c").agg(F.sum("n").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        kinds_ = common.written(kinds_, "kinds")
        equal = kinds_.where("n > 1").select("g", "c", F.array("lo").alias("near"), F.array("hi").alias("far"))
        out = out.unionByName(equal.join(members, ["g", "c"]).select("h", "cx", "near", "far"))
        several = kinds_.groupBy("g").agg(F.count("*").alias("_n")).where("_n > 1").select("g")
        now = common.written(kinds_.join(several, "g", "left_semi").select("g", "c", "n", "left", "right"), "now")
    return out.groupBy("h", "cx").agg(F.flatten(F.collect_list("near")).alias("near"), F.flatten(F.collect_list("far")).alias("far"))


def _shared_windows(contexts: DataFrame, pieces: DataFrame) -> DataFrame:
    """(h, cx, near, far): offsets at which a context of words has a window that
    another document has. Windows of one gram are equal by another 64-bit hash.

    Keys are aggregated before they are joined, so a window that most documents
    have is a count in each task.
    """
    windows = pieces.where("windows IS NOT NULL").dropDuplicates(["h", "cx"]).join(contexts.where("by_word").select("h", "cx", "who", "other", (F.col("pos") - F.col("lo")).alias("before")), ["h", "cx"])
    windows = common.written(windows.select("h", "cx", "who", "other", "before", F.posexplode("windows").alias("i", "key")), "windows")
    shared = windows.groupBy("h", "key").agg(F.min("who").alias("who"), F.max("other").alias("other")).where("who <> other").select("h", "key")
    near = F.collect_list(F.col("before") - F.col("i"))
    return windows.join(shared, ["h", "key"], "left_semi").groupBy("h", "cx").agg(near.alias("near")).select("h", "cx", "near", F.col("near").alias("far"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = GRAM, cap: int = 1_000, words: int = 0) -> DataFrame:
    """(t1, t2, spans, passages): per different text, runs [a, z) of repeated bytes,
    and of words in windows of ``words`` words that another document has (0: none).

    docs has t1, t2 (hashes of the text), doc_id and text. Grams with over
    ``cap`` different contexts are cut by offsets; see ``_marks``.
    """
    places, contexts, pieces = _contexts(docs, length, k, words)
    some = _marks(pieces.where("windows IS NULL").drop("windows"), length, k, cap)
    if words:
        some = some.union(_shared_windows(contexts, pieces))
    none = F.lit(None).cast("array<long>")
    whole = contexts.where("IF(by_word, who <> other, n > 1)").select("h", "cx", none.alias("near"), none.alias("far"))
    marks = common.written(whole.union(some), "marks")
    common.forget(contexts, pieces)
    common.tidy(docs.sparkSession)
    # copies of a text have the same runs: one row per text and anchor (an anchor
    # with windows in two pieces of a text has a row for either)
    hit = places.select("by_word", "h", "cx", "t1", "t2", "pos", "lo", "hi").distinct().join(marks, ["h", "cx"])
    span = F.when(F.col("by_word"), F.lit(words)).otherwise(F.lit(length))
    starts = F.when(F.col("near").isNull(), F.array(F.col("lo"))).otherwise(F.transform("far", lambda x: F.col("pos") - x))
    ends = F.when(F.col("near").isNull(), F.array(F.col("hi") + span)).otherwise(F.transform("near", lambda x: F.col("pos") - x + span))
    hit = hit.select("t1", "t2", "by_word", F.arrays_zip(starts.alias("a"), ends.alias("z")).alias("runs"))
    of = lambda by_word: F.flatten(F.collect_list(F.when(F.col("by_word") == by_word, F.col("runs"))))
    spans = common.written(hit.groupBy("t1", "t2").agg(of(False).alias("spans"), of(True).alias("passages")), "spans")
    common.forget(places, marks)
    common.tidy(docs.sparkSession)
    return spans


def repeat_groups(docs: DataFrame, length: int = LENGTH, k: int = GRAM, cap: int = 8_000) -> DataFrame:
    """Maximal repeats with all their occurrences: group_id, n_bytes, doc_id, start.

    A repeat is maximal within the bytes that its anchor's windows see, so a long
    passage comes as several groups that overlap. group_id is a hash of the
    repeated bytes and their anchor; starts are byte offsets. Rows without an id
    have a null doc_id; equal rows of docs count as one place. Grams with over
    ``cap`` different contexts are cut into chunks of which each pair is compared.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    src = src.withColumns(dict(zip(("t1", "t2"), common.text_hash(), strict=True)))
    places, contexts, pieces = _contexts(src, length, k)
    pieces = pieces.drop("windows")
    blocks = common.in_blocks(pieces, ["h"], "cx", cap)
    groups = max(common.salts(docs), pieces.count() // 5_000 + 1)
    blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("h", "bi", "bj"), F.lit(groups)))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (h, _, _), g in pdf.groupby(["h", "bi", "bj"], sort=False):
            g = g.drop_duplicates("cx")
            left, right, cx = g["left"].tolist(), g["right"].tolist(), g["cx"].tolist()
            for before, after, who in maximal_repeats(left, right, length, k) if len(g) > 1 else []:
                one = left[who[0]][len(left[who[0]]) - before :] + right[who[0]][:after]
                key = xxhash.xxh3_64_intdigest(one, seed=before) - (1 << 63)
                out += [(key, h, cx[i], before, before + after) for i in who]
        return pd.DataFrame(out, columns=["group_id", "h", "cx", "before", "n_bytes"])

    groups = blocks.groupBy("bucket").applyInPandas(scan, "group_id long, h long, cx long, before long, n_bytes long")
    # a context that occurs again is a repeat of its own
    whole = contexts.where("n > 1").select(F.xxhash64("h", "cx").alias("group_id"), "h", "cx", (F.col("pos") - F.col("lo")).alias("before"), (F.col("hi") + length - F.col("lo")).alias("n_bytes"))
    members = groups.union(whole).distinct()
    return members.join(places, ["h", "cx"]).select("group_id", "n_bytes", "doc_id", (F.col("pos") - F.col("before")).alias("start")).distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = GRAM, cap: int = 1_000, words: int = WORDS, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    n_passages, passage_words.

    A byte goes if some ``length``-byte string that covers it starts anywhere
    else in any text too. Null texts count as empty; texts under ``length``
    bytes keep everything; repeated rows count as other places and each return.
    Kept bytes can split a character; ``with_text`` adds them as ``kept``.

    Passages are what a document's windows of ``words`` words cover that another
    document (another id or text) has word for word, whatever white space parts
    the words; windows that touch or overlap are one passage. They are reported,
    not removed: a passage of short words can have less than ``length`` bytes.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    src = src.withColumns(dict(zip(("t1", "t2"), common.text_hash(), strict=True)))
    slim = common.written(src.select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")), "slim")
    spans = repeated_spans(src, length, k, cap, words)
    # one row of each text that loses bytes or is returned
    first = slim.groupBy("t1", "t2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("m")).select("t1", "t2", F.col("m.doc_id").alias("first"))
    cuts = spans.select("t1", "t2", "spans", "passages") if not with_text else slim.select("t1", "t2").distinct().join(spans, ["t1", "t2"], "left")
    wanted = cuts.join(first, ["t1", "t2"]).alias("w")
    d = src.alias("d")
    joined = d.join(wanted, [F.col("d.t1") == F.col("w.t1"), F.col("d.t2") == F.col("w.t2"), F.col("d.doc_id").eqNullSafe(F.col("w.first"))]).select("w.t1", "w.t2", "text", "spans", "passages")

    def finish(batches):
        names = ["t1", "t2", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words", "kept"][: 8 if with_text else 7]
        types = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for t1, t2, text, runs, passages in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                raw = text.encode()
                cuts = _union([(x["a"], x["z"]) for x in runs or []], gap=0)
                kept, at = [], 0
                for lo, hi in cuts:
                    kept.append(raw[at:lo])
                    at = hi
                left = b"".join([*kept, raw[at:]])
                shared = _union([(x["a"], x["z"]) for x in passages or []], gap=0)
                for out, v in zip(rows, (t1, t2, len(raw) - len(left), len(cuts), hashlib.sha256(left).hexdigest(), len(shared), sum(z - a for a, z in shared), left), strict=False):
                    out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=False)], names=names)

    kind = "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long" + ", kept binary" * with_text
    # equal rows of docs bring a text twice
    results = common.written(joined.mapInArrow(finish, kind).dropDuplicates(["t1", "t2"]), "kept")
    common.tidy(docs.sparkSession)
    out = common.join_few(slim, results, ["t1", "t2"])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), zero("n_passages"), zero("passage_words"), *["kept"] * with_text)
