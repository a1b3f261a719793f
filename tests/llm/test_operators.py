import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from tests.llm import data

from tierscope.llm import decontam, media, near_copies, packing, pii, sharding, simhash, suffix_dedup, token_files, tokens, toxicity, url_filter


@pytest.fixture(scope="module")
def docs(spark):
    return data.docs(spark).cache()


def table(df):
    return [tuple(r) for r in df.collect()]


def counted(rows=()):
    return collections.Counter(rows)


# ---- simhash ----------------------------------------------------------------------


def plain_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    c = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x, 42)
        for i in range(64):
            c[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * c[i] > len(s))


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_simhash_classes_equal_brute_force(docs):
    rows = data.rows()
    fp = np.array([plain_fingerprint(r[1]) for r in rows], np.uint64)
    links = [(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 2)]
    root = components(len(fp), links)
    least = {}
    for r, x in zip(root, rows, strict=True):
        if x[0] is not None:
            least[r] = min(least.get(r, 1 << 60), x[0])
    want = counted((x[0], f"{int(f):016x}", least.get(r)) for x, f, r in zip(rows, fp, root, strict=True))
    assert counted(table(simhash.simhash_classes(docs))) == want


def test_gray_rank_orders_like_the_gray_code():
    x = np.arange(64, dtype=np.uint64)
    code = x ^ (x >> np.uint64(1))
    assert (simhash.gray_rank(code[:, None])[:, 0] == x).all()
    two = np.stack([np.zeros(64, np.uint64) + np.uint64(1), code], 1)
    assert len(np.unique(simhash.gray_rank(two), axis=0)) == 64


@pytest.mark.parametrize(("words", "radius"), [(1, 2), (1, 5), (4, 40)])
def test_index_finds_every_link(words, radius):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, (40, words), dtype=np.uint64)
    fp = np.repeat(seeds, 12, axis=0)
    for _ in range(radius):
        at = rng.integers(0, 64 * words, len(fp))
        fp[np.arange(len(fp)), at // 64] ^= np.uint64(1) << (at % 64).astype(np.uint64)
    diff = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(2)
    want = components(len(fp), [tuple(x) for x in np.argwhere(diff <= radius)])
    got = simhash.link_group(fp, radius)
    assert len(set(zip(want, got.tolist(), strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_hot_key_is_cut_into_blocks(spark):
    rng = np.random.default_rng(5)
    fp = np.unique(np.uint64(0xABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)))
    nodes = spark.createDataFrame([(i, int(x).to_bytes(8, "little")) for i, x in enumerate(fp)], "node long, fp binary")
    for cap in (5, 1000):
        links = table(simhash.gray_links(nodes, 2, cap=cap))
        assert len(set(components(len(fp), links))) == 1


def test_simhash_of_an_empty_table(spark):
    assert table(simhash.simhash_classes(data.empty(spark))) == []


# ---- near copies ----------------------------------------------------------------------


def grams(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) > width else frozenset([b" ".join(w)] if w else [])


def test_near_copies_equal_brute_force(docs):
    rows = data.rows()
    sets = [grams(r[1]) for r in rows]
    near = lambda a, b: not a and not b or len(a & b) >= 0.8 * len(a | b) and a & b
    root = components(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])])
    best = {}
    for r, x in zip(root, rows, strict=True):
        best[r] = min(best.get(r, (2,)), (x[0] is None, x[0] or 0))
    out = near_copies.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert counted(r[0] for r in table(out)) == counted(None if x[0] else x[1] for x in best.values())


def test_a_repeated_line_does_not_part_near_copies(spark):
    import random

    rng = random.Random(21)
    stock = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows = []
    for i in range(6):
        base, line = data.words(rng, 300, stock), data.words(rng, 10, stock)
        rows += [(2 * i, f"{base} {line}"), (2 * i + 1, f"{base}{f' {line}' * 20}")]
    out = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 4, 6, 8, 10]


def test_short_near_copies_are_all_found(spark):
    import random

    rng = random.Random(22)
    stock = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows = []
    for i in range(300):
        text = data.words(rng, (8, 9, 12, 28, 34)[i % 5], stock)
        rows += [(2 * i, text), (2 * i + 1, f"{text} one")]
    df = spark.createDataFrame([*rows, (9000, ""), (9001, " ")], "doc_id long, text string")
    want = sorted({2 * i for i in range(300)} | {9000})
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(df).collect()) == want
    slim = df.select("doc_id", "text", *near_copies.common.text_hash())
    assert near_copies.near_classes(slim, cap=2).select("root").distinct().count() == len(want)


def test_miss_of_the_tables_keeps_to_its_bound():
    import math

    def apart(a, b, both):  # chance that majorities of sets with these own and shared grams differ
        share = np.array([math.comb(both, s) / 2**both for s in range(both + 1)])
        over = lambda n: np.array([sum(math.comb(n, j) for j in range(max(0, (n + both) // 2 + 1 - s), n + 1)) / 2**n for s in range(both + 1)])
        x, y = over(a), over(b)
        return float(share @ (x * (1 - y) + y * (1 - x)))

    for n in (*range(near_copies.SHORT + 1, 60), 100, 200):
        for m in range(n, near_copies.longest_partner(n) + 1):
            both = math.ceil(0.8 * (n + m) / 1.8 - 1e-9)
            assert both > n or apart(n - both, m - both, both) <= near_copies.APART
    for n in (1000, 10**6):
        tables = near_copies.tables_for(n)
        assert near_copies.missed(near_copies.APART, len(tables[0]), len(tables)) <= near_copies.MISS


def test_linked_sets_with_a_small_cap(spark, docs):
    some = docs.where("doc_id < 80")
    a = counted(r[0] for r in table(near_copies.drop_near_copies(some)))
    slim = some.select("doc_id", "text", *near_copies.common.text_hash())
    n = near_copies.near_classes(slim, cap=2).select("root").distinct().count()
    assert n == sum(a.values())


def test_near_copies_of_an_empty_table(spark):
    assert table(near_copies.drop_near_copies(data.empty(spark))) == []


# ---- repeats ----------------------------------------------------------------------


def plain_removal(texts, n):
    seen = collections.Counter(r[p : p + n] for r in texts for p in range(len(r) - n + 1))
    out = []
    for r in texts:
        gone = bytearray(len(r))
        for p in range(len(r) - n + 1):
            if seen[r[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def plain_passages(docs, n):
    """(runs, words in them) of n-word windows that another (id, text) has."""
    words = [(t or "").encode().split() for _, t in docs]
    seen = collections.defaultdict(set)
    for who, w in zip(docs, words, strict=True):
        for p in range(len(w) - n + 1):
            seen[tuple(w[p : p + n])].add(who)
    out = []
    for w in words:
        shared = [False] * len(w)
        for p in range(len(w) - n + 1):
            if len(seen[tuple(w[p : p + n])]) > 1:
                shared[p : p + n] = [True] * n
        out.append((sum(g and not (i and shared[i - 1]) for i, g in enumerate(shared)), sum(shared)))
    return out


@pytest.mark.parametrize(("length", "gram", "cap", "words"), [(400, 64, 8000, 51), (60, 16, 8000, 9), (60, 16, 3, 5)])
def test_repeats_equal_brute_force(docs, length, gram, cap, words):
    rows = [r for r in data.rows() if len(r[1] or "") < 20_000]
    some = docs.where("text IS NULL OR length(text) < 20000")
    cut, passages = plain_removal([(r[1] or "").encode() for r in rows], length), plain_passages([(r[0], r[1] or "") for r in rows], words)
    assert sum(n > 0 for n, _ in passages) > 9
    want = counted((r[0], *x, *y) for r, x, y in zip(rows, cut, passages, strict=True))
    assert counted(table(suffix_dedup.remove_repeats(some, length, gram, cap, words))) == want


def test_passages_of_short_words_across_line_breaks(spark):
    import random

    rng = random.Random(15)
    stock = ["".join(rng.choices("abcdefghij", k=3)) for _ in range(900)]
    passage = [rng.choice(stock) for _ in range(51)]
    texts = [f"{data.words(rng, 60, stock)} {' '.join(passage)} {data.words(rng, 60, stock)}", f"{data.words(rng, 70, stock)}\n" + "\n".join(passage), " ".join(passage[:50]) + " " + data.words(rng, 30, stock)]
    texts += [f"{' '.join(passage[1:])} {data.words(rng, 30, stock)}" * 2, " ".join([*passage[:30], "x", *passage[30:]])]
    got = {r["doc_id"]: (r["n_removed"], r["n_passages"], r["passage_words"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (0, 1, 51), 1: (0, 1, 51), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0)}


def test_rows_of_a_text_that_most_rows_share(spark):
    import random

    rng = random.Random(16)
    texts = ["hot " * 120] * 300 + [data.words(rng, 20, ["a", "b"]) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, with_text=True).toPandas().set_index("doc_id")
    assert len(out) == 320 and (out.kept.map(len) == out.n_bytes - out.n_removed).all()
    assert (out.n_removed[:300] == 480).all() and (out.passage_words[:300] == 120).all() and (out.n_removed[300:] == 0).all()


@pytest.mark.parametrize("cap", [2, 5])
def test_a_passage_that_all_texts_share(spark, cap):
    import random

    rng = random.Random(11)
    noise = lambda a, b: "".join(rng.choices("abc", k=rng.randint(a, b)))
    passage, tail = noise(90, 90), noise(45, 45)
    texts = [noise(0, 120) + passage + (tail if i % 3 else "") + noise(0, 120) for i in range(60)] + [passage, passage[:70], tail * 3]
    texts += [texts[0], texts[1][5:], passage * 2]
    want = counted((i, *x) for i, x in enumerate(plain_removal([t.encode() for t in texts], 60)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert counted(r[:5] for r in table(suffix_dedup.remove_repeats(df, 60, 16, cap))) == want


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    import random

    rng = random.Random(13)
    noise = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passages = [noise(rng.randint(70, 160)) for _ in range(12)]
    texts = ["".join(noise(rng.randint(0, 30)) + rng.choice(passages) for _ in range(25)) for _ in range(12)]
    texts += texts[:2]
    texts = [re.sub("[gh]", " ", t) for t in texts]
    want = counted((i, *x, *y) for i, (x, y) in enumerate(zip(plain_removal([t.encode() for t in texts], 60), plain_passages(list(enumerate(texts)), 12), strict=True)))
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert counted(table(suffix_dedup.remove_repeats(df, 60, 16, words=12))) == want


def test_repeats_of_an_empty_table(spark):
    assert table(suffix_dedup.remove_repeats(data.empty(spark))) == []


def test_interval_tree_has_every_interval():
    text = b"abracadabra abracadabra"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = np.array([0] + [suffix_dedup._common(text[a:], text[b:]) for a, b in zip(order, order[1:], strict=False)])
    got = {(i, j, d) for i, j, d in suffix_dedup.lcp_intervals(lcp, 1)}
    want = set()
    for i in range(len(text)):
        for j in range(i + 1, len(text)):
            d = lcp[i + 1 : j + 1].min()
            if d >= 1 and (i == 0 or lcp[i] < d) and (j + 1 == len(text) or lcp[j + 1] < d):
                want.add((i, j, int(d)))
    assert got == want


def test_maximal_repeats_equal_brute_force():
    import random

    rng = random.Random(7)
    for _ in range(30):
        gram = "".join(rng.choices("ab", k=4))
        ctx = [("".join(rng.choices("ab", k=rng.randint(0, 7))), gram + "".join(rng.choices("ab", k=rng.randint(0, 7)))) for _ in range(9)]
        ctx = list(dict.fromkeys(ctx))
        left, right = [a.encode() for a, _ in ctx], [b.encode() for _, b in ctx]
        got = {(b, a, tuple(w)) for b, a, w in suffix_dedup.maximal_repeats(left, right, 6, 4)}
        want = set()
        for i in range(len(ctx)):
            for j in range(i):
                before = suffix_dedup._common(left[i][::-1], left[j][::-1])
                after = suffix_dedup._common(right[i], right[j])
                if before + after >= 6:
                    tail, head = left[i][len(left[i]) - before :], right[i][:after]
                    want.add((before, after, tuple(x for x in range(len(ctx)) if left[x].endswith(tail) and right[x].startswith(head))))
        assert got == want


def test_repeat_groups_hold_equal_bytes(docs):
    texts = collections.defaultdict(set)
    for r in data.rows():
        texts[r[0]].add((r[1] or "").encode())
    groups = collections.defaultdict(list)
    for g, n, doc, start in table(suffix_dedup.repeat_groups(docs.where("doc_id <> 7 OR doc_id IS NULL"), 60, 16)):
        groups[g, n].append((doc, start))
    assert groups
    for (_, n), places in groups.items():
        bytes_ = {t[start : start + n] for doc, start in places for t in texts[doc]}
        assert len(bytes_) == 1 and len(next(iter(bytes_))) == n
    shared = max(groups.values(), key=len)
    assert len(shared) > 3


def test_repeat_groups_have_all_occurrences(spark):
    """Any two places of an equal window meet in some group (brute force)."""
    import random

    rng = random.Random(17)
    noise = lambda n: "".join(rng.choices("abcd", k=n))
    passages = [noise(rng.randint(40, 90)) for _ in range(6)]
    texts = [noise(rng.randint(0, 60)) + "".join(rng.choice(passages) + noise(rng.randint(0, 9)) for _ in range(3)) for _ in range(25)]
    got = collections.defaultdict(set)
    for g, n, doc, start in table(suffix_dedup.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 30, 8)):
        got[g, n].add((doc, start))
    together = {(a, b, n) for (_, n), places in got.items() for a in places for b in places if a < b}
    windows = collections.defaultdict(list)
    for d, t in enumerate(texts):
        for p in range(len(t) - 29):
            windows[t[p : p + 30]].append((d, p))
    reach = collections.defaultdict(set)
    for a, b, n in together:
        for o in range(n - 29):
            reach[a[0], a[1] + o].add((b[0], b[1] + o))
    for places in windows.values():
        places.sort()
        for i, a in enumerate(places):
            assert set(places[i + 1 :]) <= reach[a]


def test_anchors_own_every_window_once():
    rng = np.random.default_rng(2)
    for raw in (rng.integers(97, 100, 5000, dtype=np.uint8).tobytes(), b"a" * 1500, b"ab" * 700):
        pos, lo, hi, _ = suffix_dedup.anchors(raw, 100, 16)
        assert [p for a, z in zip(lo, hi, strict=True) for p in range(a, z + 1)] == list(range(len(raw) - 99))
        assert ((pos >= lo) & (pos >= hi) & (pos <= lo + 84) | (pos >= hi) & (pos + 16 <= lo + 100 + (hi - lo))).all()


# ---- tokens, packing, files ----------------------------------------------------------


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_the_library(name, spaced, monkeypatch):
    import random

    rng = random.Random(4)
    stock = [chr(i) for i in range(1, 0x250)] + [" "] * 300 + ["\n"] * 60 + list("abcxyz'") * 30 + ["ll", " the", "\r\n", "  "] * 20
    texts = [t or "" for t in data.texts()] + ["".join(rng.choices(stock, k=rng.randint(0, 60))) for _ in range(1500)]
    enc = tokens.Encoder(tokens.tokenizer_path(name), spaced)
    want = [x.ids for x in enc.tok.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "CACHED", 300)  # forget often
    got = [np.frombuffer(x, enc.dtype).tolist() for lo in range(0, len(texts), 100) for x in enc.encode(texts[lo : lo + 100])]
    assert got == want


def ids_of(name, rows, spaced, end):
    enc = tokens.Encoder(tokens.tokenizer_path(name), spaced)
    return [np.array(x.ids + [end], "<u4") for x in enc.tok.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]


def test_packing_is_whole_and_dense(docs):
    rows = data.rows()
    out = packing.pack_documents(docs).toPandas()
    want = counted((r[0], len(i), zlib.crc32(i.tobytes())) for r, i in zip(rows, ids_of("word_bpe_49k.json", rows, False, 1), strict=True))
    ids = {(r[0], zlib.crc32(i.tobytes())): i for r, i in zip(rows, ids_of("word_bpe_49k.json", rows, False, 1), strict=True)}
    by_doc = collections.defaultdict(list)
    for x in ids:
        by_doc[x[0]].append(ids[x])
    for r in out.itertuples():
        doc = None if np.isnan(r.doc_id) else int(r.doc_id)
        assert any(zlib.crc32(i[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(i) == r.doc_tokens for i in by_doc[doc])
    assert out.length.sum() == sum(n for (_, n, _), c in want.items() for _ in range(c))
    full = 0
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length)[:-1]]).all() and g.length.sum() <= 2048
        full += g.length.sum() == 2048
    assert full >= out.sequence_id.nunique() - 1


def test_plan_places_every_remainder_once():
    rng = np.random.default_rng(8)
    for counts in (rng.integers(0, 4, 64), np.bincount([5] * 40 + [60] * 3, minlength=64), np.zeros(64, int)):
        counts[0] = 0
        plan, used = packing.Plan(counts, 64), collections.defaultdict(set)
        for n in range(1, 64):
            for r in range(counts[n]):
                for seq, off, k in plan.place(n, r):
                    cells = set(range(off, off + k))
                    assert not used[seq] & cells and off + k <= 64
                    used[seq] |= cells
        sizes = sorted(map(len, used.values()))
        assert sum(sizes) == (counts * np.arange(64)).sum() and all(s == 64 for s in sizes[1:])


def test_least_squares_fits_a_mixture():
    truth = np.array([[10, 54, 0], [20, 20, 24], [30, 34, 0]])
    counts = np.zeros(65)
    for row, n in zip(truth, (5, 7, 3), strict=True):
        np.add.at(counts, row[row > 0], n)
    assert np.allclose(packing.solve(truth, counts, 2000), [5, 7, 3], atol=0.05)


def test_token_files_read_back(docs):
    rows = sorted(data.rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_files.token_documents(docs).orderBy("start").collect()
    want = counted((r[0], len(i), zlib.crc32(i.tobytes())) for r, i in zip(rows, ids_of("byte_bpe_50k.json", rows, True, 0), strict=True))
    assert counted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.r_[0, np.cumsum([r["n_tokens"] for r in got])[:-1]].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)


@pytest.mark.parametrize("high", [1, 2, 300, 1 << 16, (1 << 32) - 1])
def test_blocks_round_trip(high):
    rng = np.random.default_rng(high)
    x = rng.integers(0, high, (30, token_files.BLOCK), dtype=np.uint32)
    x[rng.random(x.shape) < 0.04] = (1 << 32) - 1
    blocks = token_files.encode_blocks(x)
    assert (token_files.decode_blocks(b"".join(blocks), np.cumsum([0, *map(len, blocks)])[:-1]) == x).all()


def test_token_operators_on_an_empty_table(spark):
    assert table(packing.pack_documents(data.empty(spark))) == [] and table(token_files.token_documents(data.empty(spark))) == []


# ---- media ----------------------------------------------------------------------


def test_media_read_back(docs):
    want = collections.Counter()
    for r in data.rows():
        raw = (r[1] or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want[r[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    out = media.media_columns(docs).toPandas()
    got = counted((None if np.isnan(r.doc_id) else int(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out.itertuples())
    assert got == want
    assert (out.height * 64 == out.payload_bytes).all() and (out.width == 64).all() and (out.bits == 8).all()
    assert out.groupby("payload_sha256").agg({"media_sha256": "nunique", "feature": "nunique"}).max().max() == 1


def test_png_header_needs_only_its_first_bytes():
    data_ = media.to_png(media.padded(b"abc" * 100))
    assert media.png_header(data_[: media.HEADER]) == (64, 5, 8) and media.from_png(data_) == media.padded(b"abc" * 100)
    with pytest.raises(ValueError):
        media.png_header(b"x" * 33)


def test_media_of_an_empty_table(spark):
    assert table(media.media_columns(data.empty(spark))) == []


# ---- urls ----------------------------------------------------------------------


def plain_judge(url, rules=url_filter.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, *rule


URLS = ["http://a.com/x", "HTTPS://WWW.Example.COM/en/1?q#f", "https://m.example.com/en/1", "http://example.com/en", "http://x.net/es/", "http://net/fr/1", "http://com", "http://com/", "http://..com/", "ftp://x.net?/es/", "no url", "", None, "://", "http://a://b.com/", "http://é.com/en/", "http://notexample.com/en/", "http://x.net/ES/"]


def test_urls_equal_brute_force(spark):
    rows = [(i, u, 1) for i, u in enumerate(URLS)] + [(0, URLS[0], 2), (None, URLS[1], None)]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, keys int"))
    assert counted(table(out)) == counted((i, *plain_judge(u)) for i, u, _ in rows)


def test_long_lists_are_cut_into_slices(spark):
    """The same rows, repeated ones too, however many slices the lists need."""
    rules = url_filter.RULES + [("block" if i % 2 else "allow", f"site{i}.org", "/" if i % 3 else "/en/") for i in range(60)]
    urls = URLS + [f"https://www.site{i % 80}.org/{'en/' * (i % 2)}x" for i in range(300)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, URLS[3])] * 2 + [(None, None)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string")
    want = counted((i, *plain_judge(u, rules)) for i, u in rows)
    one = url_filter.judge(df, rules)
    assert counted(table(one)) == want
    assert counted(table(url_filter.judge(df, rules, max_bits=512))) == want
    table_ = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert counted(table(url_filter.judge(df, table_))) == want
    assert {r["verdict"] for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    from pyspark.sql import functions as F

    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 9 = 0")
    for rate in (0.2, None):
        c = url_filter.cascades({"a": listed, "none": listed.limit(0)}, universe, 4000, rate=rate)
        assert len(c["a"].levels) > 2 or rate is None
        got = {r[0] for r in universe.where(c["a"].member(F.col("key"))).collect()}
        assert got == {r[0] for r in listed.collect()} and universe.where(c["none"].member(F.col("key"))).isEmpty()


def test_urls_of_an_empty_table(spark):
    assert table(url_filter.judge(spark.createDataFrame([], "page_id long, url string"))) == []


# ---- shards ----------------------------------------------------------------------


def test_shards_are_even_and_groups_together(spark, docs):
    more = docs.select("doc_id", "text").union(spark.range(400).selectExpr("id + 5000", "'one hot text'"))
    out = sharding.shard_documents(more, n_shards=8).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == more.count() and sizes.max() - sizes.min() <= 1 and len(sizes) == 8
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    texts = dict(zip(range(10_000), [None] * 10_000, strict=True)) | {r[0]: r[1] for r in more.collect()}
    hot = out[out.doc_id >= 5000]
    assert hot["shard"].nunique() <= 8 and set(out.law) == {"rows"}
    for r in out.itertuples():
        if r.doc_id == r.doc_id and r.doc_id != 7:
            raw = (texts[int(r.doc_id)] or "").encode()
            assert (r[2], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    copies = out[out.text_crc32 == zlib.crc32(data.rows()[3][1].encode())]
    assert copies["shard"].nunique() == 1


def least_cut(sizes, n_shards):
    """Fewest links between shards over all even assignments (brute force)."""
    n, best = sum(sizes), [1 << 60]
    most, rest = -(-n // n_shards), n % n_shards or n_shards

    def ways(size, room):
        if not room:
            if not size:
                yield ()
            return
        for k in range(min(size, room[0]) + 1):
            for more in ways(size - k, room[1:]):
                yield (k, *more)

    def place(i, room, cut):
        if cut >= best[0]:
            return
        if i == len(sizes):
            best[0] = cut
            return
        for way in ways(sizes[i], room):
            together = sum(k * (k - 1) // 2 for k in way)
            place(i + 1, tuple(a - k for a, k in zip(room, way, strict=True)), cut + sizes[i] * (sizes[i] - 1) // 2 - together)

    place(0, tuple([most] * rest + [most - 1] * (n_shards - rest)), 0)
    return best[0]


@pytest.mark.parametrize(("sizes", "n_shards", "over"), [((3, 3, 2, 1, 1, 1, 1), 3, 0), ((6, 2, 2, 1, 1), 2, 8), ((5, 4, 1, 1, 1, 1, 1, 1), 3, 0), ((1, 1, 1), 2, 0)])
def test_cut_links_against_the_optimum(spark, sizes, n_shards, over):
    """The optimum where unlinked rows leave room; where they are few, exchanges run out."""
    texts = [f"text {g}" for g, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sharding.shard_documents(df, n_shards).toPandas()
    for r in out.itertuples():
        mine = out[out.text_crc32 == r.text_crc32]
        assert r.links == len(mine) - 1 and r.cut_links == (mine["shard"] != r.shard).sum()
    counts = out.groupby("shard").size().reindex(range(n_shards), fill_value=0)
    assert counts.max() - counts.min() <= 1
    dealt = sharding.shard_documents(df, n_shards, rounds=0).toPandas()
    cut, before, best = out.cut_links.sum() // 2, dealt.cut_links.sum() // 2, least_cut(sizes, n_shards)
    assert best <= cut <= before and cut <= best + over


def test_grants_keep_counts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        asked, loose = rng.integers(0, 9, (6, 6)), rng.integers(0, 12, 6)
        moves, swap = sharding.grant(asked, loose)
        total = moves + swap
        assert (total.sum(0) == total.sum(1)).all() and (swap.sum(1) <= loose).all()
        assert (moves <= asked).all() and (np.diag(moves) == 0).all()


def test_shards_of_an_empty_table(spark):
    assert table(sharding.shard_documents(data.empty(spark))) == []


# ---- personal data ------------------------------------------------------------------

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(s))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (name, p) in enumerate(KINDS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda m, d: True, "ip": lambda m, d: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda m, d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 10 <= len(d) <= 15}[name](m, d):
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


PII = ["a@b.c_d@e.f g", "4111 1111 1111 1111 and 4111-1111-1111-1111 4111 1111 1111 1112", "1.2.3.4.5.6.7.8 0000256.1.1.1 000255.1.1.1", "+1 (234) 567-8901) .. +12 345 ++44 20 7183 8750", "é@x.y a@b", "😀 a.b@c.d 😀 +442071838750", "a@b@c.d@e.f", "9" * 400 + ".1.1.1", "a" * 20_000 + "@", "1 " * 5_000, None, ""]


def test_base_spans_equal_plain_expressions(spark):
    import random

    rng = random.Random(6)
    fuzz = ["".join(rng.choices(list("01259") * 3 + list("abé.@+-() _%"), k=rng.randint(0, 90))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(PII + fuzz)] + [(0, PII[0]), (None, PII[1])]
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = rows[r["doc_id"]][1] if r["doc_id"] is not None else PII[1]
        spans = plain_spans(text or "")
        told = ",".join(f"{n}:{s}:{e}" for s, _, e, n in spans)
        assert [r[f"n_{n}"] for n, _ in KINDS] == [sum(x[3] == n for x in spans) for n, _ in KINDS]
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"please call me tomorrow, my number: +44 20 7183 87{i:02d} thanks for all") for i in range(20)]
    rows += [(100 + i, f"write to address mail: user{i}@host.example now") for i in range(20)]
    rows += [(200, "write to address mail: user77@host now")] + [(300 + i, f"chapter {i} of 12 verse 3") for i in range(30)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[300] == "" and got[100].startswith("email:")
    more = rows + [(201, "write to address mail: user77@host now"), (202, "address mail: user5@host.example now")]
    assert len(pii.find_pii(spark.createDataFrame(more, "doc_id long, text string")).collect()) == len(more)


NUMBER, WHOLE = r"^[+(]*[0-9][().0-9-]*$", r"^[0-9]+([.][0-9]+){3}$"


def plain_bootstrap(texts, rounds=3):
    """Spans that the bootstrap adds, by text: plain loops over the same graph."""
    import regex

    of = lambda p: regex.compile(p, regex.ASCII)
    token, loose = of(pii.TOKEN), {k: of(p) for k, p in pii.LOOSE.items()}
    shape = lambda t: regex.sub(r"\p{L}+", "a", regex.sub("[0-9]+", "9", t.lower()))
    split = lambda t: [w for w in regex.split(r"\s+", t.lower(), flags=regex.ASCII) if w]
    seen = []
    for text in dict.fromkeys(t or "" for t in texts):
        base, found = plain_spans(text), list(token.finditer(text))
        tokens = ["^", "^", *(shape(m[0]) for m in found)]
        cuts = [0, *(x for m in found for x in m.span()), len(text)]
        between = [split(text[a:b]) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        for i, m in enumerate(found):
            flat = [tokens[i], *(between[i - 1] if i else []), tokens[i + 1], *between[i]] if i else ["^", "^", *between[0]]
            words = flat[-2:]
            after = between[i + 1][0] if between[i + 1] else shape(found[i + 1][0]) if i + 1 < len(found) else "$"
            own = next((s for s in base if m.start() <= s[0] < m.end()), None)
            follows = any(m.end() <= s[0] < m.end() + len(m[1]) for s in base)
            raw = m[0]
            if regex.match(NUMBER, raw) and not regex.match(WHOLE, raw) and not follows and sum(c in "0123456789" for c in m[0] + m[1]) <= 19:
                raw = m[0] + m[1]
            label = regex.match(r"^([\p{L}_.-]+[=:])[\"'<\[{(]*[^=:\s]{4}", raw)
            if label:
                words = [words[1], label[1].lower()]
            body = raw[len(label[1]) if label else 0 :]
            free = regex.sub(r"""^[<"'\[{]+""", "", body)
            start = m.start() + len(raw) - len(free)
            free = regex.sub(r"[^\p{L}\p{N}]+$", "", free)
            a, z = (own[0], own[2]) if own else (start, start + len(free))
            instance = text[a:z].lower()
            kind = own[1] if own else 4 if regex.match(pii.SECRET, instance) and words[1][-1] in "=:" else None
            covered = any(s[0] < z and s[2] > a for s in base)
            if instance and (kind is not None or not covered):
                seen.append((text, a, z, instance, kind, covered, (f"2 {words[0]} {words[1]}", f"1 {words[1]}", f"r {after}")))
    members, known = collections.defaultdict(set), {}
    for _, _, _, instance, kind, _, patterns in seen:
        for p in patterns:
            members[p].add(instance)
        if kind is not None:
            known[instance] = min(known.get(instance, 9), kind)

    def could(instance, kind):
        name, n = pii.ALL_KINDS[kind], sum(c in "0123456789" for c in instance)
        return bool(loose[name].search(instance)) and (name not in pii.DIGITS or pii.DIGITS[name][0] <= n <= pii.DIGITS[name][1])

    accepted = {}
    for _ in range(rounds):
        accepted = {}
        for p, who in members.items():
            votes = collections.Counter(known[i] for i in who if i in known)
            if votes:
                n, kind = max((n, k) for k, n in votes.items())
                if n >= pii.SUPPORT and n / len(who) >= (pii.CONFIDENCE if p[0] == "2" else pii.STRONG):
                    accepted[p] = kind, n / len(who)
        miss = collections.defaultdict(lambda: 1.0)
        for p, (kind, score) in accepted.items():
            for i in members[p]:
                if could(i, kind):
                    miss[i, kind] *= max(1 - score, 1e-9)
        new = {}
        for (i, kind), x in miss.items():
            if i not in known and 1 - x >= pii.CONFIDENCE - 1e-12:
                new[i] = max(new.get(i, (0, 0)), (round(1 - x, 12), kind))
        known |= {i: kind for i, (_, kind) in new.items()}
        if not new:
            break
    out = collections.defaultdict(set)
    for text, a, z, instance, _, covered, patterns in seen:
        for p in patterns:
            if not covered and p in accepted and known.get(instance) == accepted[p][0]:
                out[text].add((a, accepted[p][0], z))
    return out


def plain_told(text, added):
    spans = sorted({(s, k, e) for s, k, e, _ in plain_spans(text)} | added.get(text, set()))
    return ",".join(f"{pii.ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)


def bootstrap_texts(seed=12):
    import random

    rng = random.Random(seed)
    stock = ["the", "of", "Üben", "line", "call", "no:", "ref", "is", "a,", "and", "mail:", "ip", "token =", "key:"]
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    forms = [lambda: f"+44 20 {digits(4)} {digits(4)}", lambda: f"020 {digits(4)} {digits(4)}", lambda: f"u{digits(2)}@h.example", lambda: f"u{digits(2)}@host", lambda: f"10.{rng.randint(0, 300)}.1.{rng.randint(0, 9)}",
             lambda: f'"{"".join(rng.choices("0123456789abcdef", k=40))}"', lambda: f"xy-{digits(24)}.", lambda: digits(rng.randint(1, 17)), lambda: f"key={digits(6)}abcdefghijk{digits(3)}", lambda: f"api_key:{''.join(rng.choices('0123456789abcdef', k=32))}", lambda: "4111 1111 1111 1111", lambda: "4111111111111111 5500005555555559", lambda: f"({digits(2)})"]
    few = [f() for f in forms for _ in range(4)]
    out = []
    for _ in range(260):
        words = []
        for _ in range(rng.randint(1, 6)):
            words += [rng.choice(stock) for _ in range(rng.randint(0, 3))] + [rng.choice(few) if rng.random() < 0.6 else rng.choice(forms)()]
        out.append(rng.choice((" ", "  ", "\n")).join(words) + rng.choice(("", " end", " 😀 x")))
    return [*out, *out[:5], None, ""]


def test_bootstrap_equals_plain_loops(spark):
    texts = bootstrap_texts()
    added = plain_bootstrap(texts)
    want = counted((i, plain_told(t or "", added)) for i, t in enumerate(texts))
    assert sum(map(len, added.values())) > 50
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert counted((r["doc_id"], r["spans"]) for r in got) == want
    for r in got:
        n = len(plain_spans(texts[r["doc_id"]] or ""))
        assert r["n_spans"] == len(list(filter(None, r["spans"].split(",")))) == n + r["n_added"]


def test_very_long_texts_of_numbers(spark):
    """Tens of thousands of matches in one text take about n log n steps."""
    import time

    texts = ["10.0.0.1 " * 30_000, "a@b.c " * 20_000, "7 " * 60_000, "x" * 300_000 + " 1", "number " + "5 " * 9 + "y" * 200 + " 12345678"]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["n_ip"] == 30_000 and got[1]["n_email"] == 20_000 and time.time() - began < 90


def test_bootstrap_adds_an_instance_of_an_accepted_pattern(spark):
    texts = [f"my card code is {n} ok" for n in ("4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4111111111111112")]
    got = {r["doc_id"]: (r["n_card"], r["spans"]) for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0][0] == 1 and got[4] == (0, "card:16:32")


def test_bootstrap_finds_unseen_forms(spark):
    rows = [(i, f"please call, my number: +44 20 7183 87{i:02d} thanks for all") for i in range(20)]
    rows += [(100 + i, f"write to address mail: user{i}@host.example now") for i in range(20)]
    rows += [(300 + i, f"the server with ip 10.0.{i}.1 is up") for i in range(20)]
    new = {200: ("please call, my number: 020 7183 8701, thanks", "phone", "020 7183 8701"), 201: ("write to address mail: user77@host. Now", "email", "user77@host"),
           202: ("the server with ip fe80::1:20 is up", "ip", "fe80::1:20"), 203: ("my number: 12 was drawn", None, None), 204: ("😀 now my number: (020)7183-8702 or so", "phone", "(020)7183-8702")}
    # found only by what the first rounds add: the same number in another context, and that context's others
    rows += [(400 + i, f"please call, my number: 020 7000 100{i}") for i in range(3)] + [(410 + i, f"or by telex code 020 7000 100{i}") for i in range(3)]
    new[420] = ("or by telex code 030-555-1212", "phone", "030-555-1212")
    rows += [(i, t) for i, (t, _, _) in new.items()]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (text, kind, found) in new.items():
        assert got[i] == (f"{kind}:{text.index(found)}:{text.index(found) + len(found)}" if kind else "")


def test_contexts_reach_over_tokens_and_the_start(spark):
    rows = [(i, f"log line {i}: 10.0.{i}.1 ok") for i in range(9)] + [(100, "log line 12: 300.0.0.1 ok")]
    cards = ("4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4111111111111112")
    rows += [(200 + i, f"{n} was used") for i, n in enumerate(cards)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "ip:13:22" and got[204] == "card:0:16"


def test_redaction_keeps_rows_and_columns(docs, spark):
    out = pii.redact(docs)
    assert out.columns == docs.columns and counted(r[0] for r in table(out)) == counted(r[0] for r in data.rows())
    rows = [(1, "mail a@b.c, call +44 20 7183 8750!", "en", "s", 1, "c", 1, "n", 0.5, 2)]
    (row,) = pii.redact(spark.createDataFrame(rows, data.SCHEMA)).collect()
    assert row["text"] == "mail <EMAIL>, call <PHONE>!" and row["n_chars"] == len(row["text"])


def test_pii_of_an_empty_table(spark):
    assert table(pii.find_pii(data.empty(spark))) == [] and table(pii.redact(data.empty(spark))) == []


# ---- decontamination -----------------------------------------------------------------


def test_leaks_are_found_and_clean_rows_stay(spark, docs):
    import random

    rng = random.Random(9)
    stock = ["".join(rng.choice("klmnopqr") for _ in range(6)) for _ in range(500)]
    items = [(i, f"{data.words(rng, 25, stock)}. {data.words(rng, 12, stock)}.") for i in range(40)]
    items += [(40, None), (41, ""), (None, items[0][1]), items[3], (43, data.words(rng, 300, stock))]
    leaked = [(9000 + i, f"{data.words(rng, 90, stock)} {t} {data.words(rng, 200, stock)}") for i, t in items[:10]] + [(9500, items[-1][1])]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(leaked, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(rows, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(9000 + i, i) for i in range(10)} | {(9000, None), (9500, 43)}
    in_parts = decontam.contamination(rows, bench, part_bytes=900).where("size(leaks) > 0").collect()
    assert {(r["doc_id"], x["item_id"]) for r in in_parts for x in r["leaks"]} == {(r["doc_id"], r["item_id"]) for r in got}
    assert decontam.drop_leaks(rows, bench).count() == rows.count() - 11


def plain_leaks(docs, items, threshold=0.6, overlap=0.6):
    """(doc_id, item_id, passage) by full BM25 scoring of every passage and item."""
    items = list(dict.fromkeys((i, t) for i, t in items if t is not None))
    words = {t: decontam.words_of(t) for _, t in items}
    n, mean = len(items), max(1.0, sum(len(words[t]) for _, t in items) / max(1, len(items)))
    df = collections.Counter(w for _, t in items for w in set(words[t]))
    out = []
    for item, t in items:
        tf, norm = collections.Counter(words[t]), 1.2 * (1 - 0.75 + 0.75 * len(words[t]) / mean)
        weight = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + norm) for w, c in tf.items()}
        step = max(64, 1 << (len(words[t]) - 1).bit_length()) if words[t] else 64
        for doc, text in docs:
            w, best = decontam.words_of(text), None
            for lo in range(0, len(w), step):
                have = set(w[lo : lo + 2 * step])
                score = sum(v for x, v in weight.items() if x in have) / sum(weight.values()) if weight else 0
                if score < threshold - 1e-9:
                    continue
                around = w[max(0, lo - len(words[t])) : lo + 2 * step + len(words[t])]
                shares = []
                for part in decontam.halves(t):
                    k = min(5, len(part))
                    mine = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)} if k else set()
                    near = {tuple(around[i : i + k]) for i in range(len(around) - k + 1)}
                    shares.append(len(mine & near) / len(mine) if mine else 1.0)
                if min(shares) >= overlap and (best is None or score > best[0] + 1e-12):
                    best = score, lo
            if best:
                out.append((doc, item, best[1]))
    return counted(out)


def test_leaks_equal_full_scoring(spark, monkeypatch):
    """The query as a whole against brute force, in one part, in several, and in slices."""
    import random

    rng = random.Random(31)
    stock = [f"w{i}" for i in range(150)]
    items = [(i, f"{data.words(rng, rng.randint(2, 40), stock)}. {data.words(rng, rng.randint(1, 12), stock)}.") for i in range(60)]
    items += [(60, None), (61, ""), (None, items[0][1]), items[3], (3, "one more text of that id. yes"), (63, data.words(rng, 200, stock)), (64, "x")]
    docs_ = []
    for i in range(150):
        parts = [data.words(rng, rng.randint(0, 120), stock)]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice([t for _, t in items if t]).split()
            for _ in range(rng.choice((0, 0, 1, 3, 9))):
                w[rng.randrange(len(w))] = "other"
            parts += [" ".join(w), data.words(rng, rng.randint(0, 90), stock)]
        docs_.append((i, " ".join(parts)))
    docs_ += [(900, None), (901, ""), docs_[2], (902, docs_[2][1]), (None, docs_[4][1]), (903, " ".join(t for _, t in docs_[:40]))]
    want = plain_leaks(docs_, items)
    assert len(want) > 100
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs_], "doc_id long, text string, leaks int, _text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = lambda d: counted((r["doc_id"], x["item_id"], x["passage"]) for r in d.collect() for x in r["leaks"])
    one = decontam.contamination(df, bench)
    assert one.columns == ["doc_id", "text", "_text", "leaks"] and got(one) == want
    assert counted((r["doc_id"], r["item_id"], r["passage"]) for r in decontam.find_leaks(df, bench).collect()) == want
    several = decontam.contamination(df, bench, part_bytes=2000)
    assert several.columns == one.columns and several.count() == len(docs_) and got(several) == want
    monkeypatch.setattr(decontam, "AT_ONCE", 256)
    index_items = lambda rows: [x for x in rows if x[1]]
    index_df = lambda rows: collections.Counter(w for _, t in rows if t for w in set(decontam.words_of(t)))
    index = decontam.Index(index_items(items), index_df(items), 66, 30.0)
    words = [decontam.words_of(t) for _, t in docs_]
    sliced = [sorted(x) for x in index.search(words)]
    monkeypatch.setattr(decontam, "CELLS", 8)  # no table, a few sums at once
    index = decontam.Index(index_items(items), index_df(items), 66, 30.0)
    assert sliced == [sorted(x) for x in index.search(words)]
    monkeypatch.setattr(decontam, "AT_ONCE", 1 << 18)
    assert sliced == [sorted(x) for x in index.search(words)]


def test_search_equals_full_scoring():
    """All items at the threshold, while most postings are never read."""
    import random

    rng = random.Random(2)
    stock = [f"w{i}" for i in range(3000)]
    items = [(i, data.words(rng, rng.randint(1, 30), stock[: 3000 if i % 4 else 60])) for i in range(200)]
    df = collections.Counter(w for _, t in items for w in set(t.split()))
    index = decontam.Index(items, dict(df), len(items), 15.0, 0.5)
    texts = [data.words(rng, rng.randint(0, 400), stock[: 3000 if i % 2 else 80]).split() for i in range(40)] + [" ".join(t for _, t in items).split()]
    for words, hits in zip(texts, index.search(texts), strict=True):
        want = {}
        for lo in range(0, max(1, len(words)), index.step):
            have = {index.terms.get(w) for w in words[lo : lo + 2 * index.step]}
            for i, weights in enumerate(index.weights):
                score = sum(v for t, v in weights.items() if t in have)
                if score >= 0.5 - 1e-9:
                    want[i, lo] = pytest.approx(score)
        assert {(i, lo): s for i, lo, s in hits} == want and len(hits) == len(want)
    assert index.stats["read"] < index.stats["postings"]
    index.stats = dict.fromkeys(index.stats, 0)
    index.search(texts[1:40:2])  # texts that hold no item
    assert index.stats["read"] < index.stats["postings"] / 20 and index.stats["searched"] < index.stats["passages"]


def test_decontamination_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert table(decontam.find_leaks(docs, none)) == [] and decontam.drop_leaks(docs, none).count() == docs.count()
    assert table(decontam.find_leaks(data.empty(spark), none)) == []


# ---- toxicity ----------------------------------------------------------------------


def toxic_rows(n, seed):
    import random

    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    out = []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(stock) for _ in range(rng.randint(20, 80))] + [f"vile{rng.choice('abc')}"] * bad * 2
        rng.shuffle(words)
        out.append((i, " ".join(words), int(rng.random() < 0.8), int(bad)))
    return out


def test_chain_separates_held_out_rows(spark):
    rows = toxic_rows(900, 3)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:600]] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.flag_toxic(docs, labels).collect()}
    assert np.mean([got[r[0]] == bool(r[3]) for r in rows[600:]]) > 0.97


def plain_features(text):
    out = set()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out |= {zlib.crc32(x.encode()) % (1 << 18) for x in {w, *(w[:n] + "*" for n in (4, 5, 6, 7, 8) if len(w) >= n)}}
    return sorted(out)


def plain_scores(text, chain):
    """Probabilities of the links, one after another (brute force)."""
    seen = []
    for m in chain.links:
        z = sum(float(m.w[i]) for i in plain_features(text)) + sum(float(u) * p for u, p in zip(m.u, seen, strict=False)) + float(m.u[-1])
        seen.append(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
    return seen


def test_chain_equals_plain_scoring_and_fitting(spark, docs):
    """The query's rows by a plain scorer; its models by one fit after another, on
    labels of which some clash."""
    from pyspark.sql import functions as F

    rows = toxic_rows(400, 8)
    df = docs.select("doc_id", "text").where("doc_id > 60 OR doc_id IS NULL").withColumn("doc_id", F.col("doc_id") + 10_000).union(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string"))
    labels = [(r[0], r[2], r[3]) for r in rows[:300]] + [(i, 0, 0) for i in range(40)] + [(i, 1, 1) for i in range(40, 60)]
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(4)
    chain = toxicity.train(df, labels_df)
    known = {}
    for i, q, t in labels:
        a, b = known.get(i, (0, 0))
        known[i] = max(a, q), max(b, t)
    order = [r[0] for r in spark.createDataFrame([(i,) for i in known], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    xs = [np.array(plain_features(rows[i][1]), np.int32) for i in order]
    plain = toxicity.fit_chain(xs, np.array([known[i] for i in order], float))
    assert plain.threshold == pytest.approx(chain.threshold, abs=1e-6)
    assert all(np.allclose(a.w, b.w, atol=1e-5) and np.allclose(a.u, b.u, atol=1e-5) for a, b in zip(plain.links, chain.links, strict=True))
    texts = {(r["doc_id"], r["text"]) for r in df.collect()}
    want = counted()
    for r in df.collect():
        q, t = plain_scores(r["text"], chain)
        want[r["doc_id"], round(q, 5), round(t, 5), t > chain.threshold] += 1
    got = counted((r["doc_id"], round(r["p_quality"], 5), round(r["p_toxic"], 5), r["toxic"]) for r in toxicity.flag_toxic(df, labels_df).collect())
    assert texts and got == want


def test_toxicity_on_awkward_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.drop_toxic(docs, none)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert table(toxicity.flag_toxic(data.empty(spark), none)) == []


def test_threshold_is_the_best_cut():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1.0, 1, 0, 0])) == pytest.approx(0.5)
    assert toxicity.best_threshold(np.zeros(0), np.zeros(0)) == 0.5
