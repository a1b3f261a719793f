"""The whole pipeline on awkward rows, each stage against a brute-force version."""

import random
import zlib

import numpy as np
import pytest
from tests.llm import data
from tests.llm import test_operators as plain

import corpus_pipeline
from tierscope.llm import tokens, toxicity

STOCK = ["".join(random.Random(41).choices("bcdfghklmnoprst", k=3)) + x for x in "aeiou" for _ in (0,)] + [f"{a}{b}{c}" for a in "bcdfgk" for b in "aeiou" for c in ("l", "ma", "rt", "no")]


def tables():
    rng = random.Random(40)
    items = [(i, f"{data.words(rng, 25, STOCK)} {i} q{i}. {data.words(rng, 9, STOCK)} a{i}.") for i in range(20)] + [(20, None), (21, ""), items_repeat()]
    rows = [(i, data.words(rng, rng.randint(1, 160), STOCK)) for i in range(120)]
    labels = []
    for i in range(400, 640):  # labelled rows
        bad = i % 3 == 0
        words = data.words(rng, rng.randint(20, 60), STOCK).split() + ["vilely"] * 2 * bad
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 > 0), int(bad)))
    rows += [(700 + i, f"{data.words(rng, 30, STOCK)} vilely vilely so {data.words(rng, 9, STOCK)}") for i in range(8)]
    base = data.words(rng, 120, STOCK).split()
    for i in range(12):  # near copies
        w = list(base)
        for _ in range(i // 2):
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((800 + i, " ".join(w)))
    rows += [(830 + i, f"{data.words(rng, 70, STOCK)} {items[i][1]} {data.words(rng, 50, STOCK)}") for i in range(6)]
    rows += [(850 + i, t) for i, t in enumerate(plain.bootstrap_texts()[:60])]
    rows += [(920, ""), (921, " \n"), (922, None), (None, "a row without an id"), rows[5], rows[5], (7, "the same id, another text"), (923, data.words(rng, 9_000, STOCK)), (924, "x"), (925, "日本語 😀 +44 20 7183 8750")]
    return [(i, t, "en", f"s{k % 3}", None if t is None else len(t), "c", 1) for k, (i, t) in enumerate(rows)], items, labels


def items_repeat():
    return (0, "one more text of that id with several words in it. and an answer to it")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t1 string, _row int"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Rows after each stage, the documents first."""
    sf = str(tmp_path_factory.mktemp("sf"))
    rows, items, labels = tables()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append([tuple(r) for r in docs.collect()])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == [c.strip().split()[0] for c in SCHEMA.split(",")]
        out.append([tuple(r) for r in docs.collect()])
    return sf, out


def test_toxicity_stage(spark, staged):
    sf, out = staged
    chain = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    want = plain.counted(r for r in out[0] if plain.plain_scores(r[1], chain)[-1] <= chain.threshold)
    assert plain.counted(out[1]) == want and len(out[1]) < len(out[0])
    ids = {r[0] for r in out[1]}
    assert not ids & set(range(700, 708)) and set(range(20)) <= ids


def test_near_copies_stage(staged):
    _, out = staged
    sets = [plain.grams(r[1]) for r in out[1]]
    near = lambda a, b: not a and not b or len(a & b) >= 0.8 * len(a | b) and a & b
    root = plain.components(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])])
    best = {}
    for r, x in zip(root, out[1], strict=True):
        best[r] = min(best.get(r, (2, 0)), (x[0] is None, x[0] or 0))
    assert plain.counted((x[0] is None, x[0] or 0) for x in out[2]) == plain.counted(best.values())
    assert set(out[2]) <= set(out[1]) and len(out[2]) < len(out[1])


def test_decontamination_stage(staged):
    _, out = staged
    _, items, _ = tables()
    leaks = {k for k, _, _ in plain.plain_leaks([(i, r[1]) for i, r in enumerate(out[2])], items)}
    assert plain.counted(out[3]) == plain.counted(r for i, r in enumerate(out[2]) if i not in leaks)
    assert len(leaks) >= 6


def test_pii_stage(staged):
    _, out = staged
    added = plain.plain_bootstrap([r[1] for r in out[3]])
    want = plain.counted()
    for r in out[3]:
        text = r[1]
        spans = sorted({(s, k, e) for s, k, e, _ in plain.plain_spans(text or "")} | added.get(text, set()))
        if spans:
            new, at = "", 0
            for s, k, e in spans:
                if s >= at:
                    new += text[at:s] + f"<{plain.pii.ALL_KINDS[k].upper()}>"
                at = max(at, e)
            text = new + r[1][at:]
        want[(r[0], text, *r[2:4], None if text is None else len(text), *r[5:])] += 1
    assert plain.counted(out[4]) == want and len(out[4]) == len(out[3])


def test_packing_stage(staged):
    _, out = staged
    enc = tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json"), False)
    ids = [np.array([*x.ids, 1], "<u4") for x in enc.tok.encode_batch([r[1] or "" for r in out[4]], add_special_tokens=False)]
    pieces = out[5]
    assert sum(p[2] for p in pieces) == sum(map(len, ids))
    mine = {}
    for r, i in zip(out[4], ids, strict=True):
        mine.setdefault(r[0], []).append(i)
    for doc, start, length, crc, n, _, _ in pieces:
        assert any(len(i) == n and zlib.crc32(i[start : start + length].tobytes()) == crc for i in mine[doc])
    places = sorted((p[5], p[6], p[2]) for p in pieces)
    at = {}
    for seq, off, n in places:
        assert off == at.get(seq, 0)
        at[seq] = off + n
    assert sorted(at.values())[1:] == [2048] * (len(at) - 1)


def test_run_equals_the_stages(spark, staged):
    sf, out = staged
    whole = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    key = lambda rows: plain.counted((r[0], r[4]) for r in rows if r[1] == 0)
    assert key(whole) == key(out[5]) and sum(r[2] for r in whole) == sum(r[2] for r in out[5])


def test_run_on_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
