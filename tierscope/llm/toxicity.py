"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another: each link is a logistic model
over hashed words and word beginnings, and over the probabilities of the links
before it. For training those are out-of-fold predictions (each by models that
never saw the row), so a link learns from the errors that it will meet.

The models are fitted from at most ``MAX_ROWS`` labelled rows, the first by a hash of
doc_id; features are extracted by the executors and only their numbers are sent.
The model of a link and those of its folds are fitted side by side, each in a task
of its own. Every row of the corpus is scored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.llm import common

#: Bound of the fitted sample, hashed dimensions, folds, passes.
MAX_ROWS, DIMS, FOLDS, EPOCHS = 8_000, 1 << 18, 4, 8
#: Predicted in this order; the last is the decision.
CATEGORIES = ("quality", "toxic")
PREFIXES = (4, 5, 6, 7, 8)
#: Features a link uses, by their chi-squared statistic; rows each is in; least
#: statistic (one in a million features without effect reaches it).
BEST, RARE, LEAST_CHI = 2_000, 4, 25.0
_WORD = re.compile(r"[^\W\d_]+")
#: Words that a task remembers.
CACHED = 100_000


def _of_word(word: str) -> tuple[int, ...]:
    names = {word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)}
    return tuple(zlib.crc32(n.encode()) % DIMS for n in sorted(names))


class Features:
    """Numbers of the features of whole texts; with a mask, of those in it."""

    def __init__(self, mask: np.ndarray | None = None):
        self.mask, self.known = mask, {}

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHED:
            self.known = {}
        out: set[int] = set()
        get = self.known.get
        for w in set(_WORD.findall((text or "").lower())):
            x = get(w)
            if x is None:
                x = _of_word(w)
                if self.mask is not None:
                    x = tuple(n for n in x if self.mask[n])
                self.known[w] = x
            if x:
                out.update(x)
        return np.array(sorted(out), np.int32)


@dataclass
class Linear:
    """Logistic model: binary features, earlier probabilities, a constant."""

    w: np.ndarray
    u: np.ndarray

    def probability(self, x: np.ndarray, before: np.ndarray) -> float:
        z = float(self.w[x].sum()) + float(self.u[:-1] @ before) + float(self.u[-1])
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def chosen(xs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Which features tell y's classes apart best (a mask)."""
    n, ones = np.zeros(DIMS, np.int64), np.zeros(DIMS, np.int64)
    for lo in range(0, len(xs), 500):
        part = list(zip(xs[lo : lo + 500], y[lo : lo + 500], strict=True))
        n += np.bincount(np.concatenate([x for x, _ in part]), minlength=DIMS)
        ones += np.bincount(np.concatenate([np.zeros(0, np.int32), *(x for x, t in part if t)]), minlength=DIMS)
    share = y.mean() if len(y) else 0.5
    chi = (ones - n * share) ** 2 / np.maximum(n * share * (1 - share), 1e-9)
    chi[n < RARE] = 0
    mask = np.zeros(DIMS, bool)
    best = np.argsort(-chi, kind="stable")[:BEST]
    mask[best[chi[best] >= LEAST_CHI]] = True
    return mask


def fit(xs: list[np.ndarray], before: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 1.0, seed: int = 5) -> Linear:
    """Adaptive stochastic gradients over the rows in a fixed random order."""
    mask = chosen(xs, y)
    xs = [x[mask[x]] for x in xs]
    k = before.shape[1]
    m = Linear(np.zeros(DIMS, np.float32), np.zeros(k + 1, np.float32))
    g, gu, rng = np.full(DIMS, 1.0, np.float32), np.full(k + 1, 1.0, np.float32), np.random.default_rng(seed)
    extra = np.concatenate([before, np.ones((len(y), 1))], 1).astype(np.float32)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            x = xs[i]
            z = float(m.w[x].sum()) + float(m.u @ extra[i])
            d = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0))) - y[i]
            if abs(d) < 1e-3:
                continue
            g[x] += d * d
            m.w[x] -= rate * d / np.sqrt(g[x])
            gu += (d * extra[i]) ** 2
            m.u -= rate * d * extra[i] / np.sqrt(gu)
    return m


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 over out-of-fold probabilities."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1e-9))
    last = np.r_[p[order][1:] < p[order][:-1], True] if len(p) else np.zeros(0, bool)
    f1[~last] = -1
    if not len(p) or not y.sum():
        return 0.5
    k = int(f1.argmax())
    after = float(p[order][k + 1]) if k + 1 < len(p) else 0.0
    return (float(p[order][k]) + after) / 2


@dataclass
class Chain:
    links: list[Linear]
    threshold: float


def fit_fold(xs: list[np.ndarray], seen: np.ndarray, y: np.ndarray, fold: int, folds: int, epochs: int = EPOCHS) -> tuple[Linear, np.ndarray, np.ndarray]:
    """(model, rows, probabilities): fitted without the rows of the fold, which it
    then predicts; fold -1 leaves out none."""
    mine = np.arange(len(y)) % folds == fold
    rows = np.flatnonzero(~mine)
    m = fit([xs[i] for i in rows], seen[rows], y[rows], epochs)
    held = np.flatnonzero(mine)
    return m, held, np.array([m.probability(xs[i], seen[i]) for i in held])


def _side_by_side(spark: SparkSession, xs, seen, y, folds: list[int], of: int, epochs: int):
    """``fit_fold`` of each fold in a task of its own."""
    shared = spark.sparkContext.broadcast((xs, seen, y))  # at most MAX_ROWS rows

    def run(batches):
        for b in batches:
            for f in b.column(0).to_pylist():
                m, rows, p = fit_fold(*shared.value, f, of, epochs)
                at = np.flatnonzero(m.w).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"fold": pa.array([f], pa.int64()), **{k: pa.array([x.tolist()], t) for k, x, t in (("at", at, pa.list_(pa.int64())), ("w", m.w[at], pa.list_(pa.float32())), ("u", m.u, pa.list_(pa.float32())), ("rows", rows, pa.list_(pa.int64())), ("p", p, pa.list_(pa.float64())))}})

    tasks = spark.range(0, len(folds), 1, len(folds)).select((F.col("id") + min(folds)).alias("fold"))
    done = tasks.mapInArrow(run, "fold long, at array<long>, w array<float>, u array<float>, rows array<long>, p array<double>").collect()  # models of at most BEST features
    shared.destroy()
    out = {}
    for r in done:
        m = Linear(np.zeros(DIMS, np.float32), np.array(r["u"], np.float32))
        m.w[np.array(r["at"], np.int64)] = np.array(r["w"], np.float32)
        out[r["fold"]] = m, np.array(r["rows"], np.int64), np.array(r["p"])
    return [out[f] for f in folds]


def fit_chain(xs: list[np.ndarray], ys: np.ndarray, folds: int = FOLDS, epochs: int = EPOCHS, spark: SparkSession | None = None) -> Chain:
    """One model per column of ys; later ones are fitted on out-of-fold
    probabilities of the earlier ones, and the last one's set the threshold.
    With a session, models of a link are fitted side by side in its executors."""
    n, k = ys.shape
    seen, links, threshold = np.zeros((n, 0)), [], 0.5
    parts = list(range(-1, min(folds, n)))
    for c in range(k):
        if spark is None:
            done = [fit_fold(xs, seen, ys[:, c], f, folds, epochs) for f in parts]
        else:
            done = _side_by_side(spark, xs, seen, ys[:, c], parts, folds, epochs)
        links.append(done[0][0])
        out = np.zeros(n)
        for _, rows, p in done[1:]:
            out[rows] = p
        threshold = best_threshold(out, ys[:, c])
        seen = np.c_[seen, out]
    return Chain(links, threshold)


def predict(chain: Chain, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(chain.links))
    for c, m in enumerate(chain.links):
        out[c] = m.probability(x, out[:c])
    return out


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, max_rows: int = MAX_ROWS) -> Chain:
    """Chain from the labelled rows; rows with a null label or id are left out.

    Of clashing labels of an id the largest counts, category by category; of the
    texts of an id, that with the largest features.
    """
    known = labels.select("doc_id", *(F.col(c).cast("double").alias(c) for c in categories)).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    known = common.written(known, "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_rows
    fields = ["doc_id", *categories, "x"]

    def extract(batches):
        features = Features()
        for b in batches:
            texts = b.column(1).to_pylist()
            x = pa.array([features(t).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], x], names=fields)

    found = rows.mapInArrow(extract, f"doc_id long, {', '.join(f'{c} double' for c in categories)}, x binary")
    # copies of an id would pass the bound: one row for each
    found = found.groupBy("doc_id").agg(F.max(F.struct(*fields[1:])).alias("r")).orderBy(F.xxhash64("doc_id"), "doc_id").select("r.*")
    xs, ys = [], []
    for r in found.toLocalIterator():  # at most max_rows
        xs.append(np.frombuffer(r["x"], np.int32))
        ys.append([r[c] for c in categories])
    ys = np.array(ys).reshape(len(ys), len(categories))
    return fit_chain(xs, ys, spark=docs.sparkSession if len(ys) else None)


def score(docs: DataFrame, chain: Chain, keep: list[str], categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """``keep`` columns and p_<category> of every row of docs."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(chain)  # DIMS numbers per category
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text"))
    names = [f"p_{c}" for c in categories]
    schema = src.select(*keep, *(F.lit(0.0).alias(n) for n in names)).schema

    def run(batches):
        chain = shared.value
        features = Features(np.logical_or.reduce([m.w != 0 for m in chain.links]))
        for b in batches:
            p = np.array([predict(chain, features(t)) for t in b.column(b.num_columns - 1).to_pylist()]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(p[:, i]) for i in range(len(names)))], schema=pa.schema([*(b.schema.field(i) for i in range(b.num_columns - 1)), *(pa.field(n, pa.float64()) for n in names)]))

    return src.mapInArrow(run, schema)


def flag_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_quality, p_toxic, toxic (p_toxic above the threshold) by row.

    Null and empty texts have the score of a text without words. Repeated rows
    stay. Without labelled rows every probability is one half: nothing is toxic.
    """
    chain = train(docs, labels)
    return score(docs.select("doc_id", "text"), chain, ["doc_id"]).withColumn("toxic", F.col("p_toxic") > chain.threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that ``flag_toxic`` doesn't flag."""
    chain = train(docs, labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return score(rows, chain, ["_row"]).where(F.col("p_toxic") <= chain.threshold).select("_row.*")
