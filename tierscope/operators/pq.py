"""Product quantization: codebook, codes, decoding, asymmetric distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tierscope.functions import vectors as V
from tierscope.operators.corpus import shuffled
from tierscope.operators.knn import Coded, knn_blocked
from tierscope.plans.session import cut

CHUNKS, CENTROIDS = 32, 16


def center(base: DataFrame, dims: int) -> DataFrame:
    """One row: the mean vector, rounded to 6 digits."""
    return base.agg(F.array(*[F.round(F.avg(F.col("vec")[i]), 6) for i in range(dims)]).alias("center"))


def codebook(base: DataFrame, dims: int, chunks: int = CHUNKS, centroids: int = CENTROIDS, seed: int = 11) -> DataFrame:
    """(chunk, centroid, sub): sampled vectors minus the center, cut into chunks."""
    step = dims // chunks
    sample = base.select("node_id", "vec").orderBy(*shuffled(seed, "node_id")).limit(centroids)
    sample = sample.withColumn("centroid", F.row_number().over(W.orderBy(*shuffled(seed, "node_id"))) - 1)  # ``centroids`` rows
    moved = sample.crossJoin(center(base, dims)).select("centroid", F.zip_with("vec", "center", lambda a, b: a - b).alias("v"))
    parts = F.array(*[F.slice("v", c * step + 1, step) for c in range(chunks)])
    return moved.select("centroid", F.posexplode(parts).alias("chunk", "sub")).select(F.col("chunk").cast("long").alias("chunk"), F.col("centroid").cast("long").alias("centroid"), "sub")


def trained(base: DataFrame, dims: int, chunks: int = CHUNKS, centroids: int = 256, rounds: int = 8, seed: int = 11) -> DataFrame:
    """(chunk, centroid, sub) by k-means in every chunk at once, from ``codebook``.

    A round is one pass: tasks add up their vectors by nearest centroid (the
    smaller of equally near ones) in Arrow batches, and only chunks x centroids
    sums leave them. Centroids without vectors stay. The codebook, of a fixed
    size, is all that passes through the driver. Means are rounded to 6 digits.
    """
    step, spark = dims // chunks, base.sparkSession
    middle = np.array(center(base, dims).first()["center"])
    book = np.zeros((chunks, centroids, step))
    used = np.zeros((chunks, centroids), bool)
    for r in codebook(base, dims, chunks, centroids, seed).collect():  # chunks x centroids rows
        book[r["chunk"], r["centroid"]], used[r["chunk"], r["centroid"]] = r["sub"], True
    book[~used] = np.inf  # fewer vectors than centroids
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((book, middle))

        def add(batches, shared=shared):
            book, middle = shared.value
            sums, n = np.zeros((chunks, centroids, step)), np.zeros((chunks, centroids), np.int64)
            for pdf in batches:
                if not len(pdf):
                    continue
                v = (np.stack(pdf["vec"].to_numpy()).astype(np.float64) - middle).reshape(len(pdf), chunks, step)
                for c in range(chunks):
                    d = ((v[:, c, None, :] - book[None, c]) ** 2).sum(2)
                    near = np.where(np.isnan(d), np.inf, d).argmin(1)
                    np.add.at(sums[c], near, v[:, c])
                    n[c] += np.bincount(near, minlength=centroids)
            at = np.argwhere(n)
            yield pd.DataFrame({"chunk": at[:, 0], "centroid": at[:, 1], "n": n[n > 0], "sub": [sums[c, j].tolist() for c, j in at]})

        parts = base.select("vec").mapInPandas(add, "chunk long, centroid long, n long, sub array<double>")
        mean = F.array(*[F.round(F.sum(F.col("sub")[i]) / F.sum("n"), 6) for i in range(step)])
        moved = book.copy()
        for r in parts.groupBy("chunk", "centroid").agg(mean.alias("sub")).collect():  # chunks x centroids rows
            moved[r["chunk"], r["centroid"]] = r["sub"]
        shared.destroy()
        if np.array_equal(moved, book):
            break
        book = moved
    rows = [(c, j, book[c, j].tolist()) for c, j in np.argwhere(used).tolist()]
    return spark.createDataFrame(rows, "chunk long, centroid long, sub array<double>")


def encode_lists(base: DataFrame, book: DataFrame, dims: int, chunks: int = CHUNKS) -> DataFrame:
    """node_id, code: the nearest centroid (the smaller of equally near ones) of
    each chunk, in chunk order. The codebook has a fixed size."""
    step = dims // chunks
    middle = np.array(center(base, dims).first()["center"], np.float64)
    known = {(r["chunk"], r["centroid"]): r["sub"] for r in book.collect()}  # chunks x centroids rows
    subs = np.full((chunks, max((j for _, j in known), default=0) + 1, step), np.inf)
    for at, sub in known.items():
        subs[at] = sub

    def near(batches):
        for pdf in batches:
            code = np.zeros((len(pdf), chunks), np.int64)
            if len(pdf):
                v = (np.stack(pdf["vec"].to_numpy()).astype(np.float64) - middle).reshape(len(pdf), chunks, step)
                for c in range(chunks):
                    d = v[:, c, None, :] - subs[c]
                    d = (d * d).cumsum(2)[:, :, -1]  # adds from left to right
                    code[:, c] = np.where(np.isnan(d), np.inf, d).argmin(1)
            yield pd.DataFrame({"node_id": pdf["node_id"], "code": list(code)})

    return base.select("node_id", "vec").mapInPandas(near, "node_id long, code array<long>")


def code_rows(lists: DataFrame) -> DataFrame:
    """(node_id, chunk, code) from codes as arrays."""
    return lists.select("node_id", F.posexplode("code").alias("chunk", "code")).withColumn("chunk", F.col("chunk").cast("long"))


def encode(base: DataFrame, book: DataFrame, dims: int, chunks: int = CHUNKS) -> DataFrame:
    """(node_id, chunk, code): the nearest centroid of each chunk."""
    return code_rows(encode_lists(base, book, dims, chunks))


def code_arrays(codes: DataFrame) -> DataFrame:
    """node_id, code as an array in chunk order."""
    x = codes.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "code"))).alias("x"))
    return x.select("node_id", F.col("x.code").alias("code"))


def decode(codes: DataFrame, book: DataFrame, middle: DataFrame) -> DataFrame:
    """node_id, decoded: centroids put together, plus the center."""
    parts = codes.join(F.broadcast(book), (codes["chunk"] == book["chunk"]) & (codes["code"] == book["centroid"])).select("node_id", codes["chunk"], "sub")
    whole = parts.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "sub"))).alias("x"))
    return whole.crossJoin(F.broadcast(middle)).select("node_id", F.zip_with(F.flatten(F.col("x.sub")), F.col("center"), lambda a, b: a + b).alias("decoded"))


def adc_table(queries: DataFrame, book: DataFrame, middle: DataFrame, dims: int, chunks: int = CHUNKS) -> DataFrame:
    """(query_id, chunk, centroid, d): distances of a query's chunks to centroids."""
    step = dims // chunks
    moved = queries.crossJoin(F.broadcast(middle)).select("query_id", F.zip_with("qvec", "center", lambda a, b: a - b).alias("v"))
    parts = moved.select("query_id", F.posexplode(F.array(*[F.slice("v", c * step + 1, step) for c in range(chunks)])).alias("chunk", "part"))
    return parts.join(F.broadcast(book), "chunk").select("query_id", F.col("chunk").cast("long").alias("chunk"), "centroid", V.l2_sq(F.col("part"), F.col("sub"), step).alias("d"))


def adc_arrays(table: DataFrame) -> DataFrame:
    """query_id, adc: the table of a query as one array."""
    x = table.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "centroid", "d"))).alias("x"))
    return x.select("query_id", F.col("x.d").alias("adc"))


def adc_scan(lists: DataFrame, table: DataFrame, k: int, centroids: int = CENTROIDS) -> DataFrame:
    """The k nearest by codes alone (node_id, code as an array), scanning all nodes
    block by block."""
    tables = cut(adc_arrays(table)).select("query_id", F.col("adc").alias("qvec"))
    return knn_blocked(lists.select("node_id", F.col("code").alias("vec")), tables, k, how=Coded(centroids))
