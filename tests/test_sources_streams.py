import numpy as np
import pytest
from pyspark.sql import functions as F

from tierscope.operators import recovery
from tierscope.sources import formats
from tierscope.streaming import quality


@pytest.fixture(scope="module")
def sources(spark):
    formats.register(spark)
    return spark


def test_matrix_round_trip(sources, tmp_path):
    x = np.random.default_rng(0).normal(size=(53, 4)).astype("<f4")
    path = f"{tmp_path}/m.bin"
    formats.write_section(path, x)
    df = sources.read.format("matrixfile").option("rows", 10).load(path)
    got = {r["row_id"]: r["values"] for r in df.collect()}
    assert df.rdd.getNumPartitions() == 6 and np.allclose([got[i] for i in range(53)], x, atol=0)
    out = f"{tmp_path}/copy.bin"
    df.repartition(3).write.format("matrixfile").option("dtype", "f4").mode("append").save(out)
    assert (formats.section(out, "f4") == x).all()
    with open(path, "r+b") as f:
        f.truncate(100)
    with pytest.raises(ValueError):
        formats.section(path, "f4")


@pytest.mark.parametrize(("dtype", "n", "d", "slots"), [("u1", 500, 32, 16), ("f4", 600, 24, 20)])
def test_index_round_trip(sources, tmp_path, dtype, n, d, slots):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 256, (n, d)) if dtype == "u1" else rng.normal(size=(n, d))
    v = v.astype(formats.TYPES[dtype])
    nbrs = [rng.choice(n, rng.integers(1, slots + 1), replace=False).tolist() for _ in range(n)]
    path = f"{tmp_path}/i.index"
    formats.write_index(path, v, nbrs, slots, 7, dtype)
    meta = formats.index_meta(path, dtype)
    assert (meta.npts, meta.ndims, meta.medoid, meta.slots) == (n, d, 7, slots)
    assert meta.file_size == __import__("os").path.getsize(path)
    df = sources.read.format("graphindex").option("dtype", dtype).option("rows", 70).load(path)
    rows = {r["node_id"]: r for r in df.collect()}
    assert len(rows) == n and all(rows[i]["nbrs"] == nbrs[i] and np.allclose(rows[i]["vec"], v[i], atol=0) for i in range(n))
    few = sources.read.format("graphindex").option("dtype", dtype).load(path).where("node_id >= 10 AND node_id < 13")
    assert [r["node_id"] for r in few.orderBy("node_id").collect()] == [10, 11, 12]
    assert formats.entry_points(path, dtype)[0] == [7]
    formats.write_section(f"{path}_medoids.bin", np.array([[3], [9]]), "u4")
    formats.write_section(f"{path}_centroids.bin", v[[3, 9]].astype("<f4"))
    assert formats.entry_points(path, dtype)[0] == [3, 9]
    formats.write_section(f"{path}_medoids.bin", np.array([[3]]), "u4")
    with pytest.raises(ValueError):
        formats.entry_points(path, dtype)
    with pytest.raises(IndexError):
        formats.node_offset(meta, n)


def test_metadata_errors(tmp_path):
    for rows, error in ((12, NotImplementedError), (8, ValueError)):
        path = f"{tmp_path}/{rows}.index"
        formats.write_section(path, np.zeros((rows, 1)), "u8")
        with pytest.raises(error):
            formats.index_meta(path, "f4")


def test_pivots_and_truth_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    c, middle, at = rng.normal(size=(256, 8)).astype("<f4"), rng.normal(size=8).astype("<f4"), np.array([0, 2, 5, 8])
    formats.write_pivots(f"{tmp_path}/p", c, middle, at)
    book, center = formats.read_pivots_tables(spark, f"{tmp_path}/p")
    assert book.count() == 3 * 256 and np.allclose(center.first()[0], middle)
    assert np.allclose(book.where("chunk = 1 AND centroid = 5").first()["sub"], c[5, 2:5])
    truth = spark.createDataFrame([(q, r, 10 * q + r, r / 2) for q in range(3) for r in range(4)], "query_id long, rank long, node_id long, dist double")
    formats.write_truth(truth, f"{tmp_path}/t")
    assert sorted(map(tuple, formats.read_truth(spark, f"{tmp_path}/t").collect())) == sorted(map(tuple, truth.collect()))


def test_records_and_curves(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.json").write_text('{"run_id": "x", "spec": {"groups": {"CODES": [1, 2]}}}')
    row = formats.read_records(spark, f"{tmp_path}/r", "run_id string, spec struct<groups: map<string, array<int>>>").first()
    assert row["spec"]["groups"] == {"CODES": [1, 2]}
    formats.write_curve(spark.createDataFrame([("a", 1.0)], "order string, bytes_total double"), f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True, inferSchema=True).first() == ("a", 1.0)


def drain(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


@pytest.fixture
def log(spark, tmp_path):
    rows = [(i, i % 5, f"t{i % 2}", "s", float(i % 13), 0.1 * (i % 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "lsn long, node_id long, tier string, source string, latency double, recall double")
    df = df.select("*", F.timestamp_seconds(F.col("lsn") / 10 + 1000).alias("ts"), F.lit(2).alias("degree"), F.array("lsn", F.col("lsn") + 1).alias("nbrs"))
    df.repartition(4).write.parquet(f"{tmp_path}/log")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")


def test_streamed_replay_equals_batch(spark, log):
    batch, stream = log
    got = drain(spark, quality.replayed(stream.select("lsn", "node_id", "degree", "nbrs")), "replayed", "update")
    last = got.groupBy("node_id").agg(F.max_by("nbrs", "lsn").alias("nbrs"))
    assert {r[0]: r[1] for r in last.collect()} == {r["node_id"]: r["nbrs"] for r in recovery.replay(batch).collect()}
    assert quality.truncated(batch, 150).count() == 49


def test_streamed_windows_equal_batch(spark, log, tmp_path):
    batch, _ = log
    batch.coalesce(1).write.parquet(f"{tmp_path}/one")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/one")
    got = drain(spark, quality.windowed(stream, 1.1, late="0 seconds"), "windows", "complete")
    slow = batch.withColumn("recall", F.when(F.col("latency") > 11.0, 0.0).otherwise(F.col("recall")))
    want = slow.groupBy(F.window("ts", "1 second")["start"].alias("start")).agg(F.avg("recall").alias("recall"), F.count("*").alias("n"))
    rows = lambda d: {r["start"]: (round(r["recall"], 9), r["n"]) for r in d.collect()}
    assert rows(got) == rows(want)


def test_streamed_smoothing_equals_batch(spark, log, tmp_path):
    batch, _ = log
    batch.coalesce(1).write.parquet(f"{tmp_path}/one")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/one")
    got = drain(spark, quality.smoothed(stream), "smooth", "update")
    rows = lambda d: {(r["tier"], r["source"]): round(r["ewma"], 9) for r in d.collect()}
    assert rows(got) == rows(quality.smoothed_batch(batch))
