"""What sweeps send to the driver, and their answers against plain ones."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.operators import knn, masks, search
from tierscope.plans import catalog, oracle
from tierscope.plans.catalog import CURVE, DIMS, FRACTIONS, ORDERS, RANDOM, Fixture, _r


@pytest.fixture(scope="module")
def f(spark, sf):
    return Fixture(spark, sf)


def equals_sql(f, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got, want = _r(catalog.Q[name](f)), con.sql(oracle.oracle_sql()[name])
    cell = lambda v: round(v, 5) if isinstance(v, float) else v
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(map(cell, r)) for r in got.select(*want.columns).collect()), key=str) == sorted((tuple(map(cell, r)) for r in want.fetchall()), key=str)


def no_search(*_):
    raise AssertionError("a ceiling needs no search")


@pytest.mark.parametrize("name", ["ceiling_curve", "random_avg_ceiling_curve"])
def test_ceilings_run_no_search(f, sf, name, monkeypatch):
    monkeypatch.setattr(search, "masked_search", no_search)
    equals_sql(f, sf, name)


@pytest.mark.parametrize("name", ["restoration_curve", "random_avg_curve", "normalized_curve", "crossing_bytes", "h1_ratio"])
def test_masks_do_not_come_to_the_driver_by_node(f, sf, name, monkeypatch):
    """Only a row for each node comes to the driver, not one for each mask and node."""
    sizes, arrow = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toPandas", lambda _: pytest.fail("rows by mask and node"))
    monkeypatch.setattr(DataFrame, "toArrow", lambda d: sizes.append(len(out := arrow(d))) or out)
    equals_sql(f, sf, name)
    assert max(sizes, default=0) <= f.nodes.count()


def test_groupings_of_a_sweep_equal_those_of_single_orders(f):
    names = ORDERS + RANDOM[:2]
    got = f.sweep_groupings(names).toPandas()
    limits = f.sweep_limits(names)
    sizes = {r["mask_id"]: r["bytes_total"] for r in masks.prefix_bytes(f.sweep_groupings(names), limits, f.adj, DIMS).collect()}
    for o in names:
        one = got[got["order"] == o]
        assert dict(zip(one["node_id"], one["group_id"], strict=True)) == {r["node_id"]: r["group_id"] for r in f.grouping(o).collect()}
        assert {k: v for k, v in sizes.items() if k.startswith(f"{o}|")} == {r["mask_id"]: r["total"] for r in f.bytes(o, CURVE, prefix=f"{o}|").collect()}


def test_bits_hold_the_flags_of_more_masks_than_a_word(f):
    some = f.pred("random_101", FRACTIONS).where("node_id < 20")
    pred = some.crossJoin(f.spark.range(40)).withColumn("mask_id", F.concat_ws("|", "mask_id", "id")).drop("id")
    names, bits = search.mask_bits(pred)
    rows = {r["node_id"]: r for r in bits.collect()}
    assert len(names) == 160
    for r in pred.collect():
        w, i = divmod(names.index(r["mask_id"]), search.WORD)
        assert tuple(bool(rows[r["node_id"]][f"w{2 * w + k}"] >> i & 1) for k in (0, 1)) == (r["codes_ok"], r["adj_ok"])


@pytest.mark.parametrize("how", [knn.Squared(), knn.Coded(16)])
def test_blocks_keep_the_nearest_with_many_ties(how):
    """Copies and few different codes: the smaller id wins, as in a plain sort."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 8)) if isinstance(how, knn.Squared) else rng.integers(0, 2, (900, 4))
    v[:300] = v[0]
    q = np.concatenate([v[:40], rng.normal(size=(300, 8))]) if isinstance(how, knn.Squared) else np.round(rng.random((300, 64)), 1)
    dist = np.stack([((x - v) ** 2).cumsum(1)[:, -1] for x in q]) if isinstance(how, knn.Squared) else np.stack([x[v + 16 * np.arange(4)].cumsum(1)[:, -1] for x in q])
    ids, best = rng.permutation(900), knn._Best(np.arange(len(q)), q.astype(float), 11, how)
    for lo in range(0, 900, 350):
        knn._add(best, pd.DataFrame({"node_id": ids[lo : lo + 350], "vec": list(v[lo : lo + 350])}))
    order = [np.lexsort((ids, d))[:11] for d in dist]
    assert (best.node == [ids[o] for o in order]).all() and (best.dist == [d[o] for d, o in zip(dist, order, strict=True)]).all()


def test_codes_are_scanned_in_blocks(f, sf, monkeypatch):
    """No expression over all pairs; several blocks give the SQL's rows."""
    monkeypatch.setattr(DataFrame, "crossJoin", lambda a, b, cross=DataFrame.crossJoin: pytest.fail("all pairs") if "code" in a.columns else cross(a, b))
    monkeypatch.setattr(knn.knn_blocked, "__defaults__", (7, 90, None))
    equals_sql(f, sf, "estimator_calibration")
