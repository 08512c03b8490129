"""Stored sketches: merged ones against one over all rows and against exact values, within the stated bounds."""

import math
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import aggregates, sketches


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Thirty days of skewed numbers, keys and text with nulls, a folder a day."""
    base = tmp_path_factory.mktemp("days")
    for d in range(30):
        rng = np.random.default_rng(d)
        n = 2000 + 100 * d
        rows = [(float(v) if k % 50 else None, int(k), f"w{k % 300}" if k % 7 else None) for v, k in zip(rng.lognormal(1 + d / 30, 1, n), rng.integers(0, 40_000, n))]
        spark.createDataFrame(rows, "v double, k long, s string").coalesce(2).write.parquet(f"{base}/day={d:02d}")
    return str(base)


@pytest.fixture(scope="module")
def store(spark, table, tmp_path_factory):
    store = sketches.SketchStore(spark, str(tmp_path_factory.mktemp("store")))
    for d in range(29):
        store.add(spark.read.parquet(f"{table}/day={d:02d}"), "t", f"{d:02d}")
    return store


def close(got, exact):
    """Exact fields are equal; distinct counts and quartiles keep their bounds."""
    for r in got:
        v = np.sort(exact[r["column"]].dropna().to_numpy()) if r["column"] != "s" else exact["s"].dropna().to_numpy()
        assert r["n"] == len(v) and r["nulls"] == exact[r["column"]].isna().sum()
        assert abs(r["approx_distinct"] / len(set(v)) - 1) < 3 * 1.04 / math.sqrt(1 << sketches.LG_K)
        if r["column"] == "s":
            assert r["quartiles"] is None and r["mean"] is None
            continue
        assert (r["least"], r["most"]) == (v[0], v[-1])
        assert r["mean"] == pytest.approx(v.mean()) and r["std"] == pytest.approx(v.std(ddof=1))
        for share, q in zip((0.25, 0.5, 0.75), r["quartiles"]):
            low, high = np.searchsorted(v, q, "left") / len(v), np.searchsorted(v, q, "right") / len(v)
            assert low - sketches.RANK_ERROR <= share <= high + sketches.RANK_ERROR


def test_merged_and_direct_profiles_keep_their_bounds(spark, table, store):
    df = spark.read.parquet(*[f"{table}/day={d:02d}" for d in range(29)])
    exact = df.toPandas()
    merged = store.profile("t").collect()
    close(merged, exact)
    direct = sketches.profile(sketches.sketch(df)).collect()
    close(direct, exact)
    # a merged distinct sketch is the same as a direct one
    assert {r["column"]: r["approx_distinct"] for r in merged} == {r["column"]: r["approx_distinct"] for r in direct}
    assert {r["column"] for r in aggregates.approx_profile(df, ["v", "k"]).collect()} == {"v", "k"}


def test_a_new_day_needs_its_own_rows_only(spark, table, store, tmp_path):
    only = tmp_path / "day=29"
    shutil.copytree(f"{table}/day=29", only)
    before = {r["column"]: r["n"] for r in store.profile("t").collect()}
    for _ in range(2):  # a second time replaces the first
        store.add(spark.read.parquet(str(only)), "t", "29")
    after = store.profile("t").collect()
    close(after, spark.read.parquet(table).drop("day").toPandas())
    assert all(r["n"] > before[r["column"]] for r in after)
    assert {r["partition"] for r in store.rows("t", ["03", "04"]).collect()} == {"03", "04"}


def test_all_partitions_in_one_pass(spark, table, store, tmp_path):
    other = sketches.SketchStore(spark, str(tmp_path))
    df = spark.read.parquet(table).where("day < 29")
    for _ in range(2):
        other.add_by(df, "t", F.format_string("%02d", "day"), ["v", "k", "s"])
    exact = ["column", "partition", "n", "nulls", "zeros", "least", "most"]
    days = [f"{d:02d}" for d in range(29)]
    assert sorted(map(tuple, other.rows("t", days).select(exact).collect())) == sorted(map(tuple, store.rows("t", days).select(exact).collect()))


def test_drift_from_sketches(spark, table, store):
    base, now = [f"{d:02d}" for d in range(5)], [f"{d:02d}" for d in range(24, 29)]
    got = {r["column"]: r["psi"] for r in store.psi("t", base, now).collect()}
    assert set(got) == {"v", "k"}
    frame = lambda days: spark.read.parquet(*[f"{table}/day={d}" for d in days]).toPandas()
    for c in got:
        a, b = (np.sort(frame(days)[c].dropna().to_numpy()) for days in (base, now))
        edges = [a[int(len(a) * i / 10)] for i in range(1, 10)]
        share = lambda x: np.diff([0, *[np.searchsorted(x, e, "right") / len(x) for e in edges], 1])
        p, q = share(a), share(b)
        assert got[c] == pytest.approx(float(((q - p) * np.log(q / p)).sum()), abs=0.05)
    assert got["v"] > 0.2 > got["k"]


def test_empty_and_null_columns(spark, tmp_path):
    store = sketches.SketchStore(spark, str(tmp_path))
    assert store.profile("none").count() == 0
    df = spark.createDataFrame([], "v double, s string")
    store.add(df, "t", "a")
    assert {(r["column"], r["n"], r["quartiles"]) for r in store.profile("t").collect()} == {("v", 0, None), ("s", 0, None)}
    store.add(spark.createDataFrame([(None, None), (float("nan"), "x")], "v double, s string"), "t", "b")
    got = {r["column"]: r for r in store.profile("t").collect()}
    assert (got["v"]["n"], got["v"]["nulls"], got["v"]["mean"], got["s"]["n"]) == (0, 2, None, 1)
    store.add(spark.createDataFrame([(2.0, "x")], "v double, s string"), "t", "c")
    got = {r["column"]: r for r in store.profile("t").collect()}
    assert (got["v"]["mean"], got["v"]["std"], got["v"]["quartiles"]) == (2.0, None, [2.0, 2.0, 2.0])
