"""Hard negatives against SQL and brute force, and the lookups against plain inner products."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import hard_negatives, oracles, queries

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every):
    """(vec_id, label, vector) rows -> expected rows."""
    own = {(i, y, tuple(math.floor(256 * t) for t in x)) for i, y, x in rows if None not in (i, y, x) and all(t is not None and math.isfinite(t) for t in x)}
    out = []
    for a in own:
        if a[0] % every:
            continue
        scored = sorted((-sum(s * t for s, t in zip(a[2], c[2])), c[0], c[1]) for c in own if c != a)
        for p, i, y in [x for x in scored if x[2] == a[1]][:5]:
            fits = [(n, j) for n, j, z in scored if z != a[1] and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(a[0], i, k, j, -p, -n) for k, (n, j) in enumerate(fits, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({oracles.oracle_sql()['op11_hard_negatives']})").fetchall()
    got = found(queries.op11_hard_negatives(spark, folder))
    assert got == sorted(want) and len(got) > 50


def test_odd_vectors_ties_and_repeats_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 3)), [float(t) for t in rng.normal(0, 0.4, 11)]) for i in range(300)]
    rows += [(i, i % 3, [0.5] * 11) for i in range(300, 700)]  # a large group of equal vectors
    rows += rows[:20] + [(5, 1, [0.1] * 11), (50, 2, [0.2] * 11), (-50, 2, [-3.0] * 3), (1000, 1, []), (1050, 2, [9.75, -8.5, 100.0])]
    rows += [(None, 1, [1.0]), (100, None, [1.0]), (150, 1, None), (200, 1, [None, 1.0]), (250, 1, [float("nan")]), (350, 1, [1.0, float("-inf")])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("key", F.lit(1)).withColumn("x", F.lit("x"))
    want = brute(rows, 50)
    assert found(hard_negatives.mine(df, F.col("vec_id") % 50 == 0)) == want and want
    monkeypatch.setattr(hard_negatives, "LEAST", 64)
    monkeypatch.setattr(hard_negatives, "TILE", 3)
    assert found(hard_negatives.mine(df, F.col("vec_id") % 50 == 0)) == want


def test_no_vectors_no_anchors_and_too_large(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.mine(spark.createDataFrame([], kind), F.col("vec_id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(1, 1, [1.0])], kind)
    assert hard_negatives.mine(one, F.col("vec_id") % 2 == 0).count() == 0
    assert hard_negatives.mine(one, F.lit(True)).columns == NAMES
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.mine(spark.createDataFrame([(1, 1, [1e30])], kind), F.lit(True))


def test_lookups_equal_inner_products():
    rng = np.random.default_rng(1)
    q, a = rng.integers(-512, 512, (5000, 24)), rng.integers(-(2**20), 2**20, (7, 24))
    planes = np.ascontiguousarray(hard_negatives.bit_planes(q, 10).transpose(1, 2, 0))
    assert np.array_equal(hard_negatives.scores(hard_negatives.subset_sums(a), planes), q @ a.T)
