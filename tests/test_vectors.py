"""Nearest vectors and feature dependence against plain numpy."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import learning, vectors


@pytest.mark.parametrize("small", [False, True])
def test_nearest_vectors_are_exact(spark, monkeypatch, small):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 6))
    v[100:200] = v[100]  # ties
    rows = [(i, [float(x) for x in r], i % 7) for i, r in enumerate(v)] + [(900, None, 0), (901, [0.0] * 6, 0), (902, [None] + [1.0] * 5, 0), (None, [1.0] * 6, 0), (903, [float("nan")] * 6, 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, block int")
    if small:
        monkeypatch.setattr(vectors, "LEAST", 32)
        monkeypatch.setattr(vectors, "TILE", 3)
    found = vectors.cosine_topk(df.where("id % 50 = 0"), df, "id", "v", 4)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], []).append((r["neighbour"], r["similarity"]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 400, 50))
    for q, near in got.items():
        s = unit @ unit[q]
        want = sorted(((-round(float(x), 9), i) for i, x in enumerate(s) if i != q))[:4]
        near = sorted((-round(x, 9), i) for i, x in near)
        assert [x for x, _ in near] == pytest.approx([x for x, _ in want]) and len(near) == 4
        if q not in (100, 150):
            assert [i for _, i in near] == [i for _, i in want]


def test_vectors_of_text_keys_none_and_unequal(spark):
    kind = "id string, v array<float>"
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], kind)
    got = [tuple(r)[:2] for r in vectors.cosine_topk(df.where("id = 'a'"), df, "id", "v", 5).orderBy(F.desc("similarity")).collect()]
    assert got == [("a", "b"), ("a", "c")]
    none = df.where("false")
    assert vectors.cosine_topk(none, df, "id", "v").count() == 0 and vectors.cosine_topk(df, none, "id", "v").count() == 0
    with pytest.raises(ValueError, match="components"):
        vectors.cosine_topk(df, df.unionByName(spark.createDataFrame([("d", [1.0])], kind)), "id", "v")


def test_features_are_ranked_by_information(spark):
    rng = np.random.default_rng(2)
    n = 3000
    y = rng.integers(0, 3, n)
    rows = [(int(t), float(t + rng.normal(0, 0.3)) if i % 40 else None, f"c{(t + (rng.random() < 0.3)) % 3}", float(rng.normal()), "same") for i, t in enumerate(y)]
    df = spark.createDataFrame(rows, "y int, near double, word string, noise double, flat string")
    got = {r["feature"]: r for r in learning.feature_dependence(df, "y").collect()}
    assert [f for f, _ in sorted(got.items(), key=lambda x: x[1]["rank"])][:2] == ["near", "word"] and got["flat"]["mi"] == pytest.approx(0) and got["noise"]["mi"] < 0.01
    cells = Counter((r[2], r[0]) for r in rows)
    a, b = Counter(r[2] for r in rows), Counter(r[0] for r in rows)
    assert got["word"]["mi"] == pytest.approx(sum(c / n * math.log(c * n / (a[x] * b[t])) for (x, t), c in cells.items()))
    assert got["near"]["n_values"] == 11  # ten bins and null


def test_semantic_types_by_values(spark):
    n = 200
    rows = [(f"http://x.org/{i}", f"10.0.{i % 9}.{i % 7}", ["EUR", "USD"][i % 2], f"u{i}@x.org", -33.8123456 + i / 977, (i % 90) / 91.0, i % 80, 1000 + i % 3, ["yes", "no"][i % 2], f"{i % 60}:{i % 50 + 10}", f"{i} Long Winding Garden Street", f"{10000 + i % 50}", " ".join(["word"] * 20) + str(i % 150), f"w{i % 40}", f"+49 170 {1000000 + i % 90}", None, i * 1.5 + 300) for i in range(n)]
    names = "a1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2 b3 b4 b5 b6 b7 b8"
    kinds = ["string"] * 4 + ["double"] * 2 + ["int"] * 2 + ["string"] * 8 + ["double"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(names.split(), kinds)))
    got = {r["column"]: r["semantic"] for r in learning.semantic_types(df).collect()}
    want = "url ip_address currency_code email coordinates percentage age count boolean duration address zipcode text name phone unknown numeric"
    assert got == dict(zip(names.split(), want.split()))
