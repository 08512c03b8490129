"""Forecasts: Levinson against the linear system, and intervals that hold as often as they say."""

import numpy as np
import pytest

from tidewell.operators import forecasts


def test_levinson_solves_the_equations():
    g = np.array([2.0, 1.2, 0.9, 0.3, 0.1])
    for k, (phi, variance) in enumerate(forecasts.levinson(g)):
        if k:
            m = np.array([[g[abs(i - j)] for j in range(k)] for i in range(k)])
            assert phi == pytest.approx(np.linalg.solve(m, g[1 : k + 1]))
        assert variance == pytest.approx(g[0] - phi @ g[1 : k + 1])


def test_errors_of_a_random_walk_and_an_ar():
    walk = forecasts.project(np.array([1.0, 2.0]), np.array([1.0]), 4.0, 0.0, 0, 3)
    assert [x for x, _ in walk] == [2.0, 2.0, 2.0] and [e for _, e in walk] == pytest.approx([2, 2 * 2**0.5, 2 * 3**0.5])
    ar = forecasts.project(np.array([10.0]), np.array([0.5]), 1.0, 0.0, 0, 3)
    assert [x for x, _ in ar] == [5.0, 2.5, 1.25] and [e for _, e in ar] == pytest.approx([1, 1.25**0.5, (1 + 0.25 + 0.0625) ** 0.5])
    seasonal = forecasts.project(np.array([1.0, 2.0, 3.0]), np.zeros(0), 1.0, 0.0, 3, 4)
    assert [x for x, _ in seasonal] == [1.0, 2.0, 3.0, 1.0] and [e for _, e in seasonal] == pytest.approx([1, 1, 1, 2**0.5])


@pytest.mark.parametrize("kind", ["ar1", "ar2", "seasonal"])
def test_intervals_cover_what_they_say(spark, kind):
    rng = np.random.default_rng(len(kind))
    many, n, steps = 500, 400, 5
    e = rng.normal(size=(many, n + steps + 100))
    x = np.zeros_like(e)
    for t in range(7, e.shape[1]):
        if kind == "ar1":
            x[:, t] = 0.7 * x[:, t - 1] + e[:, t]
        elif kind == "ar2":
            x[:, t] = 0.5 * x[:, t - 1] - 0.4 * x[:, t - 2] + e[:, t]
        else:
            x[:, t] = x[:, t - 7] + 0.6 * (x[:, t - 1] - (x[:, t - 8] if t > 7 else 0)) + e[:, t]
    x = x[:, 100:] + 20
    rows = [(i, t, float(x[i, t])) for i in range(many) for t in range(n)]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    got = forecasts.ar_forecast(df, "v", ["t"], ["k"], period=7 if kind == "seasonal" else 0, steps=steps).toPandas()
    assert len(got) == many * steps
    true = np.array([x[k, n + s - 1] for k, s in zip(got["k"], got["step"])])
    share = ((got["lo"] <= true) & (true <= got["hi"])).mean()
    assert abs(share - 0.95) < 0.03
    assert (got["p"] >= (2 if kind == "ar2" else 1)).mean() > 0.95
    if kind == "ar1":
        short = forecasts.ar_forecast(df.where("k < 3 AND t < 17 OR k = 7"), "v", ["t"], ["k"], ranges=4)
        assert {r["k"] for r in short.collect()} == {7}


def test_a_constant_series(spark):
    df = spark.createDataFrame([("a", i, 3.0) for i in range(40)], "k string, t long, v double")
    assert {(r["forecast"], r["lo"], r["hi"], r["p"]) for r in forecasts.ar_forecast(df, "v", ["t"], ["k"]).collect()} == {(3.0, 3.0, 3.0, 0)}
    assert forecasts.ar_forecast(df.where("false"), "v", ["t"], ["k"]).count() == 0
