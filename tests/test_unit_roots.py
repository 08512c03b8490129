"""Unit-root tests against plain numpy regressions, and on series of known kind."""

import math

import numpy as np
import pytest

from tidewell.operators import statistics, unit_roots


def brute_adf(x, lags=None):
    """(stat, lags, rows used), each regression by least squares on its own rows."""
    x, n = np.asarray(x, float), len(x)
    d = np.diff(x)

    def fit(k, first):
        rows = range(first, n - 1)
        a = np.array([[1.0, x[t], *[d[t - j] for j in range(1, k + 1)]] for t in rows])
        y = np.array([d[t] for t in rows])
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        rss = float(((y - a @ beta) ** 2).sum())
        return beta, rss, a, len(y)

    most = unit_roots.most_lags(n)
    if lags is None:
        scores = []
        for k in range(most + 1):
            _, rss, _, used = fit(k, most)
            scores.append((used * math.log(rss / used) + 2 * (k + 2), k))
        lags = min(scores)[1]
    beta, rss, a, used = fit(lags, lags)
    return beta[1] / math.sqrt(rss / (used - lags - 2) * np.linalg.inv(a.T @ a)[1, 1]), lags, used


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(11)
    made = {"noise": rng.normal(50, 1, 200), "walk": 1000 + np.cumsum(rng.normal(0, 1, 300)), "short": rng.normal(0, 1, 25), "lagged": None, "flat": np.full(40, 3.0), "tiny": np.array([1.0, 2.0])}
    x = np.zeros(400)
    for t in range(3, 400):
        x[t] = 0.5 * x[t - 1] - 0.3 * x[t - 2] + 0.4 * x[t - 3] + rng.normal()
    made["lagged"] = x
    rows = [(k, i, float(v)) for k, own in made.items() for i, v in enumerate(own)] + [("walk", 500, None), ("noise", 500, float("nan"))]
    return made, spark.createDataFrame(rows, "k string, t long, v double")


@pytest.mark.parametrize("ranges", [None, 5])
def test_adf_equals_separate_regressions(series, ranges):
    made, df = series
    got = {r["k"]: r for r in unit_roots.adf_test(df, "v", ["t"], ["k"], ranges=ranges).collect()}
    for k in ("noise", "walk", "short", "lagged"):
        stat, lags, used = brute_adf(made[k])
        assert (got[k]["lags"], got[k]["n_used"]) == (lags, used)
        assert got[k]["stat"] == pytest.approx(stat, rel=1e-6)
    assert got["noise"]["stationary"] and got["noise"]["p"] < 0.001 and got["lagged"]["stationary"]
    assert not got["walk"]["stationary"] and got["walk"]["p"] > 0.1
    assert got["flat"]["stat"] is None and got["tiny"]["stationary"] is None
    fixed = {r["k"]: r["stat"] for r in unit_roots.adf_test(df, "v", ["t"], ["k"], lags=2).collect()}
    assert fixed["walk"] == pytest.approx(brute_adf(made["walk"], 2)[0], rel=1e-6)


def test_one_series_without_a_key(series):
    made, df = series
    got = unit_roots.adf_test(df.where("k = 'walk'"), "v", ["t"]).collect()
    assert len(got) == 1 and got[0]["stat"] == pytest.approx(brute_adf(made["walk"])[0], rel=1e-6)
    assert unit_roots.adf_test(df.where("false"), "v", ["t"], ["k"]).count() == 0


def test_tabulated_values():
    assert unit_roots.dickey_fuller_p(-2.86) == pytest.approx(0.05, abs=0.001)
    assert unit_roots.dickey_fuller_p(-3.43) == pytest.approx(0.01, abs=0.001)
    assert unit_roots.dickey_fuller_p(-1.61 - 1e-9) == pytest.approx(unit_roots.dickey_fuller_p(-1.61 + 1e-9), abs=0.01)
    assert unit_roots.critical_value(100) == pytest.approx(-2.891, abs=0.001)


def brute_kpss(x, lags=None):
    e, n = np.asarray(x) - np.mean(x), len(x)
    g = [float(e[i:] @ e[: n - i]) for i in range(n)]
    if lags is None:
        first = int(n ** (2 / 9))
        s0 = g[0] / n + sum(g[i] / (n / 2) for i in range(1, first + 1))
        s1 = sum(i * g[i] / (n / 2) for i in range(1, first + 1))
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    variance = (g[0] + 2 * sum(g[i] * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / n
    return float((np.cumsum(e) ** 2).sum()) / n**2 / variance, lags


@pytest.mark.parametrize("ranges", [None, 5])
def test_kpss_equals_plain_sums(series, ranges):
    made, df = series
    got = {r["k"]: r for r in unit_roots.kpss_test(df, "v", ["t"], ["k"], ranges=ranges).collect()}
    for k in ("noise", "walk", "short", "lagged"):
        stat, lags = brute_kpss(made[k])
        assert got[k]["lags"] == lags and got[k]["stat"] == pytest.approx(stat, rel=1e-6)
    assert got["noise"]["stationary"] and not got["walk"]["stationary"] and got["flat"]["stat"] is None
    assert 0.01 <= got["walk"]["p"] < 0.05 < got["noise"]["p"] <= 0.1


def test_battery_has_stationarity(series):
    _, df = series
    got = {r["test"]: r for r in statistics.statistical_test_battery(df.where("k IN ('noise', 'walk')"), ["v"], "k", ["k", "t"]).collect()}
    assert set(got) == {"dagostino", "levene", "adf"} and all(0 <= r["p"] <= 1 for r in got.values())


@pytest.mark.parametrize("ranges", [None, 7, 300])
def test_lags_grow_with_the_series(spark, ranges):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 5000)
    for t in range(32, 5000):
        x[t] += 0.6 * x[t - 32]
    x[0] = 1e4  # far from the mean of the other ranges
    walk = np.cumsum(rng.normal(0, 1, 5000))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, walk))], "t long, v double, w double")
    assert unit_roots.most_lags(5000) == 32 and unit_roots.most_lags(36_000_000) == 294
    got = {r["column"]: r for r in unit_roots.adf_tests(df, ["v", "w"], ["t"], ranges=ranges).collect()}
    for c, values in (("v", x), ("w", walk)):
        stat, lags, used = brute_adf(values)
        assert (got[c]["lags"], got[c]["n_used"]) == (lags, used) and got[c]["stat"] == pytest.approx(stat, rel=1e-6)
    assert got["v"]["lags"] > 30
    stat, lags = brute_kpss(walk)
    found = unit_roots.kpss_test(df, "w", ["t"], ranges=ranges).first()
    assert lags > 30 and found["lags"] == lags and found["stat"] == pytest.approx(stat, rel=1e-6)


def test_rows_of_equal_order_make_no_dependence(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i // 10, float(v)) for i, v in enumerate(rng.normal(0, 1, 4000))], "t long, v double")
    got = [unit_roots.adf_test(x, "v", ["t"], lags=1).first()["stat"] for x in (df, df.orderBy("v").repartition(3))]
    assert got[0] == got[1] and abs(got[0] + math.sqrt(4000 / 2)) < 3  # of noise: one lag halves the rows' weight
