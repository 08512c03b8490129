"""Regressions from cross products against plain numpy fits on the rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import tails
from tidewell.operators import regression


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = np.column_stack([rng.normal(1e5, 3, n), rng.normal(0, 1, n), rng.normal(-2, 0.5, n), rng.normal(5, 2, n)])
    y = 3 + 0.5 * (x[:, 0] - 1e5) - 2 * x[:, 1] + 0.05 * x[:, 2] + rng.normal(0, 1, n)
    rows = [(i, *map(float, r), float(v), int(v > 3), i % 5) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, d double, y double, z int, k int")
    odd = spark.createDataFrame([(n, None, 1.0, 1.0, 1.0, 1.0, 1, 0), (n + 1, 1.0, float("nan"), 1.0, 1.0, 1.0, 1, 0)], df.schema)
    return x, y, df.unionByName(odd)


FEATURES = ["a", "b", "c", "d"]


def test_ols_equals_a_fit_on_the_rows(data):
    x, y, df = data
    got = regression.ols_report(df, "y", FEATURES, ["i"], ranges=7).collect()
    a = np.column_stack([np.ones(len(y)), x])
    mean = x.mean(axis=0)
    centred = np.column_stack([np.ones(len(y)), x - mean])
    beta = np.linalg.lstsq(centred, y, rcond=None)[0]
    e, n, k = y - centred @ beta, len(y), 5
    rss, tss = float(e @ e), float(((y - y.mean()) ** 2).sum())
    se = np.sqrt(rss / (n - k) * np.diag(np.linalg.inv(centred.T @ centred)))
    assert [r["feature"] for r in got] == ["intercept", *FEATURES] and a.shape == (n, k)
    assert [r["coef"] for r in got[1:]] == pytest.approx(beta[1:], rel=1e-6)
    assert got[0]["coef"] == pytest.approx(beta[0] - beta[1:] @ mean, rel=1e-6)
    assert [r["se"] for r in got[1:]] == pytest.approx(se[1:], rel=1e-6)
    r = got[2]
    assert (r["n"], r["r2"], r["adj_r2"]) == (n, pytest.approx(1 - rss / tss), pytest.approx(1 - rss / tss * (n - 1) / (n - k)))
    likelihood = -n / 2 * (math.log(2 * math.pi * rss / n) + 1)
    assert (r["aic"], r["bic"]) == (pytest.approx(2 * k - 2 * likelihood), pytest.approx(k * math.log(n) - 2 * likelihood))
    assert r["f"] == pytest.approx((tss - rss) / (k - 1) / (rss / (n - k))) and r["f_p"] < 1e-10
    assert r["dw"] == pytest.approx(float((np.diff(e) ** 2).sum()) / rss)
    assert tails.t_two_sided((r["ci_high"] - r["coef"]) / r["se"], n - k) == pytest.approx(0.05)
    assert got[4]["ci_low"] < 0 < got[4]["ci_high"] and got[4]["p"] > 0.01


def test_ridge_folds_equal_separate_fits(data):
    x, y, df = data
    got = regression.regularised_cv(df, "y", FEATURES, 0.0, fold=F.col("k")).collect()
    fold = np.arange(len(y)) % 5

    def fit(rows, alpha):
        m, my = x[rows].mean(axis=0), y[rows].mean()
        c = x[rows] - m
        beta = np.linalg.solve(c.T @ c + alpha * np.eye(4), c.T @ (y[rows] - my))
        return my - m @ beta, beta

    errors = {}
    for alpha in regression.RIDGE:
        errors[alpha] = np.mean([np.mean((y[fold == k] - fit(fold != k, alpha)[0] - x[fold == k] @ fit(fold != k, alpha)[1]) ** 2) for k in range(5)])
    alpha = min(errors, key=errors.get)
    intercept, beta = fit(fold >= 0, alpha)
    assert {r["alpha"] for r in got} == {alpha}
    assert [r["coef"] for r in got] == pytest.approx([intercept, *beta], rel=1e-6)
    p = intercept + x @ beta
    assert got[0]["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_lasso_meets_its_conditions_and_drops_features(data):
    x, y, df = data
    got = regression.regularised_cv(df, "y", FEATURES, 1.0)
    rows = got.collect()
    alpha, beta, n = rows[0]["alpha"], np.array([r["coef"] for r in rows[1:]]), len(y)
    c = x - x.mean(axis=0)
    slope = c.T @ (y - y.mean() - c @ beta) / n
    for g, b in zip(slope, beta):  # zero subgradient of the penalised error
        assert abs(g - math.copysign(alpha, b)) < 1e-5 if b else abs(g) <= alpha + 1e-6
    assert abs(beta[0] - 0.5) < 0.05 and abs(beta[1] + 2) < 0.1
    assert [r["coef"] for r in rows] == [r["coef"] for r in got.collect()]
    strong = regression.regularised_cv(df, "y", FEATURES, 1.0, alphas=[1.0]).collect()
    assert strong[3]["coef"] == 0 and strong[4]["coef"] == 0 and strong[2]["coef"] < -0.5


def test_logistic_equals_newton_on_the_rows(data):
    x, y, df = data
    got = regression.logistic_report(df, "z", FEATURES).collect()
    z = (y > 3).astype(float)
    m = x.mean(axis=0)
    a = np.column_stack([np.ones(len(y)), x - m])
    beta = np.zeros(5)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-a @ beta))
        h = a.T @ (a * (mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(h, a.T @ (z - mu))
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    assert [r["coef"] for r in got[1:]] == pytest.approx(beta[1:], rel=1e-5) and got[0]["coef"] == pytest.approx(beta[0] - beta[1:] @ m, rel=1e-5)
    assert [r["se"] for r in got[1:]] == pytest.approx(se[1:], rel=1e-4)
    ll = float((z * np.log(mu) + (1 - z) * np.log(1 - mu)).sum())
    assert got[0]["converged"] and got[0]["log_likelihood"] == pytest.approx(ll) and got[0]["aic"] == pytest.approx(10 - 2 * ll)
    assert got[2]["p"] < 1e-6 and got[2]["odds_ratio"] == pytest.approx(math.exp(got[2]["coef"]))


def test_degenerate_fits(spark):
    kind = "a double, y double"
    none = spark.createDataFrame([], kind)
    assert {r["coef"] for r in regression.ols_report(none, "y", ["a"]).collect()} == {None}
    assert {r["coef"] for r in regression.regularised_cv(none, "y", ["a"], 0.0).collect()} == {None}
    assert {r["coef"] for r in regression.logistic_report(none, "y", ["a"]).collect()} == {None}
    flat = spark.createDataFrame([(float(i), 1.0) for i in range(30)], kind)
    assert {r["coef"] for r in regression.logistic_report(flat, "y", ["a"]).collect()} == {None}
    assert regression.ols_report(flat, "y", ["a"]).collect()[1]["r2"] is None
    twin = spark.createDataFrame([(float(i), float(i), 2.0 * i) for i in range(30)], "a double, b double, y double")
    got = regression.ols_report(twin, "y", ["a", "b"]).collect()
    assert got[1]["coef"] + got[2]["coef"] == pytest.approx(2.0)
    apart = spark.createDataFrame([(float(i), float(i > 14)) for i in range(30)], kind)
    assert regression.logistic_report(apart, "y", ["a"]).collect()[0]["converged"] in (True, False)
