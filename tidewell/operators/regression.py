"""Regressions from cross products: one aggregate by fold gives every fit of every fold and penalty, and each step of a
logistic fit is one aggregate.  Only matrices of features x features reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import tails
from tidewell.functions.columns import value
from tidewell.functions.stages import stash
from tidewell.operators.halo import over_rows_before

#: Penalties of the ridge path.  The lasso path has PATH penalties down to LEAST of the one that leaves no feature.
RIDGE = (0.1, 1.0, 10.0)
PATH, LEAST = 100, 1e-3
FOLDS = 5


def known_rows(df: DataFrame, target: str, features: list[str], extra: list[str] = ()) -> DataFrame:
    """The rows with all values, as doubles x0 .. and y, beside ``extra``."""
    cols = [value(df, c).cast("double") for c in [*features, target]]
    out = df.select(*extra, *[c.alias(n) for c, n in zip(cols, [*[f"x{i}" for i in range(len(features))], "y"])])
    return out.na.drop("any", subset=[*[f"x{i}" for i in range(len(features))], "y"])


def fold_products(rows: DataFrame, k: int, fold: Column) -> tuple[np.ndarray, np.ndarray]:
    """(folds, k + 2, k + 2): the cross products of 1, x0 .. and y of each fold, from one scan; and what was taken from x0 .. and y
    before, the values of any one row, so that values far from zero keep their digits."""
    names = [*[f"x{i}" for i in range(k)], "y"]
    one = rows.select(*names).first()
    shift = np.array(one if one else [0.0] * (k + 1), float)
    terms = [F.lit(1.0), *[F.col(c) - float(v) for c, v in zip(names, shift)]]
    sums = [F.sum(terms[a] * terms[b]) for a in range(k + 2) for b in range(a, k + 2)]
    got = rows.groupBy(fold.alias("fold")).agg(F.array(*sums).alias("s")).collect()  # a row a fold
    out = np.zeros((len(got), k + 2, k + 2))
    for m, r in zip(out, got):
        m[np.triu_indices(k + 2)] = r["s"]
        m += np.triu(m, 1).T
    return out, shift


def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Products of the features about their means, those with y, that of y, and all means."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - n * np.outer(mean, mean)
    return c[:-1, :-1], c[:-1, -1], float(c[-1, -1]), mean


def squared_error(m: np.ndarray, intercept: float, beta: np.ndarray) -> float:
    """Of a fit on the rows whose products are m."""
    b = np.concatenate([[intercept], beta, [-1.0]])
    return float(b @ m @ b)


def ridge(m: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of least squared error + alpha |coefficients|^2."""
    a, b, _, mean = centred(m)
    beta = np.linalg.pinv(a + alpha * np.eye(len(b))) @ b
    return float(mean[-1] - mean[:-1] @ beta), beta


def lasso_path(m: np.ndarray, alphas: Sequence[float], rounds: int = 10_000, tolerance: float = 1e-12) -> list[tuple[float, np.ndarray]]:
    """For falling penalties, the fit of least squared error / 2n + alpha |coefficients|, by coordinate descent on the products, each from
    the one before."""
    a, b, yy, mean = centred(m)
    n, beta, out = m[0, 0], np.zeros(len(b)), []
    for alpha in alphas:
        for _ in range(rounds):
            moved = 0.0
            for j in range(len(b)):
                if a[j, j] <= 0:
                    continue
                rest = b[j] - a[j] @ beta + a[j, j] * beta[j]
                new = math.copysign(max(abs(rest) - n * alpha, 0.0), rest) / a[j, j]
                moved = max(moved, (new - beta[j]) ** 2 * a[j, j])
                beta[j] = new
            if moved <= tolerance * yy:
                break
        out.append((float(mean[-1] - mean[:-1] @ beta), beta.copy()))
    return out


def regularised_cv(df: DataFrame, target: str, features: list[str], l1: float, alphas: Sequence[float] | None = None, folds: int = FOLDS, fold: Column | None = None) -> DataFrame:
    """Ridge (l1 = 0) or lasso (l1 = 1) with the penalty of least mean squared error over folds: feature (and intercept), coef, alpha, r2.

    One scan gives the products of all folds; a fold's training products are all less its own.  Folds go by a hash of the row's
    values, or by ``fold`` (a number from 0).  Ties go to the larger penalty.  Rows with nulls or NaN are left out; with no more rows
    than folds, or folds without rows to train on, all results are null.
    """
    if l1 not in (0.0, 1.0):
        raise ValueError("l1 is 0 (ridge) or 1 (lasso)")
    spark, k, schema = df.sparkSession, len(features), "feature string, coef double, alpha double, r2 double"
    rows = known_rows(df.withColumn("_fold", fold) if fold is not None else df, target, features, ["_fold"] if fold is not None else [])
    own = F.col("_fold") if fold is not None else F.pmod(F.xxhash64(*[f"x{i}" for i in range(k)], "y"), F.lit(folds))
    parts, shift = fold_products(rows, k, own)
    total = parts.sum(axis=0) if len(parts) else np.zeros((k + 2, k + 2))
    if total[0, 0] <= folds or len(parts) < 2:
        return spark.createDataFrame([(f, None, None, None) for f in ["intercept", *features]], schema)
    if alphas is None:
        alphas = list(RIDGE)
        if l1:
            top = float(np.abs(centred(total)[1]).max() / total[0, 0]) or 1.0
            alphas = [top * LEAST ** (i / (PATH - 1)) for i in range(PATH)]
    alphas = sorted(alphas, reverse=True)
    fits = lambda m: lasso_path(m, alphas) if l1 else [ridge(m, x) for x in alphas]
    errors = np.mean([[squared_error(m, *fit) / m[0, 0] for fit in fits(total - m)] for m in parts], axis=0)
    best = int(np.argmin(errors))
    intercept, beta = fits(total)[best]
    spread = centred(total)[2]
    r2 = 1 - squared_error(total, intercept, beta) / spread if spread > 0 else None
    return spark.createDataFrame([(f, float(c), float(alphas[best]), r2) for f, c in zip(["intercept", *features], [intercept + shift[-1] - beta @ shift[:-1], *beta])], schema)


def ols_report(df: DataFrame, target: str, features: list[str], order: list[str] | None = None, by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """feature, coef, se, t, p, ci_low, ci_high (95 %) and, the same in each row, n, r2, adj_r2, aic, bic, f, f_p and dw.

    Least squares from cross products.  Durbin-Watson needs the rows' ``order`` (within ``by``) and is null without.
    With no more rows than coefficients, or no spread of the target, what is undefined is null.
    """
    spark, k = df.sparkSession, len(features) + 1
    schema = "feature string, coef double, se double, t double, p double, ci_low double, ci_high double, n long, r2 double, adj_r2 double, aic double, bic double, f double, f_p double, dw double"
    rows = known_rows(df, target, features, [*dict.fromkeys([*(order or []), *by])])
    parts, shift = fold_products(rows, k - 1, F.lit(0))
    n = int(parts[0, 0, 0]) if len(parts) else 0
    if n <= k:
        return spark.createDataFrame([(f, *[None] * 6, n, *[None] * 7) for f in ["intercept", *features]], schema)
    a, b, tss, mean = centred(parts[0])
    mean = mean + shift
    size = np.sqrt(np.diag(a))
    size[size == 0] = 1.0
    inv = np.linalg.pinv(a / np.outer(size, size)) / np.outer(size, size)
    beta = inv @ b
    intercept = float(mean[-1] - mean[:-1] @ beta)
    rss, dof = max(tss - float(beta @ b), 0.0), n - k
    s2 = rss / dof
    se = np.sqrt(np.maximum(s2 * np.concatenate([[1 / n + mean[:-1] @ inv @ mean[:-1]], np.diag(inv)]), 0.0))
    half = tails.t_critical(0.95, float(dof))
    r2 = 1 - rss / tss if tss > 0 else None
    likelihood = -n / 2 * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else None
    f = (tss - rss) / (k - 1) / s2 if s2 > 0 and k > 1 else None
    whole = (n, r2, None if r2 is None else 1 - (1 - r2) * (n - 1) / dof, None if likelihood is None else 2 * k - 2 * likelihood, None if likelihood is None else k * math.log(n) - 2 * likelihood, f, None if f is None else float(tails.f_upper(f, k - 1, dof)))
    dw = None
    if order:
        residual = F.col("y") - reduce(lambda x, y: x + y, [F.col(f"x{i}") * float(c) for i, c in enumerate(beta)], F.lit(intercept))
        rows = over_rows_before(rows.withColumn("e", residual), order, list(by), ["e"], 1, lambda w: {"d": F.col("e") - F.lag("e").over(w)}, ranges)
        got = rows.agg(F.sum(F.col("d") * F.col("d")).alias("d"), F.sum(F.col("e") * F.col("e")).alias("e")).first()
        dw = got["d"] / got["e"] if got["d"] is not None and got["e"] else None
    out = []
    for name, c, s in zip(["intercept", *features], [intercept, *beta], se):
        t = float(c / s) if s > 0 else None
        out.append((name, float(c), float(s), t, None if t is None else float(tails.t_two_sided(t, float(dof))), float(c - half * s), float(c + half * s), *whole, dw))
    return spark.createDataFrame(out, schema)


def logistic_report(df: DataFrame, target: str, features: list[str], rounds: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """feature, coef, se, z, p, odds_ratio and, the same in each row, n, log_likelihood, pseudo_r2, aic, bic, converged: a logistic fit
    of a 0/1 target by iteratively reweighted least squares, one aggregate a round over the rows' narrow columns.

    Separated classes don't converge: the last round's values are given.  Without rows of both classes all is null.
    """
    spark, k = df.sparkSession, len(features) + 1
    schema = "feature string, coef double, se double, z double, p double, odds_ratio double, n long, log_likelihood double, pseudo_r2 double, aic double, bic double, converged boolean"
    rows = stash(known_rows(df, target, features), "logistic")
    names = ["intercept", *features]
    first = rows.agg(F.count("*").alias("n"), F.avg("y").alias("share"), F.array(*[F.avg(f"x{i}") for i in range(k - 1)]).alias("mean"), F.array(*[F.stddev_pop(f"x{i}") for i in range(k - 1)]).alias("sd")).first()
    n, share = first["n"], first["share"]
    if not n or not 0 < share < 1:
        return spark.createDataFrame([(f, *[None] * 5, n, *[None] * 5) for f in names], schema)
    # features on one scale, so that the weighted products keep their digits
    scale = [s if s and s > 0 else 1.0 for s in first["sd"]]
    terms = [F.lit(1.0), *[(F.col(f"x{i}") - first["mean"][i]) / scale[i] for i in range(k - 1)]]
    beta, old, converged = np.array([math.log(share / (1 - share)), *[0.0] * (k - 1)]), None, False
    for _ in range(rounds):
        eta = reduce(lambda a, b: a + b, [t * float(b) for t, b in zip(terms, beta)])
        mu = 1 / (1 + F.exp(-eta))
        weight, off = mu * (1 - mu), F.col("y") - mu
        # log(1 + exp(eta)) without overflow
        likelihood = F.col("y") * eta - (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))))
        sums = [F.sum(weight * terms[a] * terms[b]) for a in range(k) for b in range(a, k)]
        got = rows.agg(F.array(*sums).alias("h"), F.array(*[F.sum(off * t) for t in terms]).alias("g"), F.sum(likelihood).alias("l")).first()
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = got["h"]
        h += np.triu(h, 1).T
        inv = np.linalg.pinv(h)
        if old is not None and abs(got["l"] - old) <= tolerance * (abs(old) + tolerance):
            converged = True
            break
        old, beta = got["l"], beta + inv @ np.array(got["g"])
    # back to the features' own scale
    turn = np.eye(k)
    for i in range(k - 1):
        turn[0, i + 1], turn[i + 1, i + 1] = -first["mean"][i] / scale[i], 1 / scale[i]
    coef, cov = turn @ beta, turn @ inv @ turn.T
    null = n * (share * math.log(share) + (1 - share) * math.log(1 - share))
    whole = (n, float(got["l"]), 1 - got["l"] / null, 2 * k - 2 * got["l"], k * math.log(n) - 2 * got["l"], converged)
    out = []
    for name, c, v in zip(names, coef, np.diag(cov)):
        s = math.sqrt(v) if v > 0 else None
        z = float(c / s) if s else None
        out.append((name, float(c), s, z, None if z is None else math.erfc(abs(z) / math.sqrt(2)), math.exp(min(float(c), 700.0)), *whole))
    return spark.createDataFrame(out, schema)
