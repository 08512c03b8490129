"""Autoregressive forecasts of many series at once: orders are chosen on each series' autocovariances, which are sums that Spark
makes in one pass over lagged rows; only those and a series' last values are brought together."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.halo import over_rows_before
from tidewell.operators.unit_roots import _beside, _numbered

Z95 = 1.959964


def levinson(g: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """For each order from 0 the coefficients and innovation variance that solve the Yule-Walker equations of autocovariances ``g``."""
    phi, variance, out = np.zeros(0), float(g[0]), [(np.zeros(0), float(g[0]))]
    for k in range(1, len(g)):
        if variance <= 0:
            break
        last = (g[k] - phi @ g[k - 1 : 0 : -1]) / variance
        phi = np.concatenate([phi - last * phi[::-1], [last]])
        variance *= 1 - last * last
        out.append((phi, variance))
    return out


def best_order(g: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """The order of least AIC; ties go to the smaller one."""
    fits = [x for x in levinson(g) if x[1] > 0]
    return min(fits, key=lambda x: n * math.log(x[1]) + 2 * len(x[0])) if fits else (np.zeros(0), 0.0)


def project(past: np.ndarray, phi: np.ndarray, variance: float, mean: float, period: int, steps: int) -> list[tuple[float, float]]:
    """(forecast, standard error) of each step: differences over ``period`` (none if 0) follow the AR, and the errors of a step add up by
    the weights that past innovations have in it."""
    coef = np.zeros(len(phi) + period)
    coef[: len(phi)] = phi
    if period:  # (1 - phi B ..)(1 - B^period)
        coef[period - 1] += 1
        coef[period:] -= phi
    constant = mean * (1 - phi.sum())
    values, weights, out = list(past), [1.0], []
    for h in range(steps):
        new = constant + sum(c * values[-1 - i] for i, c in enumerate(coef))
        out.append((float(new), math.sqrt(variance * sum(w * w for w in weights))))
        values.append(new)
        weights.append(sum(c * weights[-1 - i] for i, c in enumerate(coef) if i < len(weights)))
    return out


def ar_forecast(df: DataFrame, column: str, order: list[str], by: list[str], most: int = 8, period: int = 0, steps: int = 5, ranges: int | None = None) -> DataFrame:
    """by, step, forecast, lo, hi (95 %) and p, the order of each series: an AR of the series, or of its differences over ``period``, with
    the order up to ``most`` of least AIC.

    Intervals hold the innovations' part of the error, not that of the coefficients.  A series needs over 2 ``most`` + 2 rows beyond a
    period, others give no rows; null and NaN values are left out; a constant series is forecast as itself.
    """
    import pandas as pd

    rows, _ = _numbered(df, column, order, by, ranges)
    if period:
        rows = over_rows_before(rows, order, by, ["x"], period, lambda w: {"_old": F.lag("x", period).over(w)}, ranges)
        rows = rows.withColumn("d", F.col("x") - F.col("_old"))
    else:
        rows = rows.withColumn("d", F.col("x"))
    sizes = rows.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("mean"))
    rows = _beside(rows, sizes, by).withColumn("e", F.col("d") - F.col("mean"))
    rows = over_rows_before(rows, order, by, ["e"], most, lambda w: {f"_e{k}": F.lag("e", k).over(w) for k in range(1, most + 1)}, ranges)
    products = F.array(*[F.coalesce(F.sum(F.col("e") * F.col(f"_e{k}" if k else "e")), F.lit(0.0)) / F.first("n") for k in range(most + 1)])
    keep = most + period + 1
    last = F.array_sort(F.collect_list(F.when(F.col("i") > F.col("n") + period - keep, F.struct("i", "x"))))
    series = rows.groupBy(*by).agg(F.first("n").alias("_n"), F.first("mean").alias("_mean"), products.alias("_g"), last.alias("_last")).where(F.col("_n") > 2 * most + 2)

    def solve(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                n, g = int(r["_n"]), np.array(r["_g"], float)
                phi, variance = best_order(g, n)
                variance *= n / max(1, n - len(phi) - 1)
                past = np.array([x["x"] for x in r["_last"]], float)
                for step, (value, error) in enumerate(project(past, phi, variance, float(r["_mean"]), period, steps), 1):
                    out.append((*[r[c] for c in by], step, value, value - Z95 * error, value + Z95 * error, len(phi)))
            yield pd.DataFrame(out, columns=[*by, "step", "forecast", "lo", "hi", "p"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    return series.mapInPandas(solve, f"{kinds}step int, forecast double, lo double, hi double, p int")
