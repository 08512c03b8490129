"""Stationarity tests of many series at once: each series comes down to one matrix of lag products, from which all nested lag
regressions follow.  Series of any length are split into ranges (see ``halo``).

All rows of a lag matrix are one series, shifted, so its entries are sums of one lag's products each, less a few at the series' ends:
a range gives as many sums as lags and its first and last values, and products across two ranges follow from those.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.columns import agg_row
from tidewell.functions.stages import stash
from tidewell.operators.halo import running_sum, split

# MacKinnon's surfaces for a constant and one variable.  p of a Dickey-Fuller statistic below and above TAU, as
# polynomials in it whose value is a normal quantile; critical values as polynomials in 1 / n.
TAU, TAU_LEAST, TAU_MOST = -1.61, -18.83, 2.74
P_BELOW, P_ABOVE = [2.1659, 1.4412, 0.038269], [1.7339, 0.93202, -0.12745, -0.010368]
CRITICAL = {0.01: [-3.43035, -6.5393, -16.786, -79.433], 0.05: [-2.86154, -2.8903, -4.234, -40.040], 0.1: [-2.56677, -1.5384, -2.809, 0.0]}
# Level KPSS statistics and their p.
KPSS_STATS, KPSS_P = [0.347, 0.463, 0.574, 0.739], [0.1, 0.05, 0.025, 0.01]
#: Values whose lag products are summed at once: they stay in a core's cache.
CHUNK = 8192


def dickey_fuller_p(stat: float) -> float:
    if stat > TAU_MOST:
        return 1.0
    if stat < TAU_LEAST:
        return 0.0
    z = sum(c * stat**i for i, c in enumerate(P_BELOW if stat <= TAU else P_ABOVE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def critical_value(n: int, level: float = 0.05) -> float:
    return sum(c / n**i for i, c in enumerate(CRITICAL[level]))


def most_lags(n: int) -> int:
    """12 (n / 100)^(1/4), and no more than leaves rows for the regression."""
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))


def _numbered(df: DataFrame, column: str, order: list[str], by: list[str], ranges: int | None) -> tuple[DataFrame, DataFrame]:
    """The known rows of each series with x and their number i from 1, and (by, n, mean)."""
    rows = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(*by, *order, F.col(column).cast("double").alias("x"))
    rows = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), "_one", order, by, "i", ranges).drop("_one")
    return rows, rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))


def _beside(rows: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    sizes = sizes.toDF(*[f"_k{i}" for i in range(len(by))], "n", "mean")
    same = reduce(lambda a, i: a & F.col(by[i]).eqNullSafe(F.col(f"_k{i}")), range(len(by)), F.lit(True))
    return rows.join(sizes if by else F.broadcast(sizes), same).drop(*[f"_k{i}" for i in range(len(by))])  # without by one row


def _solve(m: np.ndarray, k: int) -> tuple[np.ndarray, float, float]:
    """Coefficients on the first k columns of the cross products m, whose last is the target; the residual sum, and the
    variance factor of the second coefficient."""
    a, b = m[:k, :k], m[:k, -1]
    size = np.sqrt(np.diag(a))
    size[size == 0] = 1.0
    inv = np.linalg.pinv(a / np.outer(size, size)) / np.outer(size, size)
    beta = inv @ b
    return beta, max(float(m[-1, -1] - beta @ b), 0.0), float(inv[1, 1])


def lag_products(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The sums of a[s + k] b[s] for k = 0 .. most; ``b`` is as long as ``a``."""
    out, wide = np.zeros(most + 1), np.concatenate([a, np.zeros(most)])
    for at in range(0, len(b), CHUNK):
        part = b[at : at + CHUNK]
        out += np.correlate(wide[at : at + len(part) + most], part, "valid")
    return out


def _range_sums(df: DataFrame, columns: list[str], order: list[str], by: list[str], most: int, ranges: int | None) -> DataFrame:
    """One row a range of a series and column (its number c) with known values: their number n, their mean m, the sum ``sq`` of squares
    about it, the lag products ``dd`` of changes, ``yd`` of levels (from m) before and changes, ``yy`` of levels, and the first and
    last ``most`` + 3 values."""
    import pandas as pd

    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows, _ = split(df.select(*by, *order, *[number(c).alias(f"_c{i}") for i, c in enumerate(columns)]), order[0], by, ranges)
    names = [f"_c{i}" for i in range(len(columns))]
    # rows that the order leaves equal go by a hash: an order by their values would itself be a dependence
    rows = rows.withColumn("_i", F.row_number().over(W.partitionBy(*by, "_p").orderBy(*order, F.xxhash64(*order, *names), *names))).select(*by, "_p", "_i", *names)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*by).schema)

    def sums(keys, frame):
        frame, out = frame.sort_values("_i", kind="stable"), []
        for i in range(len(columns)):
            x = frame[f"_c{i}"].to_numpy(float)
            x = x[~np.isnan(x)]
            if len(x):
                m, d = x.mean(), np.diff(x)
                y = x - m
                out.append((*keys[:-1], int(keys[-1]), i, len(x), m, float(y @ y), lag_products(d, d, most), lag_products(y[:-1], d, most), lag_products(y, y, most), x[: most + 3], x[-most - 3 :]))
        return pd.DataFrame(out, columns=[*by, "_p", "c", "n", "m", "sq", "dd", "yd", "yy", "head", "tail"])

    arrays = "".join(f", {c} array<double>" for c in ("dd", "yd", "yy", "head", "tail"))
    return rows.groupBy(*by, "_p").applyInPandas(sums, f"{kinds}_p int, c int, n long, m double, sq double{arrays}")


class _Series:
    """A series put together from its ranges: n, mean, the first and last ``most`` + 3 values, and over all its rows, with levels taken
    from the mean: their sum of squares ``sq`` and the lag products ``dd``, ``yd`` and ``yy`` of :func:`_range_sums`."""

    def __init__(self, frame, most: int):
        parts = frame.sort_values("_p").to_dict("records")
        self.n = sum(r["n"] for r in parts)
        self.mean = sum(r["n"] * (r["m"] / self.n) for r in parts)
        self.sq, self.dd, self.yd, self.yy = 0.0, np.zeros(most + 1), np.zeros(most + 1), np.zeros(most + 1)
        self.head, self.tail = np.zeros(0), np.zeros(0)
        for r in parts:
            head, tail, off = np.asarray(r["head"], float), np.asarray(r["tail"], float), r["m"] - self.mean
            self.sq += r["sq"] + r["n"] * off * off
            self.dd += r["dd"]
            # the sums of a range are about its own mean
            held = min(most + 1, int(r["n"]) - 1)
            self.yd += r["yd"]
            self.yd[:held] += off * (tail[::-1][:held] - head[0])
            held = min(most + 1, int(r["n"]))
            early, late = (np.concatenate([[0.0], np.cumsum(z - r["m"])])[:held] for z in (head, tail[::-1]))
            self.yy += r["yy"]
            self.yy[:held] += off * off * (r["n"] - np.arange(held)) - off * (early + late)
            self._across(head[: most + 1], most)
            self.tail = np.concatenate([self.tail, tail])[-most - 3 :]
            if len(self.head) < most + 3:
                self.head = np.concatenate([self.head, head])[: most + 3]

    def _across(self, head: np.ndarray, most: int) -> None:
        """Adds the products of a range's first rows with those of the ranges before."""
        first = len(self.tail)
        if not first:
            return
        x = np.concatenate([self.tail, head])
        y, d = x - self.mean, np.diff(x)
        for t in range(len(head)):
            g = first + t  # changes d[g - 1 - k] that begin before the range have k from t
            before = d[: g - t][::-1][: most + 1 - t]
            self.dd[t : t + len(before)] += d[g - 1] * before
            self.yd[t : t + len(before)] += y[g - 1] * before
            levels = y[:first][::-1][: most - t]
            self.yy[t + 1 : t + 1 + len(levels)] += y[g] * levels

    def matrix(self, lags: int) -> np.ndarray:
        """The cross products of 1, the level before, the ``lags`` changes before and the change itself over the rows that have all."""
        n, c = self.n, self.mean
        head, tail = self.head[: lags + 1] - c, self.tail[::-1] - c  # the last first
        dh, dt = np.diff(head), -np.diff(tail[: lags + 1])
        m, at = np.zeros((lags + 3, lags + 3)), [lags + 2, *range(2, lags + 2)]  # places of the changes 0 .. lags rows before
        m[0, 0], m[0, 1] = n - lags - 1, -tail[0] - head[:lags].sum()
        m[1, 1] = self.sq - tail[0] ** 2 - head[:lags] @ head[:lags]
        m[0, at] = tail[: lags + 1] - head[::-1]
        m[1, at] = [self.yd[k] - head[k:lags] @ dh[: lags - k] for k in range(lags + 1)]
        own = np.array([self.dd[k] - dh[k:] @ dh[: lags - k] for k in range(lags + 1)])
        # shifting both changes of a product by a row takes one in at the front and leaves one out at the end
        shift = np.outer(dh[::-1], dh[::-1]) - np.outer(dt, dt)
        changes = np.zeros((lags + 1, lags + 1))
        for k in range(lags + 1):
            i = np.arange(lags + 1 - k)
            changes[i, i + k] = own[k] + np.concatenate([[0.0], np.cumsum(np.diagonal(shift, k))])
        m[np.ix_(at, at)] = changes + np.triu(changes, 1).T
        return np.triu(m) + np.triu(m, 1).T

    def early(self, k: int, lags: int) -> np.ndarray:
        """The same terms for ``k`` lags, a row for each of the rows that ``k`` lags leave and ``lags`` don't."""
        x = self.head[: lags + 1]
        d = np.diff(x)
        rows = [[1.0, x[t - 1] - self.mean, *d[t - 1 - k : t - 1][::-1], d[t - 1]] for t in range(k + 1, lags + 1)]
        return np.array(rows).reshape(-1, k + 3)


def adf_test(df: DataFrame, column: str, order: list[str], by: list[str] = (), lags: int | None = None, ranges: int | None = None) -> DataFrame:
    """by, stat, p, lags, n_used, critical, stationary: the augmented Dickey-Fuller test with a constant, one row a series.

    The number of lags is ``lags``, or has the least AIC among 0 .. :func:`most_lags`, judged on the rows that all of them have; the
    test then uses all rows its lags leave.  ``critical`` is the 5 % value.  Series that are too short or constant have nulls.  Null
    and NaN values are left out.
    """
    return adf_tests(df, [column], order, by, lags, ranges).drop("column")


def adf_tests(df: DataFrame, columns: list[str], order: list[str], by: list[str] = (), lags: int | None = None, ranges: int | None = None) -> DataFrame:
    """by, column and the results of :func:`adf_test`, for every one of ``columns``: rows are sorted once for all."""
    import pandas as pd

    by, order = list(by), list(order)
    most = lags
    if lags is None:
        known = [F.count(F.when(~F.isnan(F.col(c).cast("double")), 1)) for c in columns]
        sizes = df.groupBy(*by).agg(F.array_max(F.array(*known)).alias("_n"))
        most = most_lags(agg_row(sizes, {"n": F.max("_n")})["n"] or 0)
    names = ["stat", "p", "lags", "n_used", "critical", "stationary"]

    def solve(keys, frame):
        series, best = _Series(frame, most), None
        n = series.n
        own = most_lags(n) if lags is None else lags
        m = series.matrix(own) if n - own - 1 > own + 2 else np.full((1, 1), np.nan)
        if np.isfinite(m).all():
            # nested regressions on the rows that all lags have, by AIC
            used, scores = n - own - 1, []
            for k in range(own + 1) if lags is None else [lags]:
                pick = [*range(k + 2), own + 2]
                rss = _solve(m[np.ix_(pick, pick)], k + 2)[1]
                scores.append((used * math.log(max(rss, 1e-300) / used) + 2 * (k + 2), k))
            k = min(scores)[1]
            pick, more = [*range(k + 2), own + 2], series.early(k, own)
            final = m[np.ix_(pick, pick)] + more.T @ more
            used = n - k - 1
            beta, rss, factor = _solve(final, k + 2)
            spread = rss / (used - k - 2) * factor
            if spread > 0 and final[-1, -1] > 0:
                best = float(beta[1] / math.sqrt(spread)), k, used
        values = (best[0], dickey_fuller_p(best[0]), best[1], best[2], critical_value(best[2])) if best else (None,) * 5
        row = (*keys[:-1], columns[int(keys[-1])], *values, best[0] < values[4] if best else None)
        return pd.DataFrame([row], columns=[*by, "column", *names]).astype({"lags": "Int64", "n_used": "Int64", "stationary": "boolean"})

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    sums = _range_sums(df, columns, order, by, most, ranges)  # a row a range
    return sums.groupBy(*by, "c").applyInPandas(solve, f"{kinds}column string, stat double, p double, lags long, n_used long, critical double, stationary boolean")


def kpss_test(df: DataFrame, column: str, order: list[str], by: list[str] = (), lags: int | None = None, ranges: int | None = None) -> DataFrame:
    """by, stat, p, lags, stationary: the KPSS test of a level, one row a series, with a Bartlett long-run variance over ``lags``
    lags or a number chosen from the autocovariances (Hobijn, Franses and Ooms), which grows with the series.  p is interpolated between 0.01 and 0.1;
    ``stationary`` means p over 0.05.  Constant series have nulls."""
    by, order = list(by), list(order)
    rows, sizes = _numbered(df, column, order, by, ranges)
    rows = running_sum(_beside(rows, sizes, by).withColumn("e", F.col("x") - F.col("mean")), "e", order, by, "s", ranges)
    out = rows.groupBy(*by).agg(F.first("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss")).where("n IS NOT NULL")
    most = lags
    if lags is None:
        longest = sizes.agg(F.max("n")).first()[0] or 0
        first = F.floor(F.pow(F.col("n"), 2 / 9)).cast("int")
        spans = F.sequence(F.lit(1), F.greatest(first, F.lit(1)))
        s0 = F.get("g", F.lit(0)) / F.col("n") + F.aggregate(spans, F.lit(0.0), lambda a, i: a + F.coalesce(F.get("g", i), F.lit(0.0)) / (F.col("n") / 2))
        s1 = F.aggregate(spans, F.lit(0.0), lambda a, i: a + i * F.coalesce(F.get("g", i), F.lit(0.0)) / (F.col("n") / 2))
        ratio = F.try_divide(s1, s0)
        chosen = F.floor(1.1447 * F.pow(ratio * ratio, 1 / 3) * F.pow(F.col("n"), 1 / 3))
        # the number of lags follows from the first few autocovariances, and tells how many are needed in all
        few = _autocovariances(df, column, order, by, max(1, math.floor(longest ** (2 / 9))), ranges)
        few = stash(few.select(*by, "n", F.least(F.coalesce(F.when(F.isnan(chosen), None).otherwise(chosen), F.lit(0)), F.col("n") - 1).cast("long").alias("lags")), "bandwidths")
        most = agg_row(few, {"lags": F.max("lags")})["lags"] or 0
        out = _joined(out, few.drop("n"), by)
    else:
        out = out.withColumn("lags", F.lit(lags).cast("long"))
    out = _joined(out, _autocovariances(df, column, order, by, most, ranges).drop("n"), by)
    weights = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: (i > 0) & (i <= F.col("lags"))), F.lit(0.0), lambda a, i: a + 2 * F.get("g", i) * (1 - i / (F.col("lags") + 1)))
    variance = (F.get("g", F.lit(0)) + weights) / F.col("n")
    out = out.withColumn("stat", F.when(variance > 0, F.col("ss") / (F.col("n") * F.col("n") * variance)))
    return out.withColumn("p", _between(F.col("stat"))).select(*by, "stat", "p", "lags", (F.col("p") > 0.05).alias("stationary"))


def _autocovariances(df: DataFrame, column: str, order: list[str], by: list[str], most: int, ranges: int | None) -> DataFrame:
    """by, n, g: the sums of products of values (from the series' mean) k rows apart, for k = 0 .. most."""
    import pandas as pd

    def whole(keys, frame):
        series = _Series(frame, most)
        return pd.DataFrame([(*keys, series.n, series.yy)], columns=[*by, "n", "g"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    sums = _range_sums(df, [column], order, by, most, ranges)  # a row a range
    if by:
        return sums.groupBy(*by).applyInPandas(whole, f"{kinds}n long, g array<double>")
    return sums.groupBy("c").applyInPandas(lambda _, frame: whole((), frame), "n long, g array<double>")


def _joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Both one row a series."""
    names = [f"_k{i}" for i in range(len(by))]
    b = b.toDF(*names, *b.columns[len(by) :])
    same = reduce(lambda s, i: s & F.col(by[i]).eqNullSafe(F.col(names[i])), range(len(by)), F.lit(True))
    return a.join(b, same).drop(*names)


def _between(stat: Column) -> Column:
    """p of a KPSS statistic between the tabulated ones; the ends hold beyond them."""
    found = F.when(stat <= KPSS_STATS[0], KPSS_P[0])
    for (a, pa), (b, pb) in zip(zip(KPSS_STATS, KPSS_P), list(zip(KPSS_STATS, KPSS_P))[1:]):
        found = found.when(stat <= b, pa + (stat - a) / (b - a) * (pb - pa))
    return F.when(stat.isNotNull(), found.otherwise(KPSS_P[-1]))
