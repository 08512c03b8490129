"""Correlation, hypothesis tests, intervals, resampling, regression and time series.

All sums run in Spark over all rows; only scalars, or matrices the size of the number of columns, reach the driver.  A test
that its data don't define (too few rows, one group, no spread) gives one row of nulls.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions import tails
from tidewell.functions.columns import agg_row, corr, long_form, value
from tidewell.functions.stages import stash
from tidewell.operators import unit_roots
from tidewell.operators.features import lookup
from tidewell.operators.ordering import average_ranks, by_ranges, dense_ranks, group_medians, range_cuts, rank_average


def _row(df: DataFrame, schema: str, defined, values) -> DataFrame:
    """One row of ``values()``, or of nulls unless ``defined``."""
    return df.sparkSession.createDataFrame([values() if defined else (None,) * len(schema.split(","))], schema)


def corr_pearson(df: DataFrame, columns: list[str], least: int = 5) -> DataFrame:
    """a, b, r of all pairs over rows in which both are given."""
    both = lambda a, b: F.count(F.when(value(df, a).isNotNull() & value(df, b).isNotNull(), 1))
    out = long_form(df, {f"{a}|{b}": [corr(value(df, a), value(df, b)), both(a, b)] for a, b in combinations(columns, 2)}, ["r", "n"])
    return out.where(F.col("n") >= least).select(F.split_part("column", F.lit("|"), F.lit(1)).alias("a"), F.split_part("column", F.lit("|"), F.lit(2)).alias("b"), "r")


def corr_spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """rho over rows in which both are given.  Equal pairs are one row with a count before they meet their ranks."""
    rows = df.select(value(df, a).alias("x"), value(df, b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    cells = rows.groupBy("x", "y").agg(F.count("*").alias("m"))
    ranks = {c: average_ranks(rows, c).select(c, F.col("rank").alias(f"r{c}")) for c in "xy"}
    both, m = cells.join(ranks["x"], "x").join(ranks["y"], "y"), F.col("m")
    mean = (F.sum(m) + 1) / 2
    part = lambda u, v: F.sum(m * F.col(u) * F.col(v)) - mean * mean * F.sum(m)
    return both.agg(F.try_divide(part("rx", "ry"), F.sqrt(part("rx", "rx")) * F.sqrt(part("ry", "ry"))).alias("rho"))


def corr_kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """tau-b over rows in which both are given; exact for any number of distinct values.

    Values become dense ranks, written in digits of base 4.  Two ranks differ first in exactly one digit, so every pair of rows
    is counted once, at its first differing digit of ``a`` and of ``b``, from 16 sums by (digit of a, digit of b) of the group
    that shares the digits before.  One aggregate, combined before its shuffle; no pair of rows is ever built.
    """
    rows = df.select(value(df, a).cast("double").alias("x"), value(df, b).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    cells = rows.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    cuts, sizes = range_cuts(cells, ["x", "y"]), agg_row(cells, {c: F.count_distinct(c) for c in "xy"})
    ranked = cells
    for c in "xy":
        ranked = ranked.join(dense_ranks(cells, c, cuts[c], f"r{c}"), c)
    digits = {c: max(1, math.ceil(max(1, sizes[c] - 1).bit_length() / 2)) for c in "xy"}
    places = lambda c: F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(f"r{c}", 2 * k + 2).alias("head"), F.shiftright(f"r{c}", 2 * k).bitwiseAND(F.lit(3)).alias("d")) for k in range(digits[c])])
    dealt = ranked.select("n", F.explode(places("x")).alias("p"), places("y").alias("ys")).select("n", "p", F.explode("ys").alias("q"))
    sums = [F.sum(F.when((F.col("p.d") == i) & (F.col("q.d") == j), F.col("n")).otherwise(0.0)).alias(f"c{i}{j}") for i in range(4) for j in range(4)]
    groups = dealt.groupBy(F.col("p.k").alias("kx"), F.col("p.head").alias("hx"), F.col("q.k").alias("ky"), F.col("q.head").alias("hy")).agg(*sums)
    total = lambda cells_: reduce(lambda s, t: s + t, cells_)
    up = total([F.col(f"c{i}{j}") * total([F.col(f"c{k}{m}") for k in range(i + 1, 4) for m in range(j + 1, 4)]) for i in range(3) for j in range(3)])
    down = total([F.col(f"c{i}{j}") * total([F.col(f"c{k}{m}") for k in range(i + 1, 4) for m in range(j)]) for i in range(3) for j in range(1, 4)])
    cd = groups.agg(F.sum(up).alias("conc"), F.sum(down).alias("disc"))
    tie = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias(f"t{c}"), F.sum("m").alias(f"n{c}"))
    one = cd.crossJoin(tie("x")).crossJoin(tie("y"))  # one row each
    pairs = F.col("nx") * (F.col("nx") - 1) / 2
    return one.select(F.try_divide(F.col("conc") - F.col("disc"), F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))).alias("tau"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, row and column totals, the grand total and the expected count."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    return cells.join(rows, "a").join(columns, "b")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, dof, v (Cramer), v_corrected (Bergsma), n.  Absent cells add their expected count."""
    cells = contingency(df, a, b)
    sums = cells.agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("s"), F.sum("n").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    n, r, c = F.col("n"), F.col("r"), F.col("c")
    chi2 = n * (F.col("s") - 1)
    out = sums.withColumn("chi2", chi2)
    over = lambda x: F.try_divide(x, n - 1)
    phi = F.greatest(F.col("chi2") / n - over((c - 1) * (r - 1)), F.lit(0.0))
    rc, cc = r - over((r - 1) * (r - 1)), c - over((c - 1) * (c - 1))
    v, corrected = F.try_divide(F.col("chi2") / n, F.least(r, c) - 1), F.try_divide(phi, F.least(rc, cc) - 1)
    return out.select("chi2", ((r - 1) * (c - 1)).alias("dof"), F.sqrt(v).alias("v"), F.sqrt(corrected).alias("v_corrected"), "n")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    return chi_square(df, a, b).select("v", "v_corrected")


def corr_highlights(pairs: DataFrame, near: float = 0.95, strong: float = 0.8) -> DataFrame:
    kind = F.when(F.abs("r") >= near, "NEAR_DUPLICATE").when(F.abs("r") >= strong, "STRONG")
    return pairs.withColumn("kind", kind).where("kind IS NOT NULL").orderBy(F.desc(F.abs("r")), "a", "b")


def target_correlation(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    out = long_form(df, {c: [corr(value(df, c), value(df, target))] for c in columns}, ["r"])
    return out.where("r IS NOT NULL").orderBy(F.desc(F.abs("r")), "column")


def vif(df: DataFrame, columns: list[str], cap: float = 0.9999) -> DataFrame:
    """column, vif: the diagonal of the inverse correlation matrix, R^2 capped."""
    import numpy as np

    r = agg_row(df, {f"{a}|{b}": corr(value(df, a), value(df, b)) for a, b in combinations(columns, 2)})
    m = np.eye(len(columns))
    for i, j in combinations(range(len(columns)), 2):
        m[i, j] = m[j, i] = r[f"{columns[i]}|{columns[j]}"] or 0.0
    d = np.minimum(np.diag(np.linalg.pinv(m)), 1 / (1 - cap))
    return df.sparkSession.createDataFrame(list(zip(columns, d.tolist())), "column string, vif double")


def ttest_one(df: DataFrame, column: str, mu: float) -> DataFrame:
    g = agg_row(df, {"n": F.count(value(df, column)), "m": F.avg(value(df, column)), "s": F.stddev_samp(value(df, column)), "p": F.stddev_pop(value(df, column))})

    def test():
        t = (g["m"] - mu) / (g["s"] / math.sqrt(g["n"]))
        return t, float(g["n"] - 1), tails.t_two_sided(t, g["n"] - 1), (g["m"] - mu) / g["p"]

    return _row(df, "t double, dof double, p double, cohen_d double", g["n"] > 1 and g["s"], test)


def ttest_two(df: DataFrame, column: str, group: str, a: str, b: str, equal: bool = False) -> DataFrame:
    """Welch's test, or Student's with ``equal``; Cohen's d by the population deviations."""
    v = value(df, column)
    pick = lambda g, f: f(F.when(F.col(group) == g, v))
    g = agg_row(df, {f"{k}{i}": pick(x, f) for i, x in enumerate((a, b)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp), ("p", F.var_pop))})
    schema = "t double, dof double, p double, cohen_d double"
    if min(g["n0"], g["n1"]) < 2 or not (g["v0"] or g["v1"]):
        return _row(df, schema, False, tuple)
    if equal:
        sp = ((g["n0"] - 1) * g["v0"] + (g["n1"] - 1) * g["v1"]) / (g["n0"] + g["n1"] - 2)
        se, dof = math.sqrt(sp * (1 / g["n0"] + 1 / g["n1"])), g["n0"] + g["n1"] - 2
    else:
        x, y = g["v0"] / g["n0"], g["v1"] / g["n1"]
        se, dof = math.sqrt(x + y), (x + y) ** 2 / (x * x / (g["n0"] - 1) + y * y / (g["n1"] - 1))
    t = (g["m0"] - g["m1"]) / se
    return df.sparkSession.createDataFrame([(t, float(dof), tails.t_two_sided(t, dof), (g["m0"] - g["m1"]) / math.sqrt((g["p0"] + g["p1"]) / 2))], schema)


def ttest_paired(df: DataFrame, a: str, b: str) -> DataFrame:
    return ttest_one(df.select((value(df, a) - value(df, b)).cast("double").alias("_d")), "_d", 0.0)


def anova_oneway(df: DataFrame, column: str, group: str) -> DataFrame:
    return _anova(df, df.where(value(df, column).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(column).alias("m"), F.var_pop(column).alias("v")))


def _anova(df: DataFrame, parts: DataFrame) -> DataFrame:
    """From the groups' rows n, mean m and variance v."""
    g = agg_row(parts, {"k": F.count("*"), "n": F.sum("n"), "s": F.sum(F.col("n") * F.col("m")), "q": F.sum(F.col("n") * F.col("m") * F.col("m")), "within": F.sum(F.col("n") * F.col("v"))})

    def test():
        between, dof = g["q"] - g["s"] ** 2 / g["n"], (g["k"] - 1, g["n"] - g["k"])
        f = between / dof[0] / (g["within"] / dof[1])
        return f, float(dof[0]), float(dof[1]), tails.f_upper(f, *dof), between / (between + g["within"])

    return _row(df, "f double, dof1 double, dof2 double, p double, eta2 double", g["k"] > 1 and g["n"] > g["k"] and g["within"], test)


def mann_whitney_u(df: DataFrame, column: str, group: str, a: str, b: str) -> DataFrame:
    """u (of ``a``), rank_biserial."""
    rows = df.where(F.col(group).isin(a, b)).select(group, column)
    ranked = rank_average(rows, column)
    g = agg_row(ranked, {"ra": F.sum(F.when(F.col(group) == a, F.col("rank"))), "na": F.count(F.when(F.col(group) == a, 1)), "nb": F.count(F.when(F.col(group) == b, 1))})

    def test():
        u = g["ra"] - g["na"] * (g["na"] + 1) / 2
        return float(u), 2 * u / (g["na"] * g["nb"]) - 1

    return _row(df, "u double, rank_biserial double", g["na"] and g["nb"], test)


def kruskal_wallis(df: DataFrame, column: str, group: str) -> DataFrame:
    """h with tie correction, dof, p."""
    ranks = average_ranks(df, column)
    m = F.col("n").cast("double")  # cubes of counts leave the range of whole numbers at two million equal values
    ties = agg_row(ranks, {"t": F.sum(m * m * m - m), "n": F.sum("n"), "values": F.count("*")})
    sums = rank_average(df.where(F.col(column).isNotNull()).select(group, column), column).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("m"))
    n = ties["n"] or 0
    off = F.col("r") / F.col("m") - (n + 1) / 2  # a group's mean rank, from the mean of all
    g = agg_row(sums, {"s": F.sum(F.col("m") * off * off), "k": F.count("*")})

    def test():
        h = 12 / (n * (n + 1)) * g["s"] / (1 - ties["t"] / (float(n) ** 3 - n))
        return h, float(g["k"] - 1), tails.chi2_upper(h, g["k"] - 1)

    return _row(df, "h double, dof double, p double", g["k"] > 1 and ties["values"] > 1, test)


def wilcoxon_signed_rank(df: DataFrame, a: str, b: str) -> DataFrame:
    """w: the smaller of the rank sums of positive and negative differences; zeros are left out."""
    d = df.select((F.col(a) - F.col(b)).alias("_d")).where("_d <> 0").withColumn("_a", F.abs("_d"))
    g = agg_row(rank_average(d, "_a"), {"p": F.sum(F.when(F.col("_d") > 0, F.col("rank")).otherwise(0.0)), "m": F.sum(F.when(F.col("_d") < 0, F.col("rank")).otherwise(0.0)), "n": F.count("*")})
    return df.sparkSession.createDataFrame([(float(min(g["p"] or 0, g["m"] or 0)), g["n"])], "w double, n long")


def levene_test(df: DataFrame, column: str, group: str) -> DataFrame:
    """Brown-Forsythe form: an ANOVA on distances to the group's median.  Equal values of a group are counted once, for all steps."""
    known = df.where(F.col(group).isNotNull() & F.col(column).isNotNull())
    counts = stash(known.groupBy(group, column).agg(F.count("*").alias("_n")), "counts")
    med = stash(group_medians(counts, column, [group], "_n"), "medians")
    z = lookup(counts, med, group).select(group, F.abs(F.col(column) - F.col("median")).alias("_z"), "_n")
    z = z.where(value(z, "_z").isNotNull())
    means = stash(z.groupBy(group).agg(F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.col("_z")) / F.sum("_n")).alias("m")), "means")
    off = F.col("_z") - F.col("m")
    parts = lookup(z, means, group).groupBy(group).agg(F.first("n").alias("n"), F.first("m").alias("m"), (F.sum(F.col("_n") * off * off) / F.first("n")).alias("v"))
    return _anova(df, parts).select(F.col("f").alias("w"), "p")


def dagostino_pearson(df: DataFrame, column: str) -> DataFrame:
    """k2, p, normal (p >= 0.05), and Jarque-Bera."""
    g = agg_row(df, {"n": F.count(value(df, column)), "s": F.skewness(value(df, column)), "k": F.kurtosis(value(df, column))})

    def test():
        z1, z2 = tails.skew_z(g["s"], g["n"]), tails.kurtosis_z(g["k"], g["n"])
        k2, jb = z1 * z1 + z2 * z2, g["n"] / 6 * (g["s"] ** 2 + g["k"] ** 2 / 4)
        p = tails.chi2_upper(k2, 2)
        return k2, p, p >= 0.05, jb

    spread = g["s"] is not None and not math.isnan(g["s"])
    return _row(df, "k2 double, p double, normal boolean, jarque_bera double", g["n"] >= 8 and spread, test)


def ci_mean(df: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    g = agg_row(df, {"n": F.count(value(df, column)), "m": F.avg(value(df, column)), "s": F.stddev_samp(value(df, column))})
    half = tails.t_critical(level, g["n"] - 1) * g["s"] / math.sqrt(g["n"]) if g["n"] > 1 else 0.0
    return _row(df, "mean double, lo double, hi double", g["n"] > 1, lambda: (g["m"], g["m"] - half, g["m"] + half))


def ci_diff_means(df: DataFrame, column: str, group: str, a: str, b: str, level: float = 0.95) -> DataFrame:
    v = value(df, column)
    g = agg_row(df, {f"{k}{i}": f(F.when(F.col(group) == x, v)) for i, x in enumerate((a, b)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))})
    if min(g["n0"], g["n1"]) < 2 or not (g["v0"] or g["v1"]):
        return _row(df, "diff double, lo double, hi double", False, tuple)
    x, y = g["v0"] / g["n0"], g["v1"] / g["n1"]
    dof = (x + y) ** 2 / (x * x / (g["n0"] - 1) + y * y / (g["n1"] - 1))
    d, half = g["m0"] - g["m1"], tails.t_critical(level, dof) * math.sqrt(x + y)
    return df.sparkSession.createDataFrame([(d, d - half, d + half)], "diff double, lo double, hi double")


def ci_proportion(df: DataFrame, condition: Column, z: float = 1.959963984540054) -> DataFrame:
    """p, Wilson and Wald intervals."""
    g = df.agg(F.avg(condition.cast("int")).alias("p"), F.nullif(F.count(condition), F.lit(0)).alias("n"))
    p, n = F.col("p"), F.col("n")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    wald = z * F.sqrt(p * (1 - p) / n)
    return g.select("p", (mid - half).alias("wilson_lo"), (mid + half).alias("wilson_hi"), (p - wald).alias("wald_lo"), (p + wald).alias("wald_hi"))


def harmonic(m: int) -> float:
    """1 + 1/2 + ... + 1/m; beyond a million terms by Euler's expansion, whose error is under 1e-25 there."""
    if m <= 1_000_000:
        return math.fsum(1 / i for i in range(1, m + 1))
    return math.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m)


def multiple_testing(tests: DataFrame, key: str, p: str = "p") -> DataFrame:
    """Bonferroni, Holm, Benjamini-Hochberg and -Yekutieli adjusted p of each test; null p stay null and are not counted.

    Equal p get equal adjusted values, so only distinct p are put in order, dealt out by ranges: a range's running extremes
    are completed by the extremes of the ranges before or behind it.
    """
    m = agg_row(tests, {"m": F.count(p)})["m"]
    counts = average_ranks(tests, p)  # distinct p, n, average rank
    first, last = F.col("rank") - (F.col("n") - 1) / 2, F.col("rank") + (F.col("n") - 1) / 2
    terms = counts.select(p, (F.col(p) * (m - first + 1)).alias("_up"), (F.col(p) * m / last).alias("_down"))
    terms = by_ranges(terms, p, range_cuts(counts.select(p), [p])[p])
    # one row a range
    ends = terms.groupBy("_p").agg(F.max("_up").alias("up"), F.min("_down").alias("down"))
    ends = ends.select("_p", F.max("up").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.min("down").over(W.orderBy("_p").rowsBetween(1, W.unboundedFollowing)).alias("_behind"))
    w = W.partitionBy("_p").orderBy(p)
    up, down = F.max("_up").over(w.rowsBetween(W.unboundedPreceding, 0)), F.min("_down").over(w.rowsBetween(0, W.unboundedFollowing))
    done = terms.join(F.broadcast(ends), "_p").select(F.col(p).alias("_v"), F.greatest(up, "_before").alias("_holm"), F.least(down, "_behind").alias("_bh"))
    cap = lambda c: F.least(F.lit(1.0), c)
    out = tests.join(done, F.col(p) == F.col("_v"), "left")
    given = lambda c: F.when(F.col(p).isNotNull(), cap(c))
    return out.select(key, p, given(F.col(p) * m).alias("bonferroni"), given(F.col("_holm")).alias("holm"), given(F.col("_bh")).alias("bh"), given(F.col("_bh") * harmonic(m)).alias("by"))


def ols(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """feature, coef, se, t, p (and r2): normal equations from one aggregate of cross products.

    With no more rows than coefficients all are null; what a fit leaves undefined (no residual, a constant target) is null too.
    """
    import numpy as np

    cols = [F.lit(1.0), *[value(df, f).cast("double") for f in features], value(df, target).cast("double")]
    rows = df.where(~sum(((c.isNull()).cast("int") for c in cols[1:]), F.lit(0)).cast("boolean"))
    got = agg_row(rows, {f"{i}|{j}": F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))})
    k, schema = len(cols) - 1, "feature string, coef double, se double, t double, p double, r2 double"
    if (got["0|0"] or 0) <= k:
        return df.sparkSession.createDataFrame([(f, None, None, None, None, None) for f in ["intercept", *features]], schema)
    m = np.array([[got[f"{min(i, j)}|{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    # columns of very different size are brought to one scale first
    size = np.sqrt(np.diag(m)[:k])
    size[size == 0] = 1.0
    size = np.outer(size, size)
    unit = m[:k, :k] / size
    inv = (np.linalg.inv(unit) if np.linalg.matrix_rank(unit) == k else np.linalg.pinv(unit)) / size
    beta, n = inv @ m[:k, k], m[0, 0]
    rss = m[k, k] - beta @ m[:k, k]
    tss = m[k, k] - m[0, k] ** 2 / n
    se = np.sqrt(np.maximum(rss / (n - k) * np.diag(inv), 0.0))
    t = [float(b / s) if s > 0 else None for b, s in zip(beta, se)]
    out = [(f, float(b), float(s), x, None if x is None else float(tails.t_two_sided(x, float(n - k))), float(1 - rss / tss) if tss > 0 else None) for f, b, s, x in zip(["intercept", *features], beta, se, t)]
    return df.sparkSession.createDataFrame(out, schema)


def simple_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def durbin_watson(df: DataFrame, residual: str, order: list[str], by: list[str] = ()) -> DataFrame:
    """dw within ``by``; the order is global if ``by`` is empty, so give a key for large tables."""
    d = F.col(residual) - F.lag(residual).over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_d", d).groupBy(*by).agg(F.try_divide(F.sum(F.col("_d") * F.col("_d")), F.sum(F.col(residual) * F.col(residual))).alias("dw"))


def ljung_box(df: DataFrame, residual: str, order: list[str], by: list[str], lags: int = 10) -> DataFrame:
    """by, q, p of each series: n (n + 2) times the sum of squared autocorrelations over n - lag; lags beyond half a series are
    left out, and p has as many degrees of freedom as lags were used."""
    r = acf(df, residual, order, by, lags)
    n = df.groupBy(*by).agg(F.count(residual).alias("_n"))
    out = r.join(n, by).where("acf IS NOT NULL").groupBy(*by).agg((F.first("_n") * (F.first("_n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("_n") - F.col("lag")))).alias("q"), F.count("*").alias("dof"))
    return out.select(*by, "q", "dof", _chi2_upper(F.col("q"), F.col("dof")).alias("p"))


def _chi2_upper(x: Column, dof: Column) -> Column:
    """Upper tail of a chi-square with whole degrees of freedom, in closed form: a sum of dof / 2 terms."""
    half = x / 2
    even = F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(dof / 2), F.lit(1)).cast("int")), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")), lambda a, i: F.struct((a["t"] * half / i).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"] * F.exp(-half))
    # odd: the normal tail and the terms of half-integer powers
    first = F.sqrt(half) * 2 / math.sqrt(math.pi)
    odd = F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor((dof - 1) / 2), F.lit(1)).cast("int")), F.struct(first.alias("t"), F.lit(0.0).alias("s")), lambda a, i: F.struct((a["t"] * half / (i + 0.5)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"] * F.exp(-half))
    return F.when(dof % 2 == 0, even).otherwise(_erfc(F.sqrt(half)) + F.when(dof > 1, odd).otherwise(0.0))


def _erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, by Numerical Recipes' Chebyshev fit (relative error under 1.2e-7)."""
    # Coefficients of the fit.
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = 1 / (1 + x / 2)
    return t * F.exp(-x * x + reduce(lambda s, c: s * t + c, reversed(fit[:-1]), F.lit(fit[-1])))


def cooks_distance(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """``df`` with residual, leverage, cooks_d and influential (over 4 / n) of a least-squares fit; null where a value is missing.

    The inverse of the cross products (features x features) is made on the driver; leverages are expressions of the row.
    """
    import numpy as np

    cols = [F.lit(1.0), *[value(df, f).cast("double") for f in features]]
    y = value(df, target).cast("double")
    known = ~reduce(lambda a, c: a | c.isNull(), [*cols[1:], y], F.lit(False))
    k = len(cols)
    got = agg_row(df.where(known), {**{f"{i}|{j}": F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)}, **{f"y{i}": F.sum(cols[i] * y) for i in range(k)}, "yy": F.sum(y * y)})
    n = got["0|0"] or 0
    if n <= k:
        return df.withColumns({"residual": F.lit(None).cast("double"), "leverage": F.lit(None).cast("double"), "cooks_d": F.lit(None).cast("double"), "influential": F.lit(None).cast("boolean")})
    m = np.array([[got[f"{min(i, j)}|{max(i, j)}"] for j in range(k)] for i in range(k)])
    inv, xy = np.linalg.pinv(m), np.array([got[f"y{i}"] for i in range(k)])
    beta = inv @ xy
    s2 = max(float(got["yy"] - beta @ xy), 0.0) / (n - k)
    residual = y - reduce(lambda a, b: a + b, [c * float(b) for c, b in zip(cols, beta)])
    leverage = reduce(lambda a, b: a + b, [cols[i] * cols[j] * float(inv[i, j]) for i in range(k) for j in range(k)])
    out = df.withColumns({"residual": F.when(known, residual), "leverage": F.when(known, leverage)})
    out = out.withColumn("cooks_d", F.try_divide(F.col("residual") * F.col("residual") * F.col("leverage"), F.lit(k * s2) * (1 - F.col("leverage")) * (1 - F.col("leverage"))))
    return out.withColumn("influential", F.col("cooks_d") > 4 / n)


def breusch_pagan(df: DataFrame, residual: str, features: list[str]) -> DataFrame:
    """lm = n R^2 of the squared residuals on the features, and p."""
    n = df.count()
    r2 = ols(df.withColumn("_e2", F.col(residual) * F.col(residual)), "_e2", features).first()["r2"]
    return _row(df, "lm double, p double", r2 is not None, lambda: (n * r2, tails.chi2_upper(n * r2, len(features))))


def acf(df: DataFrame, column: str, order: list[str], by: list[str], lags: int) -> DataFrame:
    """by, lag, acf: autocorrelations of each series up to ``lags``, at most half its length."""
    w, all_ = W.partitionBy(*by).orderBy(*order), W.partitionBy(*by)
    rows = df.withColumn("_x", F.col(column) - F.avg(column).over(all_)).withColumns({f"_l{k}": F.lag("_x", k).over(w) for k in range(1, lags + 1)})
    wide = rows.groupBy(*by).agg(F.count("*").alias("_n"), *[F.try_divide(F.sum(F.col("_x") * F.col(f"_l{k}")), F.sum(F.col("_x") * F.col("_x"))).alias(f"r{k}") for k in range(1, lags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("acf")) for k in range(1, lags + 1)])
    return wide.select(*by, "_n", F.explode(pairs).alias("p")).where(F.col("p.lag") <= F.col("_n") / 2 - 1).select(*by, "p.lag", "p.acf")


def pacf(df: DataFrame, column: str, order: list[str], by: list[str], lags: int) -> DataFrame:
    """by, lag, pacf by Durbin-Levinson on each series' autocorrelations (``lags`` numbers a series)."""
    import pandas as pd

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        r = part.sort_values("lag")["acf"].astype(float).tolist()
        phi, out = [], []
        for k in range(1, len(r) + 1):
            top = r[k - 1] - sum(phi[j] * r[k - 2 - j] for j in range(k - 1))
            low = 1 - sum(phi[j] * r[j] for j in range(k - 1))
            new = top / low if low else float("nan")
            phi = [phi[j] - new * phi[k - 2 - j] for j in range(k - 1)] + [new]
            out.append(new)
        return pd.DataFrame({**{c: part[c].iloc[0] for c in by}, "lag": range(1, len(r) + 1), "pacf": out})

    found = acf(df, column, order, by, lags)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in by)
    return found.groupBy(*by).applyInPandas(solve, f"{kinds}, lag int, pacf double")


def seasonal_decompose(df: DataFrame, column: str, order: str, by: list[str], period: int, multiplicative: bool = False) -> DataFrame:
    """Trend (centred moving average over a period), seasonal, resid, whose sum or, if ``multiplicative``, product is the
    series; ``order`` numbers the rows.  Zero trends have no multiplicative parts."""
    w = W.partitionBy(*by).orderBy(order)
    half = period // 2
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*by)))
    if period % 2:
        mean = F.avg(column).over(w.rowsBetween(-half, half))
    else:
        inner = F.sum(column).over(w.rowsBetween(-half + 1, half - 1))
        mean = (inner + (F.lag(column, half).over(w) + F.lead(column, half).over(w)) / 2) / period
    inside = (F.col("_i") >= half) & (F.col("_i") < F.col("_n") - half)
    rows = rows.withColumn("trend", F.when(inside, mean)).withColumn("_k", F.col("_i") % period)
    off = F.try_divide(F.col(column), F.col("trend")) if multiplicative else F.col(column) - F.col("trend")
    means, all_ = rows.groupBy(*by, "_k").agg(F.avg(off).alias("_m")), W.partitionBy(*by)  # a period's rows a series
    level = F.avg("_m").over(all_)
    means = means.withColumn("seasonal", F.try_divide("_m", level) if multiplicative else F.col("_m") - level).drop("_m")
    resid = F.try_divide(F.col(column), F.col("trend") * F.col("seasonal")) if multiplicative else F.col(column) - F.col("trend") - F.col("seasonal")
    return rows.join(means, [*by, "_k"]).withColumn("resid", resid).drop("_i", "_n", "_k")


def statistical_test_battery(df: DataFrame, columns: list[str], group: str, order: list[str] | None = None) -> DataFrame:
    """column, test, stat, p: normality, equality of variances and, where the rows have an ``order``, stationarity of every column."""
    parts = [unit_roots.adf_tests(df, columns, order).select("column", F.lit("adf").alias("test"), "stat", "p")] if order else []
    for c in columns:
        parts.append(dagostino_pearson(df, c).select(F.lit(c).alias("column"), F.lit("dagostino").alias("test"), F.col("k2").alias("stat"), "p"))
        parts.append(levene_test(df, c, group).select(F.lit(c).alias("column"), F.lit("levene").alias("test"), F.col("w").alias("stat"), "p"))
    return reduce(lambda a, b: a.unionByName(b), parts)
