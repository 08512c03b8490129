"""Drift between a baseline and a current table: stability indices, divergences, distances, reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions import tails
from tidewell.functions.columns import agg_row, value
from tidewell.functions.quantiles import quantiles
from tidewell.operators.ordering import by_ranges, group_medians, range_cuts


def _both(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """v, side (0 baseline, 1 current), nulls left out."""
    pick = lambda df, s: df.select(value(df, column).alias("v"), F.lit(s).alias("side")).where("v IS NOT NULL")
    return pick(base, 0).unionByName(pick(now, 1))


def binned(both: DataFrame, edges: list[float]) -> list[tuple[int, int]]:
    """Counts of both sides in each bin [e, next e), the last one closed: two numbers a bin."""
    inner = edges[1:-1]
    code = sum(((F.col("v") >= e).cast("int") for e in inner), F.lit(0))
    got = {(r["b"], r["side"]): r["n"] for r in both.groupBy(code.alias("b"), "side").agg(F.count("*").alias("n")).collect()}
    return [(got.get((b, 0), 0), got.get((b, 1), 0)) for b in range(len(edges) - 1)]


def width_histograms(base: DataFrame, now: DataFrame, columns: list[str], bins: int) -> dict[str, list[tuple[int, int]]]:
    """Counts of both sides in ``bins`` equal-width bins over each column's pooled range; empty for columns without values."""
    ends = [agg_row(df, {f"{f}|{c}": e(value(df, c).cast("double")) for c in columns for f, e in (("lo", F.min), ("hi", F.max))}) for df in (base, now)]
    pick = lambda f, k, c: f((e[f"{k}|{c}"] for e in ends if e[f"{k}|{c}"] is not None), default=None)
    span = {c: (pick(min, "lo", c), pick(max, "hi", c)) for c in columns}
    own = [c for c in columns if span[c][0] is not None]
    if not own:
        return {c: [] for c in columns}

    def codes(df: DataFrame, side: int) -> DataFrame:
        bin_of = {c: sum(((value(df, c) >= lo + (hi - lo) * i / bins).cast("int") for i in range(1, bins)), F.lit(0)) for c, (lo, hi) in span.items() if c in own}
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.when(value(df, c).isNotNull(), bin_of[c]).alias("b")) for c in own])
        return df.select(F.explode(cells).alias("x"), F.lit(side).alias("side")).select("x.c", "x.b", "side").where("b IS NOT NULL")

    # bins x columns x sides rows
    got = {(r["c"], r["b"], r["side"]): r["n"] for r in codes(base, 0).unionByName(codes(now, 1)).groupBy("c", "b", "side").agg(F.count("*").alias("n")).collect()}
    return {c: [(got.get((c, b, 0), 0), got.get((c, b, 1), 0)) for b in range(bins)] if c in own else [] for c in columns}


def width_edges(both: DataFrame, bins: int) -> list[float]:
    e = agg_row(both, {"lo": F.min("v"), "hi": F.max("v")})
    if e["lo"] is None:
        return []
    return [e["lo"] + (e["hi"] - e["lo"]) * i / bins for i in range(bins + 1)]


def quantile_edges(both: DataFrame, bins: int) -> list[float]:
    q = quantiles(both, {"q": (F.col("v"), [i / bins for i in range(bins + 1)])})["q"]
    return sorted(set(q or []))


def _counts(both: DataFrame, edges: list[float]) -> tuple[list[tuple[int, int]], int, int] | None:
    """Counts of both sides in each bin and their sums; None if a side has no values.  Equal values are one bin."""
    n = binned(both, edges if len(edges) > 1 else edges * 2) if edges else []
    a, b = (sum(x) for x in zip(*n)) if n else (0, 0)
    return (n, a, b) if a and b else None


def _psi(pairs: list[tuple[float, float]]) -> float:
    return sum((q - p) * math.log(q / p) for p, q in pairs)


def _one(df: DataFrame, name: str, x: float | None) -> DataFrame:
    """One row; null where a side has no values."""
    return df.sparkSession.createDataFrame([(None if x is None else float(x),)], f"{name} double")


def psi_equal_width(base: DataFrame, now: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the pooled range, shares clipped at 1e-6."""
    both = _both(base, now, column)
    got = _counts(both, width_edges(both, bins))
    return _one(base, "psi", got and _psi([(max(p / got[1], 1e-6), max(q / got[2], 1e-6)) for p, q in got[0]]))


def psi_quantile(base: DataFrame, now: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Pooled deciles, shares (n + 0.5) / (N + 0.5 bins)."""
    both = _both(base, now, column)
    got = _counts(both, quantile_edges(both, bins))
    if not got:
        return _one(base, "psi", None)
    (n, a, b), k = got, len(got[0])
    return _one(base, "psi", _psi([((p + 0.5) / (a + 0.5 * k), (q + 0.5) / (b + 0.5 * k)) for p, q in n]))


def psi_gate(base: DataFrame, now: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Pooled deciles, empty shares as 1e-6."""
    both = _both(base, now, column)
    got = _counts(both, quantile_edges(both, bins))
    return _one(base, "psi", got and max(0.0, _psi([(p / got[1] or 1e-6, q / got[2] or 1e-6) for p, q in got[0]])))


def fingerprint(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """column, edges, shares: stored baseline histograms."""
    rows = []
    for c in columns:
        v = df.select(value(df, c).cast("double").alias("v"), F.lit(0).alias("side")).where("v IS NOT NULL")
        edges = width_edges(v, bins)
        n = [p for p, _ in binned(v, edges)] if edges else []
        rows.append((c, edges, [x / sum(n) for x in n]))
    return df.sparkSession.createDataFrame(rows, "column string, edges array<double>, shares array<double>")


def psi_fingerprint(prints: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """PSI against a stored histogram; current values are clipped into its range."""
    p = prints.where(F.col("column") == column).first()
    if not p or not p["edges"]:
        return _one(now, "psi", None)
    v = now.select(F.greatest(F.least(value(now, column).cast("double"), F.lit(p["edges"][-1])), F.lit(p["edges"][0])).alias("v"), F.lit(1).alias("side")).where("v IS NOT NULL")
    n = [q for _, q in binned(v, p["edges"])]
    return _one(now, "psi", sum(n) and _psi([(max(a, 1e-6), max(b / sum(n), 1e-6)) for a, b in zip(p["shares"], n)]))


def category_shares(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """value, p, q: shares of both sides, 0 where absent."""
    part = lambda df, n: df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias(n))
    both = part(base, "a").join(part(now, "b"), "value", "full").na.fill(0, ["a", "b"])
    total = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return both.crossJoin(F.broadcast(total)).select("value", F.try_divide("a", "na").alias("p"), F.try_divide("b", "nb").alias("q"))  # one row of totals


def psi_categorical(base: DataFrame, now: DataFrame, column: str, eps: float = 1e-6) -> DataFrame:
    p, q = F.col("p") + eps, F.col("q") + eps
    return category_shares(base, now, column).agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def _decile_shares(base: DataFrame, now: DataFrame, column: str, eps: float = 1e-10) -> list[tuple[float, float]] | None:
    both = _both(base, now, column)
    got = _counts(both, quantile_edges(both, 10))
    return got and [(p / got[1] + eps, q / got[2] + eps) for p, q in got[0]]


def kl_divergence(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    pairs = _decile_shares(base, now, column)
    return _one(base, "kl", pairs and sum(q * math.log(q / p) for p, q in pairs))


def _js(pairs: list[tuple[float, float]]) -> float:
    return sum((p * math.log(2 * p / (p + q)) if p else 0) + (q * math.log(2 * q / (p + q)) if q else 0) for p, q in pairs) / 2


def js_divergence(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """js over pooled deciles, and js_distance (root) over 20 equal-width bins."""
    both = _both(base, now, column)
    got, deciles = _counts(both, width_edges(both, 20)), _decile_shares(base, now, column)
    values = (_js(deciles), math.sqrt(max(0.0, _js([(p / got[1], q / got[2]) for p, q in got[0]])))) if got else (None, None)
    return base.sparkSession.createDataFrame([values], "js double, js_distance double")


def _distribution(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """Distinct values with both cumulative shares.  Values are dealt out by range; each range starts from the sums before it."""
    counts = _both(base, now, column).groupBy("v").agg(F.sum(1 - F.col("side")).alias("a"), F.sum("side").alias("b"))
    counts = by_ranges(counts, "v", range_cuts(counts, ["v"])["v"], "p")
    before, all_ = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()  # one row a range
    sums = counts.groupBy("p").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.min("v").alias("first"))
    sums = sums.select("p", *[F.coalesce(F.sum(f"s{x}").over(before), F.lit(0)).alias(f"o{x}") for x in "ab"], *[F.sum(f"s{x}").over(all_).alias(f"n{x}") for x in "ab"], F.lead("first").over(W.orderBy("p")).alias("next_first"))
    w = W.partitionBy("p").orderBy("v")
    out = counts.join(F.broadcast(sums), "p")
    cum = lambda x: F.try_divide(F.sum(x).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col(f"o{x}"), F.col(f"n{x}"))
    return out.select("v", cum("a").alias("fa"), cum("b").alias("fb"), F.coalesce(F.lead("v").over(w), F.col("next_first")).alias("next"), "na", "nb")


def ks_two_sample(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """d, p (asymptotic), drift."""
    g = agg_row(_distribution(base, now, column), {"d": F.max(F.abs(F.col("fa") - F.col("fb"))), "na": F.max("na"), "nb": F.max("nb")})
    if g["d"] is None:
        return base.sparkSession.createDataFrame([(None, None, None)], "d double, p double, drift boolean")
    p = tails.kolmogorov(g["d"], g["na"], g["nb"])
    return base.sparkSession.createDataFrame([(g["d"], p, p < 0.05)], "d double, p double, drift boolean")


def wasserstein(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    return _distribution(base, now, column).agg(F.sum(F.abs(F.col("fa") - F.col("fb")) * (F.col("next") - F.col("v"))).alias("wasserstein"))


def drift_report(base: DataFrame, now: DataFrame, columns: list[str]) -> DataFrame:
    """column, psi, level: STABLE under 0.10, MINOR under 0.20, MAJOR."""
    rows = [(c, psi_quantile(base, now, c).first()["psi"]) for c in columns]
    out = base.sparkSession.createDataFrame(rows, "column string, psi double")
    return out.withColumn("level", F.when(F.col("psi") < 0.10, "STABLE").when(F.col("psi") < 0.20, "MINOR").when(F.col("psi").isNotNull(), "MAJOR"))


def drift_consensus(base: DataFrame, now: DataFrame, columns: list[str]) -> DataFrame:
    """column, votes, drift: at least two of PSI > 0.25 (10 equal-width bins), KS p < 0.05 and JS distance > 0.10 (20 bins).

    The histograms of all columns come from two passes; a column without values on a side has no votes.
    """
    rows, found = [], width_histograms(base, now, columns, 20)
    for c in columns:
        n, votes = found[c], 0
        a, b = (sum(x) for x in zip(*n)) if n else (0, 0)
        if a and b:
            tens = [(p + r, q + s) for (p, q), (r, s) in zip(n[::2], n[1::2])]
            votes = int(_psi([(max(p / a, 1e-6), max(q / b, 1e-6)) for p, q in tens]) > 0.25) + int(math.sqrt(max(0.0, _js([(p / a, q / b) for p, q in n]))) > 0.10)
            votes += int(ks_two_sample(base, now, c).first()["drift"])
        rows.append((c, votes, votes >= 2))
    return base.sparkSession.createDataFrame(rows, "column string, votes int, drift boolean")


def schema_drift(base: DataFrame, now: DataFrame) -> DataFrame:
    a, b = dict(base.dtypes), dict(now.dtypes)
    rows = [(c, "column_added", "INFO") for c in b if c not in a] + [(c, "column_removed", "ERROR") for c in a if c not in b] + [(c, "dtype_changed", "ERROR") for c in a if c in b and a[c] != b[c]]
    return now.sparkSession.createDataFrame(rows, "column string, change string, severity string")


def temporal_drift(df: DataFrame, ts: str, column: str, window: str = "7 days") -> DataFrame:
    """start, mean, std, median, z and alert (|z| > 2 of the global mean) for each window."""
    g = agg_row(df, {"m": F.avg(column), "s": F.stddev_samp(column)})
    rows = df.select(F.window(ts, window).alias("w"), F.col(column))
    out = rows.groupBy("w").agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")).join(group_medians(rows, column, ["w"]), "w", "left")
    return out.select(F.col("w.start").alias("start"), "mean", "std", "median", F.try_divide(F.col("mean") - F.lit(g["m"]), F.lit(g["s"])).alias("z")).withColumn("alert", F.abs("z") > 2)


def multivariate_drift(base: DataFrame, now: DataFrame, columns: list[str], k: int = 2, limit: float = 0.10) -> DataFrame:
    """share of current rows whose PCA reconstruction error passes the baseline's 95th percentile, and drift."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    full = base.select(*[value(base, c).alias(c) for c in columns]).na.drop("any")
    if len(full.take(2)) < 2:
        return base.sparkSession.createDataFrame([(None, None)], "share double, drift boolean")
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_r", handleInvalid="skip"), StandardScaler(inputCol="_r", outputCol="_z", withMean=True), PCA(k=k, inputCol="_z", outputCol="_p")]).fit(base)
    pc = model.stages[-1].pc.toArray()
    z, p = vector_to_array("_z"), vector_to_array("_p")
    error = sum(((z[i] - sum((p[j] * float(pc[i, j]) for j in range(k)), F.lit(0.0))) * (z[i] - sum((p[j] * float(pc[i, j]) for j in range(k)), F.lit(0.0))) for i in range(len(columns))), F.lit(0.0))
    cut = model.transform(base).agg(F.percentile_approx(error, 0.95)).first()[0]
    return model.transform(now).agg(F.avg((error > cut).cast("int")).alias("share")).withColumn("drift", F.col("share") > limit)


def importance_history(now: DataFrame, before: DataFrame) -> DataFrame:
    """feature, now, before: importances of two runs, 0 where absent."""
    a, b = now.select("feature", F.col("importance").alias("now")), before.select("feature", F.col("importance").alias("before"))
    return a.join(b, "feature", "full").na.fill(0.0, ["now", "before"])


def feature_stability(now: DataFrame, before: DataFrame, warn: float = 0.7, fail: float = 0.4) -> DataFrame:
    """tau of the importances of two runs and the verdict."""
    from tidewell.operators.statistics import corr_kendall

    tau = corr_kendall(importance_history(now, before), "now", "before")
    return tau.withColumn("verdict", F.when(F.col("tau") < fail, "ERROR").when(F.col("tau") < warn, "WARN").otherwise("PASS"))


def baseline_join(base: Column | DataFrame, now: DataFrame, key: str = "column") -> DataFrame:
    """Baseline and current statistics of the columns both have."""
    return base.select(key, *[F.col(c).alias(f"base_{c}") for c in base.columns if c != key]).join(now, key)
