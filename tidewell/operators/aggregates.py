"""Aggregations: profiles, chart data, health and quality scores.  Results are one row a column, group or bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.columns import agg_row, corr, kurtosis_adjusted, long_form, numeric_columns, skewness_adjusted, value
from tidewell.functions.quantiles import quantile_exprs, quantiles
from tidewell.operators import sketches

QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def simple_aggregation(df: DataFrame, by: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """``aggs``: output name -> (column, count | sum | mean | min | max)."""
    make = {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    return df.groupBy(*by).agg(*[make[f](c).alias(n) for n, (c, f) in aggs.items()])


def aggregation_rollup(df: DataFrame, by: list[str], aggs: dict[str, tuple[str, str]], cube: bool = False) -> DataFrame:
    make = {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    grouped = df.cube(*by) if cube else df.rollup(*by)
    return grouped.agg(F.grouping_id().alias("grouping_id"), *[make[f](c).alias(n) for n, (c, f) in aggs.items()])


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    own = columns or numeric_columns(df)
    parts, q = {}, quantile_exprs(df, {c: (value(df, c), QUANTILES) for c in own})
    for c in own:
        v = value(df, c).cast("double")
        parts[c] = [F.count(v), F.sum(v.isNull().cast("long")), F.count_distinct(v), F.min(v), F.max(v), F.avg(v), F.stddev_samp(v), F.var_samp(v), F.skewness(v), F.kurtosis(v), q[c]]
    out = long_form(df, parts, ["n", "n_null", "n_distinct", "min", "max", "mean", "std", "variance", "skewness", "kurtosis", "q"])
    names = ["q05", "q25", "median", "q75", "q95"]
    return out.select("*", *[F.col("q")[i].alias(n) for i, n in enumerate(names)], (F.col("q")[3] - F.col("q")[1]).alias("iqr")).drop("q")


def profile_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_iqr (beyond Tukey fences), n_z (|z| > 3, population deviation), pct of each."""
    q = quantile_exprs(df, {c: (value(df, c), [0.25, 0.75]) for c in columns})
    got = agg_row(df, {f"{k}|{c}": e for c in columns for k, e in (("q", q[c]), ("m", F.avg(value(df, c))), ("s", F.stddev_pop(value(df, c))))})
    parts = {}
    for c in columns:
        v, (a, b) = value(df, c), got[f"q|{c}"] or (0.0, 0.0)
        iqr = F.sum(((v < a - 1.5 * (b - a)) | (v > b + 1.5 * (b - a))).cast("long"))
        z = F.sum((F.abs(v - F.lit(got[f"m|{c}"])) > F.lit(3.0) * F.lit(got[f"s|{c}"])).cast("long"))
        parts[c] = [iqr, z, F.count(v)]
    return long_form(df, parts, ["n_iqr", "n_z", "n"]).select("column", "n_iqr", "n_z", F.try_divide("n_iqr", "n").alias("pct_iqr"), F.try_divide("n_z", "n").alias("pct_z"))


def profile_datetime(df: DataFrame, column: str) -> DataFrame:
    """min, max, range_days and the upper-middle median."""
    at = F.unix_micros(F.col(column).cast("timestamp"))
    middle = quantiles(df, {"m": (at, [0.5])})["m"]
    ends = df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.min(F.when(at >= F.lit(middle[0] if middle else None), F.col(column))).alias("median"))
    return ends.select("min", "max", F.datediff("max", "min").alias("range_days"), "median")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n of all given columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def profile_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_distinct, mode, mode_freq, entropy (bits)."""
    counts = value_counts(df, columns)
    total = W.partitionBy("column")
    p = F.col("n") / F.sum("n").over(total)
    withp = counts.withColumn("p", p)
    return withp.groupBy("column").agg(F.count("*").alias("n_distinct"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"), F.max("n").alias("mode_freq"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    return value_counts(df, columns).withColumn("rank", rank).where(F.col("rank") <= k)


def cardinality_tier(df: DataFrame, columns: list[str]) -> DataFrame:
    out = long_form(df, {c: [F.try_divide(F.count_distinct(c), F.count("*"))] for c in columns}, ["ratio"])
    return out.withColumn("tier", F.when(F.col("ratio") < 0.05, "low").when(F.col("ratio") < 0.5, "medium").when(F.col("ratio") < 0.95, "high").otherwise("unique"))


def analyst_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, flag: HIGH_SKEW, HEAVY_TAILS, HIGH_OUTLIER_RATE_IQR, HIGH_CARDINALITY."""
    both = profile_numeric(df, columns).join(profile_outliers(df, columns).select("column", "pct_iqr"), "column")
    flags = [F.when(F.abs("skewness") > 1, "HIGH_SKEW"), F.when(F.abs("kurtosis") > 3, "HEAVY_TAILS"), F.when(F.col("pct_iqr") > 0.03, "HIGH_OUTLIER_RATE_IQR"), F.when(F.col("n_distinct") > 0.95 * F.col("n"), "HIGH_CARDINALITY")]
    return both.select("column", F.explode(F.array_compact(F.array(*flags))).alias("flag"))


def column_metadata(df: DataFrame) -> DataFrame:
    """column, dtype, n_null, null_rate, n_unique, is_pk_candidate, min, max (as text)."""
    kinds = dict(df.dtypes)
    parts = {c: [F.lit(kinds[c]), F.sum(value(df, c).isNull().cast("long")), F.avg(value(df, c).isNull().cast("int")), F.count_distinct(c), F.min(c).cast("string"), F.max(c).cast("string"), F.count(F.lit(1))] for c in df.columns}
    out = long_form(df, parts, ["dtype", "n_null", "null_rate", "n_unique", "min", "max", "n"])
    return out.withColumn("is_pk_candidate", (F.col("n_null") == 0) & (F.col("n_unique") >= 0.99 * F.col("n"))).drop("n")


def descriptive_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts, moments with sample-adjusted skewness and kurtosis, cv, range, zero/negative/unique counts."""
    q = quantile_exprs(df, {c: (value(df, c), [0.5]) for c in columns})
    parts = {c: [F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), F.max(v), q[c], F.skewness(v), F.kurtosis(v), F.sum((v == 0).cast("long")), F.sum((v < 0).cast("long")), F.count_distinct(v)] for c in columns for v in [value(df, c).cast("double")]}
    out = long_form(df, parts, ["n", "mean", "std", "min", "max", "median", "g1", "g2", "n_zero", "n_negative", "n_unique"]).withColumn("median", F.get("median", F.lit(0)))
    n = F.col("n").cast("double")
    return out.select("column", "n", "mean", "std", "min", "max", "median", (F.col("std") / F.nullif(F.abs("mean"), F.lit(0.0))).alias("cv"), (F.col("max") - F.col("min")).alias("range"), skewness_adjusted(n, F.col("g1")).alias("skewness"), kurtosis_adjusted(n, F.col("g2")).alias("kurtosis"), "n_zero", "n_negative", "n_unique")


def eda_missing(df: DataFrame) -> DataFrame:
    return long_form(df, {c: [F.sum(value(df, c).isNull().cast("long")), 100 * F.avg(value(df, c).isNull().cast("int"))] for c in df.columns}, ["n_missing", "pct_missing"]).where("n_missing > 0")


def histogram_equal_width(df: DataFrame, column: str, bins: int = 18) -> DataFrame:
    """bin, lo, hi, n; the last bin is closed on both sides."""
    v = value(df, column).cast("double")
    ends = agg_row(df, {"lo": F.min(v), "hi": F.max(v)})
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    lo, width = ends["lo"], (ends["hi"] - ends["lo"]) / bins or 1.0
    code = F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int")
    out = df.where(v.isNotNull()).groupBy(code.alias("bin")).agg(F.count("*").alias("n"))
    return out.select("bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), "n")


def missingness_row_buckets(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    from tidewell.operators.cleaning import null_fraction

    f = null_fraction(df, columns)
    bucket = F.when(f == 0, "0%").when(f <= 0.25, "1-25%").when(f <= 0.75, "26-75%").when(f < 1, "76-99%").otherwise("100%")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def null_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r between null indicators of all pairs, in one aggregate."""
    from itertools import combinations

    z = lambda c: value(df, c).isNull().cast("double")
    return long_form(df, {f"{a}|{b}": [corr(z(a), z(b))] for a, b in combinations(columns, 2)}, ["r"]).select(F.split_part("column", F.lit("|"), F.lit(1)).alias("a"), F.split_part("column", F.lit("|"), F.lit(2)).alias("b"), "r")


def missingness_mechanism(df: DataFrame, columns: list[str], others: list[str], r: float = 0.3, high: float = 0.3) -> DataFrame:
    """column, null_rate, mechanism: MAR if its null indicator correlates with another column, else MNAR_SUSPECTED or MCAR."""
    parts = {c: [F.avg(value(df, c).isNull().cast("int")), F.greatest(*[F.coalesce(F.abs(corr(value(df, c).isNull().cast("double"), value(df, o).cast("double"))), F.lit(0.0)) for o in others if o != c], F.lit(0.0))] for c in columns}
    out = long_form(df, parts, ["null_rate", "max_r"])
    return out.select("column", "null_rate", F.when(F.col("null_rate") == 0, "NONE").when(F.col("max_r") >= r, "MAR").when(F.col("null_rate") >= high, "MNAR_SUSPECTED").otherwise("MCAR").alias("mechanism"))


def duplicate_stats(df: DataFrame) -> DataFrame:
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return counts.agg(F.sum(F.col("_n") - 1).alias("n_duplicates"), F.sum("_n").alias("n_rows")).withColumn("duplicate_rate", F.col("n_duplicates") / F.col("n_rows"))


def overall_null_rate(df: DataFrame) -> DataFrame:
    return df.agg((sum((F.avg(value(df, c).isNull().cast("int")) for c in df.columns), F.lit(0.0)) / len(df.columns)).alias("null_rate"))


def quality_gate(df: DataFrame, ranges: dict[str, tuple] = {}, categories: dict[str, list] = {}, max_null: float = 0.2, max_dup: float = 0.05, fail: float = 0.5, warn: float = 0.75) -> DataFrame:
    """One row: the penalties, quality_score and status (FAILED, WARN, PASSED)."""
    bad_range = sum((F.sum(((F.col(c) < lo) | (F.col(c) > hi)).cast("long")) for c, (lo, hi) in ranges.items()), F.lit(0))
    bad_cat = sum((F.max((~F.col(c).isin(v)).cast("int")) for c, v in categories.items()), F.lit(0))
    one = overall_null_rate(df).crossJoin(duplicate_stats(df)).crossJoin(df.agg(bad_range.alias("n_range"), bad_cat.alias("n_cat")))  # one row each
    n_columns = len(df.columns)
    pen = {"null_penalty": F.least(F.lit(1.0), F.col("null_rate") / max(max_null, 0.01)), "dup_penalty": F.least(F.lit(1.0), F.col("duplicate_rate") / max(max_dup, 0.01)), "range_penalty": F.least(F.lit(1.0), F.col("n_range") / F.col("n_rows")), "cat_penalty": F.least(F.lit(1.0), F.col("n_cat") / F.lit(n_columns))}
    out = one.withColumns(pen)
    score = F.greatest(F.lit(0.0), 1 - (0.30 * F.col("null_penalty") + 0.20 * F.col("dup_penalty") + 0.20 * F.col("range_penalty") + 0.15 * F.col("cat_penalty")))
    out = out.withColumn("quality_score", score)
    return out.select(*pen, "quality_score", F.when(F.col("quality_score") < fail, "FAILED").when(F.col("quality_score") < warn, "WARN").otherwise("PASSED").alias("status"))


def quality_radar(df: DataFrame) -> DataFrame:
    """metric, score: completeness, uniqueness, consistency, validity, integrity."""
    numeric = numeric_columns(df)
    base = df.agg((1 - sum((F.avg(value(df, c).isNull().cast("int")) for c in df.columns), F.lit(0.0)) / len(df.columns)).alias("completeness"), F.least(F.lit(1.0), F.try_divide(sum((F.count_distinct(c) for c in df.columns), F.lit(0)) / len(df.columns), F.count(F.lit(1)))).alias("uniqueness"), (1 - sum((F.coalesce((F.stddev_samp(c) == 0).cast("int"), F.lit(0)) for c in numeric), F.lit(0)) / max(len(numeric), 1)).alias("consistency"))
    both = base.crossJoin(duplicate_stats(df))  # one row each
    both = both.withColumns({"validity": F.least(F.lit(1.0), F.col("completeness") * 1.1), "integrity": 1 - F.col("duplicate_rate")})
    names = ["completeness", "uniqueness", "consistency", "validity", "integrity"]
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("score")) for n in names])).alias("r")).select("r.*")


def data_health_score(df: DataFrame, n_violations: int = 0, n_drops: int = 0) -> DataFrame:
    """100 - 30 x null rate - 20 x share of dropped columns - 2 a violation (20 at most) - 10 x share of skewed columns."""
    numeric, n = numeric_columns(df), len(df.columns)
    skewed = sum((F.coalesce((F.abs(F.skewness(value(df, c))) > 2).cast("int"), F.lit(0)) for c in numeric), F.lit(0)) / n
    null = sum((F.avg(value(df, c).isNull().cast("int")) for c in df.columns), F.lit(0.0)) / n
    score = 100 - 30 * null - 20 * n_drops / n - min(2 * n_violations, 20) - 10 * skewed
    return df.agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2).alias("health"))


def group_mean_bar(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(column).alias("mean"), F.count("*").alias("n"))


def stacked_group_mean(df: DataFrame, by: str, second: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(by).pivot(second, values).agg(F.avg(column))


def monthly_trend(df: DataFrame, ts: str, column: str, by: str | None = None) -> DataFrame:
    """month, total (and ``by``); months without rows between the first and the last have total 0."""
    sums = df.groupBy(F.trunc(ts, "month").alias("month"), *([by] if by else [])).agg(F.sum(column).alias("total"))
    ends = sums.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = ends.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    if by:
        months = months.join(sums.select(by).distinct(), how="cross")  # months x categories of a chart
    return months.join(sums, ["month", *([by] if by else [])], "left").na.fill(0.0, ["total"])


def category_share(df: DataFrame, column: str, k: int = 6) -> DataFrame:
    """value, n, share of the ``k`` most frequent values; the rest as Other."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k).withColumn("top", F.col("value"))
    named = counts.join(F.broadcast(top.select("value", "top")), "value", "left").groupBy(F.coalesce("top", F.lit("Other")).alias("value")).agg(F.sum("n").alias("n"))
    return named.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))  # k + 1 rows


def category_counts(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def correlation_heatmap_data(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of all ordered pairs."""
    out = long_form(df, {f"{a}|{b}": [corr(value(df, a), value(df, b))] for a in columns for b in columns if a < b}, ["r"])
    pair = out.select(F.split_part("column", F.lit("|"), F.lit(1)).alias("a"), F.split_part("column", F.lit("|"), F.lit(2)).alias("b"), "r")
    own = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    return pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(own)


def segment_radar(df: DataFrame, by: str, metrics: list[str], k: int = 6) -> DataFrame:
    """Means of the ``k`` largest segments, min-max normalised across them."""
    top = df.groupBy(by).agg(F.count("*").alias("_n"), *[F.avg(m).alias(m) for m in metrics]).orderBy(F.desc("_n"), by).limit(k)
    all_ = W.partitionBy()  # k rows
    return top.select(by, *[F.coalesce((F.col(m) - F.min(m).over(all_)) / F.nullif(F.max(m).over(all_) - F.min(m).over(all_), F.lit(0.0)), F.lit(0.0)).alias(m) for m in metrics])


def funnel_cumulative(df: DataFrame, by: str, column: str, k: int = 8) -> DataFrame:
    """The ``k`` largest totals with their cumulative share of these totals."""
    top = df.groupBy(by).agg(F.sum(column).alias("total")).orderBy(F.desc("total"), by).limit(k)
    w = W.partitionBy().orderBy(F.desc("total"), by).rowsBetween(W.unboundedPreceding, 0)  # k rows
    return top.withColumn("cumulative_pct", 100 * F.sum("total").over(w) / F.sum("total").over(W.partitionBy()))


def range_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_form(df, {c: [F.min(value(df, c)).cast("double"), F.avg(value(df, c)), F.max(value(df, c)).cast("double")] for c in columns}, ["min", "avg", "max"])


def kpis(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """kpi, value for named aggregate expressions."""
    wide = df.agg(*[c.cast("double").alias(k) for k, c in named.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).alias("value")) for k in named])).alias("r")).select("r.*")


def risk_scoring(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds risk: the weighted sum of min-max normalised columns."""
    got = agg_row(df, {f"{k}|{c}": f(value(df, c)) for c in weights for k, f in (("lo", F.min), ("hi", F.max))})
    terms = [w * (F.col(c) - got[f"lo|{c}"]) / (got[f"hi|{c}"] - got[f"lo|{c}"]) for c, w in weights.items() if got[f"hi|{c}"] != got[f"lo|{c}"]]
    return df.withColumn("risk", sum(terms, F.lit(0.0)))


def cohort_retention(df: DataFrame, entity: str, ts: str, unit: str = "week") -> DataFrame:
    """cohort, offset, n, retention: entities by first period and periods since."""
    period = F.date_trunc(unit, ts)
    active = df.select(entity, period.alias("p")).distinct()
    firsts = active.groupBy(entity).agg(F.min("p").alias("cohort"))
    days = 7 if unit == "week" else 1
    cells = active.join(firsts, entity).groupBy("cohort", (F.datediff("p", "cohort") / days).cast("int").alias("offset")).agg(F.count("*").alias("n"))
    sizes = firsts.groupBy("cohort").agg(F.count("*").alias("size"))
    return cells.join(sizes, "cohort").select("cohort", "offset", "n", (F.col("n") / F.col("size")).alias("retention"))


def fairness_parity(df: DataFrame, group: str, positive: Column, least: int = 10) -> DataFrame:
    """group, rate, parity (rate over the overall rate), verdict: under 0.8 FAIL, under 0.9 WARN."""
    parts = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(positive.cast("int")).alias("k"))
    all_ = W.partitionBy()  # one row a group
    out = parts.withColumn("overall", F.sum("k").over(all_) / F.sum("n").over(all_)).where(F.col("n") >= least)
    out = out.withColumns({"rate": F.col("k") / F.col("n")}).withColumn("parity", F.try_divide("rate", "overall"))
    return out.select(group, "n", "rate", "parity", F.when(F.col("parity") < 0.8, "FAIL").when(F.col("parity") < 0.9, "WARN").otherwise("PASS").alias("verdict"))


def zscore_anomaly_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    got = agg_row(df, {f"{k}|{c}": f(value(df, c)) for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))})
    z = lambda c: F.abs(value(df, c) - got[f"m|{c}"]) / got[f"s|{c}"]
    none = [F.count(F.when(F.lit(False), 1)), F.lit(None).cast("double"), F.lit(None).cast("double")]  # a column without spread
    return long_form(df, {c: [F.sum((z(c) > 3).cast("long")), 100 * F.avg((z(c) > 3).cast("int")), F.max(z(c))] if got[f"s|{c}"] else none for c in columns}, ["n_anomaly", "pct", "max_z"])


def approx_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Approximate distinct counts and quartiles for wide data, from sketches that merge with those of other tables (see
    ``sketches``)."""
    return sketches.profile(sketches.sketch(df, columns)).select("column", "approx_distinct", "quartiles")
