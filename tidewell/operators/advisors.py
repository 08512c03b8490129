"""Advisors: suggestions from a one-row-a-column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import agg_row, long_form, numeric_columns, skewness_adjusted, string_columns, value
from tidewell.functions.quantiles import quantiles


def suggest_encoding(df: DataFrame) -> DataFrame:
    """column, encoding: one_hot, ordinal or target by cardinality."""
    out = long_form(df, {c: [F.count_distinct(c), F.try_divide(F.count_distinct(c), F.count("*"))] for c in string_columns(df)}, ["d", "ratio"])
    kind = F.when((F.col("d") <= 10) & (F.col("ratio") <= 0.1), "one_hot").when((F.col("d") <= 100) & (F.col("ratio") <= 0.5), "ordinal").otherwise("target")
    return out.select("column", kind.alias("encoding"))


def suggest_transform(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, suggestions: log1p, standard_scale, robust_scale, bucketize."""
    own = columns or numeric_columns(df)
    got = quantiles(df, {c: (value(df, c), [0.25, 0.75]) for c in own})
    parts = {}
    for c in own:
        v, q = value(df, c).cast("double"), got[c] or [0, 0]
        iqr = q[1] - q[0]
        out = F.avg(((v < q[0] - 1.5 * iqr) | (v > q[1] + 1.5 * iqr)).cast("int")) if iqr > 0 else F.lit(0.0)
        parts[c] = [F.count(v), F.min(v), F.max(v), F.stddev_samp(v), F.skewness(v), out, F.try_divide(F.count_distinct(v), F.count(v))]
    p = long_form(df, parts, ["n", "min", "max", "std", "g1", "outliers", "unique"])
    skew = skewness_adjusted(F.col("n").cast("double"), F.col("g1"))
    s = F.array_compact(F.array(F.when((F.col("min") >= 0) & (skew > 1), "log1p"), F.when((F.col("std") > 0) & (F.col("max") - F.col("min") > 10 * F.col("std")), "standard_scale"), F.when(F.col("outliers") > 0.03, "robust_scale"), F.when((F.col("unique") > 0.1) & (F.col("unique") < 0.5), "bucketize")))
    return p.where("n >= 10").select("column", F.array_join(s, ",").alias("suggestions")).where("suggestions <> ''")


def suggest_aggregations(df: DataFrame, limit: float = 0.05) -> DataFrame:
    """key, metric: columns of low cardinality with every numeric column that is no key."""
    ratios = agg_row(df, {c: F.try_divide(F.count_distinct(c), F.count("*")) for c in df.columns})
    keys = sorted(c for c, r in ratios.items() if r is not None and r <= limit) or df.columns[:3]
    rows = [(k, m) for k in keys for m in numeric_columns(df) if m not in keys]
    return df.sparkSession.createDataFrame(rows, "key string, metric string")


def suggest_features(df: DataFrame) -> DataFrame:
    """column, feature, priority."""
    numeric = numeric_columns(df)
    p = long_form(df, {c: [F.avg(value(df, c).isNull().cast("int")), F.count_distinct(c), F.count("*"), F.skewness(value(df, c)) if c in numeric else F.lit(None).cast("double"), F.lit(c in numeric)] for c in df.columns}, ["null_rate", "d", "n", "skew", "numeric"])
    ideas = [F.when(F.col("numeric") & (F.abs("skew") > 1), F.struct(F.lit("log").alias("feature"), F.lit(1).alias("priority"))), F.when(F.col("null_rate") > 0.05, F.struct(F.lit("null_flag").alias("feature"), F.lit(2).alias("priority"))), F.when(~F.col("numeric") & (F.col("d") <= 10), F.struct(F.lit("one_hot").alias("feature"), F.lit(2).alias("priority"))), F.when(~F.col("numeric") & (F.col("d") > 10) & (F.col("d") < 0.5 * F.col("n")), F.struct(F.lit("target").alias("feature"), F.lit(3).alias("priority"))), F.when(~F.col("numeric") & (F.col("d") >= 0.5 * F.col("n")), F.struct(F.lit("hash").alias("feature"), F.lit(4).alias("priority"))), F.when(F.col("numeric") & (F.col("d") > 20), F.struct(F.lit("bin").alias("feature"), F.lit(5).alias("priority")))]
    return p.select("column", F.explode(F.array_compact(F.array(*ideas))).alias("i")).select("column", "i.*").dropDuplicates(["column", "feature"]).orderBy("priority", "column")


def rank_insights(insights: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """The ``k`` insights of greatest weighted score."""
    score = sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return insights.withColumn("score", score).orderBy(F.desc("score"), "insight").limit(k)


def score_proposals(df: DataFrame) -> DataFrame:
    """Adds confidence by the weighted heuristic, clipped to 0.05-0.99."""
    raw = 0.5 + 0.1 * F.col("drifted").cast("int") + 0.2 * (F.col("quality_score") - 0.5) - 0.3 * F.col("null_rate") + F.least(F.col("sample_size") / 1e6, F.lit(0.1)) + 0.2 * (F.col("cv_score") - 0.5) - 0.05 * F.col("flag_severity_max")
    return df.withColumn("confidence", F.greatest(F.lit(0.05), F.least(F.lit(0.99), raw)))


def route_proposals(signals: DataFrame) -> DataFrame:
    """column, operation, priority from joined signals (null_rate, psi, pct_iqr, skewness, unique_ratio)."""
    op = lambda c, n, p: F.when(c, F.struct(F.lit(n).alias("operation"), F.lit(p).alias("priority")))
    ops = [op(F.col("null_rate") > 0.9, "drop_column", 1), op((F.col("null_rate") > 0.05) & (F.col("null_rate") <= 0.9), "impute", 2), op(F.col("psi") >= 0.2, "retrain", 1), op(F.col("pct_iqr") > 0.03, "cap_outliers", 3), op(F.abs("skewness") > 2, "log1p", 4), op(F.col("unique_ratio") > 0.99, "exclude_id", 2)]
    return signals.select("column", F.explode(F.array_compact(F.array(*ops))).alias("o")).select("column", "o.*").orderBy("priority", "column", "operation")


def retry_strategy(df: DataFrame) -> tuple[DataFrame, str]:
    """The clean-up that the profile calls for, and its name."""
    from tidewell.operators import cleaning as C
    from tidewell.operators.aggregates import duplicate_stats

    rates = {c: r or 0.0 for c, r in C.null_rates(df).items()}
    if max(rates.values()) > 0.3:
        return C.drop_high_null_columns(df, 0.3), "drop_high_null"
    if max(rates.values()) > 0:
        numeric = set(numeric_columns(df))
        return C.impute_simple(df, {c: "median" if c in numeric else "mode" for c, r in rates.items() if r}), "impute_median"
    if (duplicate_stats(df).first()["duplicate_rate"] or 0) > 0:
        return C.drop_duplicates(df), "aggressive_clean"
    return C.cap_outliers(df, numeric_columns(df)), "outlier_clip"


def name_tokens(names: DataFrame, column: str = "column") -> DataFrame:
    """``names`` with tokens: camelCase split, separators removed, lower-cased."""
    spaced = F.regexp_replace(F.regexp_replace(column, "([a-z0-9])([A-Z])", "$1 $2"), r"[^0-9A-Za-z]+", " ")
    return names.withColumn("tokens", F.array_remove(F.split(F.lower(F.trim(spaced)), " +"), ""))


# Name tokens of dataset domains.
DOMAIN_TOKENS = {"retail": ["order", "customer", "price", "part", "supplier", "ship", "discount", "quantity"], "banking": ["account", "loan", "balance", "acctbal"], "web": ["url", "html", "event", "user", "session"], "text": ["text", "lang", "doc"]}


def dataset_domain(columns: DataFrame) -> DataFrame:
    """table, domain, n_hits from (table, column): the domain most of whose tokens occur within the table's column names."""
    words = columns.sparkSession.createDataFrame([(d, t) for d, ts in DOMAIN_TOKENS.items() for t in ts], "domain string, word string")
    hits = columns.join(F.broadcast(words), F.contains(F.lower("column"), F.col("word"))).groupBy("table", "domain").agg(F.count_distinct("word").alias("n_hits"))
    return hits.groupBy("table").agg(F.min_by(F.struct("domain", "n_hits"), F.struct(-F.col("n_hits"), F.col("domain"))).alias("b")).select("table", "b.*")


def analyst_semantic_types(df: DataFrame) -> DataFrame:
    """column, kind, advice: a coarse type from one profile pass, with what to do about it."""
    numeric = set(numeric_columns(df))
    parts = {c: [F.avg(value(df, c).isNull().cast("int")), F.count_distinct(c), F.count(c), F.skewness(value(df, c)) if c in numeric else F.lit(None).cast("double"), F.avg(F.length(F.col(c).cast("string"))), F.lit(c in numeric), F.lit(dict(df.dtypes)[c].startswith(("timestamp", "date")))] for c in df.columns}
    p = long_form(df, parts, ["null_rate", "d", "n", "skew", "length", "numeric", "temporal"])
    kind = F.when(F.col("d") <= 1, "constant").when(F.col("temporal"), "datetime").when((F.col("d") == F.col("n")) & ((~F.col("numeric")) | (F.col("length") < 12)) & (F.col("length") < 40), "identifier").when(F.col("d") == 2, "binary").when(F.col("numeric") & (F.col("d") <= 20), "discrete").when(F.col("numeric"), "continuous").when(F.col("d") <= 50, "category").when(F.col("length") > 40, "text").otherwise("high_cardinality")
    advice = F.when(F.col("null_rate") > 0.9, "drop").when(F.col("kind").isin("constant", "identifier"), "drop").when(F.col("null_rate") > 0, "impute").when(F.abs("skew") > 2, "log1p").when(F.col("kind") == "category", "one_hot").otherwise("keep")
    return p.withColumn("kind", kind).select("column", "kind", advice.alias("advice"))
