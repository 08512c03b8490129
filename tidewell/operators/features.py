"""Feature-engineering projections.  Operators over row order take ``order`` and ``by``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.columns import agg_row, corr, numeric_columns, value
from tidewell.functions.quantiles import quantiles
from tidewell.functions.stages import evenly, stash
from tidewell.operators.halo import over_rows_before
from tidewell.operators.neighbours import nearest

#: An encoding table with at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def lookup(df: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Left equi-join to a code table keyed by ``key``; nulls match the table's null row, if it has one."""
    codes = codes.withColumnRenamed(key, "_k")
    small = codes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(codes) if small else codes, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def lag_features(df: DataFrame, column: str, lags: list[int], order: list[str], by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Values of the rows ``lags`` before; large keys, or the table without ``by``, are split by ranges of the first order column."""
    make = lambda w: {f"{column}_lag{k}": F.lag(column, k).over(w) for k in lags}
    return over_rows_before(df, order, by or [], [column], max(lags), make, ranges)


def rolling_features(df: DataFrame, column: str, window: int, stats: list[str], order: list[str], by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Statistics of the last ``window`` rows, fewer at the start; large keys are split as in :func:`lag_features`."""
    functions = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}
    make = lambda w: {f"{column}_roll{window}_{s}": functions[s](column).over(w.rowsBetween(-(window - 1), 0)) for s in stats}
    return over_rows_before(df, order, by or [], [column], window - 1, make, ranges)


def calendar_features(df: DataFrame, column: str) -> DataFrame:
    c, n = F.col(column), column
    return df.withColumns({f"{n}_year": F.year(c), f"{n}_month": F.month(c), f"{n}_day": F.dayofmonth(c), f"{n}_dayofweek": F.weekday(c), f"{n}_hour": F.hour(c), f"{n}_quarter": F.quarter(c), f"{n}_is_weekend": (F.weekday(c) >= 5).cast("int")})


def frequency_encode(df: DataFrame, column: str, max_distinct: int = 200, buckets: int = 1000) -> DataFrame:
    """Value -> relative frequency; with more than ``max_distinct`` values a hash bucket instead."""
    n = agg_row(df, {"n": F.count(column), "d": F.count_distinct(column)})
    if n["d"] > max_distinct:
        return hash_encode(df, column, buckets, f"{column}_freq")
    codes = df.where(F.col(column).isNotNull()).groupBy(column).agg((F.count("*") / F.lit(n["n"])).alias(f"{column}_freq"))
    return lookup(df, codes, column)


def target_encode(df: DataFrame, column: str, target: str, folds: int | None = None, key: str | None = None) -> DataFrame:
    """Value -> mean of the target; with ``folds`` the mean over the other folds of ``key``'s hash (no leakage)."""
    if not folds:
        return lookup(df, df.groupBy(column).agg(F.avg(target).alias(f"{column}_te")), column)
    df = df.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    part = df.groupBy(column, "_fold").agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    all_ = W.partitionBy(column)
    codes = part.select(F.col(column).alias("_k"), "_fold", ((F.sum("s").over(all_) - F.col("s")) / F.nullif(F.sum("n").over(all_) - F.col("n"), F.lit(0))).alias(f"{column}_te"))
    return df.join(codes.withColumnRenamed("_fold", "_f"), F.col(column).eqNullSafe(F.col("_k")) & (F.col("_fold") == F.col("_f")), "left").drop("_k", "_f", "_fold")


def hash_encode(df: DataFrame, column: str, buckets: int = 1000, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{column}_hash", F.pmod(F.xxhash64(column), F.lit(buckets)))


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Category -> code in sorted order.

    The distinct values are dealt out by ranges, once into the shared folder so that a range stays as it is, and numbered
    within their range; the ranges' sizes give each its start.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = stash(values.repartitionByRange(parts, column).withColumn("_p", F.spark_partition_id()), "labels")
    sizes = values.groupBy("_p").agg(F.count("*").alias("_m"))  # one row a range
    base = sizes.select("_p", F.coalesce(F.sum("_m").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    place = F.row_number().over(W.partitionBy("_p").orderBy(column)) - 1 + F.col("_base")
    return lookup(df, values.join(F.broadcast(base), "_p").select(column, place.cast("int").alias(f"{column}_code")), column)


def ordinal_encode(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Category -> its place in ``order``; -1 for others."""
    return df.withColumn(f"{column}_ord", F.when(F.col(column).isNotNull(), F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(column)) - 1, F.lit(-1))).cast("int"))


def one_hot_encode(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values})


def tfidf_vectorize(df: DataFrame, key: str, text: str, terms: int = 200) -> DataFrame:
    """key, term, weight over the ``terms`` most frequent terms: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), L2-normed by key."""
    n = df.count()
    words = evenly(df.select(key, text)).select(key, F.explode(F.expr(f"regexp_extract_all(lower({text}), '[a-z0-9_]{{2,}}', 0)")).alias("term"))
    top = words.groupBy("term").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "term").limit(terms).select("term")
    # only words that count are shuffled with their keys
    tf = stash(words.join(F.broadcast(top), "term").groupBy(key, "term").agg(F.count("*").alias("tf")), "tf")
    raw = tf.join(F.broadcast(tf.groupBy("term").agg(F.count("*").alias("df"))), "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    return raw.select(key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))).alias("weight"))


def log1p_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_log1p": F.log1p(F.greatest(value(df, c).cast("double"), F.lit(0.0))) for c in columns})


def sqrt_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_sqrt": F.sqrt(F.greatest(value(df, c).cast("double"), F.lit(0.0))) for c in columns})


def auto_log1p(df: DataFrame, columns: list[str], skew: float = 2.0) -> DataFrame:
    got = agg_row(df, {f"{k}|{c}": f(value(df, c)) for c in columns for k, f in (("g", F.skewness), ("lo", F.min))})
    hit = [c for c in columns if got[f"g|{c}"] is not None and abs(got[f"g|{c}"]) > skew and got[f"lo|{c}"] >= 0]
    return log1p_transform(df, hit) if hit else df


def yeo_johnson(df: DataFrame, column: str, grid: list[float] | None = None) -> DataFrame:
    """The transform with the lambda of greatest likelihood on a grid; all lambdas are scored in one pass."""
    grid = grid or [x / 10 for x in range(-20, 41)]
    x = value(df, column).cast("double")

    def t(lam: float):
        up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
        down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
        return F.when(x >= 0, up).otherwise(down)

    got = agg_row(df, {"n": F.count(x), "s": F.sum(F.signum(x) * F.log1p(F.abs(x)))} | {f"v{i}": F.var_pop(t(lam)) for i, lam in enumerate(grid)})
    score = lambda i: -got["n"] / 2 * math.log(got[f"v{i}"]) + (grid[i] - 1) * got["s"] if got[f"v{i}"] and got[f"v{i}"] > 0 else -math.inf
    best = max(range(len(grid)), key=score)
    return df.withColumns({f"{column}_yj": t(grid[best]), f"{column}_lambda": F.lit(grid[best])})


def polynomial_features(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    """All products of 2 .. degree of the columns."""
    from itertools import combinations_with_replacement
    from functools import reduce

    out = {}
    for d in range(2, degree + 1):
        for group in combinations_with_replacement(columns, d):
            out["*".join(group)] = reduce(lambda a, b: a * b, [F.col(c) for c in group])
    return df.withColumns(out)


def bin_quantile(df: DataFrame, column: str, bins: int = 4) -> DataFrame:
    """Quantile bins from 0, duplicate edges dropped; bins are closed on the right, the first on both sides."""
    q = quantiles(df, {"q": (value(df, column), [i / bins for i in range(bins + 1)])})["q"]
    edges = sorted(set(q))[1:-1] if q else []
    code = sum(((F.col(column) > e).cast("int") for e in edges), F.lit(0))
    return df.withColumn(f"{column}_bin", F.when(value(df, column).isNotNull(), code))


def bin_width(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    ends = agg_row(df, {"lo": F.min(value(df, column)), "hi": F.max(value(df, column))})
    lo, width = ends["lo"], ((ends["hi"] or 0) - (ends["lo"] or 0)) / bins
    code = F.least(F.floor((value(df, column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)) if width else F.when(value(df, column).isNotNull(), 0)
    return df.withColumn(f"{column}_bin", code.cast("int"))


def interaction_features(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def zscore_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    got = agg_row(df, {f"{k}|{c}": f(value(df, c)) for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))})
    return df.withColumns({f"{c}_zscore": (F.col(c) - got[f"m|{c}"]) / got[f"s|{c}"] if got[f"s|{c}"] else F.lit(0.0) for c in columns})


def minmax_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    got = agg_row(df, {f"{k}|{c}": f(value(df, c)) for c in columns for k, f in (("lo", F.min), ("hi", F.max))})
    return df.withColumns({f"{c}_minmax": (F.col(c) - got[f"lo|{c}"]) / (got[f"hi|{c}"] - got[f"lo|{c}"]) if got[f"hi|{c}"] != got[f"lo|{c}"] else F.lit(0.0) for c in columns})


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    got = quantiles(df, {c: (value(df, c), [0.25, 0.5, 0.75]) for c in columns})
    return df.withColumns({f"{c}_robust": (F.col(c) - q[1]) / (q[2] - q[0]) if q and q[2] != q[0] else F.lit(0.0) for c, q in got.items()})


def synthesize_features(df: DataFrame, columns: list[str] | None = None, min_r: float = 0.05, limit: int = 50) -> DataFrame:
    """Ratio and product columns of pairs with |r| >= ``min_r``, strongest first, ``limit`` columns in all."""
    from itertools import combinations

    own = columns or numeric_columns(df)
    r = agg_row(df, {f"{a}|{b}": corr(value(df, a), value(df, b)) for a, b in combinations(own, 2)})
    ranked = sorted(((abs(v), k) for k, v in r.items() if v is not None and abs(v) >= min_r), key=lambda x: (-x[0], x[1]))
    out = {}
    for _, k in ranked[: limit // 2]:
        a, b = k.split("|")
        out[f"{a}_div_{b}"] = F.col(a) / (F.col(b) + F.lit(1e-8))
        out[f"{a}_mul_{b}"] = F.col(a) * F.col(b)
    return df.withColumns(out) if out else df


def class_balance_resample(df: DataFrame, target: str, key: str, method: str = "oversample", limit: float = 5.0, seed: int = 7) -> DataFrame:
    """With majority/minority of at least ``limit`` (2-20 classes): oversample repeats rows up to the majority, undersample
    keeps a hash share of each class about the size of the minority."""
    # at most 21 classes come to the driver
    sizes = {r[target]: r["n"] for r in df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n")).orderBy(target).limit(21).collect()}
    if not 2 <= len(sizes) <= 20 or max(sizes.values()) / min(sizes.values()) < limit:
        return df
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_003)) / 1_000_003
    if method == "undersample":
        least = min(sizes.values())
        return df.where(F.coalesce(*[F.when(F.col(target) == c, u < least / n) for c, n in sizes.items()], F.lit(True)))
    most = max(sizes.values())
    times = F.lit(1)
    for c, n in sizes.items():
        times = F.when(F.col(target) == c, F.lit(most // n) + (u < (most % n) / n).cast("int")).otherwise(times)
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")


def smote(df: DataFrame, target: str, minority, columns: list[str], key: str, k: int = 5, seed: int = 7) -> DataFrame:
    """Synthetic minority rows, one for each minority row without gaps: key, target, columns at a random point between the row
    and one of its ``k`` nearest minority vectors by standardised distance, drawn by hash of ``key``.

    Neighbours are exact (see :func:`neighbours.nearest`); equal vectors are one neighbour, so a class with a single vector
    gives copies of it.
    """
    rows = df.where(F.col(target) == minority).select(key, target, *[value(df, c).cast("double").alias(c) for c in columns]).na.drop("any", subset=columns)
    spread = agg_row(rows, {c: F.stddev_pop(c) for c in columns})
    rows = rows.withColumn("_q", F.array(*columns))
    vectors = rows.select("_q", F.col("_q").alias("s")).distinct()
    donors = vectors.select(F.lit(0).alias("mask"), F.col("_q").alias("x"), F.lit(1).cast("long").alias("n"), "s")
    near = nearest(vectors.select(F.lit(0).alias("mask"), F.col("_q").alias("q")), donors, k + 1, [1 / (spread[c] or 1.0) ** 2 for c in columns])
    # entries at one distance are means of their vectors: n of them share it
    others = F.filter("near", lambda x: x["d2"] > 0)
    codes = near.select(F.col("q").alias("_v"), others.alias("_near"))
    u = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(key)), F.lit(1 << 30)) / (1 << 30)
    out = rows.join(codes, F.col("_q") == F.col("_v"), "left").withColumns({"_u": u("way"), "_pick": F.get("_near", F.floor(u("pick") * F.size("_near")).cast("int"))})
    to = lambda i: F.get("_pick.s", F.lit(i)) / F.col("_pick.n")
    return out.select(key, target, *[(F.col(c) + F.col("_u") * F.coalesce(to(i) - F.col(c), F.lit(0.0))).alias(c) for i, c in enumerate(columns)])


def feature_select_topk(importance: DataFrame, k: int) -> DataFrame:
    """The ``k`` features of greatest importance from (feature, importance)."""
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def ml_pipeline(numeric: list[str], categorical: list[str], text: str | None = None):
    """An unfitted Spark ML pipeline: impute and scale, index and one-hot, hash text; output column ``features``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, IDF, Imputer, OneHotEncoder, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler

    stages = [Imputer(inputCols=numeric, outputCols=[f"{c}_imp" for c in numeric], strategy="median"), VectorAssembler(inputCols=[f"{c}_imp" for c in numeric], outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
    parts = ["_scaled"]
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}_idx" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_hot" for c in categorical])]
        parts += [f"{c}_hot" for c in categorical]
    if text:
        stages += [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=256), IDF(inputCol="_tf", outputCol="_tfidf")]
        parts.append("_tfidf")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])
