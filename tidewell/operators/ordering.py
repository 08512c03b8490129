"""Window functions, sorting, top-k, sampling, splits and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.columns import agg_row, ratio
from tidewell.functions.ranges import by_ranges, range_cuts
from tidewell.operators.halo import over_rows_before, over_seconds_before, running_sum


def percent_change(df: DataFrame, column: str, order: list[str], by: list[str], ranges: int | None = None) -> DataFrame:
    """Adds the change against the row before, as a share of it (infinite or NaN if that is 0).  Here and below ``ranges`` asks for a split of keys into so many
    ranges; without it large keys are split (see ``halo``)."""
    def make(w):
        before = F.lag(column).over(w)
        return {f"{column}_pct_change": ratio(F.col(column) - before, before)}

    return over_rows_before(df, order, by, [column], 1, make, ranges)


def windowed_aggregation(df: DataFrame, column: str, ts: str, seconds: int, by: list[str], ranges: int | None = None) -> DataFrame:
    """Mean and count over the rows of the last ``seconds`` up to each row's time."""
    return over_seconds_before(df, ts, seconds, by, lambda w: {f"{column}_mean": F.avg(column).over(w), f"{column}_n": F.count(column).over(w)}, ranges)


def dense_ranks(df: DataFrame, column: str, cuts: list[float], name: str = "rank") -> DataFrame:
    """Distinct non-null values of a numeric column with their places from 0, numbered range by range."""
    values = by_ranges(df.where(F.col(column).isNotNull()).select(column).distinct(), column, cuts)
    sums = values.groupBy("_p").agg(F.count("*").alias("_m"))
    base = sums.select("_p", F.coalesce(F.sum("_m").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row a range
    place = F.row_number().over(W.partitionBy("_p").orderBy(column)) - 1 + F.col("_base")
    return values.join(F.broadcast(base), "_p").select(column, place.alias(name))


def average_ranks(df: DataFrame, column: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Distinct values with their count and average rank: (by, column, n, rank).  A row counts as ``weight`` rows, if given.

    Ranks come from running counts over distinct values, dealt out by value ranges: each range's rows are summed first, so no
    task sees more than one range of distinct values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    counts = by_ranges(counts, column, range_cuts(counts, [column])[column])
    sums = counts.groupBy(*by, "_p").agg(F.sum("n").alias("_m"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_m").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    base = base.toDF(*[f"_k{i}" for i in range(len(by))], "_q", "_base")
    same = reduce(lambda a, i: a & F.col(by[i]).eqNullSafe(F.col(f"_k{i}")), range(len(by)), F.col("_p") == F.col("_q"))
    out = counts.join(base if by else F.broadcast(base), same)  # one row a range (and group)
    upto = F.sum("n").over(W.partitionBy(*by, "_p").orderBy(column).rowsBetween(W.unboundedPreceding, 0)) + F.col("_base")
    return out.select(*by, column, "n", (upto - (F.col("n") - 1) / 2).alias("rank"))


def group_medians(df: DataFrame, column: str, by: list[str], weight: str | None = None) -> DataFrame:
    """by, median of each group (null groups too), from ranks over distinct values: no group's values meet in one buffer."""
    ranks = average_ranks(df.select(*by, F.col(column), *([weight] if weight else [])), column, by, weight)
    sizes = ranks.groupBy(*by).agg(F.sum("n").alias("_n")).toDF(*[f"_k{i}" for i in range(len(by))], "_n")
    same = reduce(lambda a, i: a & F.col(by[i]).eqNullSafe(F.col(f"_k{i}")), range(len(by)), F.lit(True))
    first, last = F.col("rank") - (F.col("n") - 1) / 2, F.col("rank") + (F.col("n") - 1) / 2
    at = lambda r: F.max(F.when((first <= r) & (r <= last), F.col(column).cast("double")))
    middle = (F.col("_n") + 1) / 2
    ends = ranks.join(sizes, same).groupBy(*by).agg(at(F.floor(middle)).alias("_a"), at(F.ceil(middle)).alias("_b"))
    return ends.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def rank_average(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """``df`` with the average rank of ``column``; nulls have none."""
    ranks = average_ranks(df, column).select(F.col(column).alias("_v"), F.col("rank").alias(name))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def percent_rank_values(df: DataFrame, column: str) -> DataFrame:
    n = agg_row(df, {"n": F.count(column)})["n"]
    return rank_average(df, column, "_r").withColumn(f"{column}_pct_rank", F.col("_r") / n).drop("_r")


def gaps_before(df: DataFrame, ts: str, by: list[str], ranges: int | None = None) -> DataFrame:
    """Adds gap: seconds since the row before within ``by``; null for the first one."""
    at = F.col(ts).cast("timestamp").cast("double")
    return over_rows_before(df, [ts], by, [], 1, lambda w: {"gap": at - F.lag(at).over(w)}, ranges)


def interarrival_stats(df: DataFrame, ts: str, by: list[str], ranges: int | None = None) -> DataFrame:
    gaps = gaps_before(df.select(*by, ts), ts, by, ranges).select(*by, "gap").where("gap IS NOT NULL")
    middles = group_medians(gaps, "gap", by).toDF(*[f"_m{i}" for i in range(len(by))], "median_gap")
    same = reduce(lambda a, i: a & F.col(by[i]).eqNullSafe(F.col(f"_m{i}")), range(len(by)), F.lit(True))
    return gaps.groupBy(*by).agg(F.count("*").alias("n"), F.max("gap").alias("max_gap")).join(middles, same).select(*by, "n", "median_gap", "max_gap")


def session_breaks(df: DataFrame, ts: str, by: list[str], gap: int, ranges: int | None = None) -> DataFrame:
    """Adds session: a new one starts where more than ``gap`` seconds have passed within ``by``."""
    at = F.col(ts).cast("timestamp").cast("double")
    out = over_rows_before(df, [ts], by, [], 1, lambda w: {"_new": F.coalesce((at - F.lag(at).over(w) > gap).cast("int"), F.lit(0)).cast("long")}, ranges)
    return running_sum(out, "_new", [ts], by, "session", ranges).drop("_new")


def cumulative_share(df: DataFrame, column: str, order: list[str], by: list[str]) -> DataFrame:
    w = W.partitionBy(*by)
    upto = F.sum(column).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(f"{column}_share", upto / F.sum(column).over(w))


def row_bucketing(df: DataFrame, size: int, order: list[str], by: list[str], ranges: int | None = None) -> DataFrame:
    out = running_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", order, by, "_n", ranges)
    return out.withColumn("bucket", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_one", "_n")


def topk_rows(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def topk_by_group(df: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def page_rows(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def sample_rows(df: DataFrame, key: str, fraction: float, salt: str = "sample") -> DataFrame:
    """A repeatable sample: the rows whose key's md5 falls under the fraction."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.where(h < int(fraction * (1 << 32)))


def train_val_holdout_split(df: DataFrame, key: str, val: float = 0.2, holdout: float = 0.2, salt: str = "split") -> DataFrame:
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    edge = lambda x: F.lit(int(x * (1 << 32)))
    return df.withColumn("split", F.when(h < edge(holdout), "holdout").when(h < edge(holdout + val), "val").otherwise("train"))


def temporal_splits(df: DataFrame, ts: str, folds: int, sliding: bool = False) -> DataFrame:
    """fold, role, row: expanding (or sliding) training periods, each followed by its test period of equal length in time."""
    ends = agg_row(df, {"lo": F.min(F.unix_micros(F.col(ts).cast("timestamp"))), "hi": F.max(F.unix_micros(F.col(ts).cast("timestamp")))})
    if ends["lo"] is None:
        return df.withColumns({"fold": F.lit(0), "role": F.lit("")}).where("false")
    step = (ends["hi"] - ends["lo"]) // (folds + 1) + 1
    part = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - ends["lo"]) / step)
    train = F.array(part + 1) if sliding else F.sequence(part + 1, F.lit(folds).cast("long"))
    roles = F.concat(F.transform(F.when(part + 1 <= folds, train).otherwise(F.array().cast("array<bigint>")), lambda f: F.struct(f.cast("int").alias("fold"), F.lit("train").alias("role"))), F.when(part >= 1, F.array(F.struct(part.cast("int").alias("fold"), F.lit("test").alias("role")))).otherwise(F.array().cast("array<struct<fold:int,role:string>>")))
    return df.withColumn("_x", F.explode(roles)).select("*", "_x.fold", "_x.role").drop("_x")


def stratified_kfold(df: DataFrame, target: str, key: str, k: int, salt: str = "fold") -> DataFrame:
    """Adds fold: classes are dealt evenly.  Rows of a class are numbered in hash buckets, so no class is one task's sort."""
    h = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    rows = df.withColumns({"_h": h, "_b": F.substring(h, 1, 2)})
    sizes = rows.groupBy(target, "_b").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy(target).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col(target).alias("_t"), F.col("_b").alias("_c"), "_base")
    out = rows.join(base, F.col(target).eqNullSafe(F.col("_t")) & (F.col("_b") == F.col("_c")))
    place = F.row_number().over(W.partitionBy("_t", "_c").orderBy("_h")) - 1 + F.col("_base")
    return out.withColumn("fold", F.pmod(place, F.lit(k)).cast("int")).drop("_h", "_b", "_t", "_c", "_base")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def new_categories(current: DataFrame, baseline: DataFrame, column: str) -> DataFrame:
    return current.select(column).subtract(baseline.select(column))


def missing_categories(current: DataFrame, baseline: DataFrame, column: str) -> DataFrame:
    return baseline.select(column).subtract(current.select(column))


def names(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")


def shared_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    return names(a).intersect(names(b))


def gained_lost_features(now: DataFrame, before: DataFrame) -> DataFrame:
    return names(now).subtract(names(before)).withColumn("change", F.lit("gained")).unionByName(names(before).subtract(names(now)).withColumn("change", F.lit("lost")))


def conflict_resolution(violations: DataFrame, strategy: str = "strictest_wins", priority: list[str] = ()) -> DataFrame:
    """For each column the violations of greatest severity (or of the first domain in ``priority``); advisory_only makes all
    of them warnings."""
    if strategy == "advisory_only":
        return violations.withColumn("severity", F.lit("WARNING"))
    order = F.array_position(F.array(*map(F.lit, ["CRITICAL", "ERROR", "WARNING"])), F.col("severity"))
    if strategy == "domain_priority":
        at = F.array_position(F.array(*map(F.lit, priority)), F.col("domain"))
        order = F.when(at == 0, len(priority) + 1).otherwise(at)
    return violations.withColumn("_r", F.rank().over(W.partitionBy("column").orderBy(order))).where("_r = 1").drop("_r")
