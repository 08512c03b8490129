"""Profiles from stored sketches: a row for each (dataset, partition, column) that merges with those of other partitions, so that a
profile or a drift check of any set of partitions reads a few kilobytes each instead of their rows.

A row holds exact counts, extremes and moments, a HyperLogLog sketch of the distinct values (all columns) and a KLL sketch of
the order (numbers).  Merged sketches have the error of one sketch over all rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewell.functions.columns import numeric_columns, value

#: log2 of the HyperLogLog's registers (standard error 1.04 / sqrt(2 ** LG_K), 1.6 %) and the KLL sketch's k (ranks are off by
#: RANK_ERROR of all rows at most, with 99 % confidence).
LG_K, KLL_K = 12, 800
RANK_ERROR = 0.006
SCHEMA = "column string, n long, nulls long, zeros long, least double, most double, mean double, m2 double, distinct_sketch binary, order_sketch binary"


def sketch(df: DataFrame, columns: list[str] | None = None, by: list[str] = ()) -> DataFrame:
    """A row of SCHEMA for each of ``columns`` (and each value of ``by``), from one pass.  NaN counts as null; text, dates and others
    have no order sketch."""
    columns, numbers = columns or [c for c in df.columns if c not in by], set(numeric_columns(df))
    made = []
    for c in columns:
        v = value(df, c)
        x = v.cast("double") if c in numbers else F.lit(None).cast("double")
        made.append([
            F.lit(c).alias("column"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(x == 0).alias("zeros"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"),
            F.hll_sketch_agg(v.cast("string"), F.lit(LG_K)).alias("distinct_sketch"), (F.kll_sketch_agg_double(x, F.lit(KLL_K)) if c in numbers else F.lit(None).cast("binary")).alias("order_sketch"),
        ])
    wide = df.groupBy(*by).agg(*[F.struct(*x).alias(f"_c{i}") for i, x in enumerate(made)])
    return wide.select(*by, F.explode(F.array(*[F.col(f"_c{i}") for i in range(len(made))])).alias("_r")).select(*by, "_r.*")


def merge(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sketch rows of several partitions as one a column (and ``by``)."""
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))
    # moments around zero would lose digits: deviations within partitions, and of their means from the common one
    means = F.collect_list(F.when(F.col("mean").isNotNull(), F.struct("n", "mean")))
    out = rows.groupBy("column", *by).agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("zeros").alias("zeros"), F.min("least").alias("least"), F.max("most").alias("most"), mean.alias("mean"), F.sum("m2").alias("_m2"), means.alias("_means"),
        F.hll_union_agg("distinct_sketch", F.lit(False)).alias("distinct_sketch"), F.kll_merge_agg_double("order_sketch").alias("order_sketch"),
    )
    between = F.aggregate("_means", F.lit(0.0), lambda a, x: a + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean")))
    return out.withColumn("m2", F.col("_m2") + between).select(*by, *[x.split()[0] for x in SCHEMA.split(", ")])


def quantile(share: float) -> Column:
    return F.when(F.col("most").isNotNull(), F.kll_sketch_get_quantile_double("order_sketch", F.lit(float(share))))


def profile(rows: DataFrame) -> DataFrame:
    """column, n, nulls, zeros, least, most, mean, std, approx_distinct and quartiles of sketch rows."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    quartiles = F.when(F.col("most").isNotNull(), F.array(*[quantile(q) for q in (0.25, 0.5, 0.75)]))
    keys = [c for c in rows.columns if c not in SCHEMA.replace(",", "").split()]
    return rows.select(*keys, "column", "n", "nulls", "zeros", "least", "most", "mean", std.alias("std"), F.hll_sketch_estimate("distinct_sketch").alias("approx_distinct"), quartiles.alias("quartiles"))


def psi(base: DataFrame, now: DataFrame, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """column, psi for each numeric column of two sets of sketch rows (one a column): over ``bins`` quantile bins of the base, with the
    shares of both sides read from the sketches, so each share is within 2 * RANK_ERROR."""
    # a column's few edges come to the driver, as ranks are looked up by constants only
    edges = F.array_distinct(F.array(*[quantile(i / bins) for i in range(1, bins)])).alias("edges")
    found = {r["column"]: r["edges"] for r in base.where("most IS NOT NULL").select("column", edges).collect()}
    if not found:
        return base.sparkSession.createDataFrame([], "column string, psi double")
    both = base.where("most IS NOT NULL").select("column", F.col("order_sketch").alias("a"))
    both = both.join(now.where("most IS NOT NULL").select("column", F.col("order_sketch").alias("b")), "column")

    def upto(side: str) -> Column:
        ranks = lambda own: F.array(F.lit(0.0), *[F.kll_sketch_get_rank_double(side, F.lit(x)) for x in own], F.lit(1.0))
        return F.coalesce(*[F.when(F.col("column") == c, ranks(own)) for c, own in found.items()])

    both = both.select("column", upto("a").alias("p"), upto("b").alias("q"))
    share = lambda ranks, i: F.greatest(F.get(ranks, i) - F.get(ranks, i - 1), F.lit(eps))
    term = lambda i: (share("q", i) - share("p", i)) * F.log(share("q", i) / share("p", i))
    return both.select("column", F.aggregate(F.transform(F.sequence(F.lit(1), F.size("p") - 1), term), F.lit(0.0), lambda a, x: a + x).alias("psi"))


class SketchStore:
    """Sketch rows below ``path``, a folder for each dataset and partition.  Adding a partition reads its rows only, and adding it
    again replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, df: DataFrame, dataset: str, partition: str, columns: list[str] | None = None) -> None:
        sketch(df, columns).write.mode("overwrite").parquet(f"{self.path}/dataset={dataset}/partition={partition}")

    def add_by(self, df: DataFrame, dataset: str, partition: Column, columns: list[str]) -> None:
        """Every partition that ``partition`` names, from one pass."""
        made = sketch(df.withColumn("partition", partition.cast("string")), columns, ["partition"])
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition").parquet(f"{self.path}/dataset={dataset}")

    def rows(self, dataset: str, partitions: Iterable[str] | None = None) -> DataFrame:
        """The stored rows of all, or the given, partitions; only their folders are read."""
        try:
            found = self.spark.read.schema(f"{SCHEMA}, partition string").parquet(f"{self.path}/dataset={dataset}")
        except AnalysisException:  # nothing stored so far
            return self.spark.createDataFrame([], f"{SCHEMA}, partition string")
        return found if partitions is None else found.where(F.col("partition").isin(list(partitions)))

    def profile(self, dataset: str, partitions: Iterable[str] | None = None) -> DataFrame:
        return profile(merge(self.rows(dataset, partitions)))

    def psi(self, dataset: str, base: Iterable[str], now: Iterable[str], bins: int = 10) -> DataFrame:
        return psi(merge(self.rows(dataset, base)), merge(self.rows(dataset, now)), bins)

