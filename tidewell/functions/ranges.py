"""Ranges of a numeric column's values, about equal in rows."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import agg_row


def range_cuts(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """For each numeric column about as many cuts as there are shuffle partitions, from one pass."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)] or [F.lit(0.5)])
    got = agg_row(df, {c: F.percentile_approx(F.col(c).cast("double"), shares, F.lit(max(1000, 2 * parts))) for c in columns})
    return {c: sorted({x for x in got[c] or [] if math.isfinite(x)}) for c in columns}


def by_ranges(df: DataFrame, column: str, cuts: list[float], name: str = "_p") -> DataFrame:
    """Adds ``name``: the number of the range between ``cuts`` that holds a value, found by binary search; NaN comes last."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [-math.inf, *cuts, math.inf]
    found = Bucketizer(splits=splits, inputCol="_v", outputCol="_b", handleInvalid="keep").transform(df.withColumn("_v", F.col(column).cast("double")))
    return found.withColumn(name, F.col("_b").cast("int")).drop("_v", "_b")
