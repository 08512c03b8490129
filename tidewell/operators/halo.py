"""Ordered windows within keys of any size: a key's rows are split into ranges of their order, and what a window needs of the rows
before a range travels along as a few extra rows, so that no task holds more than a range of a key.

Rows with one value in the first order column always lie in one range.  Tables whose keys all have at most HOT_ROWS rows
are not split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.columns import agg_row
from tidewell.functions.ranges import by_ranges

#: A key with more rows is split into ranges of about so many rows (of all keys together), up to MAX_RANGES of them.  So is a key
#: with more than LEAST_ROWS rows and more than a core's share of all, into ranges of such a share: it would leave cores idle.
HOT_ROWS, MAX_RANGES, LEAST_ROWS = 2_000_000, 10_000, 100_000


def as_number(df: DataFrame, column: str) -> Column | None:
    """A number in the column's order; None for columns that have no such number."""
    kind = dict(df.dtypes)[column]
    if kind.startswith(("date", "timestamp")):
        return F.col(column).cast("timestamp").cast("double")
    return F.col(column).cast("double") if kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else None


def split(df: DataFrame, order: str, by: list[str], ranges: int | None = None, apart: float = 0.0) -> tuple[DataFrame, list[float]]:
    """``df`` with its range ``_p`` and the cuts between ranges, which (if ``apart`` is given) are whole and at least that far apart;
    no cuts if no key needs them.  ``ranges`` asks for so many.  Nulls come first, in range -1, NaN comes last."""
    at = as_number(df, order)
    if ranges is None and at is not None:
        sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
        got = agg_row(sizes, {"most": F.max("_n"), "all": F.sum("_n")})
        fair = min(HOT_ROWS, max(LEAST_ROWS, (got["all"] or 0) // df.sparkSession.sparkContext.defaultParallelism))
        ranges = min(MAX_RANGES, math.ceil(got["all"] / fair)) if (got["most"] or 0) > fair else 1
    cuts: list[float] = []
    if at is not None and ranges > 1:
        shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
        found = agg_row(df, {"cuts": F.percentile_approx(at, shares, F.lit(max(1000, 2 * ranges)))})["cuts"]
        for x in sorted({math.floor(x) * 1.0 if apart else x for x in found or [] if math.isfinite(x)}):
            if not cuts or x - cuts[-1] >= apart:
                cuts.append(x)
    if not cuts:
        return df.withColumn("_p", F.lit(0)), []
    df = by_ranges(df.withColumn("_at", at), "_at", cuts)
    return df.withColumn("_p", F.when(F.col("_at").isNull(), -1).otherwise(F.col("_p"))).drop("_at"), cuts


def rows_before(df: DataFrame, order: list[str], by: list[str], columns: list[str], n: int) -> DataFrame:
    """``df`` (with ``_p``) and, marked by ``_halo``, the last ``n`` rows of the key before each range, with ``order`` and ``columns``.

    Each range gives its last rows; those before a range lie in the n ranges before it, as none is empty.
    """
    keys, names = [*by, "_p"], list(dict.fromkeys([*order, *columns]))
    last = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    tails = df.select(*keys, F.struct(*[c for c in names]).alias("_r"), last.alias("_k")).where(F.col("_k") <= n)
    ends = tails.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "_r")), asc=False).alias("_rows"))  # oldest first
    earlier = F.flatten(F.collect_list("_rows").over(W.partitionBy(*by).orderBy("_p").rowsBetween(-n, -1)))  # one row a range
    carried = ends.select(*keys, earlier.alias("_all")).select(*keys, F.explode(F.slice("_all", F.greatest(F.size("_all") - n, F.lit(0)) + 1, F.lit(n))).alias("_x"))
    halo = carried.select(*keys, *[F.col(f"_x._r.{c}").alias(c) for c in names if c not in keys], F.lit(True).alias("_halo"))
    return df.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)


def over_rows_before(df: DataFrame, order: list[str], by: list[str], columns: list[str], n: int, make, ranges: int | None = None) -> DataFrame:
    """``df`` with the columns that ``make(window)`` returns, by name, for an ordered window whose functions look at most ``n`` rows
    back and use ``columns`` only."""
    parts, cuts = split(df, order[0], by, ranges)
    if not cuts:
        return df.withColumns(make(W.partitionBy(*by).orderBy(*order)))
    wide = rows_before(parts, order, by, columns, n)
    out = wide.withColumns(make(W.partitionBy(*by, "_p").orderBy(*order)))
    return out.where(~F.col("_halo")).drop("_halo", "_p")


def over_seconds_before(df: DataFrame, ts: str, seconds: int, by: list[str], make, ranges: int | None = None) -> DataFrame:
    """``df`` with the columns of ``make(window)`` for a window over the rows of the last ``seconds`` (whole seconds of ``ts``).

    Ranges are at least ``seconds`` long, so what a range needs lies in the one before it; rows near a range's end go to the
    next one, too.  A task holds a range and one frame.
    """
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    frame = lambda *keys: W.partitionBy(*keys).orderBy(at).rangeBetween(-seconds, 0)
    parts, cuts = split(df, ts, by, ranges, apart=float(seconds + 1))
    if not cuts:
        return df.withColumns(make(frame(*by)))
    following = F.try_element_at(F.array(*[F.lit(x) for x in cuts]), F.col("_p") + 1)  # where the next range begins
    late = parts.where((F.col("_p") >= 0) & (F.col("_p") < len(cuts))).where(at >= F.floor(following) - seconds)
    late = late.withColumn("_p", F.col("_p") + 1).withColumn("_halo", F.lit(True))
    out = parts.withColumn("_halo", F.lit(False)).unionByName(late).withColumns(make(frame(*by, "_p")))
    return out.where(~F.col("_halo")).drop("_halo", "_p")


def running_sum(df: DataFrame, value: str, order: list[str], by: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the key's rows up to each row: every range starts from one row with the sum of those
    before it."""
    parts, cuts = split(df, order[0], by, ranges)
    if not cuts:
        return df.withColumn(name, F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    sums = parts.groupBy(*by, "_p").agg(F.sum(value).alias("_s"))
    base = F.sum("_s").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))  # one row a range
    start = sums.select(*by, "_p", base.alias(value), F.lit(True).alias("_halo")).where(F.col(value).isNotNull())
    wide = parts.withColumn("_halo", F.lit(False)).unionByName(start, allowMissingColumns=True)
    upto = F.sum(value).over(W.partitionBy(*by, "_p").orderBy(F.desc("_halo"), *order).rowsBetween(W.unboundedPreceding, 0))
    return wide.withColumn(name, upto).where(~F.col("_halo")).drop("_halo", "_p")
