"""Exact nearest neighbours by joins down a tree of cells.

Donor vectors are laid on a grid that is refined level by level.  A query holds the cells that may contain one of its nearest
donors: each level joins them with their children, takes the distance within which the children are sure to hold ``k``
donors, and drops the children that lie beyond it.  Once few distinct vectors are left they are compared one by one.  Dense
regions are refined further and empty ones dropped early, so neither a far outlier nor a crowded cell meets all donors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import agg_row
from tidewell.functions.stages import stash

#: Bits by which each dimension is divided in all.
GRID_BITS = 20
#: A query's cells are opened when they hold no more distinct vectors than this, or can't be refined.
LEAF = 256


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _reach(cells: Column, k: int) -> Column:
    """The least distance within which ``cells`` (structs with far, n) are sure to hold ``k`` donors; null if they hold fewer."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("far"))
    step = lambda a, x: F.struct((a["n"] + x["n"]).cast("long").alias("n"), F.when((a["n"] < k) & (a["n"] + x["n"] >= k), x["far"]).otherwise(a["far"]).alias("far"))
    return F.aggregate(F.array_sort(cells), state, step, lambda a: a["far"])


def _nearest_of(near: Column, k: int) -> Column:
    """The entries of a sorted array of (d2, n, s) up to the one that completes ``k``."""
    counts = F.transform(near, lambda x: x["n"])
    return F.filter(near, lambda x, i: F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0).cast("long"), lambda a, n: a + n) < k)


def nearest(queries: DataFrame, donors: DataFrame, k: int, weights: list[float]) -> DataFrame:
    """mask, q, near: for each distinct query (mask, q) its nearest donors (mask, x, n, s) of the same mask.

    q and x are arrays of doubles, one a weight; d2 is the weighted sum of squared differences.  n counts the donors with this vector and s carries their sums.  ``near`` holds
    (d2, n, s), one entry a distance from the nearest on, until at least ``k`` donors are in; equal distances are one entry, so
    ties don't depend on the order of rows.  Queries whose mask has fewer donors get all of them, or no row without any.
    """
    dims = len(weights)
    bits, scale = max(1, 6 // dims), F.array(*[F.lit(float(w)) for w in weights])
    levels = -(-GRID_BITS // bits)
    got = agg_row(donors, {f"{f.__name__}{i}": f(F.col("x")[i]) for i in range(dims) for f in (F.min, F.max)})
    if got["min0"] is None:
        return queries.select("mask", "q", F.lit(None).cast("array<struct<d2:double,n:bigint,s:array<double>>>").alias("near")).where("false")
    span = [(got[f"max{i}"] - got[f"min{i}"]) or 1.0 for i in range(dims)]
    code = F.array(*[F.least(F.floor((F.col("x")[i] - got[f"min{i}"]) / span[i] * (1 << GRID_BITS)), F.lit((1 << GRID_BITS) - 1)).cast("int") for i in range(dims)])
    donors = stash(donors.select("mask", "x", "n", "s", code.alias("code")), "donors")
    at = lambda level: F.transform("code", lambda c: F.shiftright(c, max(0, GRID_BITS - level * bits)))
    # distances of a query to a cell's bounding box: the nearest and the farthest point
    near2 = lambda c: _total(F.transform("q", lambda v, i: F.get(scale, i) * F.pow(F.greatest(F.get(c["lo"], i) - v, v - F.get(c["hi"], i), F.lit(0.0)), 2.0)))
    far2 = lambda c: _total(F.transform("q", lambda v, i: F.get(scale, i) * F.pow(F.greatest(F.abs(v - F.get(c["lo"], i)), F.abs(v - F.get(c["hi"], i))), 2.0)))
    open_, done = queries.select("mask", "q", F.array(*[F.lit(0)] * dims).alias("cell")), []
    for level in range(1, levels + 1):
        cells = donors.groupBy("mask", at(level - 1).alias("cell"), at(level).alias("child")).agg(F.sum("n").alias("n"), F.count("*").alias("vectors"), F.array(*[F.min(F.col("x")[i]) for i in range(dims)]).alias("lo"), F.array(*[F.max(F.col("x")[i]) for i in range(dims)]).alias("hi"))
        # 2 ** (bits * dims) children at most
        kids = cells.groupBy("mask", "cell").agg(F.collect_list(F.struct("child", "n", "vectors", "lo", "hi")).alias("kids"))
        met = open_.join(F.broadcast(kids) if level == 1 else kids, ["mask", "cell"])  # the first level has one row a mask
        boxes = F.transform("kids", lambda c: F.struct(far2(c).alias("far"), c["n"].alias("n"), near2(c).alias("near"), c["vectors"].alias("vectors"), c["child"].alias("cell")))
        # a query's cells at one level: those within its reach
        seen = met.select("mask", "q", boxes.alias("boxes")).groupBy("mask", "q").agg(F.flatten(F.collect_list("boxes")).alias("boxes"))
        seen = seen.withColumn("reach", _reach(F.col("boxes"), k))
        # rounding must not lose a cell that touches the reach
        kept = seen.select("mask", "q", F.filter("boxes", lambda c: F.col("reach").isNull() | (c["near"] <= F.col("reach") * (1 + 1e-9))).alias("boxes"))
        kept = stash(kept.select("mask", "q", F.transform("boxes", lambda c: c["cell"]).alias("cells"), F.aggregate("boxes", F.lit(0).cast("long"), lambda a, c: a + c["vectors"]).alias("vectors")), "cells")
        small = F.lit(True) if level == levels else F.col("vectors") <= LEAF
        leaves = kept.where(small).select("mask", "q", F.explode("cells").alias("cell"))
        found = leaves.join(donors.select("mask", at(level).alias("cell"), "x", "n", "s"), ["mask", "cell"])
        d2 = _total(F.zip_with(scale, F.zip_with("q", "x", lambda a, b: (a - b) * (a - b)), lambda w, d: w * d))
        by_distance = found.select("mask", "q", d2.alias("d2"), "n", "s").groupBy("mask", "q", "d2")
        merged = by_distance.agg(F.sum("n").alias("n"), F.collect_list("s").alias("parts"))
        sums = F.aggregate("parts", F.transform(F.col("parts")[0], lambda v: v * 0.0), lambda a, p: F.zip_with(a, p, lambda v, w: v + w))
        near = merged.select("mask", "q", F.struct("d2", "n", sums.alias("s")).alias("e")).groupBy("mask", "q").agg(F.array_sort(F.collect_list("e")).alias("near"))
        done.append(stash(near.select("mask", "q", _nearest_of(F.col("near"), k).alias("near")), "nearest"))
        if level == levels:
            break
        open_ = kept.where(~small).select("mask", "q", F.explode("cells").alias("cell"))
        if open_.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
