"""Exact quantiles (linear between neighbours) of columns of any size.

Spark's ``percentile`` keeps every distinct value in one aggregation buffer, so it is used only where a column has few values.
Of larger columns the order statistics on both sides of a quantile are bracketed by approximate percentiles, whose ranks are
counted exactly; brackets shrink by some thousands a turn until what lies inside them is small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import agg_row

#: The buffers of ``percentile`` in one aggregate hold at most this many values, of all its columns together.
DIRECT = 2_000_000
#: Ranks of approximate percentiles are off by n / ACCURACY at most.
ACCURACY = 10_000
#: Columns of at most about so many distinct values go through ``percentile`` however many rows they have.
FEW = 10_000


def _brackets(df: DataFrame, v: Column, n: int, qs: list[float], limit: int) -> list[float]:
    """Quantiles of a column with many values."""
    jobs = []
    for q in qs:
        at = q * (n - 1)
        jobs.append({"i": math.floor(at), "j": math.ceil(at), "part": at - math.floor(at), "lo": -math.inf, "hi": math.inf, "below": 0, "inside": n, "open": True})
    within = lambda b: F.when((v >= b["lo"]) & (v <= b["hi"]), v)
    while any(b["open"] for b in jobs):
        live = [b for b in jobs if b["open"]]
        spots = lambda b: [min(1.0, max(0.0, (b[k] - b["below"]) / max(1, b["inside"] - 1) + d)) for k, d in (("i", -2 / ACCURACY), ("j", 2 / ACCURACY))]
        got = agg_row(df, {str(x): F.percentile_approx(within(b), F.array(*map(F.lit, spots(b))), F.lit(ACCURACY)) for x, b in enumerate(live)})
        ends = [got[str(x)] for x in range(len(live))]
        count = agg_row(df, {f"{k}{x}": F.count(F.when(c, 1)) for x, (lo, hi) in enumerate(ends) for k, c in (("b", v < lo), ("u", v <= hi))})
        for x, (b, (lo, hi)) in enumerate(zip(live, ends)):
            before, below, upto = b["inside"], b["below"], b["below"] + b["inside"]
            if count[f"b{x}"] <= b["i"]:
                b["lo"], below = lo, count[f"b{x}"]
            if count[f"u{x}"] > b["j"]:
                b["hi"], upto = hi, count[f"u{x}"]
            b["below"], b["inside"] = below, upto - below
            # what no longer shrinks is held up by ties, which take one place in a buffer
            b["open"] = b["inside"] > limit and b["inside"] < before / 2 and b["lo"] < b["hi"]
    ranks = lambda b: F.array(*[F.lit(min(1.0, (b[k] - b["below"]) / max(1, b["inside"] - 1))) for k in "ij"])
    last = agg_row(df, {str(x): F.percentile(within(b), ranks(b)) for x, b in enumerate(jobs)})
    return [last[str(x)][0] + (last[str(x)][1] - last[str(x)][0]) * b["part"] for x, b in enumerate(jobs)]


def quantile_exprs(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], limit: int = DIRECT) -> dict[str, Column]:
    """For each name an array of the quantiles of its column, to be used in an aggregate of ``df``: null without values."""
    cast = {k: (v.cast("double"), qs) for k, (v, qs) in wanted.items()}
    counts = agg_row(df, {k: F.count(v) for k, (v, _) in cast.items()}) if cast else {}
    entries, large = dict(counts), [k for k in cast if counts[k] > limit]  # a buffer has one entry a distinct value
    if large and limit >= FEW:
        values = agg_row(df, {k: F.approx_count_distinct(cast[k][0]) for k in large})
        entries |= {k: 2 * n for k, n in values.items() if n <= FEW}
    out, held = {}, 0
    for k in sorted(cast, key=entries.__getitem__):
        v, qs = cast[k]
        held += entries[k]
        out[k] = F.percentile(v, F.array(*map(F.lit, qs))) if held <= limit else F.array(*map(F.lit, _brackets(df, v, counts[k], qs, limit)))
    return out


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], limit: int = DIRECT) -> dict[str, list[float] | None]:
    """For each name the quantiles of its column (without nulls), None if it has no values."""
    return agg_row(df, quantile_exprs(df, wanted, limit)) if wanted else {}
