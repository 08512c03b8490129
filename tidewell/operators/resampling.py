"""Bootstrap intervals and permutation tests: one pass over the rows for all replicates.

Every task adds up each replicate's sums over its rows in Arrow batches, so a task gives one row a replicate however many
rows it has, and only as many numbers as there are replicates reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import agg_row, corr, value
from tidewell.functions.stages import evenly

REPLICATES = 5000
#: Rows are permuted within random blocks of about this many.  Under the null hypothesis rows are exchangeable in any block that
#: is drawn without looking at them, so the test stays exact, and no replicate needs a shuffle of its own.
BLOCK_ROWS = 4096
#: Numbers in a matrix of replicates x rows.
CELLS = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson_sums(batches: Iterable, reps: int, seed: int):
    import pyarrow as pa

    # P(weight > k) for k = 0, 1, ... of Poisson(1), as thresholds of a 32-bit number
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    edges = np.minimum(edges * 2**32, 2**32 - 1).astype(np.uint32)
    salts = _mix(np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    sums = np.zeros((reps, 2))
    for batch in batches:
        h, x = batch.column("h").to_numpy().view(np.uint64), batch.column("x").to_numpy()
        for a in range(0, len(x), 4096):
            rows = np.column_stack([x[a : a + 4096], np.ones(len(x[a : a + 4096]))])
            step = max(1, CELLS // len(rows))
            for at in range(0, reps, step):
                u = (_mix(h[None, a : a + 4096] ^ salts[at : at + step, None]) >> np.uint64(32)).astype(np.uint32)
                weight = np.zeros(u.shape, np.float32)
                for e in edges:
                    weight += u >= e
                sums[at : at + step] += weight @ rows
    yield pa.RecordBatch.from_pydict({"rep": np.arange(reps, dtype=np.int32), "sx": sums[:, 0], "sw": sums[:, 1]})


def _hashed(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.select(F.xxhash64(key).alias("h"), value(df, column).cast("double").alias("x")).where("x IS NOT NULL")


def bootstrap_ci(df: DataFrame, column: str, key: str, reps: int = REPLICATES, level: float = 0.95, seed: int = 7, method: str = "percentile") -> DataFrame:
    """mean, lo, hi: interval of the mean by a Poisson bootstrap, whose weights are drawn by hash of ``key``, so it is repeatable.

    ``method`` is percentile, or bca (bias-corrected and accelerated; the jackknife of a mean has a closed form).  Nulls and NaN
    are left out; without values all three are null.
    """
    if method not in ("percentile", "bca"):
        raise ValueError(f"unknown method {method}")
    rows = _hashed(df, column, key)
    g = agg_row(rows, {"m": F.avg("x"), "n": F.count("x"), "skew": F.skewness("x")})
    schema = "mean double, lo double, hi double"
    if not g["n"]:
        return df.sparkSession.createDataFrame([(None, None, None)], schema)
    drawn = evenly(rows).mapInArrow(lambda b: _poisson_sums(b, reps, seed), "rep int, sx double, sw double")
    # reps rows
    means = np.array([r["sx"] / r["sw"] for r in drawn.groupBy("rep").agg(F.sum("sx").alias("sx"), F.sum("sw").alias("sw")).collect() if r["sw"]])
    ends = [(1 - level) / 2, (1 + level) / 2]
    if method == "bca":
        normal = NormalDist()
        share = min(max(float(np.mean(means < g["m"])), 0.5 / len(means)), 1 - 0.5 / len(means))
        bias, lift = normal.inv_cdf(share), (0.0 if g["skew"] is None or math.isnan(g["skew"]) else g["skew"]) / (6 * math.sqrt(g["n"]))
        ends = [normal.cdf(bias + (bias + normal.inv_cdf(q)) / (1 - lift * (bias + normal.inv_cdf(q)))) for q in ends]
    lo, hi = np.quantile(means, ends).tolist()
    return df.sparkSession.createDataFrame([(g["m"], lo, hi)], schema)


def _permuted_sums(batches: Iterable, reps: int, seed: int, groups: int):
    """Sums of permuted x by group (or of x times y, where ``groups`` is 0), one row a replicate."""
    import pyarrow as pa

    sums = np.zeros((reps, max(1, groups)))
    held: list = []

    def add(block: int, x: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        codes, starts = np.unique(y, return_index=True)
        step = max(1, CELLS // len(x))
        for at in range(0, reps, step):
            rng = np.random.default_rng((seed, block, at))
            mixed = rng.permuted(np.tile(x, (min(step, reps - at), 1)), axis=1)
            if groups:
                sums[at : at + step, codes.astype(int)] += np.add.reduceat(mixed, starts, axis=1)
            else:
                sums[at : at + step, 0] += mixed @ y

    def flush(last: bool) -> None:
        block, x, y = (np.concatenate(c) for c in zip(*held))
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() + [len(block)]
        whole = len(cuts) - 1 if last else len(cuts) - 2
        for a, b in zip(cuts[:whole], cuts[1:]):
            add(int(block[a]), x[a:b], y[a:b])
        held[:] = [(block[cuts[whole] :], x[cuts[whole] :], y[cuts[whole] :])] if not last else []

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("block").to_numpy(), batch.column("x").to_numpy(), batch.column("y").to_numpy()))
            flush(False)
    if held:
        flush(True)
    yield pa.RecordBatch.from_pydict({"rep": np.arange(reps, dtype=np.int32), "sums": list(sums)}, schema=pa.schema([("rep", pa.int32()), ("sums", pa.list_(pa.float64()))]))


def _permute(rows: DataFrame, n: int, reps: int, seed: int, groups: int) -> np.ndarray:
    """reps x groups sums over ``rows`` (h, x, y) with x permuted in each replicate."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(-(-n // BLOCK_ROWS))).alias("block")
    dealt = rows.select(block, "h", "x", "y").repartition(parts, "block").sortWithinPartitions("block", "h", "x", "y").select("block", "x", "y")
    done = dealt.mapInArrow(lambda b: _permuted_sums(b, reps, seed, groups), "rep int, sums array<double>")
    k = max(1, groups)
    got = done.groupBy("rep").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(k)]).orderBy("rep").collect()  # reps rows
    return np.array([[r[f"s{i}"] for i in range(k)] for r in got])


def _two_columns(df: DataFrame, x: Column, y: Column, key: str) -> DataFrame:
    return df.select(F.xxhash64(key).alias("h"), x.cast("double").alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def _p_value(null: np.ndarray, observed: float) -> float:
    return (1 + int(np.sum(null >= observed * (1 - 1e-12) - 1e-300))) / (1 + len(null))


def permutation_groups(df: DataFrame, column: str, group: str, key: str, statistic: Callable[[np.ndarray, np.ndarray], np.ndarray], reps: int = REPLICATES, seed: int = 7) -> tuple[float, float] | None:
    """(observed, p) of any statistic of the groups' sums: ``statistic(sums, counts)`` takes sums of shape (replicates, groups)
    in the order of the groups' names and gives one number a replicate; greater is more extreme."""
    rows = _two_columns(df, value(df, column), F.col(group).cast("string"), key)
    # one row a group
    found = rows.groupBy("y").agg(F.count("*").alias("n"), F.sum("x").alias("s")).orderBy("y").collect()
    if len(found) < 2:
        return None
    counts, sums = np.array([r["n"] for r in found], float), np.array([[r["s"] for r in found]])
    coded = rows.withColumn("y", (F.array_position(F.array(*[F.lit(r["y"]) for r in found]), F.col("y")) - 1).cast("double"))
    observed = float(statistic(sums, counts)[0])
    return observed, _p_value(statistic(_permute(coded, int(counts.sum()), reps, seed, len(found)), counts), observed)


def permutation_test(df: DataFrame, column: str, group: str, a: str, b: str, key: str, reps: int = REPLICATES, seed: int = 7) -> DataFrame:
    """diff, p: two-sided test of the difference of two groups' means; both null where a group has no values."""
    diff = lambda s, n: s[:, 0] / n[0] - s[:, 1] / n[1]
    rows = df.where(F.col(group).isin(a, b))
    got = permutation_groups(rows, column, group, key, lambda s, n: np.abs(diff(s, n)), reps, seed)
    if not got:
        return df.sparkSession.createDataFrame([(None, None)], "diff double, p double")
    v = value(rows, column)
    m = agg_row(rows, {"a": F.avg(F.when(F.col(group) == a, v)), "b": F.avg(F.when(F.col(group) == b, v))})
    return df.sparkSession.createDataFrame([(m["a"] - m["b"], got[1])], "diff double, p double")


def permutation_anova(df: DataFrame, column: str, group: str, key: str, reps: int = REPLICATES, seed: int = 7) -> DataFrame:
    """f, p of a one-way ANOVA; the total of squares is the same in every replicate, so F follows from the groups' sums."""
    total = agg_row(df.where(F.col(group).isNotNull()), {"q": F.var_pop(value(df, column)) * F.count(value(df, column)), "n": F.count(value(df, column))})
    schema = "f double, p double"
    if not total["n"]:
        return df.sparkSession.createDataFrame([(None, None)], schema)

    def f(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        between = (sums**2 / counts).sum(axis=1) - sums.sum(axis=1) ** 2 / counts.sum()
        within = np.maximum(total["q"] - between, 1e-300)
        return between / (len(counts) - 1) / (within / (counts.sum() - len(counts)))

    got = permutation_groups(df, column, group, key, f, reps, seed)
    return df.sparkSession.createDataFrame([got or (None, None)], schema)


def permutation_correlation(df: DataFrame, x: str, y: str, key: str, reps: int = REPLICATES, seed: int = 7) -> DataFrame:
    """r, p: two-sided test of Pearson's correlation, with x permuted against y."""
    rows = _two_columns(df, value(df, x), value(df, y).cast("double"), key)
    g = agg_row(rows, {"n": F.count("*"), "mx": F.avg("x"), "my": F.avg("y"), "sx": F.stddev_pop("x"), "sy": F.stddev_pop("y"), "r": corr(F.col("x"), F.col("y"))})
    if not g["n"] or not g["sx"] or not g["sy"]:
        return df.sparkSession.createDataFrame([(None, None)], "r double, p double")
    centred = rows.select("h", (F.col("x") - g["mx"]).alias("x"), (F.col("y") - g["my"]).alias("y"))
    null = np.abs(_permute(centred, g["n"], reps, seed, 0)[:, 0]) / (g["n"] * g["sx"] * g["sy"])
    return df.sparkSession.createDataFrame([(g["r"], _p_value(null, abs(g["r"])))], "r double, p double")
