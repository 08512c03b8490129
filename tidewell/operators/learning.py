"""Models on Spark ML, their evaluation and calibration, and an isolation forest as a Spark job."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.columns import agg_row, long_form, numeric_columns, share, string_columns, value
from tidewell.functions.quantiles import quantiles
from tidewell.functions.stages import OBJECTS, evenly, stash


def anomaly_score(df: DataFrame, columns: list[str], key: str, trees: int = 100, size: int = 256, contamination: float = 0.05, seed: int = 7) -> DataFrame:
    """key, score, is_anomaly by an isolation forest.

    Every tree is grown in its own task from ``size`` rows drawn by hash; the forest (trees x size nodes at most) is sent to the
    tasks, which score all rows in Arrow batches.
    """
    rows = evenly(df.select(key, *[value(df, c).cast("double").alias(c) for c in columns])).na.drop("any")
    n = rows.count()
    if not n:
        return rows.select(key, F.lit(0.0).alias("score"), F.lit(False).alias("is_anomaly"))
    share = min(1.0, 2.0 * size / n)
    draws = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))) if share == 1.0 else rows.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))).alias("tree"))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        rng = np.random.default_rng(seed + tree)
        x = part.sort_values(key)[columns].to_numpy()
        x = x[rng.permutation(len(x))[:size]]
        nodes, depth = [], math.ceil(math.log2(max(2, len(x))))

        def build(rows_: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append(None)
            spread = np.ptp(rows_, axis=0) if len(rows_) else np.zeros(len(columns))
            if level >= depth or len(rows_) <= 1 or not spread.any():
                nodes[at] = (-1, 0.0, -1, -1, len(rows_), level)
                return at
            c = int(rng.choice(np.flatnonzero(spread)))
            cut = float(rng.uniform(rows_[:, c].min(), rows_[:, c].max()))
            left = build(rows_[rows_[:, c] <= cut], level + 1)
            nodes[at] = (c, cut, left, build(rows_[rows_[:, c] > cut], level + 1), len(rows_), level)
            return at

        build(x, 0)
        out = pd.DataFrame(nodes, columns=["c", "cut", "left", "right", "n", "level"])
        out.insert(0, "node", range(len(nodes)))
        out.insert(0, "tree", tree)
        return out

    forest = draws.groupBy("tree").applyInPandas(grow, "tree int, node int, c int, cut double, left int, right int, n int, level int").toPandas()  # trees x 2 size rows
    packed = [t.sort_values("node")[["c", "cut", "left", "right", "n", "level"]].to_numpy() for _, t in forest.groupby("tree")]
    norm = lambda m: 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else float(m == 2)
    scale = norm(min(size, n)) or 1.0

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_numpy())
        total = np.zeros(len(x))
        for t in packed:
            at = np.zeros(len(x), np.int64)
            while True:
                c = t[at, 0].astype(np.int64)
                inner = c >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(c, 0)] <= t[at, 1]
                at = np.where(inner, np.where(go, t[at, 2], t[at, 3]).astype(np.int64), at)
            total += t[at, 5] + np.array([norm(int(m)) for m in t[at, 4]])
        return pd.Series(2 ** (-total / len(packed) / scale))

    scored = stash(rows.select(key, score(F.array(*columns)).alias("score")), "scores")  # scored once, for the cut and for the result
    cut = scored.agg(F.percentile_approx("score", 1 - contamination)).first()[0]
    return scored.withColumn("is_anomaly", F.col("score") > cut)


def robust_z(df: DataFrame, column: str) -> DataFrame:
    """Adds robust_z: 0.6745 (x - median) / MAD."""
    m = (quantiles(df, {"m": (value(df, column), [0.5])})["m"] or [None])[0]
    mad = (quantiles(df, {"d": (F.abs(value(df, column) - m), [0.5])})["d"] or [None])[0] if m is not None else None
    return df.withColumn("robust_z", 0.6745 * (F.col(column) - m) / mad if mad else F.lit(0.0))


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip").transform(df)


#: A k-means fit takes so many rounds at most, and ends when no centre moves by more than TOLERANCE (of standardised features).
ROUNDS, TOLERANCE = 20, 1e-4


def kmeans_clusters(df: DataFrame, features: list[str], ks: list[int] = (2, 3, 4, 5)) -> DataFrame:
    """cluster, size for the k of best silhouette (of squared distances), on standardised features of the rows that have all.

    All k are fitted side by side, so a pass over the points serves every one.  Where rows repeat, equal ones are one point with their
    count.  Centres start by k-means++: the next one is drawn in proportion to the squared distance from those so far, by a race of
    exponential times whose randomness is a hash of the point.
    """
    names = [f"x{i}" for i in range(len(features))]
    rows = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(x) for c, x in zip(features, names)]).dropna()
    parts = {"n": F.count("*"), "different": F.approx_count_distinct(F.xxhash64(*names))}
    got = agg_row(rows, parts | {f"{k}_{x}": f(x) for k, f in (("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max)) for x in names})
    # a silhouette needs two clusters: points that are all alike have one
    if all(got[f"lo_{x}"] == got[f"hi_{x}"] for x in names):
        return df.sparkSession.createDataFrame([(0, got["n"])] if got["n"] else [], "cluster int, size long")
    if got["n"] >= 2 * got["different"]:
        rows = rows.groupBy(*names).agg(F.count("*").alias("n"))
    else:
        rows = rows.withColumn("n", F.lit(1))
    scaled = [((F.col(x) - got[f"m_{x}"]) * (1 / got[f"s_{x}"] if got[f"s_{x}"] else 0.0)).alias(x) for x in names]
    cores = df.sparkSession.sparkContext.defaultParallelism
    points = stash(packed(rows.select(*scaled, F.col("n").cast("double").alias("n"))).repartition(max(cores, -(-got["n"] // OBJECTS))), "points")
    first = starts(points, len(names), max(ks))
    centres = lloyd(points, {k: first[:k] for k in ks})
    sizes, scores = silhouettes(points, centres)
    best = max(ks, key=lambda k: scores[k])
    return df.sparkSession.createDataFrame([(j, int(round(n))) for j, n in enumerate(sizes[best]) if n], "cluster int, size long")


def packed(points: DataFrame) -> DataFrame:
    """data: the columns of some thousand rows each, one after the other, as doubles."""
    import pyarrow as pa

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).tobytes()], pa.binary())], ["data"])

    return points.mapInArrow(pack, "data binary")


def _totals(points: DataFrame, width: int, make, size: int) -> np.ndarray:
    """The sum of the ``size`` numbers ``make(x, n)`` over all blocks, with the points x as ``width`` rows and their counts n."""
    import pyarrow as pa

    def part(batches):
        total = np.zeros(size)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                block = np.frombuffer(data).reshape(width + 1, -1)
                total += make(block[:-1], block[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for r in points.mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # no more rows than numbers
        out[r["i"]] = r["v"]
    return out


def _uniform(x: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each point, by a hash of its coordinates."""
    h = np.full(x.shape[1], salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for own in x:
        h = (h ^ (own + 0.0).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return ((h >> np.uint64(11)) + 0.5) / (1 << 53)


def starts(points: DataFrame, width: int, k: int) -> np.ndarray:
    """The first ``k`` centres (fewer if fewer points differ), one pass each; those of a smaller k are the first of them."""
    import pyarrow as pa

    found = np.zeros((0, width))
    while len(found) < k:

        def race(batches, found=found):
            best = (math.inf, [0.0] * width)
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    block = np.frombuffer(data).reshape(width + 1, -1)
                    x, pull = block[:-1], block[-1]
                    if len(found):
                        pull = pull * np.min([((x - c[:, None]) ** 2).sum(axis=0) for c in found], axis=0)
                    with np.errstate(divide="ignore"):
                        times = -np.log(_uniform(x, len(found) + 1)) / pull
                    i = int(np.argmin(times))
                    best = min(best, (float(times[i]), x[:, i].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.list_(pa.float64()))], ["time", "x"])

        won = points.mapInArrow(race, "time double, x array<double>").agg(F.min(F.struct("time", "x")).alias("w")).first()["w"]
        if not math.isfinite(won["time"]):
            break
        found = np.vstack([found, won["x"]])
    return found


def _labels(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[:, None] - 2 * (centres @ x), axis=0)


def _by_cluster(labels: np.ndarray, k: int, weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.bincount(labels, w, k) for w in weights])


def lloyd(points: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The centres of each k after Lloyd's rounds; a cluster that lost all points keeps its centre."""
    centres, going = dict(centres), list(centres)
    for _ in range(ROUNDS):
        if not going:
            break
        now, width = [centres[k] for k in going], centres[going[0]].shape[1]

        def make(x, n, now=now):
            weights = [n, *(n * x)]
            return np.concatenate([_by_cluster(_labels(x, c), len(c), weights) for c in now])

        sums, at = _totals(points, width, make, sum(len(c) * (width + 1) for c in now)), 0
        for k, c in zip(list(going), now):
            own = sums[at : at + len(c) * (width + 1)].reshape(width + 1, -1)
            at += own.size
            centres[k] = np.where(own[0] > 0, own[1:] / np.maximum(own[0], 1), c.T).T
            if (((centres[k] - c) ** 2).sum(axis=1) <= TOLERANCE**2).all():
                going.remove(k)
    return centres


def silhouettes(points: DataFrame, centres: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """For each k the clusters' sizes, and the mean over all rows of (b - a) / max(a, b), with the mean squared distances a to the others
    of the own cluster and b to the nearest other cluster's; 0 for a row that is alone."""
    width = next(iter(centres.values())).shape[1]

    def stats(x, n):
        weights = [n, n * (x * x).sum(axis=0), *(n * x)]
        return np.concatenate([_by_cluster(_labels(x, c), len(c), weights) for c in centres.values()])

    sums, at, own = _totals(points, width, stats, sum(len(c) * (width + 2) for c in centres.values())), 0, {}
    for k, c in centres.items():
        own[k] = sums[at : at + len(c) * (width + 2)].reshape(width + 2, -1)
        at += own[k].size

    def score(x, n):
        out, norm = [], (x * x).sum(axis=0)
        for k, c in centres.items():
            size, rows = own[k][0], np.arange(x.shape[1])
            some = np.maximum(size, 1)
            far = np.maximum(norm + (own[k][1] / some)[:, None] - 2 * ((own[k][2:] / some).T @ x), 0.0)
            far[size == 0] = np.inf
            mine = _labels(x, c)
            a = far[mine, rows] * size[mine] / np.maximum(size[mine] - 1, 1)
            far[mine, rows] = np.inf
            b = far.min(axis=0)
            most = np.maximum(a, b)
            usable = (size[mine] > 1) & (most > 0) & np.isfinite(most)
            out.append(n[usable] @ ((b - a)[usable] / most[usable]))
        return np.array(out)

    found = _totals(points, width, score, len(centres))
    return {k: own[k][0] for k in centres}, {k: found[i] / own[k][0].sum() for i, k in enumerate(centres)}


#: Bins of a feature that trees choose their cuts from, as by default in Spark.
TREE_BINS = 32


def tree_cuts(df: DataFrame, columns: list[str], bins: int = TREE_BINS) -> dict[str, list[float]]:
    """At most ``bins`` - 1 ascending cuts a column, as Spark's trees choose them, but from all rows: between all values of a column
    of few, else at the quantiles."""
    many, cuts = agg_row(df, {c: F.approx_count_distinct(c) for c in columns}), {}
    for c in columns:
        values = sorted(r[0] for r in df.select(c).distinct().limit(bins + 1).collect()) if many[c] <= 2 * bins else []
        if 0 < len(values) <= bins:
            cuts[c] = [(x + y) / 2 for x, y in zip(values, values[1:])]
    wide = [c for c in columns if c not in cuts]
    found = agg_row(df, {c: F.percentile_approx(c, [k / bins for k in range(1, bins)], 10_000) for c in wide}) if wide else {}
    return cuts | {c: sorted(set(found[c] or [])) for c in wide}


def tree_cells(rows: DataFrame, keys: list[str], columns: list[str], cuts: dict[str, list[float]]) -> DataFrame:
    """keys, columns, n: one row for the n ``rows`` of equal keys with ``columns`` between the same cuts, whose numbers stand for them.

    A tree that cuts at these places can't tell the rows of a cell apart, so it grows from cells with their counts as from the rows.
    """
    from pyspark.ml.feature import Bucketizer

    names = [f"_b{i}" for i in range(len(columns))]
    edges = [[-math.inf, *(cuts[c] or [0.0]), math.inf] for c in columns]
    # as plain integers: the discretised columns are marked as nominal, and trees would cut them into any sets of bins
    binned = Bucketizer(splitsArray=edges, inputCols=columns, outputCols=names).transform(rows).select(*keys, *[F.col(b).cast("int").alias(c) for b, c in zip(names, columns)])
    return binned.groupBy(*keys, *columns).agg(F.count("*").cast("double").alias("n"))


def with_draws(cells: DataFrame, trees: int, seed: int = 7) -> DataFrame:
    """``cells`` with w0, w1, ...: how often the bootstrap sample of each tree holds a row of the cell.

    Sampling with replacement counts a row by Poisson's law of mean 1, and so the n rows of a cell by that of mean n.  Draws are
    seeded by the cell's hash, so they are repeatable.
    """

    @F.pandas_udf("array<double>")
    def draw(n: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, k & ((1 << 63) - 1)]).poisson(m, trees).astype(float) for m, k in zip(n, h)])

    drawn = cells.withColumn("_w", draw("n", F.xxhash64(*[c for c in cells.columns if c != "n"])))
    return drawn.select(*cells.columns, *[F.col("_w")[t].alias(f"w{t}") for t in range(trees)])


def automl_train(df: DataFrame, target: str, features: list[str], key: str, classification: bool = True, folds: int = 5, trees: int = 20) -> DataFrame:
    """model, val, holdout, gap, cv_mean, cv_std, gate: a race of boosted trees, forest and linear model on a 60/20/20 hash split.

    The training part is cut into ``folds`` by hash for cross-validation.  The gate asks for the least score, a gap between
    validation and holdout of at most 3 % and a deviation over the folds of at most 5 %.  Without two
    target values in every part there is nothing to fit: all scores are null.

    Trees see no more of a feature than its bin.  Where rows are many times the cells of bins that they fall into, trees are fitted
    to and judged on counted cells, whose number stops growing with the rows.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    from tidewell.operators.ordering import train_val_holdout_split

    names = [f"x{i}" for i in range(len(features))]
    rows = train_val_holdout_split(assemble(evenly(df.select(key, target, *features), OBJECTS).na.drop("any"), features).withColumn(target, F.col(target).cast("double")), key)
    fold_of = F.when(F.col("split") == "train", F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(folds)))
    rows = rows.select("features", *[F.col(c).cast("double").alias(x) for c, x in zip(features, names)], target, "split", fold_of.alias("fold"), F.lit(1.0).alias("n")).persist()
    if classification:
        models = {"gbt": GBTClassifier(labelCol=target, maxIter=10, seed=7), "forest": RandomForestClassifier(labelCol=target, numTrees=trees, seed=7), "linear": LogisticRegression(labelCol=target)}
        judge, least = BinaryClassificationEvaluator(labelCol=target, weightCol="n"), 0.55
    else:
        models = {"gbt": GBTRegressor(labelCol=target, maxIter=10, seed=7), "forest": RandomForestRegressor(labelCol=target, numTrees=trees, seed=7), "linear": LinearRegression(labelCol=target)}
        judge, least = RegressionEvaluator(labelCol=target, metricName="r2", weightCol="n"), 0.10
    schema = "model string, val double, holdout double, gap double, cv_mean double, cv_std double, gate boolean"
    parts = {r["split"]: r for r in rows.groupBy("split").agg(F.count_distinct(target).alias("d"), F.count("*").alias("rows")).collect()}  # three rows
    if len(parts) < 3 or min(r["d"] for r in parts.values()) < (2 if classification else 1) or parts["train"]["d"] < 2:
        rows.unpersist()
        return df.sparkSession.createDataFrame([(name, None, None, None, None, None, False) for name in models], schema)

    cells = stash(tree_cells(rows, [target, "split", "fold"], names, tree_cuts(rows.where("split = 'train'"), names)), "cells")
    size = cells.count()
    # a forest over cells fits its trees one at a time, so cells are read that many times as often as rows would be
    grouped = size * trees <= sum(r["rows"] for r in parts.values())
    few, held = -(-size // OBJECTS), [rows]

    def kept(cells: DataFrame) -> DataFrame:
        held.append(assemble(cells.coalesce(few), names).drop(*names).persist())
        return held[-1]

    def without(fold: int) -> DataFrame:
        """The training cells but those of a fold, added up."""
        return kept(drawn.where(F.col("fold") != fold).groupBy(target, *names).agg(*[F.sum(c).alias(c) for c in ["n", *(f"w{t}" for t in range(trees))]]))

    if grouped:
        drawn = stash(with_draws(cells.where("split = 'train'").drop("split"), trees), "draws")
        fitted_to, judged_on = {f: without(f) for f in range(-1, folds)}, kept(cells)
        # Spark looks for cuts in a sample of as many rows as the square of maxBins: here, in all cells
        bins = max(TREE_BINS, math.isqrt(size) + 1)

    def grown(fold: int):
        """A function that adds the predictions of a forest, each tree fitted to its own draws of the cells."""
        one = models["forest"].copy({models["forest"].maxBins: bins})
        one.setNumTrees(1).setBootstrap(False).setFeatureSubsetStrategy("sqrt" if classification else "onethird")
        fits = [one.copy({one.seed: 7 + t, one.weightCol: f"w{t}"}).fit(fitted_to[fold]) for t in range(trees)]

        def predict(to: DataFrame) -> DataFrame:
            for t, tree in enumerate(fits):
                if classification:
                    tree.setProbabilityCol(f"_p{t}").setRawPredictionCol("")
                to = tree.setPredictionCol("" if classification else f"_p{t}").transform(to)
            votes = [vector_to_array(f"_p{t}")[1] if classification else F.col(f"_p{t}") for t in range(trees)]
            return to.withColumn("rawPrediction" if classification else "prediction", reduce(Column.__add__, votes) / trees)

        return predict

    def one(job: tuple[str, int]) -> list[float]:
        """Scores of a model on validation and holdout, or on a fold that it was not fitted on."""
        name, fold = job
        on_cells = grouped and name != "linear"
        table = judged_on if on_cells else rows
        train = table.where("split = 'train'")
        if on_cells:
            predict = grown(fold) if name == "forest" else models[name].copy({models[name].maxBins: bins, models[name].weightCol: "n"}).fit(fitted_to[fold]).transform
        else:
            predict = models[name].fit(train if fold < 0 else train.where(F.col("fold") != fold)).transform
        return [float(judge.evaluate(predict(part))) for part in ([table.where(f"split = '{s}'") for s in ("val", "holdout")] if fold < 0 else [train.where(F.col("fold") == fold)])]

    jobs = [(name, fold) for fold in range(-1, folds) for name in ("forest", "gbt", "linear")] if grouped else [(name, fold) for name in models for fold in range(-1, folds)]
    with ThreadPoolExecutor(8 if grouped else 4) as pool:  # small fits leave most of a cluster idle, so some run at a time
        done = dict(zip(jobs, pool.map(one, jobs)))
    for table in held:
        table.unpersist()
    out = []
    for name in models:
        (val, hold), cv = done[name, -1], np.array([done[name, f][0] for f in range(folds)])
        spread = float(cv.std())
        out.append((name, val, hold, abs(val - hold), float(cv.mean()), spread, bool(hold >= least and abs(val - hold) <= 0.03 and spread <= 0.05)))
    return df.sparkSession.createDataFrame(out, schema).orderBy(F.desc("val"))


def evaluate_classification(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """auc (by rank sums), accuracy, weighted_f1."""
    from tidewell.operators.ordering import rank_average

    g = agg_row(rank_average(df.select(label, score), score), {"r": F.sum(F.when(F.col(label) == 1, F.col("rank"))), "p": F.count(F.when(F.col(label) == 1, 1)), "n": F.count(F.when(F.col(label) == 0, 1))})
    auc = (g["r"] - g["p"] * (g["p"] + 1) / 2) / (g["p"] * g["n"]) if g["p"] and g["n"] else None
    hit = F.col(score) >= threshold
    c = agg_row(df, {"tp": F.sum((hit & (F.col(label) == 1)).cast("long")), "fp": F.sum((hit & (F.col(label) == 0)).cast("long")), "fn": F.sum((~hit & (F.col(label) == 1)).cast("long")), "tn": F.sum((~hit & (F.col(label) == 0)).cast("long"))})
    f1 = lambda tp, fp, fn: 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    total = sum(x or 0 for x in c.values())
    if not total:
        return df.sparkSession.createDataFrame([(None, None, None)], "auc double, accuracy double, weighted_f1 double")
    weighted = (f1(c["tp"], c["fp"], c["fn"]) * (c["tp"] + c["fn"]) + f1(c["tn"], c["fn"], c["fp"]) * (c["tn"] + c["fp"])) / total
    return df.sparkSession.createDataFrame([(None if auc is None else float(auc), (c["tp"] + c["tn"]) / total, weighted)], "auc double, accuracy double, weighted_f1 double")


def evaluate_regression(df: DataFrame, label: str, prediction: str) -> DataFrame:
    e = F.col(label) - F.col(prediction)
    return df.agg((1 - F.try_divide(F.sum(e * e), F.var_pop(label) * F.count(label))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def ece(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    parts = df.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(label).alias("y"))
    return parts.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.agg(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))


def calibrate_platt(df: DataFrame, label: str, score: str) -> DataFrame:
    """``df`` with calibrated: a logistic curve fitted to the score; rows without a score are left out."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    rows = assemble(df.withColumn("_y", F.col(label).cast("double")), [score], "_s")
    if rows.where("_y IS NOT NULL").isEmpty():
        return rows.withColumn("calibrated", F.lit(None).cast("double")).drop("_s", "_y")
    rows = rows.where("_y IS NOT NULL")
    model = LogisticRegression(featuresCol="_s", labelCol="_y", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(rows)
    return model.transform(rows).withColumn("calibrated", vector_to_array("_p")[1]).drop("_s", "_y", "_p", "_r", "_c")


def calibrate_isotonic(df: DataFrame, label: str, score: str) -> DataFrame:
    from pyspark.ml.regression import IsotonicRegression

    rows = assemble(df.withColumn("_y", F.col(label).cast("double")), [score], "_s")
    return IsotonicRegression(featuresCol="_s", labelCol="_y", predictionCol="calibrated").fit(rows).transform(rows).drop("_s", "_y")


def feature_importance(df: DataFrame, target: str, features: list[str], classification: bool = True) -> DataFrame:
    """feature, importance of a random forest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    rows = assemble(evenly(df.select(*features, F.col(target).cast("double").alias("_y")), OBJECTS), features).where("_y IS NOT NULL")
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([(f, None) for f in features], "feature string, importance double")
    model = (RandomForestClassifier if classification else RandomForestRegressor)(labelCol="_y", numTrees=20, seed=7).fit(rows)
    return df.sparkSession.createDataFrame(list(zip(features, model.featureImportances.toArray().tolist())), "feature string, importance double")


def mutual_information(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """mi (nats) of two discrete expressions."""
    cells = df.select(F.lit("x").alias("feature"), x.cast("string").alias("v"), y.cast("string").alias("y"))
    return _information(cells.groupBy("feature", "v", "y").agg(F.count("*").alias("n"))).select("mi")


def _information(cells: DataFrame) -> DataFrame:
    """feature, mi, n_values of distinct (feature, v, y) with their count n; nulls are values of their own."""
    px = cells.groupBy("feature", "v").agg(F.sum("n").alias("nx")).toDF("_f", "_v", "nx")
    py = cells.groupBy("feature", "y").agg(F.sum("n").alias("ny"), F.lit(1).alias("_one")).toDF("_g", "_y", "ny", "_one").drop("_one")
    total = cells.groupBy("feature").agg(F.sum("n").alias("t"), F.count_distinct(F.struct("v")).alias("n_values")).withColumnRenamed("feature", "_h")  # a row a feature
    j = cells.join(px, (F.col("feature") == F.col("_f")) & F.col("v").eqNullSafe(F.col("_v"))).join(py, (F.col("feature") == F.col("_g")) & F.col("y").eqNullSafe(F.col("_y")))
    j = j.join(total, F.col("feature") == F.col("_h"))
    return j.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"), F.first("n_values").alias("n_values"))


def feature_dependence(df: DataFrame, target: str, features: list[str] | None = None, bins: int = 10) -> DataFrame:
    """rank, feature, mi (nats), n_values: all features ranked by mutual information with ``target``, from one pass over the numbers
    and one over all else, after those for the quantile bins.

    Numbers (a numeric target, too) with more than ``bins`` distinct values fall into bins between their quantiles, others go by value;
    nulls are a value of their own.  Equal information is ranked by name.
    """
    features = features or [c for c in df.columns if c != target]
    numbers = [c for c in dict.fromkeys([*features, target]) if c in set(numeric_columns(df))]
    many = agg_row(df, {c: F.approx_count_distinct(c) for c in numbers}) if numbers else {}
    wide = [c for c in numbers if many[c] > 4 * bins or many[c] > bins and df.select(c).distinct().count() > bins]
    cuts = quantiles(df, {c: (value(df, c), [i / bins for i in range(1, bins)]) for c in wide}) if wide else {}

    def coded(c: str, kind: str) -> Column:
        if c not in wide:
            return F.col(c).cast(kind)
        return F.when(value(df, c).isNotNull(), sum(((F.col(c) > x).cast("int") for x in sorted(set(cuts[c] or []))), F.lit(0))).cast(kind)

    # numbers are counted as numbers: rows of text cost several times as much; values that are no double go as text
    plain = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "float", "double")}
    parts = []
    for kind, own in (("double", [c for c in features if c in plain or c in wide]), ("string", [c for c in features if c not in plain and c not in wide])):
        if own:
            cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), coded(c, kind).alias("v")) for i, c in enumerate(own)]))
            counts = df.select(cells.alias("x"), coded(target, "string").alias("y")).groupBy("x.i", "x.v", "y").agg(F.count("*").alias("n"))
            parts.append(counts.select(F.array(*map(F.lit, own))[F.col("i")].alias("feature"), F.col("v").cast("string").alias("v"), "y", "n"))
    found = _information(stash(reduce(DataFrame.unionByName, parts), "cells"))
    return found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mi"), "feature"))).select("rank", "feature", "mi", "n_values")  # a row a feature


def task_type_detect(df: DataFrame, target: str) -> DataFrame:
    """n_distinct, task: classification with at most 20 classes that make under 5 % of rows."""
    out = df.agg(F.count_distinct(target).alias("n_distinct"), F.count(target).alias("n"))
    return out.select("n_distinct", F.when((F.col("n_distinct") <= 20) & (F.col("n_distinct") < 0.05 * F.col("n")), "classification").otherwise("regression").alias("task"))


def suggest_target(df: DataFrame) -> DataFrame:
    """column, reason: named like a target, or two-valued."""
    from tidewell.functions.columns import long_form

    hints = ("target", "label", "outcome", "churn", "fraud", "flag", "status")
    got = long_form(df, {c: [F.count_distinct(c), F.lit(any(h in c.lower() for h in hints))] for c in df.columns}, ["d", "named"])
    return got.select("column", F.when(F.col("named"), "name").when(F.col("d") == 2, "binary").alias("reason")).where("reason IS NOT NULL")


# Shapes of the values of semantic types, as the share of a column's known values that match decides.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    "phone": r"^\+?[0-9][0-9 ().-]{6,}$",
    "url": r"^https?://",
    "ip": r"^([0-9]{1,3}\.){3}[0-9]{1,3}$",
    "currency": r"^[$€£¥₹] ?[0-9]",
    "number": r"^-?[0-9]+(\.[0-9]+)?$",
    "currency_code": r"^[A-Z]{3}$",
    "duration": r"^([0-9]+:[0-9]{2}(:[0-9]{2})?|[0-9]+\s*(s|sec|min|h|hr|hours?))$",
    "address": r"(?i)[0-9][\s\S]*[^\p{L}0-9_](st|street|rd|road|ave|avenue|blvd|ln|lane|dr|drive|nagar|colony)($|[^\p{L}0-9_])",
    "zipcode": r"^[0-9]{5}(-[0-9]{4})?$",
    "boolean": r"(?i)^(true|false|yes|no|y|n|t|f)$",
}
# Name parts of semantic types, the first match counts.
NAMED = [
    ("id", ["key", "_id", "uuid"]), ("age", ["age"]), ("amount", ["price", "amount", "cost", "total", "bal"]), ("date", ["date", "time", "ts"]), ("email", ["email"]), ("phone", ["phone"]),
    ("currency_code", ["currency"]), ("country", ["nation", "country"]), ("percentage", ["pct", "percent", "discount", "tax"]), ("quantity", ["quantity", "qty", "count"]), ("name", ["name"]),
    ("category", ["type", "status", "flag", "segment", "priority"]), ("text", ["text", "comment", "html"]), ("zipcode", ["zip", "postal", "postcode"]), ("score", ["score", "rating"]), ("url", ["url", "link"]),
    ("coordinates", ["latitude", "longitude"]), ("address", ["address", "street"]), ("duration", ["duration", "elapsed"]),
]


def semantic_pattern_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column and, for each of SHAPES, the share of its known values that match; all text columns if none are given."""
    columns = string_columns(df) if columns is None else columns
    return long_form(df, {c: [share(F.col(c).rlike(p)) for p in SHAPES.values()] for c in columns}, list(SHAPES))


def semantic_types(df: DataFrame) -> DataFrame:
    """column, semantic: by name first, then by the shapes of its values, their range and number, all from one pass.

    Labels beyond those of NAMED: ip_address, boolean, count, unknown (no values) and, for numbers of no other kind, numeric.
    """
    kinds, numbers = dict(df.dtypes), set(numeric_columns(df))
    by_name = {c: next((t for t, parts in NAMED if any(p in c.lower() for p in parts)), None) for c in df.columns}
    tested = ["email", "phone", "url", "ip", "currency_code", "duration", "address", "zipcode", "boolean"]
    stats = {}
    for c in df.columns:
        text, x = F.col(c).cast("string"), value(df, c).cast("double") if c in numbers else F.lit(None).cast("double")
        stats[c] = [
            F.try_divide(F.count_distinct(c), F.count("*")), F.count(c), F.lit(by_name[c]).cast("string"), F.lit(kinds[c]), F.avg(F.length(text)), F.min(x), F.max(x), F.min(x == F.floor(x)),
            # more than four digits behind the point, as places on a map have
            share(F.abs(x * 10000 - F.round(x * 10000)) > 1e-6), *[share(text.rlike(SHAPES[k])) for k in tested],
        ]
    got = long_form(df, stats, ["unique", "known", "named", "dtype", "length", "least", "most", "whole", "fine", *tested])
    number = F.col("least").isNotNull()
    found = F.when(F.col("known") == 0, "unknown")
    for shape, label in (("url", "url"), ("ip", "ip_address"), ("currency_code", "currency_code")):
        found = found.when(F.col(shape) > 0.7, label)
    found = found.when(F.col("dtype").startswith("timestamp") | F.col("dtype").startswith("date"), "date").when(F.col("dtype") == "boolean", "boolean").when(F.col("email") > 0.7, "email")
    found = found.when(number & (F.col("least") < 0) & (F.col("least") >= -180) & (F.col("most") <= 180) & (F.col("fine") > 0.5), "coordinates")
    found = found.when(number & (F.col("most") < 1) & (F.col("least") >= 0) & ~F.col("whole"), "percentage")
    found = found.when(number & F.col("whole") & (F.col("unique") > 0.95), "id").when(number & F.col("whole") & (F.col("least") >= 0) & (F.col("most") < 200), "age").when(number & F.col("whole") & (F.col("unique") < 0.05), "count")
    found = found.when(number, "numeric").when(F.col("zipcode") > 0.7, "zipcode").when(F.col("phone") > 0.7, "phone").when(F.col("boolean") > 0.7, "boolean").when(F.col("duration") > 0.5, "duration")
    found = found.when((F.col("length") > 20) & (F.col("address") > 0.3), "address").when(F.col("unique") > 0.95, F.when(F.col("length") > 60, "text").otherwise("id")).when(F.col("unique") < 0.05, "category")
    return got.select("column", F.coalesce("named", found.otherwise(F.when(F.col("length") > 60, "text").otherwise("name"))).alias("semantic"))
