"""What fails, or costs too much, on large tables only."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidewell.functions import quantiles, stages
from tidewell.operators import cleaning, features, halo, learning, ordering, statistics, unit_roots
from tidewell.streaming import closed, windows


def test_kruskal_wallis_of_many_equal_values(spark):
    # 2.5 million rows a value: the cube of such a count is no long
    rows = spark.range(5_000_000).select((F.col("id") % 2).cast("double").alias("x"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("g"))
    skewed = rows.withColumn("x", F.when((F.col("g") == "a") & (F.col("x") == 0), 1.0).otherwise(F.col("x")))
    got = statistics.kruskal_wallis(skewed, "x", "g").first()
    # two values: h is (n - 1) times the squared phi of the table 0 / 2 000 000, 1 000 000 / 2 000 000
    assert math.isclose(got["h"], (5e6 - 1) * (2e12) ** 2 / (1e6 * 4e6 * 2e6 * 3e6), rel_tol=1e-9) and got["dof"] == 1
    assert statistics.kruskal_wallis(rows.withColumn("x", F.lit(1.0)), "x", "g").first()["h"] is None


def test_percent_change_from_zero(spark):
    values = [0.0, 0.0, 5.0, 0.0, -2.0, None, 1.0, -0.0, 3.0]
    rows = spark.createDataFrame([("u", i, v) for i, v in enumerate(values)], "u string, i long, v double")
    for ranges in (None, 3):
        got = [r["v_pct_change"] for r in ordering.percent_change(rows, "v", ["i"], ["u"], ranges).orderBy("i").collect()]
        assert got[0] is None and math.isnan(got[1]) and got[2:] == [math.inf, -1.0, -math.inf, None, None, -1.0, -math.inf]


def test_closed_windows_have_few_parts_of_state(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") * 3600).cast("timestamp").alias("ts"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(f"{tmp_path}/in/0")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        run = closed.ClosedWindows(f"{tmp_path}/out", "ts", 86400)
        run.start(windows.stream_files(spark, f"{tmp_path}/in/*", rows.schema)).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parts = [p for p in (tmp_path / "out" / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(parts) == spark.sparkContext.defaultParallelism
    assert run.read(spark, "gold").count() + run.open(spark).count() == 5 and run.totals(spark)["rows"] == 100


def test_clean_pipeline_makes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return " a " if i % 3 else "n/a"

    rows = spark.range(60).select(F.col("id"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("x"), text("id").alias("t"))
    got = cleaning.clean_pipeline(rows).collect()
    assert len(got) == 60 and {r["x"] for r in got} >= {30.0} and seen.value == 60


def test_quantiles_of_few_values_take_one_pass(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("bracketed")

    monkeypatch.setattr(quantiles, "_brackets", fail)
    rows = spark.range(20_001).select((F.col("id") % 3).alias("x"))
    assert quantiles.quantiles(rows, {"x": (F.col("x"), [0.0, 0.5, 1.0])}, limit=10_000)["x"] == [0.0, 1.0, 2.0]


def test_feature_dependence_counts_numbers_as_numbers(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 2).alias("y"), (F.col("id") % 2).cast("int").alias("same"), (F.col("id") % 4 / 4).alias("quarter"), F.lit("t").alias("text"), F.when(F.col("id") % 8 > 0, F.col("id").cast("double")).alias("wide"), (F.col("id") % 3 + (1 << 60)).alias("big"))
    kept, stash = [], learning.stash
    monkeypatch.setattr(learning, "stash", lambda df, label: kept.append(label) or stash(df, label))
    got = {r["feature"]: (r["mi"], r["n_values"]) for r in learning.feature_dependence(rows, "y").collect()}
    assert kept == ["cells"]  # the rows are counted once, and the counts read from there
    assert math.isclose(got["same"][0], math.log(2)) and math.isclose(got["quarter"][0], math.log(2)) and got["quarter"][1] == 4
    assert abs(got["text"][0]) < 1e-12 and got["text"][1] == 1 and got["wide"][1] == 11 and got["big"][1] == 3


def test_parts_of_objects_do_not_grow(spark):
    rows = spark.range(1000)
    assert stages.evenly(rows, 100).rdd.getNumPartitions() == 10 and stages.evenly(rows, 1000).rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_tfidf_shuffles_its_terms_only(spark, monkeypatch):
    kept, stash = [], features.stash
    monkeypatch.setattr(features, "stash", lambda df, label: kept.append(stash(df, label)) or kept[-1])
    rows = spark.createDataFrame([(1, "aa aa bb"), (1, "bb cc"), (2, "bb dd ee"), (3, None)], "k long, t string")
    got = {(r["k"], r["term"]): r["weight"] for r in features.tfidf_vectorize(rows, "k", "t", 2).collect()}
    assert sorted(tuple(r) for r in kept[0].collect()) == [(1, "aa", 2), (1, "bb", 2), (2, "bb", 1)]
    a, b = (1 + math.log(2)) * (math.log(5 / 2) + 1), (1 + math.log(2)) * (math.log(5 / 3) + 1)
    assert got.keys() == {(1, "aa"), (1, "bb"), (2, "bb")} and math.isclose(got[1, "aa"], a / math.hypot(a, b)) and got[2, "bb"] == 1.0


def test_a_series_of_the_whole_table_uses_all_cores(spark):
    rows = spark.range(250_000).withColumn("x", F.lit(1.0))
    assert len(halo.split(rows, "id", [])[1]) == 2 and not halo.split(rows.where("id < 90000"), "id", [])[1]


def test_trees_of_many_equal_rows_are_fitted_on_counted_cells(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    kept, stash = [], learning.stash
    monkeypatch.setattr(learning, "stash", lambda df, label: kept.append(label) or stash(df, label))
    a, b, noise = F.col("id") % 5, F.floor(F.col("id") / 5) % 4, F.pmod(F.xxhash64("id"), F.lit(10))
    rows = spark.range(12_000).select("id", a.alias("a"), (b * 1.5).alias("b"), F.when(noise == 0, 0).otherwise((a * b > 4).cast("int")).alias("y"))
    got = {r["model"]: r for r in learning.automl_train(rows, "y", ["a", "b"], "id", folds=2, trees=4).collect()}
    assert kept == ["cells", "draws"] and got.keys() == {"gbt", "forest", "linear"}
    # few values: bins lose nothing, so boosting over cells gives what it gives over rows
    split = learning.assemble(ordering.train_val_holdout_split(rows, "id").withColumn("y", F.col("y").cast("double")), ["a", "b"])
    plain = GBTClassifier(labelCol="y", maxIter=10, seed=7).fit(split.where("split = 'train'"))
    want = BinaryClassificationEvaluator(labelCol="y").evaluate(plain.transform(split.where("split = 'val'")))
    assert math.isclose(got["gbt"]["val"], want, rel_tol=1e-6) and abs(got["forest"]["val"] - want) < 0.02
    again = {r["model"]: r["val"] for r in learning.automl_train(rows.repartition(3), "y", ["a", "b"], "id", folds=2, trees=4, classification=False).collect()}
    assert kept == ["cells", "draws"] * 2 and all(0.1 < v < 1 for v in again.values())


def test_cells_hold_all_rows_and_draws_follow_their_counts(spark):
    rows = spark.range(40_000).select((F.col("id") % 3).cast("double").alias("x0"), F.col("id").cast("double").alias("x1"), F.lit(2.0).alias("x2"), (F.col("id") % 2).alias("y"))
    names = ["x0", "x1", "x2"]
    cuts = learning.tree_cuts(rows, names)
    assert cuts["x0"] == [0.5, 1.5] and len(cuts["x1"]) == 31 and cuts["x2"] == []
    assert all(abs(q - k * 1250) < 20 for k, q in enumerate(cuts["x1"], 1))
    cells = learning.tree_cells(rows, ["y"], names, cuts)
    # bins are numbers, not names of categories, so trees cut them in order
    assert not any(cells.schema[c].metadata for c in names)
    found = cells.collect()
    assert len(found) == 2 * 3 * 32 and sum(r["n"] for r in found) == 40_000 and all(150 < r["n"] < 270 for r in found)
    drawn = [(r["n"], [r[f"w{t}"] for t in range(50)]) for r in learning.with_draws(cells, 50).orderBy("y", *names).collect()]
    assert drawn == [(r["n"], [r[f"w{t}"] for t in range(50)]) for r in learning.with_draws(cells.repartition(3), 50).orderBy("y", *names).collect()]
    z = [(w - n) / math.sqrt(n) for n, ws in drawn for w in ws]
    assert abs(sum(z) / len(z)) < 0.05 and abs(sum(v * v for v in z) / len(z) - 1) < 0.08


def test_battery_sorts_once_and_counts_equal_values(spark, monkeypatch):
    sorts, split, kept, stash = [], unit_roots.split, {}, statistics.stash
    monkeypatch.setattr(unit_roots, "split", lambda *a, **k: sorts.append(1) or split(*a, **k))
    monkeypatch.setattr(statistics, "stash", lambda df, label: kept.setdefault(label, []).append(stash(df, label)) or kept[label][-1])
    rows = spark.range(3000).select("id", (F.col("id") % 7 * F.col("id") % 11).cast("double").alias("a"), F.pmod(F.xxhash64("id"), F.lit(9)).cast("double").alias("b"), F.when(F.col("id") % 50 > 0, F.col("id") % 3).alias("g"))
    got = {(r["column"], r["test"]): r["stat"] for r in statistics.statistical_test_battery(rows, ["a", "b"], "g", ["id"]).collect()}
    assert len(sorts) == 1 and len(got) == 6
    assert [x.count() for x in kept["counts"]] == [3 * 11, 3 * 9] and kept["counts"][0].agg(F.sum("_n")).first()[0] == 2940
    far = rows.join(rows.groupBy("g").agg(F.median("a").alias("m")), "g").withColumn("z", F.abs(F.col("a") - F.col("m")))
    assert math.isclose(got["a", "levene"], statistics.anova_oneway(far, "z", "g").first()["f"], rel_tol=1e-9)


def test_kmeans_fits_all_k_in_a_pass_and_counts_equal_rows(spark, monkeypatch):
    kept, passes, totals, stash = [], [], learning._totals, learning.stash
    monkeypatch.setattr(learning, "_totals", lambda *a: passes.append(1) or totals(*a))
    monkeypatch.setattr(learning, "stash", lambda df, label: kept.append(stash(df, label)) or kept[-1])
    blob = F.col("id") % 3
    rows = spark.range(6000).select((blob * 10 + F.col("id") % 7 / 7).alias("a"), F.when(F.col("id") != 17, F.pmod(blob * 2, F.lit(3)) * 5.0 + F.col("id") % 4 / 4).alias("b"))
    got = sorted(r["size"] for r in learning.kmeans_clusters(rows, ["a", "b"]).collect())
    assert got == [1999, 2000, 2000] and len(passes) <= learning.ROUNDS + 2
    blocks = [np.frombuffer(r["data"]).reshape(3, -1) for r in kept[0].collect()]
    assert sum(b.shape[1] for b in blocks) == 3 * 7 * 4 and sum(b[-1].sum() for b in blocks) == 5999
    few = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, 2.0), (None, 1.0), (math.nan, 1.0)], "a double, b double")
    assert sorted(r["size"] for r in learning.kmeans_clusters(few, ["a", "b"]).collect()) == [1, 2]
    assert [tuple(r) for r in learning.kmeans_clusters(few.where("a = 1"), ["a", "b"]).collect()] == [(0, 2)]
    assert learning.kmeans_clusters(few.where("a > 9"), ["a", "b"]).count() == 0


def test_kmeans_against_plain_sums_and_spark(spark):
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1, (60, 2)) for c in ((0, 0), (6, 0), (0, 7), (9, 9))])
    n = rng.integers(1, 4, len(x))
    rows = spark.createDataFrame([(*map(float, p), float(m)) for p, m in zip(x, n)], "x0 double, x1 double, n double").repartition(3)
    points = learning.packed(rows)
    first = learning.starts(points, 2, 4)
    assert np.array_equal(first, learning.starts(learning.packed(rows.repartition(5)), 2, 4)) and len({tuple(c) for c in first}) == 4
    centres = learning.lloyd(points, {3: first[:3], 4: first})
    ml = KMeans(k=4, seed=7, weightCol="n").fit(learning.assemble(rows, ["x0", "x1"]))
    assert np.allclose(sorted(map(tuple, centres[4])), sorted(tuple(c) for c in ml.clusterCenters()), atol=1e-3)
    sizes, scores = learning.silhouettes(points, centres)
    whole = np.repeat(x, n, axis=0)
    for k, c in centres.items():
        label = ((whole[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        far = ((whole[:, None] - whole[None]) ** 2).sum(axis=2)
        own = []
        for i, j in enumerate(label):
            mean = [far[i, label == m].mean() for m in range(k)]
            a, b = mean[j] * (label == j).sum() / ((label == j).sum() - 1), min(v for m, v in enumerate(mean) if m != j)
            own.append((b - a) / max(a, b))
        assert np.array_equal(sizes[k], np.bincount(label, minlength=k)) and math.isclose(scores[k], np.mean(own), rel_tol=1e-9)
    assert scores[4] > scores[3]
