"""Properties of operators without a SQL form, canary tables and small helpers."""

import itertools
import json
import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import columns as K
from tidewell.functions import quantiles
from tidewell.functions import tails
from tidewell.operators import advisors, aggregates, cleaning, drift, features, governance, learning, metadata, ordering, regulatory, resampling, statistics, validators
from tidewell.sources import connectors, files
from tidewell.streaming import windows


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="module")
def canary(spark):
    data = [(i, float(i % 7) if i % 5 else None, "N/A" if i % 4 == 0 else f"v{i % 3}", float("inf") if i == 3 else float("nan") if i == 4 else i * 1.5, None) for i in range(100)]
    return spark.createDataFrame(data, "id int, x double, s string, y double, gone double")


# --- tails ---------------------------------------------------------------------------------------------------------------


def test_tails_against_known_values():
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_upper(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_upper(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_critical(0.95, 10) == pytest.approx(2.228, abs=1e-3)
    assert tails.kolmogorov(0.0, 10, 10) == 1.0
    assert tails.beta_inc(2, 3, 0.5) == pytest.approx(0.6875)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.1, 50), st.floats(0.1, 50), st.floats(0.001, 0.999))
def test_beta_is_a_distribution(a, b, x):
    assert -1e-9 <= tails.beta_inc(a, b, x) <= 1 + 1e-9
    assert tails.beta_inc(a, b, x) + tails.beta_inc(b, a, 1 - x) == pytest.approx(1, abs=1e-6)


# --- cleaning ------------------------------------------------------------------------------------------------------------


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["User Id", "userID", "user-id", "%"])
    assert cleaning.normalise_column_names(df).columns == ["user_id", "user_id_1", "user_id_2", "column"]


def test_pipelines_leave_no_nulls(canary):
    out = cleaning.clean_pipeline(canary)
    assert "gone" not in out.columns
    assert all(v == 0 for v in cleaning.null_rates(out).values())
    kept, bad = cleaning.quarantine_rows(canary, 0.5)
    assert kept.count() + bad.count() == canary.count()


@pytest.mark.parametrize("method", ["iqr", "zscore", "winsorise"])
def test_capping_is_idempotent_within_bounds(canary, method):
    base = canary.where("id not in (3, 4)")
    out = cleaning.cap_outliers(base, ["y"], method, 0.5)
    lo, hi = out.agg(F.min("y"), F.max("y")).first()
    a, b = base.agg(F.min("y"), F.max("y")).first()
    assert a <= lo <= hi <= b and out.count() == base.count()
    assert set(cleaning.cap_outliers(base, ["y"], "flag").columns) - set(base.columns) == {"y_outlier"}


def test_imputers_keep_rows_and_known_values(spark):
    df = spark.createDataFrame([(i, float(i) if i % 6 else None, float(2 * i)) for i in range(1, 80)], "id long, a double, b double")
    for out, near in ((cleaning.impute_knn(df, ["a", "b"]), 2), (cleaning.impute_iterative(df, ["a", "b"]), 1)):
        got = {r["id"]: r for r in rows(out)}
        assert len(got) == 79 and all(got[i]["a"] is not None for i in got)
        assert all(got[i]["a"] == i for i in got if i % 6)
        assert all(abs(got[i]["a"] - i) <= near for i in got if i % 6 == 0)


def brute_knn(data, k):
    """Means of the k nearest complete rows over the standardised columns that are given; ties at the k-th place share it."""
    x = np.array(data, float)
    scale = np.nanstd(x, axis=0)
    scale[scale == 0] = 1
    whole = x[~np.isnan(x).any(axis=1)]
    out = []
    for row in x:
        gap = np.isnan(row)
        if gap.any():
            d = ((whole - row) ** 2 / scale**2)[:, ~gap].sum(axis=1)
            left, total = min(k, len(whole)), 0.0
            for v in np.unique(d):
                at = whole[d == v]
                take = min(left, len(at))
                total, left = total + at.mean(axis=0) * take, left - take
                if not left:
                    break
            row = np.where(gap, total / min(k, len(whole)), row)
        out.append(row)
    return np.array(out)


@pytest.mark.parametrize("shape", ["clusters", "grid", "few", "line"])
def test_knn_imputation_against_all_pairs(spark, shape):
    rng = np.random.default_rng(3)
    if shape == "clusters":  # a dense cluster, a small one and far outliers
        x = np.concatenate([rng.normal(0, 1e-4, (900, 2)), rng.normal(50, 1, (60, 2)), rng.uniform(-1000, 1000, (40, 2))])
    elif shape == "grid":  # many equal rows and ties
        x = rng.integers(0, 6, (800, 3)).astype(float)
    elif shape == "few":
        x = rng.normal(0, 1, (8, 2))
    else:
        x = np.column_stack([np.arange(700.0), np.arange(700.0) * 3, np.full(700, 4.0)])
    x[rng.random(x.shape) < (0.3 if shape == "few" else 0.08)] = np.nan
    data = [[i, *(None if math.isnan(v) else float(v) for v in r)] for i, r in enumerate(x)]
    names = [f"c{i}" for i in range(x.shape[1])]
    out = cleaning.impute_knn(spark.createDataFrame(data, "id long, " + ", ".join(f"{c} double" for c in names)), names)
    got = np.array([[r[c] for c in names] for r in sorted(rows(out), key=lambda r: r["id"])])
    assert np.allclose(got, brute_knn(x, 5), rtol=1e-6, atol=1e-9)


def test_knn_without_gaps_or_donors(spark):
    full = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert rows(cleaning.impute_knn(full, ["a", "b"])) == [{"a": 1.0, "b": 2.0}]
    none = spark.createDataFrame([(1.0, None), (3.0, None), (None, 6.0)], "a double, b double")
    assert all(r["a"] is not None and r["b"] == 6.0 for r in rows(cleaning.impute_knn(none, ["a", "b"])))


def test_smote_lies_between_minority_vectors(spark):
    data = [(i, "m", float(i), float(-i)) for i in range(40)] + [(i, "x", 100.0, 100.0) for i in range(40, 300)]
    got = rows(features.smote(spark.createDataFrame(data, "id long, y string, a double, b double"), "y", "m", ["a", "b"], "id"))
    assert len(got) == 40 and all(abs(r["a"] + r["b"]) < 1e-9 and 0 <= r["a"] <= 39 and abs(r["a"] - r["id"]) <= 5 for r in got)


@pytest.mark.parametrize("kind", ["double", "timestamp"])
def test_fill_over_a_whole_table_equals_one_window(spark, kind):
    data = [(float(i) if i % 50 else None, i, float(i) if i % 17 == 3 else None, "x" if i > 900 else None) for i in range(1000)]
    df = spark.createDataFrame(data, "t double, id long, v double, s string").withColumn("t", F.col("t").cast(kind))
    out = rows(cleaning.impute_ffill_bfill(df, ["v", "s"], ["t", "id"]))
    alone = rows(cleaning.impute_ffill_bfill(df.withColumn("g", F.lit(1)), ["v", "s"], ["t", "id"], ["g"]))
    assert {(r["id"], r["v"], r["s"]) for r in out} == {(r["id"], r["v"], r["s"]) for r in alone} and len(out) == 1000
    with pytest.raises(ValueError):
        cleaning.impute_ffill_bfill(df, ["v"], ["s"])


def test_label_codes_are_sorted(spark):
    df = spark.createDataFrame([(w,) for w in ["b", "ä", "a", None, "b", "Z", "zz", ""] * 3], "w string")
    got = {r["w"]: r["w_code"] for r in rows(features.label_encode(df, "w"))}
    assert got.pop(None) is None
    assert got == {w: i for i, w in enumerate(sorted({"b", "ä", "a", "Z", "zz", ""}))}


def test_constant_and_single_row(spark):
    one = spark.createDataFrame([(1, 2.5, "x")], "id int, v double, s string")
    assert aggregates.profile_numeric(one, ["v"]).first()["median"] == 2.5
    assert aggregates.histogram_equal_width(one, "v").first()["n"] == 1
    flat = spark.createDataFrame([(i, 42.0) for i in range(50)], "id int, v double")
    assert cleaning.drop_constant_columns(flat).columns == ["id"]
    assert rows(validators.check_cardinality(flat, ["v"]))[0]["issue"] == "CONSTANT"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id int, v double, s string")
    assert validators.check_nulls(empty).count() == 0
    assert validators.check_bounds(empty, {"v": (0, 1)}).count() == 0
    assert cleaning.clean_pipeline(empty).count() == 0
    assert aggregates.histogram_equal_width(empty, "v").count() == 0


def test_infinities_count_as_null(canary):
    got = {r["column"]: r["severity"] for r in rows(validators.check_nulls(canary, critical=["id"]))}
    assert got["gone"] == "ERROR" and "id" not in got
    assert K.agg_row(canary, {"n": F.sum(K.value(canary, "y", False).isNull().cast("int"))})["n"] == 2


# --- statistics ----------------------------------------------------------------------------------------------------------


def test_ols_finds_a_line(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), 3 + 2.0 * i - 0.5 * (i % 7)) for i in range(100)], "a double, b double, y double")
    got = {r["feature"]: r for r in rows(statistics.ols(df, "y", ["a", "b"]))}
    assert got["a"]["coef"] == pytest.approx(2) and got["b"]["coef"] == pytest.approx(-0.5) and got["intercept"]["r2"] == pytest.approx(1)


def test_bootstrap_is_repeatable_and_close_to_normal_theory(spark):
    df = spark.createDataFrame([(i, float(i % 10), None if i % 3 else 1.0) for i in range(400)], "id long, v double, c double")
    for method in ("percentile", "bca"):
        one, two = (rows(resampling.bootstrap_ci(d, "v", "id", method=method))[0] for d in (df, df.repartition(7)))
        assert one["lo"] == pytest.approx(two["lo"]) and one["hi"] == pytest.approx(two["hi"])
        half = 1.96 * math.sqrt(8.25 / 400)
        assert one["lo"] == pytest.approx(4.5 - half, abs=0.02) and one["hi"] == pytest.approx(4.5 + half, abs=0.02)
    assert rows(resampling.bootstrap_ci(df, "c", "id", reps=100))[0] == {"mean": 1.0, "lo": 1.0, "hi": 1.0}
    assert rows(resampling.bootstrap_ci(df.where("false"), "v", "id"))[0]["mean"] is None


def test_bca_follows_the_skew(spark):
    df = spark.createDataFrame([(i, math.exp(i % 60 / 10)) for i in range(60)], "id long, v double")
    plain, bca = (rows(resampling.bootstrap_ci(df, "v", "id", method=m))[0] for m in ("percentile", "bca"))
    assert bca["lo"] > plain["lo"] and bca["hi"] > plain["hi"]  # a long right tail moves both ends up


def test_permutation_p_against_all_permutations(spark):
    x, g = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 9.0, 3.0], "aabababb"
    df = spark.createDataFrame([(i, v, c, v * v % 7) for i, (v, c) in enumerate(zip(x, g))], "id long, v double, g string, w double")
    mean = lambda z: sum(z) / len(z)
    own = abs(mean([v for v, c in zip(x, g) if c == "a"]) - mean([v for v, c in zip(x, g) if c == "b"]))
    splits = [set(s) for s in itertools.combinations(range(8), 4)]
    exact = mean([abs(mean([x[i] for i in s]) - mean([x[i] for i in range(8) if i not in s])) >= own - 1e-12 for s in splits])
    got = rows(resampling.permutation_test(df, "v", "g", "a", "b", "id"))[0]
    assert abs(got["diff"]) == pytest.approx(own) and got["p"] == pytest.approx(exact, abs=0.03)
    # two groups: F is monotone in the difference
    assert rows(resampling.permutation_anova(df, "v", "g", "id"))[0]["p"] == pytest.approx(exact, abs=0.03)
    y = [v * v % 7 for v in x]
    r = lambda a: abs(np.corrcoef(a, y)[0, 1])
    exact = mean([r(p) >= r(x) - 1e-12 for p in itertools.permutations(x)])
    assert rows(resampling.permutation_correlation(df, "v", "w", "id"))[0]["p"] == pytest.approx(exact, abs=0.03)


def test_permutations_over_many_blocks(spark):
    df = spark.range(20_000).select("id", (F.col("id") * 7919 % 101).cast("double").alias("v"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"))
    shifted = df.withColumn("v", F.col("v") + F.when(F.col("g") == "a", 2.0).otherwise(0.0))
    assert rows(resampling.permutation_test(df, "v", "g", "a", "b", "id", reps=500))[0]["p"] > 0.05
    assert rows(resampling.permutation_test(shifted, "v", "g", "a", "b", "id", reps=500))[0]["p"] == pytest.approx(1 / 501)
    assert rows(resampling.permutation_test(df.where("g = 'a'"), "v", "g", "a", "b", "id", reps=50))[0]["p"] is None
    assert rows(resampling.permutation_correlation(df.withColumn("z", F.lit(1.0)), "v", "z", "id", reps=50))[0]["p"] is None


def test_adjusted_p_with_ties_and_nulls(spark):
    p = [0.01, 0.04, 0.03, 0.03, 0.5, 0.5, 0.9, 1.0, 0.03]
    df = spark.createDataFrame([*enumerate(p), (99, None)], "id long, p double")
    got = {r["id"]: r for r in rows(statistics.multiple_testing(df, "id"))}
    order, m = sorted(range(9), key=lambda i: p[i]), 9
    top, low = 0.0, 1.0
    holm, bh = {}, {}
    for k, i in enumerate(order):
        holm[i] = top = max(top, min(1, p[i] * (m - k)))
    for k, i in reversed(list(enumerate(order))):
        bh[i] = low = min(low, p[i] * m / (k + 1))
    for i in range(9):
        assert got[i]["holm"] == pytest.approx(holm[i]) and got[i]["bh"] == pytest.approx(bh[i])
        assert got[i]["by"] == pytest.approx(min(1, bh[i] * sum(1 / j for j in range(1, 10)))) and got[i]["bonferroni"] == pytest.approx(min(1, p[i] * 9))
    assert got[99]["holm"] is None


@pytest.mark.parametrize("shape", ["spread", "ties", "steps", "wide"])
def test_quantiles_of_large_columns_equal_percentile(spark, shape):
    make = {"spread": "id * 7919 % 20011 / 7.0", "ties": "CASE WHEN id % 3 = 0 THEN 5.0 ELSE id % 1009 / 10.0 END", "steps": "floor(id / 5000)", "wide": "CASE WHEN id < 20 THEN 1e300 * (id - 10) ELSE id * 1e-9 END"}
    df = spark.range(20_000).selectExpr(f"CASE WHEN id % 11 = 0 THEN NULL ELSE double({make[shape]}) END AS v", "double(id) AS w")
    qs = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.75, 0.95, 1.0]
    want = df.agg(F.percentile("v", F.array(*map(F.lit, qs)))).first()[0]
    got = quantiles.quantiles(df, {"v": (F.col("v"), qs), "w": (F.col("w"), [0.5]), "none": (F.lit(None).cast("double"), [0.5])}, limit=50)
    assert got["v"] == pytest.approx(want, rel=1e-9) and got["w"] == pytest.approx([9999.5]) and got["none"] is None


def test_group_medians_keep_null_groups(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id % 4 = 3 THEN NULL ELSE id % 4 END AS g", "double(id * id % 97) AS v")
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert {r["g"]: r["median"] for r in rows(ordering.group_medians(df, "v", ["g"]))} == want


def test_modes_prefer_the_least_of_ties(spark):
    df = spark.createDataFrame([(10, "b", 1.5), (9, "a", 1.5), (10, "a", None), (9, "b", None), (None, None, None)], "i int, s string, d double")
    got = cleaning.impute_simple(df, {"i": "mode", "s": "mode", "d": "mode"}).collect()[-1]
    assert (got["i"], got["s"], got["d"]) == (9, "a", 1.5)


def test_correlation_with_a_constant_is_null(spark):
    df = spark.range(50).selectExpr("double(id) AS a", "2.0D AS b", "CASE WHEN id > 40 THEN NULL ELSE double(id * 2) END AS c")
    got = {(r["a"], r["b"]): r["r"] for r in rows(statistics.corr_pearson(df, ["a", "b", "c"]))}
    assert got["a", "b"] is None and got["a", "c"] == pytest.approx(1)


def test_harmonic_numbers_meet():
    assert statistics.harmonic(10) == pytest.approx(sum(1 / i for i in range(1, 11)))
    assert statistics.harmonic(1_000_001) == pytest.approx(statistics.harmonic(1_000_000) + 1 / 1_000_001, abs=1e-12)


def test_chi_square_tails_as_expressions(spark):
    df = spark.createDataFrame([(x, d) for x in (0.0, 0.3, 2.0, 9.5, 40.0) for d in (1, 2, 3, 4, 5, 9, 10)], "x double, d int")
    for r in df.select("x", "d", statistics._chi2_upper(F.col("x"), F.col("d")).alias("p")).collect():
        assert r["p"] == pytest.approx(tails.chi2_upper(r["x"], r["d"]), rel=1e-5, abs=1e-12)


def test_same_tables_do_not_drift(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 101).cast("double").alias("v"))
    assert drift.psi_quantile(df, df, "v").first()["psi"] == pytest.approx(0)
    assert drift.ks_two_sample(df, df, "v").first()["d"] == pytest.approx(0)
    assert drift.wasserstein(df, df.select((F.col("v") + 5).alias("v")), "v").first()[0] == pytest.approx(5)
    assert not drift.drift_consensus(df, df, ["v"]).first()["drift"]


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") * 7 % 50).alias("v"))
    want = {v: v * 10 + 5.5 for v in range(50)}
    assert {r["v"]: r["rank"] for r in rows(ordering.average_ranks(df, "v"))} == want


# --- learning ------------------------------------------------------------------------------------------------------------


def test_isolation_forest_finds_the_outlier(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(500)] + [(999, 500.0, -300.0)], "id long, a double, b double")
    got = rows(learning.anomaly_score(df, ["a", "b"], "id", trees=20).orderBy(F.desc("score")).limit(1))
    assert got[0]["id"] == 999 and got[0]["is_anomaly"]


def test_luhn_and_cosine(spark):
    df = spark.createDataFrame([("4539578763621486", [1.0, 0.0], [0.0, 2.0]), ("4539578763621487", [1.0, 1.0], [2.0, 2.0]), ("x", [1.0], [0.0])], "n string, a array<double>, b array<double>")
    got = rows(df.select(K.luhn_valid(F.col("n")).alias("ok"), K.cosine(F.col("a"), F.col("b")).alias("c")))
    assert [r["ok"] for r in got] == [True, False, False]
    assert got[0]["c"] == 0 and got[1]["c"] == pytest.approx(1) and got[2]["c"] is None


# --- governance ----------------------------------------------------------------------------------------------------------


def test_redaction_is_clean_and_idempotent(spark):
    df = spark.createDataFrame([("mail a.b@c.org now",), ("ssn 123-45-6789",), ("card 4539 5787 6362 1486",), ("call (212) 555-0187",), ("clean",)], "t string")
    out = governance.pii_redact(df, ["t"], governance.POLICY["generic"])
    assert governance.pii_detect(out, ["t"], governance.POLICY["generic"]).count() == 0
    assert rows(governance.pii_redact(out, ["t"], governance.POLICY["generic"])) == rows(out)
    assert rows(out)[4]["t"] == "clean"
    assert governance.governance_policy(df, ["t"], "gdpr", "reject")[0].count() == 0
    assert governance.governance_policy(df, ["t"], "gdpr", "off")[1].count() == 0


def test_checksum_ignores_order(spark):
    a = spark.range(100)
    assert rows(governance.dataset_checksum(a)) == rows(governance.dataset_checksum(a.orderBy(F.desc("id"))))
    assert rows(governance.dataset_checksum(a)) != rows(governance.dataset_checksum(a.where("id <> 5")))


def test_rules_apply_only_where_bound(spark):
    df = spark.createDataFrame([(9600.0, None), (-5.0, 1)], "amt double, sca int")
    got = {r["rule"]: r["n_bad"] for r in rows(regulatory.evaluate(df, {"amount": "amt", "sca": "sca"}))}
    assert got == {"reg_positive_amount": 1, "reg_structuring": 1, "reg_sca_exemption": 1}


# --- state ---------------------------------------------------------------------------------------------------------------


def test_layers_are_immutable_and_verified(spark, tmp_path):
    store = metadata.LayerStore(spark, str(tmp_path / "layers"))
    bronze = store.store(spark.range(10), "d")
    with pytest.raises(Exception):
        spark.range(5).write.mode("errorifexists").parquet(store.path("bronze", "d", bronze))
    with pytest.raises(RuntimeError):
        store.promote("d", bronze, lambda df: (_ for _ in ()).throw(RuntimeError("bad")))
    assert store.snapshots().count() == 1 and store.verify("bronze", "d", bronze)
    spark.range(3).write.mode("overwrite").parquet(store.path("bronze", "d", bronze))
    spark.catalog.refreshByPath(store.path("bronze", "d", bronze))
    assert not store.verify("bronze", "d", bronze)


# --- sources -------------------------------------------------------------------------------------------------------------


def test_bad_csv_lines_are_quarantined(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;x\nno;y\n2;z\n;\n")
    good, bad = files.scan_csv(spark, str(tmp_path / "a.csv"), "a INT, b STRING")
    assert sorted(r["a"] for r in rows(good)) == [1, 2] and bad.count() == 1


def test_options_builders():
    o = connectors.jdbc_options("postgres", "db", table="t", user="u", split=("id", 0, 100, 8))
    assert o["url"] == "jdbc:postgresql://localhost:5432/db" and o["numPartitions"] == "8" and o["fetchsize"] == "50000"
    with pytest.raises(ValueError):
        connectors.jdbc_options("mysql", "db")
    for store in connectors.STORES:
        fmt, opts = connectors.store_options(store, **{k: "v" for k in connectors.STORES[store][1]})
        assert fmt and all(v == "v" for v in opts.values())
    with pytest.raises(ValueError):
        connectors.store_options("redis", filter="x")
    k = windows.kafka_options("h:1", ["a", "b"], group="g", per_trigger=5, sasl={"sasl.mechanism": "PLAIN"})
    assert k["subscribe"] == "a,b" and k["maxOffsetsPerTrigger"] == "5" and k["kafka.sasl.mechanism"] == "PLAIN"
    assert connectors.next_link('<http://x/2>; rel="next", <http://x/9>; rel="last"') == "http://x/2"


@pytest.fixture(scope="module")
def service():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.partition("page=")[2] or 1)
            body = json.dumps({"data": {"items": [{"id": page * 10 + i} for i in range(3)]}}).encode()
            self.send_response(200)
            if page < 3:
                self.send_header("Link", f'<http://127.0.0.1:{self.server.server_port}/r?page={page + 1}>; rel="next"')
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/r"
    server.shutdown()


@pytest.mark.parametrize("mode", ["page", "link"])
def test_rest_pages(spark, service, mode):
    got = connectors.scan_rest_api(spark, "id INT", url=service, mode=mode, pages="3", records="data.items")
    assert sorted(r["id"] for r in rows(got)) == [10, 11, 12, 20, 21, 22, 30, 31, 32]


def test_http_poll(spark, service):
    spark.dataSource.register(connectors.PollSource)
    stream = spark.readStream.format("tidewell_poll").option("urls", f"{service},{service}?page=2").option("records", "data.items").option("polls", "1").load()
    q = stream.writeStream.format("memory").queryName("polled").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(json.loads(r["record"])["id"] for r in rows(spark.table("polled"))) == [10, 11, 12, 20, 21, 22]


# --- streaming -----------------------------------------------------------------------------------------------------------


def test_json_decoding_sets_bad_rows_apart(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{broken",)], "value string")
    got = rows(windows.decode_json(df, "value", "a INT"))
    assert [(r["a"], r["_raw"]) for r in got] == [(1, None), (None, "{broken")]


def test_confidence_bounds(spark):
    df = spark.createDataFrame([(q / 4, c / 4, 0.5, a, r, p, g) for q in range(5) for c in range(5) for a in (None, 0.4, 1.0) for r in (0, 9) for p in (0.0, -1.0) for g in (True, False)], "quality double, compliance double, consistency double, roc_auc double, retries int, penalty double, gate2_passed boolean")
    out = governance.confidence_score(df)
    lo, hi = out.agg(F.min("confidence"), F.max("confidence")).first()
    assert 0 <= lo <= hi <= 1
    assert out.where(~F.col("gate2_passed")).agg(F.max("confidence")).first()[0] <= 0.49
    assert not math.isnan(hi)


def test_retry_strategy_names(spark):
    null = spark.createDataFrame([(1, None), (2, None), (3, 1.0)], "a int, b double")
    assert advisors.retry_strategy(null)[1] == "drop_high_null"
    assert advisors.retry_strategy(spark.createDataFrame([(1, 1.0), (1, 1.0)], "a int, b double"))[1] == "aggressive_clean"


@pytest.mark.parametrize("spread", [3, 40, 100000])
def test_kendall_against_all_pairs(spark, spread):
    data = [((i * 7919 % 1009) % spread + 0.5 * (i % 2), (i * 104729 % 733) % spread) for i in range(300)] + [(None, 1), (float("nan"), 2)]
    known = [(x, y) for x, y in data if x is not None and x == x]
    sign = lambda v: (v > 0) - (v < 0)
    pairs = [(sign(x - u), sign(y - v)) for i, (x, y) in enumerate(known) for u, v in known[:i]]
    want = sum(a * b for a, b in pairs) / math.sqrt(sum(a * a for a, _ in pairs) * sum(b * b for _, b in pairs))
    df = spark.createDataFrame(data, "x double, y long")
    assert statistics.corr_kendall(df, "x", "y").first()["tau"] == pytest.approx(want)
    assert statistics.corr_kendall(df.where("false"), "x", "y").first()["tau"] is None


def test_ranks_over_many_partitions(spark):
    from tidewell.operators import ordering

    df = spark.range(5000).selectExpr("cast(id % 1700 as double) AS v")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3000")
    try:
        cuts = ordering.range_cuts(df, ["v"])["v"]
        spark.conf.set("spark.sql.shuffle.partitions", before)
        got = {r["v"]: r["rank"] for r in rows(ordering.dense_ranks(df, "v", cuts))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(cuts) > 1000 and got == {float(i): i for i in range(1700)}
