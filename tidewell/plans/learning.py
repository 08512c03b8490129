"""Queries of models, their evaluation, and semantic typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.columns import luhn_valid as luhn
from tidewell.operators import drift as R
from tidewell.operators import learning as L
from tidewell.operators import vectors as V
from tidewell.plans.registry import query, read

SCORE = "SELECT doc_id, quality AS y, ((doc_id * 37) % 101) / 202.0::DOUBLE + quality * 0.4::DOUBLE AS p FROM labels"


def scored(spark, sf):
    return read(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") * 37 % 101) / 202.0 + F.col("quality") * 0.4).alias("p"))


def numbers(spark, sf):
    return read(spark, sf, "lineitem").withColumn("row", F.col("l_orderkey") * 100 + F.col("l_linenumber"))


@query()
def anomaly_score(spark, sf):
    return L.anomaly_score(read(spark, sf, "events").withColumn("h", F.hour("ts").cast("double")), ["value", "h"], "event_id")


@query("WITH m AS (SELECT median(value) AS m FROM events), d AS (SELECT median(abs(value - m)) AS d FROM events, m) SELECT event_id, 0.6745 * (value - m) / d AS robust_z FROM events, m, d")
def robust_z(spark, sf):
    return L.robust_z(read(spark, sf, "events").select("event_id", "value"), "value").drop("value")


@query()
def kmeans_clusters(spark, sf):
    return L.kmeans_clusters(numbers(spark, sf), ["l_quantity", "l_extendedprice"])


@query()
def automl_train(spark, sf):
    df = numbers(spark, sf).withColumn("y", (F.col("l_extendedprice") * F.col("l_quantity") > 1e6).cast("int"))
    return L.automl_train(df, "y", ["l_quantity", "l_discount", "l_extendedprice"], "row")


@query(f"""WITH s AS ({SCORE}), r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s), a AS (SELECT (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r),
c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p < 0.5 AND y = 0)::DOUBLE AS tn FROM s)
SELECT auc, (tp + tn) / (tp + fp + fn + tn) AS accuracy, (2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fn + fp) * (tn + fp)) / (tp + fp + fn + tn) AS weighted_f1 FROM a, c""")
def evaluate_classification(spark, sf):
    return L.evaluate_classification(scored(spark, sf), "y", "p")


@query("WITH e AS (SELECT l_extendedprice AS y, l_extendedprice * (1 - l_discount) AS p FROM lineitem) SELECT 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse FROM e")
def evaluate_regression(spark, sf):
    return L.evaluate_regression(read(spark, sf, "lineitem").withColumn("p", F.expr("l_extendedprice * (1 - l_discount)")), "l_extendedprice", "p")


@query(f"WITH b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS p, avg(y) AS y FROM ({SCORE}) GROUP BY 1) SELECT sum(n * abs(p - y)) / sum(n) AS ece FROM b")
def ece(spark, sf):
    return L.ece(scored(spark, sf), "y", "p")


@query(f"SELECT avg((p - y) * (p - y)) AS brier FROM ({SCORE})")
def brier(spark, sf):
    return L.brier(scored(spark, sf), "y", "p")


@query()
def calibrate_platt(spark, sf):
    return L.calibrate_platt(scored(spark, sf), "y", "p")


@query()
def calibrate_isotonic(spark, sf):
    return L.calibrate_isotonic(scored(spark, sf), "y", "p")


@query()
def feature_importance(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("y", (F.col("l_extendedprice") > 50000).cast("int"))
    return L.feature_importance(df, "y", ["l_quantity", "l_extendedprice", "l_discount"])


@query("WITH c AS (SELECT source AS x, lang AS y, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM c) SELECT sum(n / t * ln(n * t / (nx * ny))) AS mi FROM m")
def mutual_information(spark, sf):
    return L.mutual_information(read(spark, sf, "documents"), F.col("source"), F.col("lang"))


@query("""WITH e AS (SELECT quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS eq, quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS ep, quantile_cont(l_discount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS ed FROM lineitem),
t AS (SELECT l_returnflag AS y, len(list_filter(list_distinct(eq), lambda x: x < l_quantity))::VARCHAR AS q, len(list_filter(list_distinct(ep), lambda x: x < l_extendedprice))::VARCHAR AS p, len(list_filter(list_distinct(ed), lambda x: x < l_discount))::VARCHAR AS d, l_tax::VARCHAR AS x, l_linestatus AS s FROM lineitem, e),
u AS (SELECT 'l_quantity' AS feature, q AS v, y FROM t UNION ALL SELECT 'l_extendedprice', p, y FROM t UNION ALL SELECT 'l_discount', d, y FROM t UNION ALL SELECT 'l_tax', x, y FROM t UNION ALL SELECT 'l_linestatus', s, y FROM t),
c AS (SELECT feature, v, y, count(*)::DOUBLE AS n FROM u GROUP BY 1, 2, 3), m AS (SELECT *, sum(n) OVER (PARTITION BY feature, v) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM c),
r AS (SELECT feature, sum(n / t * ln(n * t / (nx * ny))) AS mi, count(DISTINCT v) AS n_values FROM m GROUP BY 1)
SELECT row_number() OVER (ORDER BY mi DESC, feature)::INT AS rank, feature, mi, n_values FROM r""")
def feature_dependence(spark, sf):
    return L.feature_dependence(read(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"])


@query("SELECT count(DISTINCT l_returnflag) AS n_distinct, 'classification' AS task FROM lineitem")
def task_type_detect(spark, sf):
    return L.task_type_detect(read(spark, sf, "lineitem"), "l_returnflag")


@query("SELECT 'o_orderstatus' AS \"column\", 'name' AS reason UNION ALL SELECT 'half', 'binary'")
def suggest_target(spark, sf):
    return L.suggest_target(read(spark, sf, "orders").select("o_custkey", "o_orderstatus", (F.col("o_orderkey") % 2).alias("half")))


@query()
def pca_reconstruction(spark, sf):
    line = read(spark, sf, "lineitem")
    return R.multivariate_drift(line.where("l_returnflag = 'A'"), line.where("l_returnflag = 'R'"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("""WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT query, vec_id AS neighbour, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS similarity FROM q, embeddings WHERE query <> vec_id)
SELECT query, neighbour, round(similarity, 6) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) <= 5""")
def cosine_similarity_topk(spark, sf):
    e = read(spark, sf, "embeddings")
    return V.cosine_topk(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


@query("""WITH d AS (SELECT o_orderkey, o_orderkey::VARCHAR AS s FROM orders) SELECT o_orderkey, list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(s, length(s) - i + 1, 1)::INT
WHEN substr(s, length(s) - i + 1, 1)::INT > 4 THEN substr(s, length(s) - i + 1, 1)::INT * 2 - 9 ELSE substr(s, length(s) - i + 1, 1)::INT * 2 END)) % 10 = 0 AS valid FROM d""")
def luhn_valid(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", luhn(F.col("o_orderkey").cast("string")).alias("valid"))


_RATES = ", ".join(f"coalesce(avg(regexp_matches(v, '{p}')::INT), 0.0)::DOUBLE AS {k}" for k, p in L.SHAPES.items())


@query(f"SELECT c AS \"column\", {_RATES} FROM (SELECT 'url' AS c, url AS v FROM pages UNION ALL SELECT 'html', html FROM pages) GROUP BY 1")
def semantic_pattern_rates(spark, sf):
    return L.semantic_pattern_rates(read(spark, sf, "pages"))


@query("SELECT * FROM (VALUES ('o_orderkey', 'id'), ('o_custkey', 'id'), ('o_orderstatus', 'category'), ('o_totalprice', 'amount'), ('o_orderdate', 'date'), ('o_orderpriority', 'category')) t(\"column\", semantic)")
def semantic_types(spark, sf):
    return L.semantic_types(read(spark, sf, "orders"))
