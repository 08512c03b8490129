"""Queries of the feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import features as X
from tidewell.plans.registry import query, read

W = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"SELECT event_id, lag(value, 1) OVER ({W}) AS value_lag1, lag(value, 3) OVER ({W}) AS value_lag3 FROM events")
def lag_features(spark, sf):
    return X.lag_features(read(spark, sf, "events"), "value", [1, 3], ["ts", "event_id"], ["user_id"]).select("event_id", "value_lag1", "value_lag3")


@query(f"""SELECT event_id, avg(value) OVER r AS value_roll5_mean, sum(value) OVER r AS value_roll5_sum, min(value) OVER r AS value_roll5_min, max(value) OVER r AS value_roll5_max
FROM events WINDOW r AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_features(spark, sf):
    return X.rolling_features(read(spark, sf, "events"), "value", 5, ["mean", "sum", "min", "max"], ["ts", "event_id"], ["user_id"]).drop("ts", "user_id", "event_type", "value", "props")


@query("""SELECT event_id, year(ts)::INT AS ts_year, month(ts)::INT AS ts_month, day(ts)::INT AS ts_day, (isodow(ts) - 1)::INT AS ts_dayofweek, hour(ts)::INT AS ts_hour, quarter(ts)::INT AS ts_quarter, (isodow(ts) >= 6)::INT AS ts_is_weekend FROM events""")
def calendar_features(spark, sf):
    return X.calendar_features(read(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type) / count(*) OVER ()::DOUBLE AS event_type_freq FROM events")
def frequency_encode(spark, sf):
    return X.frequency_encode(read(spark, sf, "events").select("event_id", "event_type"), "event_type").drop("event_type")


@query("SELECT event_id, avg(value) OVER (PARTITION BY event_type) AS event_type_te FROM events")
def target_encode(spark, sf):
    return X.target_encode(read(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", "value").drop("event_type", "value")


@query("SELECT event_id, n FROM events JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) USING (user_id)")
def lookup_encode(spark, sf):
    df = read(spark, sf, "events").select("event_id", "user_id")
    return X.lookup(df, df.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").drop("user_id")


@query()
def hash_encode(spark, sf):
    return X.hash_encode(read(spark, sf, "events").select("event_id", "event_type"), "event_type", 64)


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type_code FROM events")
def label_encode(spark, sf):
    return X.label_encode(read(spark, sf, "events").select("event_id", "event_type"), "event_type").drop("event_type")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE -1 END AS o_orderpriority_ord FROM orders")
def ordinal_encode(spark, sf):
    return X.ordinal_encode(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).drop("o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS \"l_returnflag_A\", (l_returnflag = 'N')::INT AS \"l_returnflag_N\", (l_returnflag = 'R')::INT AS \"l_returnflag_R\" FROM lineitem")
def one_hot_encode(spark, sf):
    return X.one_hot_encode(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["A", "N", "R"]).drop("l_returnflag")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
top AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 200),
raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN top USING (term))
SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw""")
def tfidf_vectorize(spark, sf):
    return X.tfidf_vectorize(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query("SELECT c_custkey, ln(1 + greatest(c_acctbal, 0)) AS c_acctbal_log1p FROM customer")
def log1p_transform(spark, sf):
    return X.log1p_transform(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).drop("c_acctbal")


@query("SELECT c_custkey, sqrt(greatest(c_acctbal, 0)) AS c_acctbal_sqrt FROM customer")
def sqrt_transform(spark, sf):
    return X.sqrt_transform(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).drop("c_acctbal")


@query("SELECT event_id, value * value * value AS v, ln(1 + value * value * value) AS v_log1p FROM events")
def auto_log1p(spark, sf):
    return X.auto_log1p(read(spark, sf, "events").select("event_id", F.expr("value * value * value").alias("v")), ["v"])


@query()
def yeo_johnson(spark, sf):
    return X.yeo_johnson(read(spark, sf, "events").select("event_id", "value"), "value")


@query('SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS "l_quantity*l_quantity", l_quantity * l_tax AS "l_quantity*l_tax", l_tax * l_tax AS "l_tax*l_tax" FROM lineitem')
def polynomial_features(spark, sf):
    return X.polynomial_features(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]).drop("l_quantity", "l_tax")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events)
SELECT event_id, (value > a)::INT + (value > b)::INT + (value > c)::INT AS value_bin FROM events, q""")
def bin_quantile(spark, sf):
    return X.bin_quantile(read(spark, sf, "events").select("event_id", "value"), "value").drop("value")


@query("WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events) SELECT event_id, least(floor((value - lo) / w), 9)::INT AS value_bin FROM events, m")
def bin_width(spark, sf):
    return X.bin_width(read(spark, sf, "events").select("event_id", "value"), "value").drop("value")


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_discount AS l_quantity_x_l_discount FROM lineitem")
def interaction_features(spark, sf):
    return X.interaction_features(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), [("l_quantity", "l_discount")]).drop("l_quantity", "l_discount")


@query("SELECT event_id, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS value_zscore FROM events")
def zscore_scale(spark, sf):
    return X.zscore_scale(read(spark, sf, "events").select("event_id", "value"), ["value"]).drop("value")


@query("SELECT event_id, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value_minmax FROM events")
def minmax_scale(spark, sf):
    return X.minmax_scale(read(spark, sf, "events").select("event_id", "value"), ["value"]).drop("value")


@query("WITH q AS (SELECT median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS r FROM events) SELECT event_id, (value - m) / r AS value_robust FROM events, q")
def robust_scale(spark, sf):
    return X.robust_scale(read(spark, sf, "events").select("event_id", "value"), ["value"]).drop("value")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / (l_extendedprice * (1 - l_discount) + 1e-8) AS l_extendedprice_div_net, l_extendedprice * (l_extendedprice * (1 - l_discount)) AS l_extendedprice_mul_net FROM lineitem")
def synthesize_features(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.expr("l_extendedprice * (1 - l_discount)").alias("net"))
    return X.synthesize_features(df, ["l_extendedprice", "net"]).drop("l_extendedprice", "net")


@query()
def class_balance_resample(spark, sf):
    df = read(spark, sf, "labels").withColumn("rare", (F.col("doc_id") % 11 == 0).cast("int"))
    return X.class_balance_resample(df, "rare", "doc_id")


@query()
def smote(spark, sf):
    df = read(spark, sf, "lineitem").select(F.col("l_orderkey"), "l_returnflag", "l_quantity", "l_discount")
    return X.smote(df, "l_returnflag", "R", ["l_quantity", "l_discount"], "l_orderkey")


@query("SELECT event_type AS feature, sum(value) AS importance FROM events GROUP BY 1 ORDER BY importance DESC, feature LIMIT 3")
def feature_select_topk(spark, sf):
    return X.feature_select_topk(read(spark, sf, "events").groupBy(F.col("event_type").alias("feature")).agg(F.sum("value").alias("importance")), 3)


@query()
def ml_pipeline_build(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    return X.ml_pipeline(["l_quantity", "l_discount"], ["l_returnflag"]).fit(df).transform(df).select("l_orderkey", "l_linenumber", F.col("features").cast("string").alias("features"))
