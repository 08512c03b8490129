"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import aggregates as A
from tidewell.plans.cleaning import MESSY, messy
from tidewell.plans.registry import query, read, sql

REVENUE = """SELECT n_name AS nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(l_extendedprice * (1 - l_discount)) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""


@query(REVENUE)
def sql_query(spark, sf):
    return sql(spark, sf, REVENUE)


@query("SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, sum(l_quantity) AS total, avg(l_discount) AS mean_disc, min(l_tax + 1) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY ALL")
def simple_aggregation(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("t", F.col("l_tax") + 1)
    return A.simple_aggregation(df, ["l_returnflag", "l_linestatus"], {"n": ("l_quantity", "count"), "total": ("l_quantity", "sum"), "mean_disc": ("l_discount", "mean"), "lo": ("t", "min"), "hi": ("l_extendedprice", "max")})


@query("SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS grouping_id, sum(o_totalprice) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def aggregation_rollup(spark, sf):
    return A.aggregation_rollup(read(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], {"total": ("o_totalprice", "sum")})


def _numeric(c, t):
    return f"""SELECT '{c}' AS "column", count({c}) AS n, 0::BIGINT AS n_null, count(DISTINCT {c}) AS n_distinct, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg({c}) AS mean, stddev_samp({c}) AS std, var_samp({c}) AS variance,
  avg(power({c} - m, 3)) / power(var_pop({c}), 1.5) AS skewness, avg(power({c} - m, 4)) / power(var_pop({c}), 2) - 3 AS kurtosis, quantile_cont({c}, 0.05) AS q05, quantile_cont({c}, 0.25) AS q25, median({c}) AS median, quantile_cont({c}, 0.75) AS q75, quantile_cont({c}, 0.95) AS q95,
  quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM {t}, (SELECT avg({c}) AS m FROM {t})"""


@query(_numeric("l_quantity", "lineitem"))
def profile_numeric(spark, sf):
    return A.profile_numeric(read(spark, sf, "lineitem"), ["l_quantity"])


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, avg(value) AS m, stddev_pop(value) AS s FROM events),
c AS (SELECT sum((value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))::INT)::BIGINT AS n_iqr, sum((abs(value - m) > 3 * s)::INT)::BIGINT AS n_z, count(*) AS n FROM events, q)
SELECT 'value' AS "column", n_iqr, n_z, n_iqr / n::DOUBLE AS pct_iqr, n_z / n::DOUBLE AS pct_z FROM c""")
def profile_outliers(spark, sf):
    return A.profile_outliers(read(spark, sf, "events"), ["value"])


@query("SELECT min(ts) AS min, max(ts) AS max, datediff('day', min(ts), max(ts))::INT AS range_days, (list_sort(list(ts)))[count(*) // 2 + 1] AS median FROM events")
def profile_datetime(spark, sf):
    return A.profile_datetime(read(spark, sf, "events"), "ts")


@query("""WITH v AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders), c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY "column") AS p FROM c) SELECT "column", count(*) AS n_distinct, (list(value ORDER BY n DESC, value))[1] AS mode, max(n) AS mode_freq, -sum(p * log2(p)) AS entropy FROM p GROUP BY "column\"""")
def profile_categorical(spark, sf):
    return A.profile_categorical(read(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("SELECT 'event_type' AS \"column\", event_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type)::INT AS rank FROM events GROUP BY event_type")
def eda_distributions(spark, sf):
    return A.top_values(read(spark, sf, "events"), ["event_type"], 20)


@query("""SELECT "column", r AS ratio, CASE WHEN r < 0.05 THEN 'low' WHEN r < 0.5 THEN 'medium' WHEN r < 0.95 THEN 'high' ELSE 'unique' END AS tier FROM (
SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey) / count(*)::DOUBLE AS r FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) / count(*)::DOUBLE FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) / count(*)::DOUBLE FROM orders)""")
def cardinality_tier(spark, sf):
    return A.cardinality_tier(read(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("SELECT 'v' AS \"column\", unnest(['HIGH_SKEW', 'HEAVY_TAILS', 'HIGH_OUTLIER_RATE_IQR', 'HIGH_CARDINALITY']) AS flag")
def analyst_flags(spark, sf):
    return A.analyst_flags(read(spark, sf, "events").select(F.expr("pow(value, 4) + event_id / 1e6").alias("v")), ["v"])


@query("""SELECT 'o_custkey' AS "column", 'bigint' AS dtype, 0::BIGINT AS n_null, 0.0::DOUBLE AS null_rate, count(DISTINCT o_custkey) AS n_unique, min(o_custkey)::VARCHAR AS min, max(o_custkey)::VARCHAR AS max, false AS is_pk_candidate FROM orders
UNION ALL SELECT 'o_orderkey', 'bigint', 0, 0.0, count(DISTINCT o_orderkey), min(o_orderkey)::VARCHAR, max(o_orderkey)::VARCHAR, true FROM orders""")
def column_metadata(spark, sf):
    return A.column_metadata(read(spark, sf, "orders").select("o_orderkey", "o_custkey"))


@query("""WITH m AS (SELECT avg(c_acctbal) AS m FROM customer), s AS (SELECT count(*)::DOUBLE AS n, avg(power(c_acctbal - m, 3)) / power(var_pop(c_acctbal), 1.5) AS g1, avg(power(c_acctbal - m, 4)) / power(var_pop(c_acctbal), 2) - 3 AS g2 FROM customer, m)
SELECT 'c_acctbal' AS "column", count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max, median(c_acctbal) AS median, stddev_samp(c_acctbal) / abs(avg(c_acctbal)) AS cv, max(c_acctbal) - min(c_acctbal) AS range,
(SELECT g1 * sqrt(n * (n - 1)) / (n - 2) FROM s) AS skewness, (SELECT (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) FROM s) AS kurtosis, sum((c_acctbal = 0)::INT)::BIGINT AS n_zero, sum((c_acctbal < 0)::INT)::BIGINT AS n_negative, count(DISTINCT c_acctbal) AS n_unique FROM customer""")
def descriptive_stats(spark, sf):
    return A.descriptive_stats(read(spark, sf, "customer"), ["c_acctbal"])


@query(f"WITH m AS ({MESSY}) SELECT 'disc' AS \"column\", sum((disc IS NULL)::INT)::BIGINT AS n_missing, 100 * avg((disc IS NULL)::INT) AS pct_missing FROM m")
def eda_missing(spark, sf):
    return A.eda_missing(messy(spark, sf))


@query("SELECT 'value' AS \"column\", sum((abs(value - m) > 3 * s)::INT)::BIGINT AS n_anomaly, 100 * avg((abs(value - m) > 3 * s)::INT) AS pct, max(abs(value - m) / s) AS max_z FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)")
def zscore_anomaly_summary(spark, sf):
    return A.zscore_anomaly_summary(read(spark, sf, "events"), ["value"])


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem),
c AS (SELECT sum((l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a))::INT)::BIGINT AS n_iqr, sum((abs(l_extendedprice - m) > 3 * s)::INT)::BIGINT AS n_z, count(*) AS n FROM lineitem, q)
SELECT 'l_extendedprice' AS "column", n_iqr, n_z, n_iqr / n::DOUBLE AS pct_iqr, n_z / n::DOUBLE AS pct_z FROM c""")
def eda_outliers(spark, sf):
    return A.profile_outliers(read(spark, sf, "lineitem"), ["l_extendedprice"])


@query("""WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 18 AS w FROM events) SELECT least(floor((value - lo) / w), 17)::INT AS bin, lo + least(floor((value - lo) / w), 17) * w AS lo, lo + (least(floor((value - lo) / w), 17) + 1) * w AS hi, count(*) AS n FROM events, e GROUP BY ALL""")
def histogram_equal_width(spark, sf):
    return A.histogram_equal_width(read(spark, sf, "events"), "value")


NULLY = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS a, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS b, CASE WHEN o_orderkey % 6 = 0 THEN 1 END AS c, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice END AS d, o_totalprice AS p FROM orders"


@query(f"WITH x AS ({NULLY}), f AS (SELECT ((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT) / 3.0 AS f FROM x) SELECT CASE WHEN f = 0 THEN '0%' WHEN f <= 0.25 THEN '1-25%' WHEN f <= 0.75 THEN '26-75%' WHEN f < 1 THEN '76-99%' ELSE '100%' END AS bucket, count(*) AS n FROM f GROUP BY 1")
def missingness_row_buckets(spark, sf):
    return A.missingness_row_buckets(sql(spark, sf, NULLY), ["a", "b", "c"])


@query(f"WITH x AS ({NULLY}) SELECT 'a' AS a, 'c' AS b, corr((x.a IS NULL)::INT, (x.c IS NULL)::INT) AS r FROM x")
def null_correlation(spark, sf):
    return A.null_correlation(sql(spark, sf, NULLY), ["a", "c"])


@query("SELECT 'v' AS \"column\", 0.5::DOUBLE AS null_rate, 'MNAR_SUSPECTED' AS mechanism UNION ALL SELECT 'w', avg((o_totalprice > 250000)::INT), 'MAR' FROM orders")
def missingness_mechanism(spark, sf):
    df = sql(spark, sf, "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS v, CASE WHEN o_totalprice <= 250000 THEN 1 END AS w, o_totalprice FROM orders")
    return A.missingness_mechanism(df, ["v", "w"], ["o_totalprice"]).withColumn("null_rate", F.when(F.col("column") == "v", F.round("null_rate", 1)).otherwise(F.col("null_rate")))


@query("WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) SELECT sum(n - 1)::BIGINT AS n_duplicates, sum(n)::BIGINT AS n_rows, sum(n - 1) / sum(n)::DOUBLE AS duplicate_rate FROM c")
def duplicate_stats(spark, sf):
    return A.duplicate_stats(read(spark, sf, "orders").select("o_custkey", "o_orderstatus"))


@query(f"SELECT (avg((a IS NULL)::INT) + avg((b IS NULL)::INT) + avg((c IS NULL)::INT)) / 3 AS null_rate FROM ({NULLY})")
def overall_null_rate(spark, sf):
    return A.overall_null_rate(sql(spark, sf, NULLY).select("a", "b", "c"))


@query("""WITH d AS (SELECT sum(n - 1) / sum(n)::DOUBLE AS r FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus, o_totalprice)),
p AS (SELECT 0.0::DOUBLE AS null_penalty, least(1.0, (SELECT r FROM d) / 0.05) AS dup_penalty, sum((o_totalprice > 300000)::INT) / count(*)::DOUBLE AS range_penalty, 1 / 3.0::DOUBLE AS cat_penalty FROM orders)
SELECT *, 1 - (0.2 * dup_penalty + 0.2 * range_penalty + 0.15 * cat_penalty) AS quality_score, CASE WHEN 1 - (0.2 * dup_penalty + 0.2 * range_penalty + 0.15 * cat_penalty) < 0.75 THEN 'WARN' ELSE 'PASSED' END AS status FROM p""")
def quality_gate(spark, sf):
    return A.quality_gate(read(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice"), {"o_totalprice": (0, 300000)}, {"o_orderstatus": ["F", "O"]})


@query("""WITH d AS (SELECT sum(n - 1) / sum(n)::DOUBLE AS r FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus))
SELECT 'completeness' AS metric, 1.0::DOUBLE AS score UNION ALL SELECT 'uniqueness', (count(DISTINCT o_custkey) + count(DISTINCT o_orderstatus)) / 2.0 / count(*) FROM orders UNION ALL SELECT 'consistency', 1.0 UNION ALL SELECT 'validity', 1.0 UNION ALL SELECT 'integrity', 1 - r FROM d""")
def quality_radar(spark, sf):
    return A.quality_radar(read(spark, sf, "orders").select("o_custkey", "o_orderstatus"))


@query(f"WITH x AS ({NULLY}) SELECT round(100 - 30 * (avg((a IS NULL)::INT) + avg((b IS NULL)::INT) + avg((p IS NULL)::INT)) / 3 - 4, 2) AS health FROM x")
def data_health_score(spark, sf):
    return A.data_health_score(sql(spark, sf, NULLY).select("a", "b", "p"), n_violations=2)


@query("SELECT event_type, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1")
def group_mean_bar(spark, sf):
    return A.group_mean_bar(read(spark, sf, "events"), "event_type", "value")


@query("SELECT l_returnflag, avg(l_quantity) FILTER (l_linestatus = 'F') AS \"F\", avg(l_quantity) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def stacked_group_mean(spark, sf):
    return A.stacked_group_mean(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"])


@query("""WITH s AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS total FROM orders WHERE month(o_orderdate) <> 5 GROUP BY 1),
m AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM s) SELECT month, coalesce(total, 0) AS total FROM m LEFT JOIN s USING (month)""")
def monthly_trend(spark, sf):
    return A.monthly_trend(read(spark, sf, "orders").where(F.month("o_orderdate") != 5), "o_orderdate", "o_totalprice")


@query("""WITH s AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2),
m AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM s) SELECT month, o_orderstatus, coalesce(total, 0) AS total FROM m CROSS JOIN (SELECT DISTINCT o_orderstatus FROM s) LEFT JOIN s USING (month, o_orderstatus)""")
def monthly_trend_by_category(spark, sf):
    return A.monthly_trend(read(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderstatus")


@query("""WITH c AS (SELECT o_custkey::VARCHAR AS v, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS k FROM c)
SELECT CASE WHEN k <= 6 THEN v ELSE 'Other' END AS value, sum(n)::BIGINT AS n, sum(n) / (SELECT sum(n) FROM c) AS share FROM r GROUP BY 1""")
def category_share(spark, sf):
    return A.category_share(read(spark, sf, "orders"), "o_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20")
def category_counts(spark, sf):
    return A.category_counts(read(spark, sf, "orders"), "o_custkey")


@query("SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE (SELECT corr(l_extendedprice, l_quantity) FROM lineitem) END AS r FROM (VALUES ('l_quantity'), ('l_extendedprice')) x(a), (VALUES ('l_quantity'), ('l_extendedprice')) y(b)")
def correlation_heatmap_data(spark, sf):
    return A.correlation_heatmap_data(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("""WITH t AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS a, avg(c_nationkey) AS b FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 6)
SELECT c_mktsegment, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS c_acctbal, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS c_nationkey FROM t""")
def segment_radar(spark, sf):
    return A.segment_radar(read(spark, sf, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"])


@query("""WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1 ORDER BY total DESC, 1 LIMIT 8)
SELECT o_custkey, total, 100 * sum(total) OVER (ORDER BY total DESC, o_custkey ROWS UNBOUNDED PRECEDING) / sum(total) OVER () AS cumulative_pct FROM t""")
def funnel_cumulative(spark, sf):
    return A.funnel_cumulative(read(spark, sf, "orders"), "o_custkey", "o_totalprice")


@query("SELECT 'l_quantity' AS \"column\", min(l_quantity) AS min, avg(l_quantity) AS avg, max(l_quantity) AS max FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), avg(l_extendedprice), max(l_extendedprice) FROM lineitem")
def range_summary(spark, sf):
    return A.range_summary(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("SELECT 'orders' AS kpi, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'revenue', sum(o_totalprice) FROM orders UNION ALL SELECT 'open_share', avg((o_orderstatus = 'O')::INT) FROM orders")
def kpi_tracking(spark, sf):
    return A.kpis(read(spark, sf, "orders"), {"orders": F.count("*"), "revenue": F.sum("o_totalprice"), "open_share": F.avg((F.col("o_orderstatus") == "O").cast("int"))})


@query("SELECT 'rows' AS kpi, count(*)::DOUBLE AS value FROM lineitem UNION ALL SELECT 'parts', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'mean_price', avg(l_extendedprice) FROM lineitem")
def executive_summary(spark, sf):
    return A.kpis(read(spark, sf, "lineitem"), {"rows": F.count("*"), "parts": F.count_distinct("l_partkey"), "mean_price": F.avg("l_extendedprice")})


@query("SELECT o_orderkey, 0.5 * (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) + 0.5 * (o_custkey - min(o_custkey) OVER ()) / (max(o_custkey) OVER () - min(o_custkey) OVER ()) AS risk FROM orders")
def risk_scoring(spark, sf):
    return A.risk_scoring(read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), {"o_totalprice": 0.5, "o_custkey": 0.5}).select("o_orderkey", "risk")


@query("""WITH a AS (SELECT DISTINCT user_id, date_trunc('week', ts)::TIMESTAMP AS p FROM events), f AS (SELECT user_id, min(p) AS cohort FROM a GROUP BY 1), s AS (SELECT cohort, count(*) AS size FROM f GROUP BY 1)
SELECT cohort, (datediff('day', cohort, p) // 7)::INT AS "offset", count(*) AS n, count(*) / any_value(size)::DOUBLE AS retention FROM a JOIN f USING (user_id) JOIN s USING (cohort) GROUP BY 1, 2""")
def cohort_retention(spark, sf):
    return A.cohort_retention(read(spark, sf, "events"), "user_id", "ts").withColumn("cohort", F.col("cohort").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT source, count(*) AS n, avg(quality) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1), o AS (SELECT avg(quality) AS r FROM documents JOIN labels USING (doc_id))
SELECT source, n, rate, rate / r AS parity, CASE WHEN rate / r < 0.8 THEN 'FAIL' WHEN rate / r < 0.9 THEN 'WARN' ELSE 'PASS' END AS verdict FROM g, o WHERE n >= 10""")
def fairness_parity(spark, sf):
    df = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id")
    return A.fairness_parity(df, "source", F.col("quality") == 1)


@query()
def approx_profile(spark, sf):
    return A.approx_profile(read(spark, sf, "lineitem"), ["l_partkey", "l_extendedprice"])
