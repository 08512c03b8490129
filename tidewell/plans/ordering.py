"""Queries of windows, sorting, sampling, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import ordering as D
from tidewell.plans.registry import query, read

U = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"SELECT event_id, (value - lag(value) OVER ({U})) / lag(value) OVER ({U}) AS value_pct_change FROM events")
def percent_change(spark, sf):
    return D.percent_change(read(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value_pct_change")


@query("""SELECT event_id, avg(value) OVER w AS value_mean, count(value) OVER w AS value_n FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS s FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""")
def windowed_aggregation(spark, sf):
    return D.windowed_aggregation(read(spark, sf, "events"), "value", "ts", 86400, ["user_id"]).select("event_id", "value_mean", "value_n")


@query("SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rank FROM lineitem")
def rank_average(spark, sf):
    return D.rank_average(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").drop("l_quantity")


@query("SELECT event_id, (rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / count(*) OVER () AS value_pct_rank FROM events")
def percent_rank_values(spark, sf):
    return D.percent_rank_values(read(spark, sf, "events").select("event_id", "value"), "value").drop("value")


@query("""WITH g AS (SELECT event_type, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events)
SELECT event_type, count(gap) AS n, median(gap) AS median_gap, max(gap) AS max_gap FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def interarrival_stats(spark, sf):
    return D.interarrival_stats(read(spark, sf, "events"), "ts", ["event_type"])


@query("""WITH n AS (SELECT *, coalesce((epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 3600)::INT, 0) AS x FROM events)
SELECT event_id, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM n""")
def session_breaks(spark, sf):
    return D.session_breaks(read(spark, sf, "events"), "ts", ["user_id"], 3600).select("event_id", "session")


@query("SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS o_totalprice_share FROM orders")
def cumulative_share(spark, sf):
    return D.cumulative_share(read(spark, sf, "orders"), "o_totalprice", ["o_orderkey"], ["o_custkey"]).select("o_orderkey", "o_totalprice_share")


@query("SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10)::INT AS bucket FROM events")
def row_bucketing(spark, sf):
    return D.row_bucketing(read(spark, sf, "events"), 10, ["ts", "event_id"], ["user_id"]).select("event_id", "bucket")


@query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 25")
def topk_rows(spark, sf):
    return D.topk_rows(read(spark, sf, "events").select("event_id", "value"), ["value", "event_id"], 25)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_insights(spark, sf):
    return D.topk_by_group(read(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("SELECT event_type, round(avg(value), 6) AS significance FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
def topk_charts(spark, sf):
    return D.topk_rows(read(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("significance")), [F.desc("significance"), "event_type"], 2)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40")
def page_rows(spark, sf):
    return D.page_rows(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 40, 20)


HASH = "('0x' || substr(md5('{}' || o_orderkey::VARCHAR), 1, 8))::BIGINT"


@query(f"SELECT o_orderkey FROM orders WHERE {HASH.format('sample')} < 429496729")
def sample_rows(spark, sf):
    return D.sample_rows(read(spark, sf, "orders"), "o_orderkey", 0.1).select("o_orderkey")


@query(f"SELECT o_orderkey, CASE WHEN {HASH.format('split')} < 858993459 THEN 'holdout' WHEN {HASH.format('split')} < 1717986918 THEN 'val' ELSE 'train' END AS split FROM orders")
def train_val_holdout_split(spark, sf):
    return D.train_val_holdout_split(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("""WITH e AS (SELECT min(epoch_us(ts)) AS lo, (max(epoch_us(ts)) - min(epoch_us(ts))) // 5 + 1 AS step FROM events), p AS (SELECT event_id, (epoch_us(ts) - lo) // step AS part FROM events, e)
SELECT event_id, fold::INT AS fold, 'train' AS role FROM p, range(1, 5) r(fold) WHERE part < fold UNION ALL SELECT event_id, part::INT, 'test' FROM p WHERE part >= 1""")
def temporal_splits(spark, sf):
    return D.temporal_splits(read(spark, sf, "events").select("event_id", "ts"), "ts", 4).drop("ts")


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('fold' || o_orderkey::VARCHAR)) - 1) % 5)::INT AS fold FROM orders")
def stratified_kfold(spark, sf):
    return D.stratified_kfold(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 5).drop("o_orderstatus")


@query("SELECT c_custkey AS key, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier")
def union_sources(spark, sf):
    a = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return D.union_sources([a, read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))])


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= '1997-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < '1997-01-01'")
def new_categories(spark, sf):
    o = read(spark, sf, "orders")
    return D.new_categories(o.where("o_orderdate >= '1997-01-01'"), o.where("o_orderdate < '1997-01-01'"), "o_custkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < '1997-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= '1997-01-01'")
def missing_categories(spark, sf):
    o = read(spark, sf, "orders")
    return D.missing_categories(o.where("o_orderdate >= '1997-01-01'"), o.where("o_orderdate < '1997-01-01'"), "o_custkey")


@query("SELECT column_name AS name FROM duckdb_columns() WHERE table_name = 'documents' INTERSECT SELECT column_name FROM duckdb_columns() WHERE table_name = 'labels'")
def shared_columns(spark, sf):
    return D.shared_columns(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("SELECT 'quality' AS name, 'gained' AS change UNION ALL SELECT 'toxic', 'gained' UNION ALL SELECT unnest(['text', 'lang', 'source', 'n_chars']), 'lost'")
def gained_lost_features(spark, sf):
    return D.gained_lost_features(read(spark, sf, "labels"), read(spark, sf, "documents"))


@query("""WITH v AS (SELECT 'p' || l_partkey AS "column", CASE WHEN l_quantity > 48 THEN 'CRITICAL' WHEN l_quantity > 30 THEN 'ERROR' ELSE 'WARNING' END AS severity, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT * FROM v QUALIFY rank() OVER (PARTITION BY "column" ORDER BY list_position(['CRITICAL', 'ERROR', 'WARNING'], severity)) = 1""")
def conflict_resolution(spark, sf):
    sev = F.when(F.col("l_quantity") > 48, "CRITICAL").when(F.col("l_quantity") > 30, "ERROR").otherwise("WARNING")
    v = read(spark, sf, "lineitem").groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("column"), sev.alias("severity")).agg(F.count("*").alias("n"))
    return D.conflict_resolution(v)
