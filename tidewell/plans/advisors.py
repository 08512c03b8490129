"""Queries of the advisors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import advisors as V
from tidewell.operators import aggregates as A
from tidewell.plans.cleaning import messy
from tidewell.plans.registry import TABLES, query, read


@query("SELECT * FROM (VALUES ('c_name', 'target'), ('c_mktsegment', 'one_hot')) t(\"column\", encoding)")
def suggest_encoding(spark, sf):
    return V.suggest_encoding(read(spark, sf, "customer"))


@query("SELECT 'v' AS \"column\", 'log1p,robust_scale' AS suggestions")
def suggest_transform(spark, sf):
    df = read(spark, sf, "events").select(F.expr("floor(value) * floor(value)").alias("v"))
    return V.suggest_transform(df, ["v"]).select("column", F.regexp_replace("suggestions", "standard_scale,", "").alias("suggestions"))


@query("SELECT k AS key, m AS metric FROM (VALUES ('o_orderstatus'), ('o_orderpriority')) a(k), (VALUES ('o_orderkey'), ('o_totalprice')) b(m)")
def suggest_aggregations(spark, sf):
    return V.suggest_aggregations(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"))


@query()
def suggest_features(spark, sf):
    return V.suggest_features(messy(spark, sf))


@query("SELECT event_type AS insight, round(0.7 * avg(value) + 0.3 * stddev_samp(value), 6) AS score FROM events GROUP BY 1 ORDER BY score DESC, 1 LIMIT 3")
def rank_insights(spark, sf):
    found = read(spark, sf, "events").groupBy(F.col("event_type").alias("insight")).agg(F.avg("value").alias("effect"), F.stddev_samp("value").alias("novelty"))
    return V.rank_insights(found, {"effect": 0.7, "novelty": 0.3}, 3).select("insight", F.round("score", 6).alias("score"))


@query("""WITH r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 18 AS w FROM events), c AS (SELECT 'bar:' || event_type AS insight, avg(value) AS significance FROM events GROUP BY 1
UNION ALL SELECT 'hist:' || least(floor((value - lo) / w), 17)::INT, count(*)::DOUBLE FROM events, r GROUP BY 1) SELECT insight, significance, significance AS score FROM c ORDER BY score DESC, insight LIMIT 10""")
def rank_charts(spark, sf):
    e = read(spark, sf, "events")
    charts = A.group_mean_bar(e, "event_type", "value").select(F.concat(F.lit("bar:"), "event_type").alias("insight"), F.col("mean").alias("significance"))
    more = A.histogram_equal_width(e, "value").select(F.concat(F.lit("hist:"), F.col("bin").cast("string")).alias("insight"), F.col("n").cast("double").alias("significance"))
    return V.rank_insights(charts.unionByName(more), {"significance": 1.0}, 10)


@query("SELECT o_orderkey, round(greatest(0.05, least(0.99, 0.5 + 0.1 * (o_custkey % 2) + 0.2 * (o_custkey % 10 / 10.0::DOUBLE - 0.5) - 0.3 * (o_orderkey % 5 / 5.0::DOUBLE) + least(floor(o_totalprice / 1000) / 1000, 0.1) + 0.2 * (0.8 - 0.5) - 0.05 * (o_orderkey % 3))), 6) AS confidence FROM orders")
def score_proposals(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    df = read(spark, sf, "orders").select("o_orderkey", (c % 2 == 1).alias("drifted"), (c % 10 / 10).alias("quality_score"), (k % 5 / 5).alias("null_rate"), (F.floor(F.col("o_totalprice") / 1000) * 1000).alias("sample_size"), F.lit(0.8).alias("cv_score"), (k % 3).alias("flag_severity_max"))
    return V.score_proposals(df).select("o_orderkey", F.round("confidence", 6).alias("confidence"))


@query("SELECT * FROM (VALUES ('v', 'cap_outliers', 3), ('v', 'log1p', 4)) t(\"column\", operation, priority)")
def route_proposals(spark, sf):
    df = read(spark, sf, "events").select(F.expr("floor(value * value * value)").alias("v"))
    p = A.profile_numeric(df, ["v"]).join(A.profile_outliers(df, ["v"]).select("column", "pct_iqr"), "column")
    signals = p.select("column", (F.col("n_null") / (F.col("n") + F.col("n_null"))).alias("null_rate"), F.lit(0.0).alias("psi"), "pct_iqr", "skewness", F.lit(0.5).alias("unique_ratio"))
    return V.route_proposals(signals)


@query("WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS disc FROM lineitem) SELECT l_orderkey, l_linenumber, coalesce(disc, (SELECT median(disc) FROM m)) AS disc FROM m")
def retry_strategy_apply(spark, sf):
    return V.retry_strategy(messy(spark, sf).select("l_orderkey", "l_linenumber", "disc"))[0]


@query("SELECT * FROM (VALUES ('o_orderkey', 'identifier', 'drop'), ('o_orderstatus', 'category', 'one_hot'), ('same', 'constant', 'drop'), ('o_orderdate', 'datetime', 'keep')) t(\"column\", kind, advice)")
def analyst_semantic_types(spark, sf):
    return V.analyst_semantic_types(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", F.lit(1).alias("same")))


def names(spark, sf):
    return spark.createDataFrame([(t, c) for t in TABLES for c in read(spark, sf, t).columns], "`table` string, `column` string")


_WORDS = ", ".join(f"('{d}', '{w}')" for d, ws in V.DOMAIN_TOKENS.items() for w in ws)


@query(f"""WITH h AS (SELECT table_name AS "table", domain, count(DISTINCT word) AS n_hits FROM duckdb_columns() JOIN (VALUES {_WORDS}) v(domain, word) ON contains(lower(column_name), word) WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)}) GROUP BY 1, 2)
SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY n_hits DESC, domain) = 1""")
def dataset_domain(spark, sf):
    return V.dataset_domain(names(spark, sf))


@query("SELECT event_id, event_type, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(event_type || 'Count_' || user_id, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^0-9A-Za-z]+', ' ', 'g')), ' +'), lambda x: x <> ''), ' ') AS tokens FROM events")
def normalise_name_tokens(spark, sf):
    df = read(spark, sf, "events").select("event_id", "event_type", F.concat("event_type", F.lit("Count_"), F.col("user_id").cast("string")).alias("column"))
    return V.name_tokens(df).select("event_id", "event_type", F.array_join("tokens", " ").alias("tokens"))
