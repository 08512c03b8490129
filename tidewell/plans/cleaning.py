"""Queries of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import cleaning as C
from tidewell.plans.registry import query, read, sql

# a messy frame: nulls, sentinels and words derived from keys, the same way in both engines
MESSY = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS disc,
  CASE WHEN l_orderkey % 10 = 0 THEN -999 WHEN l_orderkey % 10 = 1 THEN -1 ELSE l_quantity END AS qty,
  CASE WHEN l_orderkey % 5 = 0 THEN ' N/A ' WHEN l_orderkey % 5 = 1 THEN 'null' WHEN l_orderkey % 5 = 2 THEN '?' ELSE l_returnflag END AS flag,
  CASE WHEN l_orderkey % 11 = 0 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR(10)) END AS num_text,
  CASE WHEN l_orderkey % 3 = 0 THEN 'yes' ELSE 'No ' END AS yes_no FROM lineitem"""


def messy(spark, sf):
    return sql(spark, sf, MESSY)


NULLS = "('null','none','n/a','na','nan','nil','#n/a','#na','-','.','—','undefined','')"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN lower(trim(flag)) NOT IN {NULLS} THEN flag END AS flag FROM ({MESSY})")
def unify_nulls(spark, sf):
    return C.unify_nulls(messy(spark, sf).select("l_orderkey", "l_linenumber", "flag"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN qty NOT IN (-1,-99,-999,-9999,-99999,9999,99999,999999) THEN qty END AS qty, CASE WHEN flag NOT IN ('?', 'null') THEN flag END AS flag FROM ({MESSY})")
def replace_sentinels(spark, sf):
    return C.replace_sentinels(messy(spark, sf).select("l_orderkey", "l_linenumber", "qty", "flag"), ["qty", "flag"])


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN qty NOT IN (-999, -1) THEN qty END AS qty FROM ({MESSY})")
def sentinel_rate_filter(spark, sf):
    return C.sentinel_rate_filter(messy(spark, sf).select("l_orderkey", "l_linenumber", "qty"), ["qty"], [-999, -1, 9999])


ZEROS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 < 3 THEN 0 ELSE l_quantity END AS q FROM lineitem"


@query(f"WITH z AS ({ZEROS}) SELECT l_orderkey, l_linenumber, CASE WHEN q <> 0 THEN q ELSE (SELECT median(q) FROM z WHERE q <> 0) END AS q FROM z")
def zero_to_null_impute(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 5 < 3, 0.0).otherwise(F.col("l_quantity")).alias("q"))
    return C.zero_to_null_impute(df, ["q"])


@query("SELECT o_orderkey, '{\"k\":' || o_custkey || ',\"s\":\"' || o_orderstatus || '\"}' AS pair, '[' || o_orderkey || ',' || o_custkey || ']' AS list FROM orders")
def stringify_complex(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s")).alias("pair"), F.array("o_orderkey", "o_custkey").alias("list"))
    return C.stringify_complex(df)


@query("SELECT item_id, base64(encode(text)) AS raw FROM benchmark")
def encode_binary_base64(spark, sf):
    return C.encode_binary_base64(read(spark, sf, "benchmark").select("item_id", F.col("text").cast("binary").alias("raw")))


@query('SELECT o_orderkey, o_custkey AS "a.k", o_orderstatus AS "a.b.s", o_orderkey || \', \' || o_custkey AS "a.l" FROM orders')
def flatten_struct(spark, sf):
    a = F.struct(F.col("o_custkey").alias("k"), F.struct(F.col("o_orderstatus").alias("s")).alias("b"), F.array("o_orderkey", "o_custkey").alias("l"))
    return C.flatten_struct(read(spark, sf, "orders").select("o_orderkey", a.alias("a")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def expand_json_strings(spark, sf):
    return C.expand_json_strings(read(spark, sf, "events").select("event_id", "props"), "props", "k BIGINT")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def split_single_column(spark, sf):
    df = read(spark, sf, "orders").select(F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority").alias("line"))
    return C.split_single_column(df, "line", ["key", "status", "priority"])


@query(f"SELECT l_orderkey, l_linenumber, TRY_CAST(num_text AS DOUBLE) AS num_text, lower(trim(yes_no)) = 'yes' AS yes_no FROM ({MESSY})")
def coerce_types(spark, sf):
    return C.coerce_types(messy(spark, sf).select("l_orderkey", "l_linenumber", "num_text", "yes_no"))


@query("SELECT o_orderkey, o_totalprice AS price FROM orders")
def coerce_mixed_numeric(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("$ "), F.col("o_totalprice").cast("string")).alias("price"))
    return C.coerce_mixed_numeric(df, "price")


@query("SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS created_at FROM events")
def coerce_epochs(spark, sf):
    df = read(spark, sf, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"))
    return C.coerce_epochs(df, ["created_at"]).withColumn("created_at", F.col("created_at").cast("timestamp").cast("timestamp_ntz"))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day FROM orders")
def coerce_date_strings(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return C.coerce_date_strings(df, ["day"]).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events")
def standardise_timestamps(spark, sf):
    return C.standardise_timestamps(read(spark, sf, "events").select("event_id", "ts"), ["ts"])


@query(f"SELECT l_orderkey, l_linenumber, trim(flag) AS flag, trim(yes_no) AS yes_no FROM ({MESSY})")
def strip_strings(spark, sf):
    return C.strip_strings(messy(spark, sf).select("l_orderkey", "l_linenumber", "flag", "yes_no"))


@query(f"SELECT l_orderkey, l_linenumber, TRY_CAST(num_text AS BIGINT) AS num_text FROM ({MESSY})")
def cast_columns(spark, sf):
    return C.cast_columns(messy(spark, sf).select("l_orderkey", "l_linenumber", "num_text"), {"num_text": "bigint"})


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN lower(trim(yes_no)) = 'yes' THEN 1 ELSE 0 END AS yes_no FROM ({MESSY})")
def normalise_booleans(spark, sf):
    return C.normalise_booleans(messy(spark, sf).select("l_orderkey", "l_linenumber", "yes_no"), ["yes_no"])


SPARSE = "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 20 = 0 THEN o_custkey END AS rare, 7 AS same, o_orderstatus, o_orderstatus AS copy FROM orders"


def sparse(spark, sf):
    return sql(spark, sf, SPARSE)


@query(f"SELECT o_orderkey, o_totalprice, same, o_orderstatus, copy FROM ({SPARSE})")
def drop_high_null_columns(spark, sf):
    return C.drop_high_null_columns(sparse(spark, sf))


@query(f"SELECT o_orderkey, o_totalprice, rare, o_orderstatus, copy FROM ({SPARSE})")
def drop_constant_columns(spark, sf):
    return C.drop_constant_columns(sparse(spark, sf))


@query(f"SELECT o_orderkey, o_totalprice, rare, same, o_orderstatus FROM ({SPARSE})")
def drop_duplicate_columns(spark, sf):
    return C.drop_duplicate_columns(sparse(spark, sf))


@query("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def drop_duplicates(spark, sf):
    return C.drop_duplicates(read(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query(f"SELECT l_orderkey, l_linenumber, disc FROM ({MESSY}) WHERE disc IS NOT NULL")
def drop_null_rows(spark, sf):
    return C.drop_null_rows(messy(spark, sf).select("l_orderkey", "l_linenumber", "disc"))


@query(f"""WITH m AS ({MESSY}), n AS (SELECT *, CASE WHEN flag IN ('R', 'A', 'N') THEN flag END AS f FROM m) SELECT l_orderkey, l_linenumber, coalesce(disc, (SELECT median(disc) FROM n)) AS disc,
  coalesce(f, (SELECT f FROM n WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)) AS f FROM n""")
def impute_simple(spark, sf):
    df = messy(spark, sf).withColumn("f", F.when(F.col("flag").isin("R", "A", "N"), F.col("flag")))
    return C.impute_simple(df.select("l_orderkey", "l_linenumber", "disc", "f"), {"disc": "median", "f": "mode"})


TIERS = "SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 1.0 END AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS b, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice END AS c FROM orders"


@query(f"WITH t AS ({TIERS}) SELECT o_orderkey, coalesce(b, (SELECT median(b) FROM t)) AS b, c FROM t")
def impute_tiered(spark, sf):
    return C.impute_tiered(sql(spark, sf, TIERS))


GAPS = "SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events"


@query(f"""SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM ({GAPS})""")
def impute_ffill_bfill(spark, sf):
    df = read(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return C.impute_ffill_bfill(df, ["v"], ["ts", "event_id"], ["user_id"]).select("event_id", "v")


@query(f"SELECT l_orderkey, l_linenumber, (disc IS NULL)::INT AS disc_was_null FROM ({MESSY})")
def add_null_indicators(spark, sf):
    return C.add_null_indicators(messy(spark, sf).select("l_orderkey", "l_linenumber", "disc"), ["disc"]).drop("disc")


WIDE = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS a, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS b, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS c, CASE WHEN o_orderkey % 7 = 0 THEN 1 END AS d FROM orders"


@query(f"SELECT o_orderkey, ((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT + (d IS NULL)::INT) >= 3 AS quarantined FROM ({WIDE})")
def quarantine_rows(spark, sf):
    kept, bad = C.quarantine_rows(sql(spark, sf, WIDE), 0.75, ["a", "b", "c", "d"])
    return kept.select("o_orderkey", F.lit(False).alias("quarantined")).unionByName(bad.select("o_orderkey", F.lit(True).alias("quarantined")))


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)) AS value FROM events, q""")
def cap_outliers(spark, sf):
    return C.cap_outliers(read(spark, sf, "events").select("event_id", "value"), ["value"])


@query(f"SELECT l_orderkey, l_linenumber, TRY_CAST(num_text AS DOUBLE) AS num_text, yes_no FROM ({MESSY})")
def schema_relax(spark, sf):
    return C.schema_relax(messy(spark, sf).select("l_orderkey", "l_linenumber", "num_text", "yes_no"))


AUTO = "SELECT event_id, value * value * value AS v, CASE WHEN event_id % 4 > 0 THEN user_id END AS u, 1 AS same FROM events"


@query(f"WITH a AS ({AUTO}) SELECT event_id, CASE WHEN abs((SELECT skewness(v) * (count(v) - 2) / sqrt(count(v) * (count(v) - 1.0)) FROM a)) > 2 THEN ln(1 + v) ELSE v END AS v, coalesce(u, (SELECT median(u) FROM a)) AS u FROM a")
def auto_correct(spark, sf):
    df = read(spark, sf, "events").select("event_id", F.expr("value * value * value").alias("v"), F.when(F.col("event_id") % 4 > 0, F.col("user_id").cast("double")).alias("u"), F.lit(1).alias("same"))
    return C.auto_correct(df)


@query("SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS cust_key_1, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def normalise_column_names(spark, sf):
    return C.normalise_column_names(read(spark, sf, "orders").withColumnsRenamed({"o_orderkey": "Order Key", "o_custkey": "custKey#", "o_orderstatus": "cust_key"}))


MODE = "(SELECT flag FROM u WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)"


@query(f"""WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber, disc, qty, CASE WHEN lower(trim(flag)) NOT IN {NULLS} THEN trim(flag) END AS flag, trim(num_text) AS num_text, trim(yes_no) AS yes_no FROM ({MESSY}))
SELECT l_orderkey, l_linenumber, coalesce(disc, (SELECT median(disc) FROM u)) AS disc, qty, coalesce(flag, {MODE}) AS flag, num_text, yes_no FROM u""")
def clean_pipeline(spark, sf):
    return C.clean_pipeline(messy(spark, sf))


@query(f"""WITH u AS (SELECT * REPLACE (CASE WHEN lower(trim(flag)) NOT IN {NULLS} THEN flag END AS flag) FROM ({MESSY}))
SELECT l_orderkey, l_linenumber, disc, qty, coalesce(flag, {MODE}) AS flag, TRY_CAST(num_text AS DOUBLE) AS num_text, lower(trim(yes_no)) = 'yes' AS yes_no FROM u""")
def triage_pipeline(spark, sf):
    return C.triage_pipeline(messy(spark, sf))


@query()
def missing_data_pipeline(spark, sf):
    return C.missing_data_pipeline(messy(spark, sf))


# distances are between nations only; donors at one distance share the places that are left of five
@query("""WITH t AS (SELECT c_custkey, c_nationkey AS nation, CASE WHEN c_custkey % 9 > 0 THEN c_acctbal END AS bal FROM customer), d AS (SELECT nation, count(*) AS n, sum(bal) AS s FROM t WHERE bal IS NOT NULL GROUP BY 1),
g AS (SELECT q.nation AS nat, abs(d.nation - q.nation) AS dist, sum(n) AS n, sum(s) AS s FROM (SELECT DISTINCT nation FROM t WHERE bal IS NULL) q, d GROUP BY ALL),
w AS (SELECT nat, s / n * greatest(0, least(n, 5 - coalesce(sum(n) OVER (PARTITION BY nat ORDER BY dist ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part FROM g), f AS (SELECT nat, sum(part) / 5 AS bal FROM w GROUP BY 1)
SELECT c_custkey, coalesce(t.bal, f.bal) AS bal, nation::DOUBLE AS nation FROM t LEFT JOIN f ON nation = nat""")
def impute_knn(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal")).alias("bal"), F.col("c_nationkey").cast("double").alias("nation"))
    return C.impute_knn(df, ["bal", "nation"])


@query()
def impute_iterative(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 > 0, F.col("l_extendedprice")).alias("price"), "l_quantity", F.when(F.col("l_orderkey") % 5 > 0, F.col("l_discount")).alias("disc"))
    return C.impute_iterative(df, ["price", "l_quantity", "disc"])
