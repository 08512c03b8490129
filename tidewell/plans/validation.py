"""Queries of the validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import validators as V
from tidewell.plans.cleaning import MESSY, messy
from tidewell.plans.registry import query, read


def counts(*rules: tuple[str, str, str, str], table: str) -> str:
    parts = [f"SELECT '{r}' AS rule, '{c}' AS \"column\", '{s}' AS severity, count(*) FILTER ({cond}) AS n_bad FROM {table}" for r, c, s, cond in rules]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_bad > 0"


@query("SELECT 'required_column' AS rule, 'o_comment' AS \"column\", 'CRITICAL' AS severity, 1::BIGINT AS n_bad")
def check_required_columns(spark, sf):
    return V.check_required_columns(read(spark, sf, "orders"), ["o_orderkey", "o_comment"])


@query("SELECT 'type' AS rule, c AS \"column\", s AS severity, 1::BIGINT AS n_bad FROM (VALUES ('l_discount', 'ERROR'), ('l_quantity', (SELECT CASE WHEN bool_and(l_quantity % 1 = 0) THEN 'WARNING' ELSE 'ERROR' END FROM lineitem))) t(c, s)")
def check_types(spark, sf):
    return V.check_types(read(spark, sf, "lineitem"), {"l_quantity": "bigint", "l_discount": "bigint", "l_tax": "double"})


@query("SELECT * FROM (VALUES ('column_missing', 'note', 'ERROR', 1::BIGINT), ('column_added', 'r_name', 'WARNING', 1::BIGINT)) t(rule, \"column\", severity, n_bad)")
def check_schema_drift(spark, sf):
    return V.check_schema_drift(read(spark, sf, "region").select("r_regionkey", "r_name"), {"r_regionkey": dict(read(spark, sf, "region").dtypes)["r_regionkey"], "note": "string"})


@query(counts(("unparseable", "t", "ERROR", "WHERE o_orderkey % 9 = 0"), ("future", "t", "WARNING", "WHERE o_orderkey % 9 > 0 AND o_orderdate > TIMESTAMP '1997-01-01'"), table="orders"))
def check_timestamps(spark, sf):
    df = read(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.col("o_orderdate").cast("string")).alias("t"))
    return V.check_timestamps(df, "t", "1997-01-01")


@query("SELECT 'unique_key' AS rule, 'o_custkey,o_orderstatus' AS \"column\", 'CRITICAL' AS severity, sum(n)::BIGINT AS n_bad FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1)")
def check_unique_keys(spark, sf):
    return V.check_unique_keys(read(spark, sf, "orders"), ["o_custkey", "o_orderstatus"])


@query("SELECT 'l_quantity' AS \"column\", min(l_quantity) AS min, max(l_quantity) AS max, min(l_quantity) >= 1 AND max(l_quantity) <= 40 AS ok FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice), min(l_extendedprice) >= 0 FROM lineitem")
def check_ranges(spark, sf):
    return V.check_ranges(read(spark, sf, "lineitem"), {"l_quantity": (1, 40), "l_extendedprice": (0, None)})


@query(counts(("below_min", "l_quantity", "ERROR", "WHERE l_quantity < 5"), ("above_max", "l_quantity", "ERROR", "WHERE l_quantity > 45"), ("above_max", "l_discount", "ERROR", "WHERE l_discount > 0.09"), table="lineitem"))
def check_bounds(spark, sf):
    return V.check_bounds(read(spark, sf, "lineitem"), {"l_quantity": (5, 45), "l_discount": (None, 0.09)})


@query(counts(("above_max", "o_totalprice", "ERROR", "WHERE o_totalprice > 300000"), table="orders"))
def manual_threshold_check(spark, sf):
    return V.manual_threshold_check(read(spark, sf, "orders"), {"o_totalprice": (0, 300000)})


@query(counts(("positive", "l_discount", "ERROR", "WHERE l_discount <= 0"), ("non_negative", "c", "ERROR", "WHERE false"), table="lineitem"))
def check_positivity(spark, sf):
    return V.check_positivity(read(spark, sf, "lineitem"), strict=["l_discount"], loose=["l_tax"])


@query(counts(("logical", "l_tax <= l_discount", "ERROR", "WHERE NOT (l_tax <= l_discount)"), table="lineitem"))
def check_logical(spark, sf):
    return V.check_logical(read(spark, sf, "lineitem"), [("l_tax", "<=", "l_discount")])


CUBED = "(SELECT value * value * value * value AS v FROM events)"


@query(f"WITH q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM {CUBED}) SELECT 'auto_iqr' AS rule, 'v' AS \"column\", 'WARNING' AS severity, count(*) AS n_bad FROM {CUBED}, q WHERE v < a - 3 * (b - a) OR v > b + 3 * (b - a) HAVING count(*) > 0")
def check_auto_iqr(spark, sf):
    return V.check_auto_iqr(read(spark, sf, "events").select(F.expr("value * value * value * value").alias("v")), ["v"])


@query(f"""WITH m AS ({MESSY}), r AS (SELECT 'disc' AS "column", avg((disc IS NULL)::INT) AS null_rate FROM m)
SELECT 'null_rate' AS rule, "column", 'CRITICAL' AS severity, null_rate FROM r""")
def check_nulls(spark, sf):
    return V.check_nulls(messy(spark, sf), critical=["disc"])


@query("SELECT 'zero_rate' AS rule, 'q' AS \"column\", 'ERROR' AS severity, avg((o_orderkey % 5 < 3)::INT) AS zero_rate FROM orders")
def check_zeros(spark, sf):
    return V.check_zeros(read(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 5 < 3, 0.0).otherwise(F.col("o_totalprice")).alias("q")))


@query("SELECT 'duplicate_rows' AS rule, '*' AS \"column\", 'WARNING' AS severity, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)))::BIGINT AS n_bad FROM orders")
def check_duplicate_rows(spark, sf):
    return V.check_duplicate_rows(read(spark, sf, "orders").select("o_custkey", "o_orderstatus"))


@query("SELECT 'referential' AS rule, 'o_custkey' AS \"column\", 'ERROR' AS severity, count(*) AS n_bad FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def check_referential(spark, sf):
    return V.check_referential(read(spark, sf, "orders"), "o_custkey", read(spark, sf, "customer").where("c_nationkey < 20"), "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_allowed(spark, sf):
    return V.semi_join_allowed(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey").drop("o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def anti_join_invalid(spark, sf):
    return V.anti_join_invalid(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey").drop("o_custkey")


@query(counts(("if_l_returnflag=R_then_positive", "l_discount", "ERROR", "WHERE l_returnflag = 'R' AND l_discount <= 0"), table="lineitem"))
def check_cross_column(spark, sf):
    return V.check_cross_column(read(spark, sf, "lineitem"), [("l_returnflag", "R", "l_discount", "positive")])


@query("SELECT * FROM (VALUES ('same', 'CONSTANT'), ('copy', 'FULLY_UNIQUE'), ('near', 'NEAR_CONSTANT')) t(\"column\", issue)")
def check_cardinality(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("copy"), F.lit(1).alias("same"), (F.col("o_orderkey") % 500 == 0).alias("near"), "o_orderstatus")
    return V.check_cardinality(df, df.columns, ids=["o_orderkey"])


@query("SELECT DISTINCT 'o_orderpriority' AS \"column\", o_orderpriority AS unexpected FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def check_categories(spark, sf):
    return V.check_categories(read(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query(counts(("negative", "amount", "ERROR", "WHERE c_acctbal < 0"), ("age", "age", "ERROR", "WHERE c_custkey > 150"), table="customer"))
def check_business_rules(spark, sf):
    return V.check_business_rules(read(spark, sf, "customer").select(F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("age"), F.lit(50).alias("pct")))


@query("SELECT 'net' AS \"column\", corr(l_extendedprice * (1 - l_discount), l_extendedprice) AS r, CASE WHEN corr(l_extendedprice * (1 - l_discount), l_extendedprice) >= 0.98 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM lineitem")
def detect_leakage(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    return V.detect_leakage(df, "l_extendedprice", ["net", "l_quantity", "l_discount"])


@query("SELECT * FROM (VALUES ('o_orderkey', 'ID'), ('churn_flag', 'FUTURE_NAME'), ('twin', 'CORRELATION')) t(\"column\", reason)")
def detect_model_leakage(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 2).alias("churn_flag"), (F.floor(F.col("o_totalprice") / 10000) * 2).alias("twin"), "o_totalprice", "o_custkey")
    return V.detect_model_leakage(df, "o_totalprice", ["o_orderkey", "churn_flag", "twin", "o_custkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def filter_rows(spark, sf):
    return V.filter_rows(read(spark, sf, "orders"), "o_totalprice > 200000 AND o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("SELECT 'CRITICAL' AS severity, 'a' AS \"column\", count(*) AS n FROM orders UNION ALL SELECT 'WARNING', 'b', count(*) FROM lineitem")
def sort_violations(spark, sf):
    rows = [read(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(s).alias("severity"), F.lit(c).alias("column"), "n") for t, s, c in (("lineitem", "WARNING", "b"), ("orders", "CRITICAL", "a"))]
    return V.sort_violations(rows[0].unionByName(rows[1]))


@query("SELECT event_id, CASE WHEN abs(value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events) >= 2 THEN 'HARD' ELSE 'SOFT' END AS kind FROM events WHERE event_type = 'click'")
def classify_soft_hard(spark, sf):
    df = read(spark, sf, "events")
    m = df.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).first()
    scored = df.withColumn("score", F.abs(F.col("value") - m["m"]) / m["s"])
    return V.classify_soft_hard(scored, F.col("event_type") == "click", "score", 2.0).select("event_id", "kind")
