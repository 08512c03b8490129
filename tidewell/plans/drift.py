"""Queries of the drift operators: baseline is the first half of the time range, current the second."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import aggregates as A
from tidewell.operators import drift as R
from tidewell.plans.registry import query, read

SIDES = "SELECT value AS v, (ts >= '2024-01-16')::INT AS side FROM events"
PAIRS = "p AS (SELECT b, count(*) FILTER (side = 0)::DOUBLE AS a, count(*) FILTER (side = 1)::DOUBLE AS c FROM x GROUP BY 1), s AS (SELECT a / sum(a) OVER () AS p, c / sum(c) OVER () AS q, a, c, sum(a) OVER () AS na, sum(c) OVER () AS nc, count(*) OVER () AS k FROM p)"
EQUAL = f"WITH t AS ({SIDES}), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / {{n}} AS w FROM t), x AS (SELECT side, (SELECT count(*) FROM range(1, {{n}}) r(i) WHERE v >= lo + w * i) AS b FROM t, e), {PAIRS}"
DECILES = f"WITH t AS ({SIDES}), e AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM t), x AS (SELECT side, len(list_filter(q, lambda z: v >= z)) AS b FROM t, e), {PAIRS}"


def sides(spark, sf):
    e = read(spark, sf, "events")
    return e.where("ts < '2024-01-16'"), e.where("ts >= '2024-01-16'")


@query(EQUAL.format(n=10) + " SELECT round(sum((greatest(q, 1e-6) - greatest(p, 1e-6)) * ln(greatest(q, 1e-6) / greatest(p, 1e-6))), 6) AS psi FROM s")
def psi_equal_width(spark, sf):
    return R.psi_equal_width(*sides(spark, sf), "value").select(F.round("psi", 6).alias("psi"))


@query(DECILES + " SELECT round(sum(((c + 0.5) / (nc + 0.5 * k) - (a + 0.5) / (na + 0.5 * k)) * ln(((c + 0.5) / (nc + 0.5 * k)) / ((a + 0.5) / (na + 0.5 * k)))), 6) AS psi FROM s")
def psi_quantile(spark, sf):
    return R.psi_quantile(*sides(spark, sf), "value").select(F.round("psi", 6).alias("psi"))


@query(DECILES + " SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s")
def psi_gate(spark, sf):
    return R.psi_gate(*sides(spark, sf), "value").select(F.round("psi", 6).alias("psi"))


@query(f"""WITH t AS ({SIDES}), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20 AS w, max(v) AS hi FROM t WHERE side = 0), x AS (SELECT side, (SELECT count(*) FROM range(1, 20) r(i) WHERE greatest(least(v, hi), lo) >= lo + w * i) AS b FROM t, e), {PAIRS}
SELECT round(sum((greatest(q, 1e-6) - greatest(p, 1e-6)) * ln(greatest(q, 1e-6) / greatest(p, 1e-6))), 6) AS psi FROM s""")
def psi_fingerprint(spark, sf):
    base, now = sides(spark, sf)
    return R.psi_fingerprint(R.fingerprint(base, ["value"]), now, "value").select(F.round("psi", 6).alias("psi"))


@query(f"WITH x AS (SELECT event_type AS b, (ts >= '2024-01-16')::INT AS side FROM events), {PAIRS} SELECT round(sum((q - p) * ln((q + 1e-6) / (p + 1e-6))), 6) AS psi FROM s")
def psi_categorical(spark, sf):
    return R.psi_categorical(*sides(spark, sf), "event_type").select(F.round("psi", 6).alias("psi"))


@query(DECILES + " SELECT round(sum((q + 1e-10) * ln((q + 1e-10) / (p + 1e-10))), 6) AS kl FROM s")
def kl_divergence(spark, sf):
    return R.kl_divergence(*sides(spark, sf), "value").select(F.round("kl", 6).alias("kl"))


@query(DECILES + " SELECT round(sum((p + 1e-10) * ln(2 * (p + 1e-10) / (p + q + 2e-10)) + (q + 1e-10) * ln(2 * (q + 1e-10) / (p + q + 2e-10))) / 2, 6) AS js FROM s")
def js_divergence(spark, sf):
    return R.js_divergence(*sides(spark, sf), "value").select(F.round("js", 6).alias("js"))


CDF = f"WITH t AS ({SIDES}), g AS (SELECT v, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM t GROUP BY 1), c AS (SELECT v, sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb, lead(v) OVER (ORDER BY v) AS nx FROM g WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))"


@query(CDF + " SELECT max(abs(fa - fb)) AS d FROM c")
def ks_two_sample(spark, sf):
    return R.ks_two_sample(*sides(spark, sf), "value").select("d")


@query(CDF + " SELECT round(sum(abs(fa - fb) * (nx - v)), 6) AS wasserstein FROM c")
def wasserstein(spark, sf):
    return R.wasserstein(*sides(spark, sf), "value").select(F.round("wasserstein", 6).alias("wasserstein"))


@query("SELECT 'value' AS \"column\", 'STABLE' AS level UNION ALL SELECT 'event_id', 'MAJOR'")
def drift_report(spark, sf):
    base, now = sides(spark, sf)
    at = lambda df: df.withColumn("event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    return R.drift_report(at(base), at(now), ["value", "event_id"]).drop("psi")


@query("SELECT 'value' AS \"column\", false AS drift UNION ALL SELECT 'day', true")
def drift_consensus(spark, sf):
    base, now = (df.withColumn("day", F.dayofmonth("ts").cast("double")) for df in sides(spark, sf))
    return R.drift_consensus(base, now, ["value", "day"]).drop("votes")


@query("SELECT 'lang' AS \"column\", 'column_removed' AS change, 'ERROR' AS severity UNION ALL SELECT 'quality', 'column_added', 'INFO' UNION ALL SELECT 'doc_id', 'dtype_changed', 'ERROR'")
def schema_drift(spark, sf):
    return R.schema_drift(read(spark, sf, "documents").select("doc_id", "lang"), read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality"))


@query("""WITH g AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events), w AS (SELECT to_timestamp(floor(epoch(ts) / 604800) * 604800)::TIMESTAMP AS start, value FROM events)
SELECT start, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median, (avg(value) - any_value(m)) / any_value(s) AS z, abs((avg(value) - any_value(m)) / any_value(s)) > 2 AS alert FROM w, g GROUP BY 1""")
def temporal_drift(spark, sf):
    return R.temporal_drift(read(spark, sf, "events"), "ts", "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def multivariate_drift(spark, sf):
    line = read(spark, sf, "lineitem")
    return R.multivariate_drift(line.where("l_shipdate < '1995-06-01'"), line.where("l_shipdate >= '1995-06-01'"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


IMPORTANCE = "SELECT {k} AS feature, avg(value) AS importance FROM events WHERE ts {op} '2024-01-16' AND {w} GROUP BY 1"


def importances(spark, sf):
    base, now = sides(spark, sf)
    agg = lambda df: df.groupBy(F.col("event_type").alias("feature")).agg(F.avg("value").alias("importance"))
    return agg(now.where("event_type <> 'click'")), agg(base.where("event_type <> 'view'"))


@query(f"WITH n AS ({IMPORTANCE.format(k='event_type', op='>=', w=chr(39).join(['event_type <> ', 'click', '']))}), b AS ({IMPORTANCE.format(k='event_type', op='<', w=chr(39).join(['event_type <> ', 'view', '']))}) SELECT coalesce(n.feature, b.feature) AS feature, coalesce(n.importance, 0) AS now, coalesce(b.importance, 0) AS before FROM n FULL JOIN b ON n.feature = b.feature")
def importance_history_join(spark, sf):
    return R.importance_history(*importances(spark, sf))


@query()
def feature_stability(spark, sf):
    return R.feature_stability(*importances(spark, sf))


@query("SELECT 'value' AS \"column\", min(value) FILTER (ts < '2024-01-16') AS base_min, max(value) FILTER (ts < '2024-01-16') AS base_max, min(value) FILTER (ts >= '2024-01-16') AS min, max(value) FILTER (ts >= '2024-01-16') AS max FROM events")
def baseline_join(spark, sf):
    base, now = (A.range_summary(df, ["value"]).drop("avg") for df in sides(spark, sf))
    return R.baseline_join(base, now)
