"""Queries of state and metadata tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import aggregates as A
from tidewell.operators import metadata as M
from tidewell.operators import sketches as K
from tidewell.plans.registry import query, read
from tidewell.plans.streams import shared

# the orders table in the role of a log: record, dataset, at
LOG = "SELECT o_orderkey AS record, 'c' || (o_custkey % 20) AS dataset, o_orderdate AS \"at\" FROM orders"


def log(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("record"), F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string")).alias("dataset"), F.col("o_orderdate").alias("at"))


@query("SELECT * FROM (VALUES ('1.0.0', 0), ('1.0.1', 0), ('1.1.0', 1), ('2.0.0', 2)) t(version, n_drift)")
def schema_registry(spark, sf):
    r, df = M.SchemaRegistry(spark, shared(spark)), read(spark, sf, "orders")
    tables = [df, df, df.withColumn("note", F.lit("x")), df.drop("o_custkey").withColumn("o_totalprice", F.col("o_totalprice").cast("string")).withColumn("note", F.lit("x"))]
    return spark.createDataFrame([(v, len(d)) for v, d in (r.register("orders", t) for t in tables)], "version string, n_drift int")


@query("SELECT 'bronze' AS layer, count(*) AS n, true AS verified FROM orders UNION ALL SELECT 'silver', count(*), true FROM (SELECT DISTINCT o_custkey FROM orders)")
def layer_store(spark, sf):
    s = M.LayerStore(spark, shared(spark))
    bronze = s.store(read(spark, sf, "orders"), "orders")
    silver = s.promote("orders", bronze, lambda df: df.select("o_custkey").distinct())
    checks = spark.createDataFrame([(x, s.verify(x, "orders", k)) for x, k in (("bronze", bronze), ("silver", silver))], "layer string, verified boolean")
    return s.snapshots().select("layer", "n").join(checks, "layer")


@query("SELECT 'bronze' AS layer, count(*) AS n FROM orders")
def archive_snapshots(spark, sf):
    from datetime import datetime, timedelta

    s = M.LayerStore(spark, shared(spark))
    s.store(read(spark, sf, "orders"), "orders")
    return s.archive(datetime.now() + timedelta(days=1), shared(spark)).select("layer", "n")


@query(f"SELECT record, \"at\" FROM ({LOG}) WHERE dataset = 'c7'")
def lineage_log(spark, sf):
    return M.lineage_of(log(spark, sf), "c7").select("record", "at")


@query("SELECT l_orderkey AS source, l_linenumber AS part, o_orderdate AS source_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def lineage_join(spark, sf):
    gold = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("part"))
    return M.lineage_join(gold, read(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot"), F.col("o_orderdate").alias("at")))


@query(f"SELECT dataset, \"at\", record FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY \"at\" DESC, record DESC) = 1")
def watermark_store(spark, sf):
    return M.latest_rows(log(spark, sf), "dataset", ["at", "record"])


@query(f"SELECT record, dataset, \"at\" FROM ({LOG}) ORDER BY \"at\" DESC, record DESC LIMIT 50")
def audit_log(spark, sf):
    return M.audit_latest(log(spark, sf), 50)


@query(f"SELECT dataset, count(*) AS runs, max(\"at\") AS last_at FROM ({LOG}) GROUP BY 1")
def run_history_summary(spark, sf):
    return log(spark, sf).groupBy("dataset").agg(F.count("*").alias("runs"), F.max("at").alias("last_at"))


@query("SELECT quality AS rating, count(*) AS n, avg(toxic) AS flagged FROM labels GROUP BY 1")
def feedback_summary(spark, sf):
    return read(spark, sf, "labels").groupBy(F.col("quality").alias("rating")).agg(F.count("*").alias("n"), F.avg("toxic").alias("flagged"))


@query("""WITH s AS (SELECT event_type AS bin, count(*) FILTER (ts < '2024-01-16') / (SELECT count(*) FROM events WHERE ts < '2024-01-16')::DOUBLE AS a, count(*) FILTER (ts >= '2024-01-16') / (SELECT count(*) FROM events WHERE ts >= '2024-01-16')::DOUBLE AS b FROM events GROUP BY 1)
SELECT 'event_type' AS "column", bin, round(0.8 * a + 0.2 * b, 9) AS share FROM s""")
def baseline_store(spark, sf):
    e = read(spark, sf, "events")
    part = lambda df: A.category_share(df, "event_type", 20).select(F.lit("event_type").alias("column"), F.col("value").alias("bin"), "share")
    return M.rolling_baseline(part(e.where("ts < '2024-01-16'")), part(e.where("ts >= '2024-01-16'"))).withColumn("share", F.round("share", 9))


def stored_days(spark, sf):
    """The events' sketches by day, and the days."""
    store, e = K.SketchStore(spark, f"{shared(spark)}/sketches"), read(spark, sf, "events")
    store.add_by(e, "events", F.date_format("ts", "yyyy-MM-dd"), ["value", "user_id", "event_type"])
    return store, e


@query("""WITH l AS (SELECT 'value' AS "column", value AS x, value::VARCHAR AS s FROM events UNION ALL SELECT 'user_id', user_id, user_id::VARCHAR FROM events UNION ALL SELECT 'event_type', NULL, event_type FROM events)
SELECT "column", count(s) AS n, count(*) FILTER (s IS NULL) AS nulls, count(*) FILTER (x = 0) AS zeros, min(x) AS least, max(x) AS most, avg(x) AS mean, stddev_samp(x) AS std, true AS distinct_close, CASE WHEN max(x) IS NOT NULL THEN true END AS quartiles_close FROM l GROUP BY 1""")
def sketch_profile(spark, sf):
    """Merged from the days' sketches; the two flags hold the approximate values against exact ones and the stated bounds."""
    store, e = stored_days(spark, sf)
    got = {r["column"]: r for r in store.profile("events").collect()}
    flags = []
    for c, r in got.items():
        q = r["quartiles"]
        places = F.array(*[F.struct(F.count_if(F.col(c) < x).alias("below"), F.count_if(F.col(c) <= x).alias("upto")) for x in q]) if q else F.lit(None)
        exact = e.agg(F.count_distinct(c).alias("distinct"), F.count(c).alias("n"), places.alias("places")).first()
        close = all(p["below"] / exact["n"] - K.RANK_ERROR <= s <= p["upto"] / exact["n"] + K.RANK_ERROR for s, p in zip((0.25, 0.5, 0.75), exact["places"])) if q else None
        flags.append((c, r["n"], r["nulls"], r["zeros"], r["least"], r["most"], r["mean"], r["std"], abs(r["approx_distinct"] - exact["distinct"]) <= 0.05 * exact["distinct"], close))
    kinds = "column string, n long, nulls long, zeros long, least double, most double, mean double, std double, distinct_close boolean, quartiles_close boolean"
    return spark.createDataFrame(flags, kinds)


@query("""WITH l AS (SELECT 'value' AS "column", value AS x, ts < '2024-01-16' AS base FROM events UNION ALL SELECT 'user_id', user_id, ts < '2024-01-16' FROM events),
e AS (SELECT "column", list_distinct(quantile_disc(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM l WHERE base GROUP BY 1),
b AS (SELECT "column", base, len(list_filter(edges, lambda q: x > q)) AS bin FROM l JOIN e USING ("column")),
c AS (SELECT "column", bin, count(*) FILTER (base) AS p, count(*) FILTER (NOT base) AS q FROM b GROUP BY 1, 2), s AS (SELECT "column", p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM c WINDOW w AS (PARTITION BY "column"))
SELECT "column", sum((q - p) * ln(greatest(q, 1e-6) / greatest(p, 1e-6))) > 0.2 AS drifted FROM s GROUP BY 1""")
def sketch_drift(spark, sf):
    store, e = stored_days(spark, sf)
    days = [r["d"] for r in e.select(F.date_format("ts", "yyyy-MM-dd").alias("d")).distinct().collect()]  # one a partition
    found = store.psi("events", [d for d in days if d < "2024-01-16"], [d for d in days if d >= "2024-01-16"])
    return found.select("column", (F.col("psi") > 0.2).alias("drifted"))
