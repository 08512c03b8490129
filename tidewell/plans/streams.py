"""Queries of windows and streams.  Stream queries read the events table as a file stream and run it to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.functions.stages import shared_folder
from tidewell.plans.registry import query, read
from tidewell.streaming import closed as C
from tidewell.streaming import windows as S


def events(spark, sf):
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark, sf):
    # a file stream takes folders and patterns, and the table may be a single file
    source = S.stream_files(spark, f"{sf}/events.parque[t]", read(spark, sf, "events").schema)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k == "timestamp"})


def shared(spark) -> str:
    """A folder for a stream's output and state in the shared folder."""
    return shared_folder(spark, "stream")


DAY = "to_timestamp(floor(epoch(ts) / {s}) * {s})::TIMESTAMP"


@query(f"SELECT {DAY.format(s=3600)} AS start, {DAY.format(s=3600)} + INTERVAL 1 HOUR AS \"end\", count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, sf):
    return plain(S.tumbling(events(spark, sf), "ts", 3600, total=F.sum("value")))


@query(f"SELECT {DAY.format(s=86400)} AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def window_events(spark, sf):
    return plain(S.tumbling(events(spark, sf), "ts", 86400, ["event_type"], total=F.sum("value")).drop("end"))


@query("WITH m AS (SELECT min(epoch_us(ts)) AS lo FROM events) SELECT (epoch_us(ts) - lo) // 300000000 AS window_id, count(*) AS n, make_timestamp((any_value(lo) + (epoch_us(ts) - lo) // 300000000 * 300000000)::BIGINT) AS start FROM events, m GROUP BY 1, (epoch_us(ts) - lo) // 300000000")
def window_tumbling_anchored(spark, sf):
    return plain(S.tumbling_anchored(events(spark, sf), "ts", 300))


@query("WITH w AS (SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600 - i * 3600)::TIMESTAMP AS start, value FROM events, range(0, 4) r(i)) SELECT start, start + INTERVAL 4 HOUR AS \"end\", count(*) AS n, sum(value) AS total FROM w GROUP BY 1")
def window_sliding(spark, sf):
    return plain(S.sliding(events(spark, sf), "ts", 14400, 3600, total=F.sum("value")))


@query("SELECT event_id, to_timestamp(floor(epoch(ts) / 3600) * 3600 - i * 3600)::TIMESTAMP AS start FROM events, range(0, 3) r(i)")
def window_rows_join(spark, sf):
    return plain(S.rows_in_sliding(events(spark, sf), "ts", 10800, 3600).select("event_id", "start"))


@query("""WITH n AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 3600000000)::INT, 0) AS x FROM events), s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT min(ts) AS start, max(ts) AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def window_session(spark, sf):
    return plain(S.session(events(spark, sf), "ts", 3600, ["user_id"]))


@query("""WITH g AS (SELECT event_type, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events), m AS (SELECT event_type, median(gap) AS median_gap FROM g WHERE gap IS NOT NULL GROUP BY 1), t AS (SELECT *, trunc(greatest(10, least(median_gap * 5, 3600)))::INT AS tumbling FROM m)
SELECT event_type, round(median_gap, 3) AS median_gap, tumbling, trunc(greatest(5, least(median_gap * 2, tumbling)))::INT AS sliding, tumbling * 3 AS watermark FROM t""")
def window_advisor(spark, sf):
    return S.advise_windows(events(spark, sf), "ts", ["event_type"]).withColumn("median_gap", F.round("median_gap", 3))


@query("SELECT event_id, ts, 'seconds' AS form FROM (SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts FROM events WHERE event_id % 3 = 0) UNION ALL SELECT event_id, date_trunc('milliseconds', ts)::TIMESTAMP, 'millis' FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, date_trunc('second', ts)::TIMESTAMP, 'iso' FROM events WHERE event_id % 3 = 2")
def event_time_extract(spark, sf):
    e = events(spark, sf)
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.unix_seconds("ts").cast("string")).when(k == 1, F.unix_millis("ts").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return plain(e.select("event_id", S.event_time(raw).alias("ts"), F.when(k == 0, "seconds").when(k == 1, "millis").otherwise("iso").alias("form")))


@query(f"SELECT {DAY.format(s=86400)} AS start, {DAY.format(s=86400)} + INTERVAL 1 DAY AS \"end\", count(*) AS n FROM events GROUP BY 1")
def stream_files(spark, sf):
    return plain(S.run_memory(S.tumbling(event_stream(spark, sf), "ts", 86400), f"tumbling_{uuid.uuid4().hex}"))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf):
    twice = event_stream(spark, sf).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).select("event_id", "ts")
    return C.to_folder(S.deduplicated(twice, "event_id", "ts").select("event_id"), shared(spark))


@query("SELECT event_id, 'gate failed' AS error FROM events")
def stream_dlq(spark, sf):
    def failing(rows):
        raise ValueError("gate failed")

    base = shared(spark)
    C.dead_letter_sink(event_stream(spark, sf), failing, base).awaitTermination()
    return spark.read.parquet(f"{base}/dead").select("event_id", "error")


#: The events arrive in so many deliveries; every tenth comes two deliveries late.
DELIVERIES = 5
WINDOW = 86400
_RUNS: dict[tuple[str, str], C.ClosedWindows] = {}


def delivered(spark, sf) -> C.ClosedWindows:
    """The closed daily windows of the events stream.  Each delivery lands in a folder of its own and the query is started for
    it and goes on from its checkpoint.  One run serves all queries of a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        base = shared(spark)
        table = read(spark, sf, "events")
        ends = table.agg(F.max("event_id") + 1).first()[0] or 1
        turn = F.floor(F.col("event_id") * DELIVERIES / ends) + F.when(F.col("event_id") % 10 == 3, 2).otherwise(0)
        table = table.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("turn", F.least(turn, F.lit(DELIVERIES - 1)))
        run = C.ClosedWindows(f"{base}/out", "ts", WINDOW, aggs={"total": ("sum", "value")}, gate=lambda w: w.withColumn("passed", F.col("n") >= 300), watch="total / n")
        stream = S.stream_files(spark, f"{base}/in/*", table.drop("turn").schema)
        for k in range(DELIVERIES):
            table.where(F.col("turn") == k).drop("turn").write.parquet(f"{base}/in/{k}")
            run.start(stream).awaitTermination()
        _RUNS[key] = run
    return _RUNS[key]


# by delivery: the watermark before it (in ms); by event: its window's start s (in seconds), and whether that had closed
ARRIVED = f"""WITH a AS (SELECT *, least({DELIVERIES - 1}, event_id * {DELIVERIES} // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 10 = 3 THEN 2 ELSE 0 END) AS k FROM events),
m AS (SELECT g.k, max(epoch_ms(a.ts)) - 300000 AS mark FROM (SELECT unnest(range({DELIVERIES} + 1)) AS k) g LEFT JOIN a ON a.k < g.k GROUP BY g.k),
e AS (SELECT a.*, (floor(epoch(ts) / {WINDOW}) * {WINDOW})::BIGINT AS s FROM a),
w AS (SELECT e.*, to_timestamp(s)::TIMESTAMP AS start, coalesce(mark >= (s + {WINDOW}) * 1000, false) AS late FROM e JOIN m USING (k)),
o AS (SELECT s, start, count(*) AS n, sum(value) AS total FROM w WHERE NOT late GROUP BY s, start),
c AS (SELECT o.*, (SELECT min(k) FROM m WHERE mark >= (s + {WINDOW}) * 1000) AS closed FROM o)
"""


@query(ARRIVED + "SELECT start, n, n >= 300 AS passed FROM c WHERE closed IS NOT NULL")
def window_qa(spark, sf):
    return plain(delivered(spark, sf).read(spark, "gold").select("start", "n", "passed"))


@query(ARRIVED + "SELECT start, n, total, closed IS NULL AS open FROM c")
def stream_gold_sink(spark, sf):
    run = delivered(spark, sf)
    gold = run.read(spark, "gold").select("start", "n", "total", F.lit(False).alias("open"))
    return plain(gold.unionByName(run.open(spark).select("start", "n", "total", F.lit(True).alias("open"))))


@query(ARRIVED + "SELECT event_id, start FROM w WHERE late")
def watermark_late(spark, sf):
    return plain(delivered(spark, sf).read(spark, "late").select("event_id", "start"))


@query(ARRIVED + "SELECT start, count(*) AS n, sum(value) AS total FROM w WHERE late GROUP BY start")
def late_drop_count(spark, sf):
    return plain(delivered(spark, sf).corrections(spark))


@query(ARRIVED + "SELECT (SELECT count(*) FROM w) AS rows, (SELECT count(*) FROM w WHERE late) AS late, (SELECT count(*) FROM c WHERE closed IS NOT NULL) AS windows")
def stream_stats(spark, sf):
    found = delivered(spark, sf).totals(spark)
    return spark.createDataFrame([(found["rows"], found["late"], found["windows"])], "rows long, late long, windows long")


@query(ARRIVED + """, g AS (SELECT c.start, c.total / c.n AS mean, avg(b.total / b.n) AS m, stddev_samp(b.total / b.n) AS d FROM c JOIN c b ON b.closed < c.closed GROUP BY c.start, c.total, c.n)
SELECT start, mean, (mean - m) / d AS z FROM g WHERE abs((mean - m) / d) > 2""")
def stream_drift_alerts(spark, sf):
    return plain(delivered(spark, sf).read(spark, "alerts").select("start", F.col("watched").alias("mean"), "z"))
