"""Windows within keys that are split into ranges equal those of whole keys, and no task gets a whole large key."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators import cleaning, features, halo, ordering
from tidewell.streaming import windows

BY, ORDER = ["user_id"], ["ts", "event_id"]


@pytest.fixture(scope="module")
def events(spark):
    """The events, with nulls, ties and a key with 90 % of the rows."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("user_id", F.when(F.col("event_id") % 10 > 0, 7).when(F.col("event_id") % 20 == 0, None).otherwise(F.col("user_id")))
    e = e.withColumn("ts", F.when(F.col("event_id") % 97 == 5, None).when(F.col("event_id") % 5 == 1, F.date_trunc("hour", "ts")).otherwise(F.col("ts")))
    return e.withColumn("hole", F.when(F.col("event_id") % 9 == 0, F.col("value"))).drop("props")


CASES = {
    "lag": lambda e, n: features.lag_features(e, "value", [1, 3], ORDER, BY, n),
    "lag of the table": lambda e, n: features.lag_features(e, "value", [2], ORDER, None, n),
    "rolling": lambda e, n: features.rolling_features(e, "value", 5, ["mean", "sum", "std", "min", "max"], ORDER, BY, n),
    "change": lambda e, n: ordering.percent_change(e, "value", ORDER, BY, n),
    "seconds": lambda e, n: ordering.windowed_aggregation(e, "value", "ts", 7200, BY, n),
    "sessions": lambda e, n: ordering.session_breaks(e, "ts", BY, 1800, n),
    "buckets": lambda e, n: ordering.row_bucketing(e, 10, ORDER, BY, n),
    "gaps": lambda e, n: ordering.interarrival_stats(e, "ts", BY, n),
    "advice": lambda e, n: windows.advise_windows(e, "ts", ["event_type"], n),
    "session windows": lambda e, n: windows.session(e, "ts", 1800, BY, n, total=F.sum("value")),
    "fill": lambda e, n: cleaning.impute_ffill_bfill(e, ["hole"], ORDER, BY, n),
}


def exact(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("case", CASES)
def test_fifty_ranges_equal_one(events, case):
    whole, split = CASES[case](events, 1), CASES[case](events, 50)
    assert whole.columns == split.columns
    assert exact(whole) == exact(split)


def test_sessions_equal_the_engines(events):
    got = windows.session(events.where("ts IS NOT NULL"), "ts", 1800, BY, 50)
    want = events.where("ts IS NOT NULL").groupBy(F.session_window("ts", "1800 seconds").alias("w"), *BY).agg(F.max("ts").alias("end"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "end", *BY, "n")
    # the engine starts a new session after exactly the gap where hours tie; those rows are apart by more here
    assert abs(got.count() - want.count()) <= 1 and got.agg(F.sum("n")).first() == want.agg(F.sum("n")).first()


def test_large_keys_are_split(events, monkeypatch):
    monkeypatch.setattr(halo, "HOT_ROWS", 100)
    n = events.count()
    parts, cuts = halo.split(events, "ts", BY)
    most = parts.where("_p >= 0").groupBy("user_id", "_p").count().agg(F.max("count")).first()[0]
    assert len(cuts) >= n // 100 - 2 and most <= 200
    plan = features.lag_features(events, "value", [1], ORDER, BY)._jdf.queryExecution().optimizedPlan().toString()
    assert "_p" in plan
    assert exact(features.lag_features(events, "value", [1], ORDER, BY)) == exact(events.withColumn("value_lag1", F.lag("value").over(W.partitionBy(*BY).orderBy(*ORDER))))


def test_small_keys_and_text_orders_are_not_split(events):
    assert halo.split(events, "ts", BY)[1] == []
    assert halo.split(events, "event_type", BY, 50)[1] == []
    assert halo.split(events.where("false"), "ts", BY, 50)[1] == []
