"""Closed windows over many micro-batches: once each, late rows apart, and the same after a failure."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import closed, windows

DAY = 86400


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """The events in 20 files, one a trigger; every seventh comes up to 9 files late.  (folder, schema, events by file)"""
    base = tmp_path_factory.mktemp("arrivals")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_type").toPandas().sort_values("ts")
    rng, n = random.Random(3), len(e)
    e["k"] = [min(19, i * 20 // n + (rng.randint(1, 9) if i % 7 == 3 else 0)) for i in range(n)]
    for k in range(20):
        spark.createDataFrame(e[e.k == k].drop(columns="k").sample(frac=1, random_state=k)).coalesce(1).write.parquet(f"{base}/{k}")
    return str(base), spark.read.parquet(f"{base}/0").schema, e


def expected(e, seconds=DAY, delay=300):
    """{start in s: (n, total)} of rows whose window was open, the late event ids, and the open starts, by file."""
    highs, kept, late = [], {}, set()
    for k in range(20):
        part = e[e.k == k]
        # the windows closed in the trigger before, by the times seen before that
        mark = int(highs[k - 2].timestamp() * 1000) - delay * 1000 if k > 1 else None
        for r in part.itertuples():
            start = int(r.ts.timestamp()) // seconds * seconds
            if mark is not None and (start + seconds) * 1000 <= mark:
                late.add(r.event_id)
            else:
                n, total = kept.get(start, (0, 0.0))
                kept[start] = (n + 1, total + r.value)
        highs.append(max([part.ts.max(), *highs]))
    mark = int(highs[-1].timestamp() * 1000) - delay * 1000
    return kept, late, {s for s in kept if (s + seconds) * 1000 > mark}


def results(spark, run):
    stamp = F.unix_seconds("start").alias("s")
    gold = {r["s"]: (r["n"], round(r["total"], 6)) for r in run.read(spark, "gold").select(stamp, "n", "total").collect()}
    assert len(gold) == run.read(spark, "gold").count()
    still = {r["s"]: (r["n"], round(r["total"], 6)) for r in run.open(spark).select(stamp, "n", "total").collect()}
    return gold, still, rows(run.read(spark, "late").select("event_id"))


def stream(spark, arrivals):
    return windows.stream_files(spark, f"{arrivals[0]}/*", arrivals[1], per_trigger=1)


def check(spark, run, arrivals):
    kept, late, left = expected(arrivals[2])
    gold, still, dropped = results(spark, run)
    want = {s: (n, round(t, 6)) for s, (n, t) in kept.items()}
    assert gold == {s: x for s, x in want.items() if s not in left} and still == {s: x for s, x in want.items() if s in left}
    assert dropped == sorted((i,) for i in late) and late
    found = run.totals(spark)
    assert (found["rows"], found["late"], found["windows"]) == (len(arrivals[2]), len(late), len(gold))


def test_one_row_a_window_over_twenty_triggers_and_a_crash(spark, arrivals, tmp_path, monkeypatch):
    run = closed.ClosedWindows(str(tmp_path), "ts", DAY, aggs={"total": ("sum", "value")}, watch="total / n", limit=1.0)
    write, crashes = closed.ClosedWindows._write, []

    def crash_between_writes(self, df, kind, epoch):
        if kind == "late" and epoch in (4, 9) and epoch not in crashes:
            crashes.append(epoch)  # gold of this epoch is written, the rest is not
            raise OSError("lost")
        write(self, df, kind, epoch)

    monkeypatch.setattr(closed.ClosedWindows, "_write", crash_between_writes)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            run.start(stream(spark, arrivals)).awaitTermination()
    run.start(stream(spark, arrivals)).awaitTermination()
    assert crashes == [4, 9]
    check(spark, run, arrivals)
    # alerts against the windows of earlier epochs
    by_epoch = {}
    for r in run.read(spark, "gold").collect():
        by_epoch.setdefault(r["epoch"], []).append((r["start"], r["total"] / r["n"]))
    seen, want = [], set()
    for epoch in sorted(by_epoch):
        if len(seen) > 1:
            m = sum(seen) / len(seen)
            d = (sum((x - m) ** 2 for x in seen) / (len(seen) - 1)) ** 0.5
            want |= {s for s, x in by_epoch[epoch] if abs(x - m) > d}
        seen += [x for _, x in by_epoch[epoch]]
    assert {r["start"] for r in run.read(spark, "alerts").collect()} == want and want
    # what came late is added up apart
    late = run.read(spark, "late")
    assert rows(run.corrections(spark).select("start", "n")) == rows(late.groupBy("start").agg(F.count("*")))


def test_a_failing_gate_sets_its_windows_apart(spark, arrivals, tmp_path):
    def gate(w):
        if w.where("n > 0").count() and w.agg(F.min("start")).first()[0].day < 10:
            raise ValueError("gate failed")
        return w.withColumn("passed", F.col("n") > 10)

    run = closed.ClosedWindows(str(tmp_path), "ts", DAY, by=["event_type"], aggs={"lo": ("min", "value"), "hi": ("max", "value")}, gate=gate)
    source = spark.readStream.schema(arrivals[1]).option("maxFilesPerTrigger", 7).parquet(f"{arrivals[0]}/*")
    run.start(source).awaitTermination()
    dead, gold = run.read(spark, "dead"), run.read(spark, "gold")
    assert {r["error"] for r in dead.collect()} == {"gate failed"}
    found = run.totals(spark)
    assert found["failed"] == dead.count() and found["windows"] == dead.count() + gold.count()
    assert run.open(spark).columns == ["start", "end", "event_type", "n", "lo", "hi"]
    counted = dead.agg(F.sum("n")).first()[0] + gold.agg(F.sum("n")).first()[0] + run.open(spark).agg(F.sum("n")).first()[0]
    assert counted + found["late"] == found["rows"] == len(arrivals[2])


def test_gates_that_keep_failing_stop_the_query(spark, arrivals, tmp_path):
    def gate(w):
        raise ValueError("never")

    run = closed.ClosedWindows(str(tmp_path), "ts", DAY, gate=gate, max_errors=2)
    source = spark.readStream.schema(arrivals[1]).option("maxFilesPerTrigger", 5).parquet(f"{arrivals[0]}/*")
    with pytest.raises(Exception, match="never"):
        run.start(source).awaitTermination()


def test_dead_letters_are_whole_batches(spark, arrivals, tmp_path):
    source = spark.readStream.schema(arrivals[1]).option("maxFilesPerTrigger", 5).parquet(f"{arrivals[0]}/*")

    def handle(batch):
        if batch.agg(F.min("ts")).first()[0].day < 5:
            raise ValueError("too early")
        return batch

    closed.dead_letter_sink(source, handle, str(tmp_path)).awaitTermination()
    dead, gold = spark.read.parquet(f"{tmp_path}/dead"), spark.read.parquet(f"{tmp_path}/gold")
    assert dead.count() + gold.count() == len(arrivals[2]) and {r["error"] for r in dead.collect()} == {"too early"}
