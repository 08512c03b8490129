"""Closed event-time windows of a stream, once each, with late rows apart and a sink that can be replayed.

The windows live in the state of an append-mode aggregation, so they grow over any number of micro-batches and leave it when the
watermark passes their end.  The stream's own rows travel beside them in the same query: a row whose window had left the state is
one that the aggregation dropped, and is written as a correction.  Whatever a micro-batch writes goes to a folder of its
epoch that it overwrites, so a batch run again after a failure leaves the same rows.  Below the base folder:

    gold/epoch=N      closed windows as the gate returns them
    dead/epoch=N      closed windows whose gate failed, with the error
    late/epoch=N      late rows, with the start of their window
    alerts/epoch=N    closed windows far off the mean of those closed in earlier epochs
    totals/epoch=N    one row of running totals, which the next epoch starts from
    checkpoint        offsets and state; open windows are read from there
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TOTALS = "high timestamp, closing timestamp, rows long, late long, windows long, failed long, errors long, seen long, mean double, m2 double"
#: Functions whose state is one mergeable value, so that open windows can be read from the state as they stand.
MERGEABLE = {"sum": lambda c: F.sum(F.col(c).cast("double")), "min": F.min, "max": F.max}


@dataclass
class ClosedWindows:
    """``aggs`` maps a result column to (function, column); ``n`` counts the rows of a window.

    ``watch`` is a column of closed windows (an expression over ``n`` and ``aggs``); windows over ``limit`` sample deviations off
    the mean of the windows closed in earlier epochs are alerts.  ``max_errors`` epochs in a row whose gate fails stop the query.
    A row without event time belongs to no window: it is late.  The state has ``partitions`` parts, by default one a core and no more
    than shuffles have: each task reports on every part of the state to the driver, so what it gets grows with their square.
    """

    base: str
    ts: str
    seconds: int
    by: list[str] = field(default_factory=list)
    aggs: dict[str, tuple[str, str]] = field(default_factory=dict)
    delay: int = 300
    gate: Callable[[DataFrame], DataFrame] = lambda windows: windows
    watch: str | None = None
    limit: float = 2.0
    max_errors: int = 10
    partitions: int | None = None

    def _columns(self) -> list[str]:
        return ["start", "end", *self.by, "n", *self.aggs]

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Run ``stream`` into the folders; by default to the end of what is there."""
        marked = stream.withWatermark(self.ts, f"{self.delay} seconds")
        sums = [MERGEABLE[f](c).alias(k) for k, (f, c) in self.aggs.items()]
        windows = marked.groupBy(F.window(self.ts, f"{self.seconds} seconds").alias("w"), *self.by).agg(F.count("*").alias("n"), *sums)
        windows = windows.select(F.struct(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *self.by, "n", *self.aggs).alias("closed"))
        both = windows.unionByName(marked.select(F.struct(*marked.columns).alias("row")), allowMissingColumns=True)
        writer = both.writeStream.foreachBatch(self._handle).option("checkpointLocation", f"{self.base}/checkpoint")
        # a query takes the settings of its session as it starts, and their number of parts stays that of its checkpoint
        conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
        shuffles = conf.get(name)
        conf.set(name, str(self.partitions or min(int(shuffles), stream.sparkSession.sparkContext.defaultParallelism)))
        try:
            return writer.trigger(**(trigger or {"availableNow": True})).start()
        finally:
            conf.set(name, shuffles)

    def totals(self, spark: SparkSession, epoch: int | None = None) -> dict:
        """Running totals up to ``epoch`` (the last one, if none is given)."""
        if epoch is None:
            found = spark.read.parquet(f"{self.base}/totals").orderBy(F.col("epoch").desc()).first()
        else:
            found = spark.read.schema(TOTALS).parquet(f"{self.base}/totals/epoch={epoch}").first() if epoch >= 0 else None
        return found.asDict() if found else {"high": None, "closing": None, "rows": 0, "late": 0, "windows": 0, "failed": 0, "errors": 0, "seen": 0, "mean": 0.0, "m2": 0.0}

    def _write(self, df: DataFrame, kind: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/{kind}/epoch={epoch}")

    def _handle(self, batch: DataFrame, epoch: int) -> None:
        before = self.totals(batch.sparkSession, epoch - 1)
        batch = batch.persist()
        try:
            closed = batch.where("closed IS NOT NULL").select("closed.*")
            rows = batch.where("row IS NOT NULL").select("row.*")
            # windows closed at the end of the batch before, whose watermark was the highest time of the batches before that (in ms)
            # less the delay; with single stateful operators only, the engine drops rows by this batch's own watermark
            multiple = batch.sparkSession.conf.get("spark.sql.streaming.statefulOperator.allowMultiple", "true") == "true"
            high = before["closing"] if multiple else before["high"]
            start = F.window(self.ts, f"{self.seconds} seconds")["start"]
            late = rows.withColumn("start", start)
            dropped = F.col(self.ts).isNull()
            if high is not None:
                mark = F.timestamp_millis(F.unix_millis(F.lit(high)) - self.delay * 1000)
                dropped = dropped | (F.col("start") + F.expr(f"INTERVAL {self.seconds} SECONDS") <= mark)
            late = late.where(dropped)
            after = before | {"errors": 0}
            try:
                self._write(self.gate(closed), "gold", epoch)
            except Exception as e:  # of the gate: its windows are kept apart, and the query goes on
                after |= {"errors": before["errors"] + 1, "failed": before["failed"] + closed.count()}
                if after["errors"] >= self.max_errors:
                    raise
                self._write(closed.withColumn("error", F.lit(str(e)[:500])), "dead", epoch)
            self._write(late, "late", epoch)
            if self.watch:
                after |= self._alert(closed, before, epoch)
            seen = rows.agg(F.count("*").alias("n"), F.max(self.ts).alias("high")).first()
            highs = [x for x in (before["high"], seen["high"]) if x is not None]
            after |= {"rows": before["rows"] + seen["n"], "late": before["late"] + late.count(), "windows": before["windows"] + closed.count(), "high": max(highs, default=None), "closing": before["high"]}
            own = batch.sparkSession.createDataFrame([tuple(after[k.split()[0]] for k in TOTALS.split(", "))], TOTALS)
            self._write(own, "totals", epoch)
        finally:
            batch.unpersist()

    def _alert(self, closed: DataFrame, before: dict, epoch: int) -> dict:
        """Write the epoch's alerts; the watched column's count, mean and sum of squared deviations with this epoch's windows."""
        value = F.expr(self.watch)
        n, mean, m2 = before["seen"], before["mean"], before["m2"]
        deviation = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
        z = (value - mean) / deviation if deviation else F.lit(None).cast("double")
        self._write(closed.withColumn("watched", value).withColumn("z", z).where(F.abs("z") > self.limit), "alerts", epoch)
        own = closed.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2")).first()
        if not own["n"]:
            return {}
        total, gap = n + own["n"], own["mean"] - mean
        return {"seen": total, "mean": mean + gap * own["n"] / total, "m2": m2 + own["m2"] + gap * gap * n * own["n"] / total}

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        """Rows of all epochs of ``gold``, ``dead``, ``late`` or ``alerts``, with their epoch."""
        return spark.read.parquet(f"{self.base}/{kind}")

    def open(self, spark: SparkSession) -> DataFrame:
        """The windows that are still open, as they stand in the state: start, end, the keys, n and aggregates."""
        state = spark.read.format("statestore").load(f"{self.base}/checkpoint")
        flat = state.select(F.col("key.window.start").alias("start"), F.col("key.window.end").alias("end"), *[F.col(f"key.{k}").alias(k) for k in self.by], "value.*")
        return flat.toDF(*self._columns())

    def corrections(self, spark: SparkSession) -> DataFrame:
        """start, the keys, n and aggregates of the late rows: what to add to closed windows, which are never overwritten."""
        sums = [MERGEABLE[f](c).alias(k) for k, (f, c) in self.aggs.items()]
        return self.read(spark, "late").groupBy("start", *self.by).agg(F.count("*").alias("n"), *sums)


def dead_letter_sink(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], base: str, max_errors: int = 10, **trigger) -> StreamingQuery:
    """What ``handle`` makes of each micro-batch goes to ``gold/epoch=N`` below ``base``; a batch on which it fails goes whole, with the
    error, to ``dead/epoch=N``.  Both are overwritten when an epoch is run again.  ``max_errors`` failing batches in a row stop the query."""
    errors = 0

    def run(batch: DataFrame, epoch: int) -> None:
        nonlocal errors
        try:
            handle(batch).write.mode("overwrite").parquet(f"{base}/gold/epoch={epoch}")
            errors = 0
        except Exception as e:
            errors += 1
            if errors >= max_errors:
                raise
            batch.withColumn("error", F.lit(str(e)[:500])).write.mode("overwrite").parquet(f"{base}/dead/epoch={epoch}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def to_folder(stream: DataFrame, base: str) -> DataFrame:
    """Drive a bounded stream in append mode to its end into Parquet files below ``base``, and read them."""
    q = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")
