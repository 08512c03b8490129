"""Event-time windows for batch tables and streams; closed windows of a stream are in ``closed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import agg_row


def event_time(column: Column) -> Column:
    """A timestamp from epoch seconds, epoch milliseconds or ISO text."""
    number = column.try_cast("double")
    return F.when(number > 1e11, F.timestamp_micros((number * 1000).cast("long"))).when(number.isNotNull(), F.timestamp_micros((number * 1e6).cast("long"))).otherwise(F.try_to_timestamp(column))


def tumbling(df: DataFrame, ts: str, seconds: int = 300, by: list[str] = (), **aggs: Column) -> DataFrame:
    """start, end, n and ``aggs`` of epoch-anchored windows; for batch tables and streams alike."""
    out = df.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *by).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in aggs.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", *aggs)


def tumbling_anchored(df: DataFrame, ts: str, seconds: int = 300) -> DataFrame:
    """Windows of a batch table that start at its first event: window_id, start, n."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    lo = agg_row(df, {"lo": F.min(at)})["lo"]
    k = F.floor((at - F.lit(lo)) / (seconds * 1_000_000))
    return df.groupBy(k.alias("window_id")).agg(F.count("*").alias("n")).withColumn("start", F.timestamp_micros(F.lit(lo) + F.col("window_id") * seconds * 1_000_000))


def sliding(df: DataFrame, ts: str, seconds: int = 600, step: int = 120, **aggs: Column) -> DataFrame:
    out = df.groupBy(F.window(ts, f"{seconds} seconds", f"{step} seconds").alias("w")).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in aggs.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *aggs)


def rows_in_sliding(df: DataFrame, ts: str, seconds: int, step: int) -> DataFrame:
    """Every row once for each sliding window that holds it."""
    return df.withColumn("_w", F.explode(F.transform(F.sequence(F.lit(0), F.lit(-(-seconds // step) - 1)), lambda i: F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / step) * step - i * step))).where(F.unix_seconds(F.col(ts).cast("timestamp")) < F.col("_w") + seconds).withColumn("start", F.timestamp_seconds("_w")).drop("_w")


def session(df: DataFrame, ts: str, gap: int = 300, by: list[str] = (), ranges: int | None = None, **aggs: Column) -> DataFrame:
    """Sessions that end at their last event; an event exactly ``gap`` seconds later still belongs.

    Those of a batch table are numbered by breaks, with large keys split into ranges, and then summed; a stream keeps them in state.
    """
    own = [F.max(ts).alias("end"), F.count("*").alias("n"), *[c.alias(k) for k, c in aggs.items()]]
    if df.isStreaming:
        out = df.groupBy(F.session_window(ts, f"{gap} seconds").alias("w"), *by).agg(*own)
        return out.select(F.col("w.start").alias("start"), "end", *by, "n", *aggs)
    from tidewell.operators.ordering import session_breaks

    found = session_breaks(df.where(F.col(ts).isNotNull()), ts, list(by), gap, ranges)
    return found.groupBy("session", *by).agg(F.min(ts).alias("start"), *own).select("start", "end", *by, "n", *aggs)


def advise_windows(df: DataFrame, ts: str, by: list[str], ranges: int | None = None) -> DataFrame:
    """median gap by ``by`` and the windows it suggests: tumbling 5x, sliding 2x, watermark 3x tumbling, clamped."""
    from tidewell.operators.ordering import interarrival_stats

    gap = F.when(F.col("median_gap") > 0, F.col("median_gap")).otherwise(60.0)
    out = interarrival_stats(df, ts, by, ranges).withColumn("tumbling", F.greatest(F.lit(10.0), F.least(gap * 5, F.lit(3600.0))).cast("int"))
    return out.select(*by, "median_gap", "tumbling", F.greatest(F.lit(5.0), F.least(gap * 2, F.col("tumbling"))).cast("int").alias("sliding"), (F.col("tumbling") * 3).alias("watermark"))


def stream_files(spark, path: str, schema, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def kafka_options(servers: str, topics: list[str], group: str | None = None, start: str = "latest", per_trigger: int | None = None, sasl: dict[str, str] | None = None) -> dict[str, str]:
    """Options of Spark's Kafka source (Event Hubs and Redpanda speak the same protocol)."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": start, "failOnDataLoss": "false"}
    out |= {"kafka.group.id": group} if group else {}
    out |= {"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {}
    for k, v in (sasl or {}).items():
        out[f"kafka.{k}"] = v
    return out


def stream_kafka(spark, schema: str, **options) -> DataFrame:
    """Records of Kafka topics decoded from JSON, with ``_raw`` for those that don't parse.  Needs the Kafka package."""
    raw = spark.readStream.format("kafka").options(**kafka_options(**options)).load()
    return decode_json(raw.select(F.col("value").cast("string").alias("value"), "topic", "timestamp"), "value", schema)


def decode_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of ``schema``, and ``_raw`` with the text of rows that don't parse (else null)."""
    parsed = F.from_json(column, f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    out = df.withColumn("_j", parsed)
    return out.select(*[c for c in df.columns if c != column], "_j.*").withColumnRenamed("_bad", "_raw")


def deduplicated(stream: DataFrame, key: str, ts: str, delay: str = "5 minutes") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def run_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a bounded stream to its end into a memory table (tests and small results only)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


