"""Helpers that the training-data operators share.

Every operator takes and returns DataFrames.  Intermediate results that are read more than once are written as Parquet
to the folder named by ``spark.checkpoint.dir`` (see ``stash``), so a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.stages import evenly, open_fs, read_part, stash
from tidewell.functions.stages import shared_folder as new_dir

#: A word is a run of anything but these bytes; ``bytes.split()`` cuts at the same six.
SPACE = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, dealt out evenly if it is one of few files: work on whole texts is heavy."""
    return evenly(table(spark, sf_dir, name))


def sheltered(docs: DataFrame, used: list[str]) -> DataFrame:
    """``docs`` with every column but ``used`` under a name that no operator uses; :func:`unsheltered` names them back."""
    return docs.toDF(*[c if c in used else f"other{i}" for i, c in enumerate(docs.columns)])


def unsheltered(out: DataFrame, columns: list[str], used: list[str]) -> DataFrame:
    return out.select(*[F.col(c if c in used else f"other{i}").alias(c) for i, c in enumerate(columns)])


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes: rows whose text is equal (null counts as empty) have an equal key."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("c1"), F.xxhash64(F.lit("second"), text).alias("c2")]


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z and nothing else changes; texts of one-byte characters take the JVM's fast ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def attempt_name() -> str:
    """Differs between partitions and between attempts of a partition."""
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def partition_id() -> int:
    return TaskContext.get().partitionId()


def byte_list(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null becomes empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def text_table(docs: DataFrame, label: str) -> DataFrame:
    """Each text of ``docs`` (doc_id, text) once: c1, c2, text, copies and first_id (the smallest doc_id).

    It is written as a table bucketed by (c1, c2) in the shared folder, so that later joins on the key move only the other,
    narrow side.  Copies meet in the map-side aggregate, so a large group of them is one row a task in the shuffle.
    """
    spark = docs.sparkSession
    once = docs.groupBy(*text_key(F.col("text"))).agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    name, buckets = f"{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = once.write.format("parquet").bucketBy(buckets, "c1", "c2").option("path", new_dir(spark, label)).option("compression", "zstd")
    writer.saveAsTable(name)
    return spark.table(name)
