"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that all executors share (see :func:`shared_base`)."""
    return f"{shared_base(spark)}/{label}-{uuid.uuid4().hex}"


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.  A local session may do
    without; on a cluster a folder of the driver's own machine would lose the data of all others, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Rows a part of steps that keep each row as an object of some hundred bytes, as Spark ML's trees and k-means do.
OBJECTS = 500_000


def evenly(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, dealt out evenly if it comes from fewer files than there are cores, ahead of heavy work on its rows: a scan cuts
    files between row groups only, so a small table would be one task.  Tables of more files are left as they lie.
    With ``most`` a part has about so many rows at most, so what a task keeps of its rows does not grow with the table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = -(-df.count() // most) if most else 0
    if parts > cores:
        return df.repartition(parts)
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it: its lineage is cut, and a lost executor costs
    a re-read."""
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """The Arrow file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    if "://" in uri or not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri[len("file:") :]


def read_part(folder: str, column: str, value: int):
    """In a task: the Arrow table of one value of a Parquet folder written by ``partitionBy(column)``; None if it has no rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs as store

    fs, path = open_fs(folder)
    found = fs.get_file_info(store.FileSelector(f"{path}/{column}={value}", allow_not_found=True))
    tables = [pq.read_table(fs.open_input_file(f.path)) for f in found if f.path.endswith(".parquet")]
    return pa.concat_tables(tables) if tables else None
