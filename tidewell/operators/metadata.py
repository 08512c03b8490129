"""State and metadata tables: schema registry, layers, lineage, watermarks, baselines, archive, audit."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.utils import AnalysisException

from tidewell.operators.governance import dataset_checksum


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing stored so far
        return spark.createDataFrame([], schema)


class SchemaRegistry:
    """Append-only versions of schemas: a missing or retyped column makes a major version, a new one a minor, else a patch."""

    SCHEMA = "dataset string, version string, major int, minor int, patch int, fields map<string,string>, at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def history(self, dataset: str) -> DataFrame:
        return _read(self.spark, self.path, self.SCHEMA).where(F.col("dataset") == dataset).orderBy("major", "minor", "patch")

    def latest(self, dataset: str):
        return self.history(dataset).orderBy(F.desc("major"), F.desc("minor"), F.desc("patch")).first()

    def register(self, dataset: str, df: DataFrame, at: datetime | None = None) -> tuple[str, list[tuple[str, str]]]:
        """(version, drift): drift lists (column, MISSING | TYPE_CHANGE | ADDITIVE)."""
        fields, old = dict(df.dtypes), self.latest(dataset)
        before = dict(old["fields"]) if old else fields
        drift = [(c, "MISSING") for c in before if c not in fields] + [(c, "TYPE_CHANGE") for c in before if c in fields and fields[c] != before[c]] + [(c, "ADDITIVE") for c in fields if c not in before]
        kinds = {k for _, k in drift}
        if not old:
            v = (1, 0, 0)
        elif kinds & {"MISSING", "TYPE_CHANGE"}:
            v = (old["major"] + 1, 0, 0)
        elif kinds:
            v = (old["major"], old["minor"] + 1, 0)
        else:
            v = (old["major"], old["minor"], old["patch"] + 1)
        name = ".".join(map(str, v))
        self.spark.createDataFrame([(dataset, name, *v, fields, at or datetime.now())], self.SCHEMA).write.mode("append").parquet(self.path)
        return name, drift


class LayerStore:
    """Bronze, silver and gold snapshots: immutable Parquet folders with a checksum row each."""

    SCHEMA = "layer string, dataset string, snapshot string, source string, n long, checksum long, at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, layer: str, dataset: str, snapshot: str) -> str:
        return f"{self.root}/{layer}/{dataset}/{snapshot}"

    def store(self, df: DataFrame, dataset: str, layer: str = "bronze", source: str | None = None) -> str:
        snapshot = uuid.uuid4().hex
        df.write.mode("errorifexists").parquet(self.path(layer, dataset, snapshot))
        got = dataset_checksum(self.read(layer, dataset, snapshot)).first()
        self.spark.createDataFrame([(layer, dataset, snapshot, source, got["n"], got["xor"], datetime.now())], self.SCHEMA).write.mode("append").parquet(f"{self.root}/_snapshots")
        return snapshot

    def read(self, layer: str, dataset: str, snapshot: str) -> DataFrame:
        return self.spark.read.parquet(self.path(layer, dataset, snapshot))

    def promote(self, dataset: str, snapshot: str, transform: Callable[[DataFrame], DataFrame], to: str = "silver") -> str:
        """Derive the next layer; a transform that fails leaves no snapshot row."""
        layer = {"silver": "bronze", "gold": "silver"}[to]
        return self.store(transform(self.read(layer, dataset, snapshot)), dataset, to, snapshot)

    def snapshots(self) -> DataFrame:
        return _read(self.spark, f"{self.root}/_snapshots", self.SCHEMA)

    def verify(self, layer: str, dataset: str, snapshot: str) -> bool:
        row = self.snapshots().where((F.col("snapshot") == snapshot) & (F.col("layer") == layer)).first()
        got = dataset_checksum(self.read(layer, dataset, snapshot)).first()
        return row is not None and (row["n"], row["checksum"]) == (got["n"], got["xor"])

    def archive(self, before: datetime, to: str) -> DataFrame:
        """Rewrite snapshots older than ``before`` compressed by zstd under ``to``; returns their rows."""
        old = self.snapshots().where(F.col("at") < F.lit(before))
        for r in old.select("layer", "dataset", "snapshot").collect():  # one row a snapshot
            self.read(*r).write.mode("overwrite").option("compression", "zstd").parquet(f"{to}/{r['layer']}/{r['dataset']}/{r['snapshot']}")
        return old


def lineage_of(log: DataFrame, dataset: str) -> DataFrame:
    """Records of a dataset, newest first."""
    return log.where(F.col("dataset") == dataset).orderBy(F.desc("at"), F.desc("record"))


def lineage_join(gold: DataFrame, silver: DataFrame) -> DataFrame:
    return gold.join(silver.select(F.col("snapshot").alias("source"), F.col("at").alias("source_at")), "source")


def latest_rows(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    return log.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(o) for o in order]))).where("_r = 1").drop("_r")


def audit_latest(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("at"), F.desc("record")).limit(n)


def rolling_baseline(old: DataFrame, new: DataFrame, weight: float = 0.2) -> DataFrame:
    """Histograms (column, bin, share) blended: (1 - weight) old + weight new."""
    both = old.select("column", "bin", F.col("share").alias("a")).join(new.select("column", "bin", F.col("share").alias("b")), ["column", "bin"], "full").na.fill(0.0, ["a", "b"])
    return both.select("column", "bin", ((1 - weight) * F.col("a") + weight * F.col("b")).alias("share"))


def incremental_scan(df: DataFrame, watermark: str, last) -> tuple[DataFrame, DataFrame]:
    """(rows after ``last``, the new watermark)."""
    new = df.where(F.col(watermark) > F.lit(last))
    return new, new.agg(F.max(watermark).alias("watermark"))
