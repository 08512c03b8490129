"""Exact nearest vectors by blocks: tiles of queries against blocks of rows as matrix products.

Both sides lie in the shared folder in blocks of bounded size.  A task multiplies a tile by a block that it reads from there and keeps
the best few rows for each query; those few are merged.  No pair of rows is ever a row of Spark's, and neither side is
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.stages import read_part, shared_folder

#: Rows of a block at most, and at least where there are fewer blocks than tasks could work on; queries of a tile.
BLOCK, LEAST, TILE = 1 << 16, 1 << 12, 1 << 10


def _units(folder: str, column: str, number: int) -> tuple[list, np.ndarray]:
    """Keys and unit vectors of a block or tile."""
    got = read_part(folder, column, number)
    if got is None:
        return [], np.zeros((0, 0))
    v = np.array(got.column("v").to_pylist(), np.float64)
    return got.column("id").to_pylist(), v / np.linalg.norm(v, axis=1, keepdims=True)


def _best(batches: Iterable, tiles: str, blocks: str, n_tiles: int, k: int):
    import pyarrow as pa

    have, names = None, ["query", "neighbour", "similarity"]
    for batch in batches:
        for pair in batch.column("id").to_pylist():  # block by block
            b, t = divmod(pair, n_tiles)
            if have != b:
                (ids, rows), have = _units(blocks, "block", b), b
            asked, q = _units(tiles, "tile", t)
            found = []
            for a in range(0, len(asked) if ids else 0, 64):
                for query, s in zip(asked[a : a + 64], q[a : a + 64] @ rows.T):
                    # k + 1, as the query may be among the rows; all that tie with the last one
                    least = np.partition(s, max(0, len(s) - k - 1))[max(0, len(s) - k - 1)]
                    near = sorted((-s[i], ids[i]) for i in np.flatnonzero(s >= least) if ids[i] != query)[:k]
                    found += [(query, i, -x) for x, i in near]
            cols = list(zip(*found)) or [()] * 3
            kinds = [batch.schema.field("kind").type] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds)], names)


def cosine_topk(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """query, neighbour, similarity: for each of ``queries`` the ``k`` rows of ``base`` with another key of highest cosine similarity, ties
    by key.

    Every query meets every row.  Rows without key or vector, with a null component or of length zero take no part; vectors of
    different lengths raise an error.
    """
    spark = base.sparkSession
    kind = base.schema[key].dataType.simpleString()

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
        return rows.where(F.exists("v", lambda x: x != 0))

    rows, asked = usable(base), usable(queries)
    sizes = rows.select(F.size("v").alias("d"), F.lit(0).alias("q")).unionByName(asked.select(F.size("v").alias("d"), F.lit(1).alias("q")))
    got = sizes.agg(F.count_if(F.col("q") == 0).alias("n"), F.count_if(F.col("q") == 1).alias("m"), F.min("d").alias("least"), F.max("d").alias("most")).first()
    if not got["n"] or not got["m"]:
        return spark.createDataFrame([], f"query {kind}, neighbour {kind}, similarity double")
    if got["least"] != got["most"]:
        raise ValueError(f"vectors of {got['least']} to {got['most']} components")
    n_blocks = max(-(-got["n"] // BLOCK), min(-(-got["n"] // LEAST), 2 * spark.sparkContext.defaultParallelism))
    n_tiles = -(-got["m"] // TILE)
    tiles, blocks = shared_folder(spark, "tiles"), shared_folder(spark, "blocks")
    for df, n, name, folder in ((rows, n_blocks, "block", blocks), (asked, n_tiles, "tile", tiles)):
        df.repartition(n).withColumn(name, F.spark_partition_id()).write.partitionBy(name).option("compression", "zstd").parquet(folder)
    pairs = spark.range(0, n_blocks * n_tiles, 1, min(n_blocks * n_tiles, 20_000)).withColumn("kind", F.lit(None).cast(kind))
    found = pairs.mapInArrow(lambda b: _best(b, tiles, blocks, n_tiles, k), f"query {kind}, neighbour {kind}, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return found.dropDuplicates(["query", "neighbour", "similarity"]).withColumn("_r", place).where(F.col("_r") <= k).drop("_r")
