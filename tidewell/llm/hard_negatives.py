"""Hard negatives by Four-Russians scoring: exact integer inner products from table lookups.

Components become integers and lie as bit planes: for each row, plane and group of eight dimensions one byte.  An anchor's table
holds, for each group, the sums of all 256 subsets of its eight components, so a byte looks up what the whole group adds
in that plane; a score is the looked-up sums shifted by their planes and added (the highest plane, the sign, is subtracted).

Rows lie in blocks and anchors in tiles in the shared folder.  Every task scores pairs of a tile and a block that it reads
from there, and keeps the few best rows of the block for each anchor; only those are shuffled and merged.  No pair of rows
is ever a row of Spark's, and neither side is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_dir, partition_id, read_part, stash

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Rows of a block at most, and at least where there are fewer blocks than tasks could work on; anchors of a tile.
BLOCK, LEAST, TILE = 1 << 17, 1 << 12, 1 << 10
#: Anchors and rows that a kernel call handles, so that its arrays stay in a core's cache.
WIDE, LONG = 16, 1 << 11


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for anchors (n, 8 * groups) the sum over each subset of a group's components; bit j is the j-th."""
    parts = anchors.reshape(len(anchors), -1, 8).transpose(1, 2, 0)  # group, component, anchor
    sums = np.zeros((parts.shape[0], 256, len(anchors)), np.int64)
    for j in range(8):
        sums[:, 1 << j : 2 << j] = sums[:, : 1 << j] + parts[:, j : j + 1]
    return sums


def bit_planes(q: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes of integers (rows, 8 * groups) in two's complement."""
    return np.stack([np.packbits((q >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(planes)], axis=1)


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products from :func:`subset_sums` and planes laid out as (planes, groups, rows)."""
    depth, groups, n = planes.shape
    out = np.zeros((n, tables.shape[2]), np.int64)
    for a in range(0, n, LONG):
        part = out[a : a + LONG]
        for b in range(depth):
            found = np.zeros_like(part)
            for g in range(groups):
                found += np.take(tables[g], planes[b, g, a : a + LONG], axis=0)
            part += (-found if b == depth - 1 else found) << b
    return out


def best(score: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id, then key."""
    at = np.arange(len(score))
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        sure, ties = np.flatnonzero(score > least), np.flatnonzero(score == least)
        need = k - len(sure)
        if len(ties) > need:
            last = np.partition(ids[ties], need - 1)[need - 1]
            ties = ties[ids[ties] <= last]
        at = np.concatenate([sure, ties])
    return at[np.lexsort((keys[at], ids[at], -score[at]))][:k]


def _pack(batches: Iterable, planes: int, width: int):
    """The rows of a task as one block, in order of label, vec_id and key; repeated rows once."""
    import pyarrow as pa

    last = None
    for batch in batches:
        ids, labels, keys = (batch.column(c).to_pylist() for c in ("vec_id", "label", "key"))
        own = []
        for i, x in enumerate(zip(labels, ids, keys)):
            if x != last:
                own.append(i)
            last = x
        if not own:
            continue
        lists = batch.column("q").to_pylist()
        q = np.zeros((len(own), width), np.int64)
        for row, i in zip(q, own):
            row[: len(lists[i])] = lists[i]
        cols = [pa.array([partition_id()] * len(own), pa.int64())] + [batch.column(c).take(pa.array(own)) for c in ("vec_id", "label", "key")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([x.tobytes() for x in bit_planes(q, planes)], pa.binary())], ["block", "vec_id", "label", "key", "planes"])


def _load(folder: str, kind: str, number: int) -> dict[str, np.ndarray]:
    got = read_part(folder, kind, number)
    if got is None:
        return {k: np.zeros(0, np.int64) for k in ("vec_id", "label", "key")}
    return {c: got.column(c).to_numpy() if c not in ("planes", "q") else got.column(c).to_pylist() for c in got.column_names}


def _pairs(batches: Iterable, anchors: str, blocks: str, tiles: int, planes: int, width: int) -> Iterator[tuple]:
    """(tile number, tile, tile's components, block, block's planes) of each pair number; a task's pairs come block by block."""
    have = None
    for batch in batches:
        for pair in batch.column("id").to_pylist():
            b, t = divmod(pair, tiles)
            if have != b:
                block, have = _load(blocks, "block", b), b
                n = len(block["vec_id"])
                packed = np.frombuffer(b"".join(block.get("planes", [])), np.uint8).reshape(n, planes, width // 8).transpose(1, 2, 0)
                packed = np.ascontiguousarray(packed)
            tile = _load(anchors, "tile", t)
            q = np.zeros((len(tile["vec_id"]), width), np.int64)
            for row, x in zip(q, tile.get("q", [])):
                row[: len(x)] = x
            yield t, tile, q, block, packed


def _rows(found: list[tuple], names: list[str]):
    import pyarrow as pa

    cols = list(zip(*found)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names)


#: What a task returns: the tile, the anchor, (for negatives) the score of the positive, and the row found with its score.
POSITIVE = ["tile", "anchor_id", "anchor_key", "vec_id", "key", "score"]
NEGATIVE = ["anchor_id", "anchor_key", "positive_score", "vec_id", "key", "score"]


def _positives(batches: Iterable, k: int, *where):
    """The best rows of a block with the anchor's label."""
    for t, tile, q, block, packed in _pairs(batches, *where):
        found = []
        for label in np.intersect1d(tile["label"], block["label"]):
            a, b = np.searchsorted(block["label"], label), np.searchsorted(block["label"], label, "right")
            ids, keys = block["vec_id"][a:b], block["key"][a:b]
            own = np.flatnonzero(tile["label"] == label)
            for some in (own[i : i + WIDE] for i in range(0, len(own), WIDE)):
                got = scores(subset_sums(q[some]), packed[:, :, a:b])
                for j, i in enumerate(some):
                    me, my_key = tile["vec_id"][i], tile["key"][i]
                    others = np.flatnonzero((ids != me) | (keys != my_key))
                    at = others[best(got[others, j], ids[others], keys[others], k)]
                    found += [(t, me, my_key, ids[x], keys[x], got[x, j]) for x in at]
        yield _rows(found, POSITIVE)


def _negatives(batches: Iterable, wanted: str, k: int, low: int, high: int, *where):
    """For each anchor and score p of a positive, the best rows of a block with another label and low * p <= 100 * score <= high * p."""
    for t, tile, q, block, packed in _pairs(batches, *where):
        found, limits = [], {}
        want = read_part(wanted, "tile", t)
        for i, key, p in zip(*[want.column(c).to_pylist() for c in ("anchor_id", "anchor_key", "score")]) if want is not None else ():
            limits.setdefault((i, key), set()).add(p)
        own = [i for i in range(len(q)) if (tile["vec_id"][i], tile["key"][i]) in limits]
        for some in (own[i : i + WIDE] for i in range(0, len(own), WIDE)):
            got = scores(subset_sums(q[some]), packed)
            for j, i in enumerate(some):
                me = (tile["vec_id"][i], tile["key"][i])
                others = np.flatnonzero(block["label"] != tile["label"][i])
                s = 100 * got[others, j]
                for p in sorted(limits[me]):
                    fits = others[(low * p <= s) & (s <= high * p)]
                    at = fits[best(got[fits, j], block["vec_id"][fits], block["key"][fits], k)]
                    found += [(*me, p, block["vec_id"][x], block["key"][x], got[x, j]) for x in at]
        yield _rows(found, NEGATIVE)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``vectors`` (vec_id, label, embedding).

    Anchors are the rows where ``anchor`` holds; scores are inner products of floor(256 x).  An anchor's positives are its best
    other rows of the same label, and for each the best rows of other labels with low * positive_score <= 100 * score <=
    high * positive_score follow, ranked from 1; ties go by the smaller vec_id.  Rows without vec_id, label or embedding, or with
    a null or non-finite component, take no part.  Rows equal in vec_id, label and integers count once; rows that share only
    the vec_id are different rows.  Shorter vectors end in zeros.  No rows or no anchors give no rows.  Components so large that
    a score might leave 64 bits raise an error.  Further columns are ignored.
    """
    spark = vectors.sparkSession
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(~F.exists("x", odd)).withColumn("x", F.transform("x", lambda x: F.lit(float(SCALE)) * x))
    seen = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("x")), F.max(F.array_max("x")), F.min(F.array_min("x"))).first()
    n, n_anchors, size, top, bottom = (x or 0 for x in seen)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], result)
    if 100 * max(size, 1) * (max(abs(top), abs(bottom)) + 1) ** 2 >= 2**63:
        raise ValueError("components are too large: a score might leave 64 bits")
    planes = 1 + max(int(np.floor(top)).bit_length(), int(-np.floor(bottom) - 1).bit_length() if bottom < 0 else 0)
    width = 8 * max(1, -(-size // 8))
    cores = spark.sparkContext.defaultParallelism
    n_blocks = max(-(-n // BLOCK), min(-(-n // LEAST), 2 * cores))
    n_tiles = -(-n_anchors // TILE)

    rows = rows.select("vec_id", "label", "anchor", F.transform("x", lambda x: F.floor(x).cast("long")).alias("q"))
    rows = rows.withColumn("key", F.xxhash64("vec_id", "label", "q"))
    blocks, anchors, wanted = (new_dir(spark, x) for x in ("vector-blocks", "anchor-tiles", "positives"))
    packed = rows.select("vec_id", "label", "key", "q").repartition(n_blocks).sortWithinPartitions("label", "vec_id", "key")
    packed = packed.mapInArrow(lambda b: _pack(b, planes, width), "block long, vec_id long, label long, key long, planes binary")
    packed.write.partitionBy("block").option("compression", "zstd").parquet(blocks)
    tiles = rows.where("anchor").select("vec_id", "label", "key", "q").dropDuplicates(["vec_id", "label", "key"]).repartition(n_tiles)
    tiles.withColumn("tile", F.spark_partition_id()).write.partitionBy("tile").option("compression", "zstd").parquet(anchors)

    pairs = spark.range(0, n_blocks * n_tiles, 1, min(n_blocks * n_tiles, 20_000))
    where = (anchors, blocks, n_tiles, planes, width)

    def merged(found: DataFrame, per: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*per).orderBy(F.col("score").desc(), "vec_id", "key")
        return found.dropDuplicates([*per, "vec_id", "key"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    kinds = lambda names: ", ".join(f"{x} long" for x in names)
    near = pairs.mapInArrow(lambda b: _positives(b, positives, *where), kinds(POSITIVE))
    near = stash(merged(near, ["tile", "anchor_id", "anchor_key"], positives), "positives")
    near.select("tile", "anchor_id", "anchor_key", "score").repartition(n_tiles, "tile").write.partitionBy("tile").parquet(wanted)
    far = pairs.mapInArrow(lambda b: _negatives(b, wanted, negatives, low, high, *where), kinds(NEGATIVE))
    per = ["anchor_id", "anchor_key", "positive_score"]
    far = merged(far, per, negatives).select(*per, "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("anchor_id", "anchor_key", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
    return near.join(far, per).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
