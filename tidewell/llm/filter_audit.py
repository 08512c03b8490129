"""Audit of how filters interact: what each order of applying them keeps, removes and loses.

Every document becomes a mask of the filters it fails, and only the counts of each (part, mask) cell go further.  A Gray-code walk
visits all subsets of filters, toggling one at a time: each cell keeps a counter of the active filters that it fails, the cells that
become or cease to be hit leave or rejoin the running survivors, and the survivors of each subset are stored.  Any step of
any order is then a difference of two stored states.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stash

MIN_WORDS = 200
MIN_DISTINCT = 50  # distinct words, percent of words
MAX_CAPITALS = 2  # [A-Z], percent of code points
SYMBOLS = r"[#$%&*|]"
#: The filter that sees the whole table: a text that a smaller doc_id has, too.
COPY = "E"


def text_filters() -> dict[str, Column]:
    """The failure conditions on one text, by letter; ``text`` is not null, ``words`` are its words."""
    capitals = F.char_length("text") - F.char_length(F.regexp_replace("text", "[A-Z]+", ""))
    return {
        "A": F.size("words") < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * F.size("words"),
        "C": 100 * capitals > MAX_CAPITALS * F.char_length("text"),
        "D": F.col("text").rlike(SYMBOLS),
    }


def failures(docs: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, part, mask: the filters that each row of ``docs`` (doc_id, text, source) fails, a bit for each in the order of
    ``filters`` and the highest one for COPY.

    Null texts are empty, null sources the empty part.  A row without doc_id is no copy and nothing is a copy of it; rows that
    repeat both text and doc_id are no copies of each other.  Texts are compared by SHA-256.
    """
    filters = filters or text_filters()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    bits = [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(filters.values())]
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    rows = stash(rows.select("doc_id", "part", key.alias("key"), sum(bits, F.lit(0)).cast("int").alias("mask")), "masks")
    # copies meet in the map-side sums; joined as tables, so a large group of copies can be split
    first = stash(rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("key", "first_id"), "copies")
    copy = F.when(F.col("first_id") < F.col("doc_id"), 1 << len(filters)).otherwise(0)
    return rows.join(first, "key", "left").select("doc_id", "part", (F.col("mask") + copy).cast("int").alias("mask"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each cell, and those that ``labels`` (doc_id, quality, toxic) calls good or
    toxic; of several labels of a doc_id, one that says so is enough."""
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id")
    marks = stash(marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad")), "marks")
    both = rows.join(marks, "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """For counts (parts, 2^k masks, measures), what is left of each part under each subset of filters, by Gray-code walk."""
    masks = np.arange(counts.shape[1])
    active, running = np.zeros(len(masks), np.int64), counts.sum(axis=1)
    states = np.empty_like(counts)
    states[:, 0] = running
    subset = 0
    for step in range(1, len(masks)):
        bit = step & -step  # the one filter that the next code toggles
        subset ^= bit
        fails = (masks & bit) != 0
        if subset & bit:
            running = running - counts[:, fails & (active == 0)].sum(axis=1)
            active[fails] += 1
        else:
            active[fails] -= 1
            running = running + counts[:, fails & (active == 0)].sum(axis=1)
        states[:, subset] = running
    return states


def _steps(batches: Iterable, letters: str):
    import pyarrow as pa

    k = len(letters)
    orders = list(permutations(range(k)))
    at = np.array([f for order in orders for f in order])
    before = np.array([sum(1 << f for f in order[:i]) for order in orders for i in range(k)])
    after = before | 1 << at
    names = np.array(["".join(letters[f] for f in order) for order in orders]).repeat(k)
    for batch in batches:
        parts, lists = batch.column("part").to_pylist(), batch.column("cells").to_pylist()
        for a in range(0, len(parts), 256):
            counts = np.zeros((len(parts[a : a + 256]), 1 << k, 3), np.int64)
            for own, part in zip(counts, lists[a : a + 256]):
                for x in part:
                    own[x["mask"]] = x["n"], x["good"], x["toxic"]
            states = survivors(counts)
            lost = states[:, before] - states[:, after]
            kept = states[:, after, 0]
            fails = states[:, :1, 0] - states[:, 1 << np.arange(k), 0]
            total = np.stack([lost[:, at == f, 0].sum(axis=1) for f in range(k)], axis=1)
            cols = [kept, lost[..., 0], fails[:, at] - lost[..., 0], counts[:, 1 << at, 0], lost[..., 1], lost[..., 2], total[:, at]]
            n = len(counts)
            own = [pa.array(np.repeat(np.arange(n), len(at))), pa.array(np.tile(names, n).tolist()), pa.array(np.tile(np.arange(len(at)) % k + 1, n).astype(np.int32)), pa.array([letters[f] for f in at] * n)]
            own[0] = pa.array(parts[a : a + 256], pa.string()).take(own[0])
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(x.ravel()) for x in cols]], ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """One row for each part (source), order of the filters and step: part, filter_order, step, filter, and the numbers of
    documents kept, removed, redundant (failing this filter, removed earlier), unique_fails (failing this one only), good_lost,
    toxic_lost and shapley (removed by this filter in all orders together).

    ``filters`` are named by one letter each, without E; see :func:`failures` for nulls, ties and repeated rows.  Long texts are
    read whole; further columns of any name are ignored; no documents give no rows.
    """
    filters = filters or text_filters()
    letters = "".join(filters) + COPY
    found = cells(failures(docs, filters), labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    counts = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return found.mapInArrow(lambda b: _steps(b, letters), f"part string, filter_order string, step int, filter string, {counts}")
