"""Benchmark decontamination in DataFrame functions only.

The test items' words form windows of ``size`` words (an item with fewer words is one window).  A window of L words always
holds a whole block of ceil(L/2) words whose position in the document is a multiple of ceil(L/2), so only those aligned
blocks of a document are hashed and probed against the broadcast hash set of all test blocks.  Blocks that hit are turned
into full windows, which are compared word for word with the test windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, sheltered, stash, text_key, unsheltered

#: What separates words: ASCII other than letters and digits (texts are lower-cased before).
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a text that are handled at once.
STRETCH = 1024
#: The test set is broadcast up to this many blocks (16 bytes each); a larger one is joined by shuffle.
BROADCAST_BLOCKS = 4_000_000


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def bench_windows(bench: DataFrame, size: int) -> DataFrame:
    """item, len, win (words joined by blanks): the distinct windows of each item; items without words have none."""
    words = bench.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    words = words.withColumn("len", F.least(F.size("w"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    return words.select("item", "len", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("len")), " "))).alias("win")).distinct()


def _blocks(windows: DataFrame) -> DataFrame:
    """len, b: the hashes of all blocks of the windows, of half the window's length each."""
    w, block = F.split("win", " "), F.floor((F.col("len") + 1) / 2).cast("int")
    starts = F.sequence(F.lit(1), F.size(w) - block + 1)
    return windows.select("len", F.explode(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, block)))).alias("b")).distinct()


def _stretches(texts: DataFrame, size: int) -> DataFrame:
    """c1, c2, at, w: the words of each text in stretches of STRETCH words and the ``size`` - 1 that follow; ``at`` is the first word."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(STRETCH))
    cut = F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("w", i + 1, F.lit(STRETCH + size - 1)).alias("w")))
    return texts.select("c1", "c2", F.explode(cut).alias("s")).select("c1", "c2", "s.at", "s.w")


def _aligned(length: int) -> Column:
    """b, first, near of each whole block at a multiple of the block length in the stretch ``w``: its hash, and the words around it
    (from place ``first``) that any window of ``length`` words with this block lies in."""
    block = (length + 1) // 2
    starts = F.when(F.size("w") >= length, F.sequence(F.lit(0), F.size("w") - block, F.lit(block))).otherwise(F.array().cast("array<int>"))
    first = lambda i: F.greatest(i - (length - block), F.lit(0))
    return F.transform(starts, lambda i: F.struct(F.lit(length).alias("len"), F.xxhash64(F.slice("w", i + 1, F.lit(block))).alias("b"), first(i).alias("first"), F.slice("w", first(i) + 1, i - first(i) + length).alias("near")))


def window_hits(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """c1, c2 (text_key of a text), start, len, item: every occurrence of a test window in a distinct text of ``docs``.

    Texts are read once for all lengths of windows, and a block's row carries the few words around it, so the work grows with
    the number of words, however long a text is.
    """
    windows = stash(bench_windows(bench, size), "windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # 1 .. size at most
    texts = docs.select(*text_key(F.col("text")), normal_words(F.col("text")).alias("w"))
    if not lengths:
        return texts.where("false").select("c1", "c2", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("item"))
    blocks = _blocks(windows)
    if blocks.count() <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    found = _stretches(texts, size).select("c1", "c2", "at", F.explode(F.concat(*[_aligned(n) for n in lengths])).alias("x"))
    around = found.select("c1", "c2", (F.col("at") + F.col("x.first")).alias("first"), "x.len", "x.b", "x.near").join(blocks, ["len", "b"]).drop("b").distinct()
    inner = F.transform(F.sequence(F.lit(0), F.size("near") - F.col("len")), lambda i: F.struct((F.col("first") + i).alias("start"), F.array_join(F.slice("near", i + 1, F.col("len")), " ").alias("win")))
    spans = around.where(F.size("near") >= F.col("len")).select("c1", "c2", "len", F.explode(inner).alias("s")).select("c1", "c2", "len", "s.start", "s.win").distinct()
    return spans.join(windows, ["len", "win"]).select("c1", "c2", "start", "len", "item")


def merged_spans(hits: DataFrame) -> DataFrame:
    """c1, c2, spans: the stretches of hit words of each text as ordered (start, end), overlapping and touching ones as one."""
    own = hits.select("c1", "c2", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    w = Window.partitionBy("c1", "c2").orderBy("start", "end")  # one text's windows
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = own.groupBy("c1", "c2", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("c1", "c2").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def covered(spans: str) -> Column:
    """Words covered by an array of (start, len) structs: merged in order of start."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["start"] + x["len"] - F.greatest(x["start"], a["end"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["end"], x["start"] + x["len"]).alias("end"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def contamination(docs: DataFrame, bench: DataFrame, keys: list[str], size: int = 10) -> DataFrame:
    """``keys``, n_words, n_hit (words inside any occurrence), n_items, items (sorted item ids as strings), spans.

    One row for each row of ``docs``; null texts have no words and no hits; equal texts are examined in each row but their
    hits are kept once; further columns are ignored.  With no benchmark items nothing is hit.
    """
    docs = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "text")
    hits = window_hits(docs, bench, size)
    # an array holds one text's spans or items: bounded by the text and the test set
    # read from a table: both sides of the join are plain exchanges, so a large group of copies can be split
    per_text = stash(hits.groupBy("c1", "c2").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")), "hits")
    rows = docs.select(*[f"k{i}" for i in range(len(keys))], *text_key(F.col("text")), F.size(normal_words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(per_text, ["c1", "c2"], "left")
    empty = F.array().cast("array<string>")
    return out.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)],
        "n_words",
        F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(covered("spans")).alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", empty).alias("items"),
        F.col("spans"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` (all columns, of any names) without the rows that hold a test window."""
    columns, docs = docs.columns, sheltered(docs, ["text"])
    hits = window_hits(docs, bench, size).select(F.col("c1").alias("_c1"), F.col("c2").alias("_c2")).distinct()
    c1, c2 = text_key(F.col("text"))
    return unsheltered(docs.join(hits, (c1 == F.col("_c1")) & (c2 == F.col("_c2")), "left_anti"), columns, ["text"])


def remove_spans(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` (all columns, of any names) with the hit words cut out of ``text``: untouched texts stay as they are, others
    become their other normalised words joined by blanks."""
    columns, docs = docs.columns, sheltered(docs, ["text"])
    hits = stash(merged_spans(window_hits(docs, bench, size)).select(F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), F.col("spans").alias("_spans")), "spans")
    c1, c2 = text_key(F.col("text"))
    out = docs.join(hits, (c1 == F.col("_c1")) & (c2 == F.col("_c2")), "left").withColumn("_w", normal_words(F.col("text")))
    # what lies before, between and after the spans
    end = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at("_spans", i)["end"])
    start = lambda i: F.coalesce(F.try_element_at("_spans", i + 1)["start"], F.size("_w"))
    between = F.transform(F.sequence(F.lit(0), F.size("_spans")), lambda i: F.slice("_w", end(i) + 1, start(i) - end(i)))
    out = out.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(between), " ")))
    return unsheltered(out, columns, ["text"])
