"""Line dedup by content-defined chunks at several salted levels, with matches grown line by line.

At each level a rolling hash over two lines decides whether a boundary lies between them, so a chunk depends on its own lines and on
the two beside it.  Boundaries are dense (chunks of one to three lines) and differ from level to level, so a repeated run of lines
holds a chunk that is cut the same way in all its places at some level; equal chunks of several lines match, whatever their levels.
A match is a seed: its first place (smallest doc_id, then line) and a later one are compared line by line to both sides, and
matches on one diagonal of the same two texts merge.  What has been matched is removed after its bytes have been compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_list, stash, text_key, text_table

#: Independent choices of boundaries; between two lines lies one with chance 3/4.
LEVELS = 14
#: The most lines of a chunk, and the lines by which a match grows at either end (longer runs hold further matches).
MOST, REACH = 16, 4
_SALT, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)


def line_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' lines, and where each text begins (and the end)."""
    import xxhash

    lines = [t.split(b"\n") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    return np.fromiter((xxhash.xxh64_intdigest(x) for own in lines for x in own), np.uint64, starts[-1]), starts


def cuts(hashes: np.ndarray, starts: np.ndarray, level: int) -> np.ndarray:
    """First lines of the level's chunks: each text's first line, and those after which the rolling hash chooses a boundary."""
    begin, end = (np.uint64(pow(_SALT, 2 * level + k, 1 << 64)) for k in (1, 2))
    rolling = hashes * begin
    rolling[1:] |= hashes[:-1] * end  # top bits: this line begins a chunk, or the one before ends one
    cut = rolling >> np.uint64(63) == 1
    cut[starts[:-1]] = True
    return np.flatnonzero(cut)


def chunks(hashes: np.ndarray, starts: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, lines, hash) of the distinct chunks of 2 to MOST lines at all levels; longer ones are cut into such.  Two equal
    lines in a row, between which no hash of lines can choose, are always a chunk."""
    twins = np.flatnonzero(hashes[1:] == hashes[:-1])
    codes = [twins[~np.isin(twins + 1, starts)] * 32 + 2]
    for level in range(levels):
        first = cuts(hashes, starts, level)
        size = np.diff(first, append=len(hashes))
        for i in np.flatnonzero(size > MOST):
            pieces = np.arange(first[i], first[i] + size[i], MOST)
            codes.append(pieces * 32 + np.diff(pieces, append=first[i] + size[i]))
        codes.append((first * 32 + size)[size <= MOST])
    codes = np.unique(np.concatenate(codes))
    first, size = codes // 32, codes % 32
    first, size = first[size > 1], size[size > 1]
    mixed = hashes[first].copy()
    for back in range(1, MOST):
        more = size > back
        mixed[more] = (mixed[more] ^ mixed[more] >> np.uint64(31)) * _STEP + hashes[first[more] + back]
    return first, size, mixed * _STEP + size.astype(np.uint64)


def _map_chunks(batches: Iterable, levels: int):
    import pyarrow as pa

    for batch in batches:
        hashes, starts = line_hashes(byte_list(batch.column("text")))
        first, size, mixed = chunks(hashes, starts, levels)
        own = np.searchsorted(starts, first, "right") - 1
        c1, c2 = (batch.column(k).to_numpy()[own] for k in ("c1", "c2"))
        cols = [pa.array(c1), pa.array(c2), pa.array((first - starts[own]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(mixed.view(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, ["c1", "c2", "start", "n", "h"])


def _beside(hashes: np.ndarray, places: np.ndarray, ok: np.ndarray):
    """Lists of the hashes at ``places`` (rows, REACH) up to where ``ok`` ends."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(ok.sum(axis=1))]).astype(np.int32), pa.array(hashes[places[ok]].view(np.int64)))


def _map_beside(batches: Iterable):
    """Each listed chunk (start, n, h) of a text, with the hashes of the lines before it (nearest first) and after it."""
    import pyarrow as pa

    for batch in batches:
        hashes, starts = line_hashes(byte_list(batch.column("text")))
        lists = batch.column("found")
        own = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        items = lists.flatten()
        start, n, h = (items.field(k) for k in ("start", "n", "h"))
        first, step = starts[own] + start.to_numpy(), np.arange(REACH)
        before, after = first[:, None] - 1 - step, (first + n.to_numpy())[:, None] + step
        left = _beside(hashes, before, before >= starts[own][:, None])
        right = _beside(hashes, after, after < starts[own + 1][:, None])
        cols = [batch.column("c1").take(pa.array(own)), batch.column("c2").take(pa.array(own)), start, n, h, left, right]
        yield pa.RecordBatch.from_arrays(cols, ["c1", "c2", "start", "n", "h", "before", "after"])


def _spans(batches: Iterable) -> Iterator:
    """(key, data) of each listed stretch of lines; the same bytes under one key once a batch."""
    import pyarrow as pa

    for batch in batches:
        seen, out = set(), []
        for text, found in zip(byte_list(batch.column("text")), batch.column("found").to_pylist()):
            lines = text.split(b"\n")
            for x in found:
                item = (x["key"], b"\n".join(lines[x["start"] : x["start"] + x["n"]]))
                if item not in seen:
                    seen.add(item)
                    out.append(item)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([d for _, d in out], pa.binary())], ["key", "data"])


def _map_cut(batches: Iterable, with_text: bool):
    import pyarrow as pa

    names = ["c1", "c2", "later", "n_lines", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        columns = [batch.column(x).to_pylist() for x in ("c1", "c2", "copies", "gone")]
        for c1, c2, copies, gone, text in zip(*columns, byte_list(batch.column("text"))):
            lines = text.split(b"\n")
            keep = np.ones(len(lines), bool)
            for x in gone or ():
                keep[x["start"] : x["start"] + x["n"]] = False
            for later in (False, True)[: 1 + (copies > 1)]:
                # of a later copy with several lines, all are repeats of the first copy's
                left = ([] if len(lines) > 1 else lines) if later else [lines[i] for i in np.flatnonzero(keep)]
                data = b"\n".join(left)
                rows.append((c1, c2, later, len(lines), len(lines) - len(left), hashlib.sha256(data).hexdigest(), *[data.decode()] * with_text))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)


def dedup_chunks(docs: DataFrame, with_text: bool = False, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (and kept_text) for each row of ``docs`` (doc_id, text).

    Lines in a later place of a repeated run of two lines or more are removed where the run holds an equal chunk in both places at one
    of ``levels``; the first place of a chunk always stays.  Rows with equal text and the text's smallest doc_id count as one document.
    Null doc_ids come last; null text is one empty line; stretches whose bytes differ under equal hashes remove nothing; other
    columns are ignored; no documents give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = text_table(docs, "lines")
    body = texts.select("c1", "c2", "text")
    found = stash(body.mapInArrow(lambda b: _map_chunks(b, levels), "c1 long, c2 long, start int, n int, h long"), "chunks")
    # not bucketed as texts is: both sides of its joins are plain exchanges, so a large group of copies can be split
    owners = stash(texts.select("c1", "c2", "first_id"), "owners")
    repeats = stash(found.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "repeats")
    # a text's repeated chunks: bounded by its length
    listed = found.join(repeats, "h").groupBy("c1", "c2").agg(F.collect_list(F.struct("start", "n", "h")).alias("found"))
    kind = "c1 long, c2 long, start int, n int, h long, before array<long>, after array<long>"
    members = stash(body.join(listed, ["c1", "c2"]).mapInArrow(_map_beside, kind), "members")
    last = F.coalesce("first_id", F.lit((1 << 63) - 1)).alias("first_id")
    place = F.struct("first_id", "c1", "c2", "start")
    # the first place of a chunk, with what lies beside it
    placed = members.join(owners.select("c1", "c2", last), ["c1", "c2"])
    firsts = stash(placed.groupBy("h").agg(F.min(F.struct(place.alias("place"), "before", "after")).alias("f")).select("h", "f.place", F.col("f.before").alias("f_before"), F.col("f.after").alias("f_after")), "firsts")
    pairs = members.join(firsts, "h").where((F.col("c1") != F.col("place.c1")) | (F.col("c2") != F.col("place.c2")) | (F.col("start") > F.col("place.start")))

    def alike(a: str, b: str):
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        at = F.array_position(same, False)
        return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")

    grown = pairs.withColumns({"_l": alike("before", "f_before"), "_r": alike("after", "f_after")})
    grown = grown.select("c1", "c2", F.col("place.c1").alias("f1"), F.col("place.c2").alias("f2"), (F.col("start") - F.col("place.start")).alias("shift"), (F.col("start") - F.col("_l")).alias("start"), (F.col("start") + F.col("n") + F.col("_r")).alias("end"))
    # matches of two texts on one diagonal that overlap or touch are one stretch
    w = Window.partitionBy("c1", "c2", "f1", "f2", "shift").orderBy("start", "end")
    new = F.when(F.col("start") <= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    runs = grown.distinct().withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("c1", "c2", "f1", "f2", "shift", "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("n"))
    spans = stash(spans.withColumn("key", F.xxhash64("f1", "f2", F.col("start") - F.col("shift"), "n")), "spans")
    # the bytes of each stretch and of its first place
    both = spans.select("c1", "c2", "start", "n", "key").unionByName(spans.select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), (F.col("start") - F.col("shift")).alias("start"), "n", "key").distinct())
    both = both.groupBy("c1", "c2").agg(F.collect_list(F.struct("start", "n", "key")).alias("found"))
    data = body.join(both, ["c1", "c2"]).mapInArrow(_spans, "key long, data binary")
    same = stash(data.groupBy("key").agg(F.min("data").alias("least"), F.max("data").alias("most")).where("least = most").select("key"), "same")
    # where a text repeats itself from the line before on, the first two lines stay
    kept = F.when((F.col("c1") == F.col("f1")) & (F.col("c2") == F.col("f2")), F.greatest(2 - F.col("shift"), F.lit(0))).otherwise(0)
    gone = spans.join(same, "key").select("c1", "c2", (F.col("start") + kept).alias("start"), (F.col("n") - kept).alias("n"))
    gone = gone.groupBy("c1", "c2").agg(F.collect_set(F.struct("start", "n")).alias("gone"))
    kind = "c1 long, c2 long, later boolean, n_lines long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    done = texts.select("c1", "c2", "text", "copies").join(gone, ["c1", "c2"], "left").mapInArrow(lambda b: _map_cut(b, with_text), kind)
    rows = docs.select("doc_id", *text_key(F.col("text"))).join(owners, ["c1", "c2"])
    rows = rows.withColumn("later", ~F.col("doc_id").eqNullSafe(F.col("first_id"))).drop("first_id")
    return rows.join(done, ["c1", "c2", "later"]).select("doc_id", "n_lines", "n_removed", "kept_sha256", *["kept_text"] * with_text)
