"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines chooses the boundaries, so that an inserted or lost line shifts only the
chunk it lies in.  Chunks of several lines that occur more than once in all texts are removed but for the first occurrence
(smallest doc_id, then place), after all their bytes have been compared.

Chunks miss a repeated passage whose boundaries depend on its surroundings.  With ``pairs`` the finest cut is taken instead:
every line is a boundary and each two adjacent lines are a chunk, so that all lines of a repeated run of two lines or more
are found, wherever the run begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_key, text_table

#: Lines that the rolling hash covers, the mean distance of boundaries, and the least and most lines of a chunk.
SPAN, MEAN, LEAST, MOST = 2, 4, 2, 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def boundaries(hashes: np.ndarray) -> list[int]:
    """Chunk ends (exclusive) over lines with these hashes."""
    rolling = hashes.copy()
    for back in range(1, SPAN):
        rolling[back:] += hashes[:-back] * (_A + np.uint64(2 * back))
    rolling = (rolling ^ (rolling >> np.uint64(32))) * _B
    ends, start = [], 0
    for i in np.flatnonzero((rolling >> np.uint64(40)) % np.uint64(MEAN) == 0).tolist():
        while i + 1 - start > MOST:
            start += MOST
            ends.append(start)
        if i + 1 - start >= LEAST:
            start = i + 1
            ends.append(start)
    while len(hashes) - start > MOST:
        start += MOST
        ends.append(start)
    return ends + [len(hashes)] * (start < len(hashes))


def chunks(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of each chunk; the bytes joined by newlines give the text."""
    import xxhash

    lines = text.split(b"\n")
    start, out = 0, []
    for end in boundaries(np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))):
        out.append((start, end - start, b"\n".join(lines[start:end])))
        start = end
    return out


def line_pairs(text: bytes) -> list[tuple[int, int, bytes]]:
    """As :func:`chunks`, each two adjacent lines; they overlap."""
    lines = text.split(b"\n")
    return [(i, 2, lines[i] + b"\n" + lines[i + 1]) for i in range(len(lines) - 1)]


def _map_chunks(batches: Iterable, cut_up: Callable):
    import pyarrow as pa
    import xxhash

    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("idx", pa.int32()), ("h", pa.int64())])
    for batch in batches:
        c1, c2 = (batch.column(x).to_numpy() for x in ("c1", "c2"))
        row, idx, hashes = [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
            for j, (_, n, data) in enumerate(cut_up(text or b"")):
                if n > 1:
                    row.append(i)
                    idx.append(j)
                    hashes.append(xxhash.xxh64_intdigest(data))
        at = np.array(row, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c1[at]), pa.array(c2[at]), pa.array(idx, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64))], schema=schema)


def _map_bytes(batches: Iterable, cut_up: Callable):
    import pyarrow as pa

    for batch in batches:
        seen, hashes, data = set(), [], []
        for text, found in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("found").to_pylist()):
            cut = cut_up(text or b"")
            for x in found:
                item = (x["h"], cut[x["idx"]][2])
                if item not in seen:  # the same bytes once a batch
                    seen.add(item)
                    hashes.append(item[0])
                    data.append(item[1])
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(data, pa.binary())], ["h", "data"])


def _map_cut(batches: Iterable, with_text: bool, pairs: bool):
    import pyarrow as pa

    names = ["c1", "c2", "later", "n_lines", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    for batch in batches:
        rows = [[] for _ in names]
        columns = [batch.column(x).to_pylist() for x in ("c1", "c2", "copies", "idx")]
        for c1, c2, copies, gone, text in zip(*columns, batch.column("text").cast(pa.large_binary()).to_pylist()):
            # of pairs the single lines are listed in idx
            cut = [(i, 1, line) for i, line in enumerate((text or b"").split(b"\n"))] if pairs else chunks(text or b"")
            n_lines = sum(n for _, n, _ in cut)
            for later in (False, True)[: 1 + (copies > 1)]:
                # to a later copy, all chunks of several lines are repeats of the first copy's
                out = {j for j, (_, n, _) in enumerate(cut) if n > 1 or (pairs and len(cut) > 1)} if later else set(gone or ())
                kept = b"\n".join(data for j, (_, _, data) in enumerate(cut) if j not in out)
                values = [c1, c2, later, n_lines, sum(cut[j][1] for j in out), hashlib.sha256(kept).hexdigest()] + [kept.decode()] * with_text
                for column, value in zip(rows, values):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names)


def dedup_lines(docs: DataFrame, with_text: bool = False, pairs: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (and kept_text) for each row of ``docs`` (doc_id, text).

    Rows with equal text and the text's smallest doc_id count as one document.  Null doc_ids come last; null text is one empty
    line; a chunk hash under which different bytes are found removes nothing; other columns are ignored.  With ``pairs`` a line
    goes if it lies in a later occurrence of two adjacent lines; the first place of every line stays.
    """
    cut_up = line_pairs if pairs else chunks
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = text_table(docs, "lines")
    found = stash(texts.select("c1", "c2", "text").mapInArrow(lambda b: _map_chunks(b, cut_up), "c1 long, c2 long, idx int, h long"), "chunks")
    # not bucketed as texts is: both sides of its joins are plain exchanges, so a large group of copies can be split
    firsts_of = stash(texts.select("c1", "c2", "first_id"), "owners")
    owners = firsts_of.select("c1", "c2", F.coalesce("first_id", F.lit((1 << 63) - 1)).alias("first_id"))
    place = F.struct("first_id", "c1", "c2", "idx")
    repeats = stash(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeats")
    members = stash(found.join(repeats, "h").join(owners, ["c1", "c2"]), "members")
    # a text's repeated chunks: bounded by its length
    listed = members.groupBy("c1", "c2").agg(F.collect_list(F.struct("idx", "h")).alias("found"))
    data = texts.select("c1", "c2", "text").join(listed, ["c1", "c2"]).mapInArrow(lambda b: _map_bytes(b, cut_up), "h long, data binary")
    same = data.groupBy("h").agg(F.min("data").alias("least"), F.max("data").alias("most")).where("least = most").select("h")
    firsts = stash(members.groupBy("h").agg(F.min(place).alias("first")).join(same, "h"), "firsts")
    gone = members.join(firsts, "h").where(place != F.col("first"))
    if pairs:
        # a pair right behind its own first place (equal lines in a row) shares a line with it, which stays
        overlaps = (F.col("c1") == F.col("first.c1")) & (F.col("c2") == F.col("first.c2")) & (F.col("idx") == F.col("first.idx") + 1)
        lines = F.when(overlaps, F.array(F.col("idx") + 1)).otherwise(F.array(F.col("idx"), F.col("idx") + 1))
        gone = gone.select("c1", "c2", F.explode(lines).alias("idx"))
    gone = gone.groupBy("c1", "c2").agg((F.collect_set if pairs else F.collect_list)("idx").alias("idx"))
    schema = "c1 long, c2 long, later boolean, n_lines long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    done = texts.select("c1", "c2", "text", "copies").join(gone, ["c1", "c2"], "left").mapInArrow(lambda b: _map_cut(b, with_text, pairs), schema)
    rows = docs.select("doc_id", *text_key(F.col("text"))).join(firsts_of, ["c1", "c2"])
    rows = rows.withColumn("later", ~F.col("doc_id").eqNullSafe(F.col("first_id"))).drop("first_id")
    return rows.join(done, ["c1", "c2", "later"]).select("doc_id", "n_lines", "n_removed", "kept_sha256", *["kept_text"] * with_text)
