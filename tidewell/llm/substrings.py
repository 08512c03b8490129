"""Exact substring dedup over words by a compacted de Bruijn graph.

The edges of the graph are the windows of ``k`` words of all texts; a window that starts in two places is a repeated edge and
its words are removed.  Consecutive windows that share a minimizer (the ``m``-word mer of least hash in a window) form a run, so that runs of the same passage break at the same words in every copy.  Two Spark joins settle the runs:

1. by minimizer: a run whose minimizer is found once in all texts holds no repeated window.  Where all runs of a minimizer
   spell the same words they are one nonbranching path, kept compact as a whole: repeated if it occurs twice.
2. by window, for branching minimizers only: their runs are taken apart into edges, which are counted one by one.

Both give source coordinates (text, first window, number of windows); a last pass over each distinct text checks nothing but
these coordinates and cuts the words.  Words are compared by two independent 64-bit hashes of the spelt-out sequence.

Equal texts are one text with a count, so a group of copies of any size costs one text: with a copy elsewhere every window of
it is repeated, and its runs meet those of other texts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_key, text_table

K, M = 35, 8
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    return x ^ (x >> np.uint64(29))


def _join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the concatenations of two equally long lists of sequences."""
    return _mix(a * _ODD[1 + salt] + (b ^ (b >> np.uint64(33))) * _ODD[0] + _ODD[2])


def window_hashes(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of ``size`` elements, from windows of powers of two."""
    out, done, power, width = None, 0, h, 1
    while size:
        if size & 1:
            out = power if out is None else _join(out[: len(out) - width if width < len(out) else 0], power[done:], salt)[: max(0, len(h) - done - width + 1)]
            done += width
        size >>= 1
        if size:
            power = _join(power[: max(0, len(power) - width)], power[width:], salt)
            width *= 2
    return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def runs(h: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with one minimizer: (minimizer, first window, windows, hash of the run's words)."""
    mers = window_hashes(h, m, 1)
    # the leftmost least mer of a window, by the upper half of its hash; so no window occurs twice in a run
    half = np.uint64(32)
    least = sliding_min((mers >> half << half) | np.arange(len(mers), dtype=np.uint64), k - m + 1) & np.uint64(0xFFFFFFFF)
    edges = window_hashes(h, k)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    n = np.diff(np.r_[first, len(least)])
    # a run is spelt by its windows; their order is kept by mixing in the place
    place = np.arange(len(edges)) - np.repeat(first, n)
    spelt = np.add.reduceat(_mix(edges + place.astype(np.uint64) * _ODD[3]), first)
    return mers[least[first].astype(np.int64)], first, n, _mix(spelt + n.astype(np.uint64))


def _map_runs(batches: Iterable, k: int, m: int):
    import pyarrow as pa

    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("mh", pa.int64()), ("rh", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
    for batch in batches:
        c1, c2 = (batch.column(x).to_numpy() for x in ("c1", "c2"))
        rows, size = [], 0
        for i, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
            words = (text or b"").split()
            if len(words) < k:
                continue
            mh, start, n, rh = runs(word_hashes(words), k, m)
            rows.append((np.full(len(mh), c1[i]), np.full(len(mh), c2[i]), mh.view(np.int64), rh.view(np.int64), start.astype(np.int32), n.astype(np.int32)))
            size += len(mh)
            if size > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], schema=schema)


def _map_edges(batches: Iterable, k: int):
    import pyarrow as pa

    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("e1", pa.int64()), ("e2", pa.int64()), ("start", pa.int32())])
    for batch in batches:
        c1, c2 = (batch.column(x).to_pylist() for x in ("c1", "c2"))
        texts, spans = batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist()
        rows = []
        for i, text in enumerate(texts):
            h = word_hashes((text or b"").split())
            e1, e2 = window_hashes(h, k), window_hashes(h, k, 1)
            at = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in spans[i]]))
            rows.append((np.full(len(at), c1[i]), np.full(len(at), c2[i]), e1[at].view(np.int64), e2[at].view(np.int64), at.astype(np.int32)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], schema=schema)


def _map_cut(batches: Iterable, k: int, with_text: bool):
    import pyarrow as pa

    names = ["c1", "c2", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    for batch in batches:
        texts, spans, copies = batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("copies").to_pylist()
        n_words, removed, digest, kept_text = [], [], [], []
        for text, cuts, n in zip(texts, spans, copies):
            words = (text or b"").split()
            kept = words
            if n > 1 and len(words) >= k:  # each window also starts in the text's copy
                kept = []
            elif cuts:
                edges = np.zeros(len(words) + 1, np.int64)
                for s in cuts:  # windows start .. start + n - 1 cover these words
                    edges[s["start"]] += 1
                    edges[s["start"] + s["n"] + k - 1] -= 1
                keep = np.cumsum(edges)[:-1] == 0
                kept = [words[j] for j in np.flatnonzero(keep).tolist()]
            joined = b" ".join(kept)
            n_words.append(len(words))
            removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                kept_text.append(joined.decode())
        columns = [batch.column("c1"), batch.column("c2"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(kept_text, pa.string())] * with_text, names)


def repeated_spans(texts: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """c1, c2, start, n: runs of windows of the distinct ``texts`` (see text_table) that also start elsewhere."""
    found = texts.select("c1", "c2", "text").mapInArrow(lambda b: _map_runs(b, k, m), "c1 long, c2 long, mh long, rh long, start int, n int")
    paths = stash(found, "runs")
    nodes = stash(paths.groupBy("mh").agg(F.count("*").alias("total"), (F.min("rh") == F.max("rh")).alias("single")).where("total > 1").select("mh", "single"), "nodes")
    joined = stash(paths.select("c1", "c2", "mh", "start", "n").join(nodes, "mh").select("c1", "c2", "start", "n", "single"), "repeated-runs")
    whole = joined.where("single").select("c1", "c2", "start", "n")
    # a text's branching runs: bounded by its length
    branching = joined.where("not single").groupBy("c1", "c2").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    edges = stash(texts.select("c1", "c2", "text").join(branching, ["c1", "c2"]).mapInArrow(lambda b: _map_edges(b, k), "c1 long, c2 long, e1 long, e2 long, start int"), "edges")
    # read from a table, so that both sides of the join are plain exchanges and an edge of a hot passage can be split
    twice = stash(edges.groupBy("e1", "e2").agg(F.count("*").alias("total")).where("total > 1").drop("total"), "repeated-edges")
    single = edges.join(twice, ["e1", "e2"]).select("c1", "c2", "start", F.lit(1).alias("n"))
    return whole.unionByName(single)


def cut_repeats(docs: DataFrame, keys: list[str], k: int = K, m: int = M, with_text: bool = False) -> DataFrame:
    """``keys``, n_words, n_removed, kept_sha256 (and kept_text) for each row of ``docs``.

    Every word inside a window of ``k`` words that starts at least twice in all texts (in one text too) is removed; windows
    are judged on the input.  Null text has no words; texts under ``k`` words lose none; other columns are ignored.
    """
    docs = docs.select(*[F.col(x).alias(f"k{i}") for i, x in enumerate(keys)], F.lit(None).cast("long").alias("doc_id"), "text")
    texts = text_table(docs, "texts")
    spans = repeated_spans(texts, k, m).groupBy("c1", "c2").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    schema = "c1 long, c2 long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    done = texts.select("c1", "c2", "text", "copies").join(spans, ["c1", "c2"], "left").mapInArrow(lambda b: _map_cut(b, k, with_text), schema)
    rows = docs.select(*[f"k{i}" for i in range(len(keys))], *text_key(F.col("text")))
    out = rows.join(done, ["c1", "c2"]).drop("c1", "c2")
    return out.select(*[F.col(f"k{i}").alias(x) for i, x in enumerate(keys)], "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text)
