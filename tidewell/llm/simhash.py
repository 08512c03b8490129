"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits; a link is 3 or fewer differing bits.  The anchors are the codewords of the perfect Hamming(31, 26)
code (covering radius 1) on two blocks of 31 bits.  Two linked fingerprints differ in at most one bit of one of the blocks:
there the anchor within radius 1 of the one lies within radius 2 of the other.  So every distinct fingerprint goes once to
its own anchor and to all anchors within radius 2 (16 at most) of each block, and is compared per anchor on all 64 bits.
2^26 anchors a block keep the groups small; an anchor with many fingerprints is dealt out further by a quarter of the other
bits, one of which must be equal.  Each group gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sheltered, stash, text_key, unsheltered

MAX_BITS = 3
WIDTH = 31
#: An anchor that is home to more fingerprints than this is split.
HOT_ANCHOR = 1024
#: Split anchors are broadcast up to this many (8 bytes each); more are joined by shuffle.
BROADCAST_ANCHORS = 1_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of the text's word shingles; 0 without words."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < size:
        return h(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - size].tolist()]
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) - len(bits) % 255  # 255 ones fit a byte
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable, size: int):
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()
        found = np.array([fingerprint(t or b"", size) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], ["doc_id", "c1", "c2", "fp"])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, c1, c2 (text_key) and fp (the fingerprint as a signed long), written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), "text")
    return stash(rows.mapInArrow(lambda b: _fingerprints(b, size), "doc_id long, c1 long, c2 long, fp long"), "fingerprints")


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _syndrome(block: Column) -> Column:
    """Hamming syndrome: the xor of the positions 1 .. 31 of the set bits, from five parities."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, WIDTH + 1) if p >> j & 1)
        out = out + F.bit_count(block.bitwiseAND(F.lit(mask))) % 2 * (1 << j)
    return out


def _bit(position: Column) -> Column:
    """The bit of a position from 1; no bit for position 0."""
    return F.when(position > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), F.greatest(position - 1, F.lit(0))).cast("long")


def anchored(classes: DataFrame) -> DataFrame:
    """key, home, fp: every fingerprint once at the home anchor of each block, and at all anchors within radius 2."""
    keys = []
    for k in (0, 1):
        block, s = F.col(f"b{k}"), F.col(f"s{k}")
        home = block.bitwiseXOR(_bit(s))
        # a ^ b = s with a < b: flipping both leads to a codeword; for s = 0 there is none within radius 2 but itself
        pairs = F.filter(F.transform(F.sequence(F.lit(1), F.lit(WIDTH)), lambda a: F.struct(a.alias("a"), a.bitwiseXOR(F.col(f"s{k}")).alias("b"))), lambda p: (p["a"] < p["b"]))
        flips = F.transform(F.when(s == 0, F.array().cast("array<struct<a:int,b:int>>")).otherwise(pairs), lambda p: F.struct((F.col(f"b{k}").bitwiseXOR(_bit(p["a"])).bitwiseXOR(_bit(p["b"])) * 2 + k).alias("key"), F.lit(False).alias("home")))
        keys.append(F.concat(F.array(F.struct((home * 2 + k).alias("key"), F.lit(True).alias("home"))), flips))
    rows = classes.select("fp", *[_block(F.col("fp"), k).alias(f"b{k}") for k in (0, 1)])
    rows = rows.select("*", *[_syndrome(F.col(f"b{k}")).cast("int").alias(f"s{k}") for k in (0, 1)])
    return rows.select("fp", F.explode(F.concat(*keys)).alias("x")).select("x.key", "x.home", "fp")


def _quarters(key: Column, fp: Column) -> Column:
    """The four quarters of the 33 bits outside the anchor's block, as (number, value)."""
    rest = F.when(key % 2 == 0, F.shiftrightunsigned(fp, WIDTH)).otherwise(F.shiftrightunsigned(fp, 2 * WIDTH) * (1 << WIDTH) + _block(fp, 0))
    return F.array(*[F.shiftrightunsigned(rest, 8 * j).bitwiseAND(F.lit(255 if j < 3 else 511)) * 4 + j for j in range(4)])


def _forest(homes: np.ndarray, fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``homes`` and ``fps`` (which holds the homes too)."""
    labels, out = np.arange(len(fps)), []
    place = np.searchsorted(fps, homes)
    step = max(1, (1 << 22) // len(fps))
    for at in range(0, len(homes), step):
        near = np.bitwise_count(homes[at : at + step, None] ^ fps[None, :]) <= max_bits
        for i, row in zip(place[at : at + step].tolist(), near):
            js = np.flatnonzero(row)
            if len(js) < 2:
                continue
            own = labels[i]
            found, first = np.unique(labels[js], return_index=True)
            if len(found) > 1:
                out += [(int(fps[i]), int(fps[js[f]])) for x, f in zip(found, first) if x != own]
                labels[np.isin(labels, found)] = found[0]
    return out


def _links(batches: Iterable, max_bits: int):
    import pyarrow as pa

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = None

    def links(key: np.ndarray, home: np.ndarray, fp: np.ndarray):
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
        sizes = np.diff(new)
        out = []
        for g in np.flatnonzero(sizes > 1).tolist():
            a, b = new[g], new[g + 1]
            homes = np.unique(fp[a:b][home[a:b]])
            if len(homes):
                fps = np.unique(fp[a:b])
                if len(fps) > 1:
                    out += _forest(homes, fps, max_bits)
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column("key").to_numpy(), batch.column("sub").to_numpy()], axis=1)
        parts = (key, batch.column("home").to_numpy(zero_copy_only=False).astype(bool), batch.column("fp").to_numpy().view(np.uint64))
        if held is not None:
            parts = tuple(np.concatenate(x) for x in zip(held, parts))
        # the last group may go on in the next batch
        cut = int(np.flatnonzero((parts[0] != parts[0][-1]).any(axis=1))[-1]) + 1 if (parts[0] != parts[0][-1]).any() else 0
        if cut:
            yield links(*(x[:cut] for x in parts))
        held = tuple(x[cut:] for x in parts)
    if held is not None:
        yield links(*held)


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all that are linked within ``max_bits`` (3 at most)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the covering holds for up to 3 differing bits")
    rows = anchored(classes)
    # a thousandth of the fingerprints at most, read from a table: Spark takes ``rows`` for as small as its fingerprints, and would broadcast it
    hot = stash(rows.where("home").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ANCHOR).select("key"), "hot")
    hot, rows = (F.broadcast(hot), rows) if hot.count() <= BROADCAST_ANCHORS else (hot.hint("merge"), rows.hint("merge"))
    cold = rows.join(hot, "key", "left_anti").withColumn("sub", F.lit(0).cast("long"))
    split = rows.join(hot, "key").withColumn("sub", F.explode(F.transform(_quarters(F.col("key"), F.col("fp")), lambda x: x + 1)))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cold.unionByName(split).select("key", "sub", "home", "fp").repartition(parts, "key", "sub").sortWithinPartitions("key", "sub")
    return dealt.mapInArrow(lambda b: _links(b, max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for all nodes of ``edges`` (a, b), by random contraction.

    Each round every node joins its neighbour (or itself) of least random priority and edges are renamed; a constant share of
    the nodes vanishes each round.  All steps are joins and minima, so a node with many links is pre-aggregated and split.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left, maps, turn = stash(both.where("a <> b").distinct(), "edges"), [], 0
    while not left.isEmpty():
        prio = lambda c, r=turn: F.xxhash64(F.lit(r), c)
        best = left.groupBy("a").agg(F.min(F.struct(prio(F.col("b")).alias("p"), F.col("b").alias("b"))).alias("m"))
        step = stash(best.select(F.col("a").alias("node"), F.when(F.col("m.p") < prio(F.col("a")), F.col("m.b")).otherwise(F.col("a")).alias("root")), "contraction")
        maps.append(step)
        ends = left.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = stash(ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        turn += 1
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for step in maps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, c1, c2, fp, root (one fingerprint of its component) and component_id (its smallest doc_id), one row a row.

    Texts without words, null ones included, have fingerprint 0 and are linked like any other.  Null doc_ids never become a
    component_id unless a component has no other; equal rows stay.
    """
    rows = fingerprints(docs, size)
    classes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes, max_bits))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.select("fp", "root").join(least, "root"), "fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` (all columns) with one row of each component: that of the smallest doc_id.

    Rows that share that doc_id and component are told apart by their text's key; full repeats collapse to one row.  Further
    columns may have any names.
    """
    columns, used = docs.columns, ["doc_id", "text"]
    docs = sheltered(docs, used)
    found = near_duplicates(docs, size, max_bits)
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "c1", "c2")).alias("k"), F.count("*").alias("n"))
    chosen = stash(chosen.select(F.col("k.doc_id").alias("_id"), F.col("k.c1").alias("_c1"), F.col("k.c2").alias("_c2"), "n"), "kept")
    c1, c2 = text_key(docs["text"])
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (c1 == F.col("_c1")) & (c2 == F.col("_c2"))
    once = docs.join(chosen.where("n = 1"), match, "left_semi")
    again = docs.join(chosen.where("n > 1"), match, "inner").dropDuplicates(["_id", "_c1", "_c2"]).select(*docs.columns)
    return unsheltered(once.unionByName(again), columns, used)
