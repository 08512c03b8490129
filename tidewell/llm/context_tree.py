"""Language-model scoring by context-tree weighting over bytes.

A text is the stream of its lower-cased words, one blank between words and a newline at the end.  Every byte is eight binary
decisions; each decision has a tree over the last DEPTH bytes, whose nodes hold Krichevsky-Trofimov estimates, and the
weighting mixes the estimates of all depths by the posterior of each, as learnt from the training texts.

Counts are byte (DEPTH + 1)-grams, keyed so that the nearest context byte is the highest one: all nodes from UPPER bytes of
context down lie in one run of keys of at most 256 ** (DEPTH + 1 - UPPER), and only sums by node go further up.  Texts lie in
blocks of bounded size.  Each block sends its distinct grams once to the buckets (ranges of runs) that hold the counts, packed as
one row a bucket, and gets their probabilities back the same way; so neither model nor texts are broadcast, and texts are
never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_list, new_dir, partition_id, read_part, stash

#: Bytes of context; a gram of DEPTH context bytes and a symbol fills 56 bits.
DEPTH = 6
#: Context bytes that the nodes of a run of grams share; nodes with fewer are summed by Spark.
UPPER = 4
#: Texts are dealt to blocks of about this many bytes (a longer text is a block of its own).
BLOCK_BYTES = 1 << 26
#: Bytes of text, and grams, handled at once.
PIECE = 1 << 21
END = b"\n"
PAD = END * DEPTH
LN2 = float(np.log(2))


def held_out() -> Column:
    """Whether the row is kept from the counts; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def gram_keys(stream: np.ndarray) -> np.ndarray:
    """The key of each position from DEPTH on: the byte before highest, then the one before that, and the symbol lowest."""
    n, wide = len(stream) - DEPTH, 8 * DEPTH
    # the DEPTH + 1 bytes up to each position as one little-endian number: the symbol is highest in it
    padded = np.concatenate([stream, np.zeros(8, np.uint8)])
    keys = np.ndarray(n, "<u8", padded.data, strides=(1,)).astype(np.uint64)
    symbols = stream[DEPTH:]
    keys &= np.uint64((1 << wide) - 1)
    keys <<= np.uint64(8)
    keys |= symbols
    return keys


def pieces(words: list[list[bytes]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(texts, keys, starts): some whole texts, the keys of all their bytes and where each begins; a text of over PIECE bytes
    comes in several parts."""
    at = 0
    while at < len(words):
        stop, size, parts = at, 0, []
        while stop < len(words):
            part = PAD + b" ".join(words[stop]) + END
            if parts and size + len(part) > PIECE:
                break
            parts.append(part)
            size, stop = size + len(part), stop + 1
        stream = np.frombuffer(b"".join(parts), np.uint8)
        if len(parts) == 1:
            for first in range(0, len(stream) - DEPTH, PIECE):
                yield [at], gram_keys(stream[first : first + PIECE + DEPTH]), np.zeros(1, np.int64)
        else:
            sizes = np.array([len(x) for x in parts]) - DEPTH
            ends = np.cumsum(sizes + DEPTH)
            own = np.ones(len(stream) - DEPTH, bool)  # not those between texts
            for k in range(DEPTH):
                own[ends[:-1] + k - DEPTH] = False
            yield list(range(at, stop)), gram_keys(stream)[own], np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = stop


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts (occurrences, if none are given)."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        return keys[first], np.diff(first, append=len(keys))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _deal(batches: Iterable, block_bytes: int):
    """Adds the block to each row: consecutive rows of a task, cut by bytes of text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    block, size = partition_id() << 32, 0
    for batch in batches:
        sizes, own = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), []
        for n in np.nan_to_num(sizes):
            if size and size + n > block_bytes:
                block, size = block + 1, 0
            size += n
            own.append(block)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], [*batch.schema.names, "block"])


def _runs(blocks: np.ndarray) -> Iterator[tuple[int, int, int]]:
    first = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1))
    for a, b in zip(first, [*first[1:], len(blocks)]):
        yield int(blocks[a]), int(a), int(b)


def _parts(batch) -> Iterator[tuple[int, int, int]]:
    """(block, first row, last row + 1) of a batch's rows: of one block, and of about PIECE bytes of text or one longer text."""
    import pyarrow.compute as pc

    blocks = batch.column("block").to_numpy()
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
    first = np.flatnonzero((np.diff(blocks, prepend=-1) != 0) | (np.diff(sizes, prepend=-1) != 0))
    for a, b in zip(first, [*first[1:], len(blocks)]):
        yield int(blocks[a]), int(a), int(b)


def squeeze(values: np.ndarray) -> bytes:
    """The array's bytes by place value, compressed."""
    import pyarrow as pa

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int, kind: type) -> np.ndarray:
    import pyarrow as pa

    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def squeeze_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueeze(data, n, np.uint64), dtype=np.uint64)


def run_of(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(8 * (DEPTH + 1 - UPPER))


def _sample(batches: Iterable):
    """run: of some grams of some texts of each batch; they only balance the buckets."""
    import pyarrow as pa

    for batch in batches:
        texts = byte_list(batch.column("text").take(pa.array(range(0, batch.num_rows, 1 + batch.num_rows // 16))))
        for _, keys, _ in pieces([words_of(t[: 1 << 16]) for t in texts]):
            yield pa.RecordBatch.from_arrays([pa.array(run_of(keys)[:: 1 + len(keys) // 512].astype(np.int64))], ["run"])


def bucket_bounds(rows: DataFrame, buckets: int) -> np.ndarray:
    """First runs of all buckets but the first, so that the buckets hold about equally many grams."""
    runs = rows.select("text").mapInArrow(_sample, "run long")
    found = runs.approxQuantile("run", [i / buckets for i in range(1, buckets)], 0.001) if buckets > 1 else []
    return np.unique(np.array(found or [], np.float64).astype(np.uint64))


def _gather(batches: Iterable, bounds: np.ndarray):
    """Rows (block, piece, bucket, size, grams, counts), the distinct grams of a block in a bucket, and (block, word, n), its words;
    counts and n are occurrences in training texts (may be 0)."""
    import pyarrow as pa

    kinds = pa.schema([("block", pa.int64()), ("piece", pa.int64()), ("bucket", pa.int32()), ("size", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("word", pa.binary()), ("n", pa.int64())])
    block, grams, words, others, piece = None, [], Counter(), set(), partition_id() << 32

    def close():
        nonlocal grams, words, others, piece
        if block is None:
            return
        if grams:
            keys, n = tally(np.concatenate([x for x, _ in grams]), np.concatenate([x for _, x in grams]))
            buckets = np.searchsorted(bounds, run_of(keys), "right")
            out = [(block, piece, k, b - a, squeeze_keys(keys[a:b]), squeeze(n[a:b]), None, None) for k, a, b in _runs(buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
        known = [*words, *(others - words.keys())]
        for a in range(0, len(known), 1 << 17):
            own = known[a : a + (1 << 17)]
            cols = [pa.array(own, f.type) if f.name == "word" else pa.array([words[w] for w in own], f.type) if f.name == "n" else pa.array([block] * len(own), f.type) if f.name == "block" else pa.nulls(len(own), f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays(cols, schema=kinds)
        grams, words, others, piece = [], Counter(), set(), piece + 1

    for batch in batches:
        kept_out = np.array(batch.column("held_out").to_pylist(), bool)
        for own, a, b in _parts(batch):
            if own != block:
                yield from close()
                block = own
            texts = byte_list(batch.column("text").slice(a, b - a))
            for held in (False, True):
                part = [words_of(t) for t, x in zip(texts, kept_out[a:b]) if x == held]
                for x in part:
                    others.update(x) if held else words.update(x)
                for _, keys, _ in pieces(part):
                    keys, n = tally(keys)
                    grams.append((keys, n * (not held)))
                    if sum(len(x) for x, _ in grams) > 2 * PIECE:
                        grams = [tally(np.concatenate([x for x, _ in grams]), np.concatenate([x for _, x in grams]))]
                if len(grams) == 1 and len(grams[0][0]) > PIECE or len(words) + len(others) > PIECE // 4:
                    yield from close()  # the block goes on in another piece
    yield from close()


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov estimate of a sequence with ``a`` zeros and ``b`` ones."""

    def log_gamma(x):
        small = x < 16
        z = np.where(small, x + 8, x)
        series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
        y = np.where(small, x, 1.0)
        return series - np.where(small, np.log(y * (y + 1) * (y + 2) * (y + 3) * (y + 4) * (y + 5) * (y + 6) * (y + 7)), 0)

    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


def weigh(grams: np.ndarray, n: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The nodes with UPPER context bytes (context, node, zeros, ones, log weighted probability) of whole runs of sorted
    distinct grams, and for each gram the eight probabilities of a one, weighted from depth UPPER down."""
    chance, nodes = np.empty((len(grams), 8)), []
    levels = [(grams, n, np.arange(len(grams)))]  # by depth: distinct (context, symbol), counts, and the place of each gram
    for depth in range(DEPTH - 1, UPPER - 1, -1):
        keys = grams >> np.uint64(8 * (DEPTH - depth) + 8) << np.uint64(8) | grams & np.uint64(255)
        own, back = np.unique(keys, return_inverse=True)
        levels.append((own, np.bincount(back, n, len(own)).astype(np.int64), back))
    for k in range(8):
        below = None
        mixed = []  # (estimate of a one, weight of the estimate, node of each gram), deepest first
        for keys, count, back in levels:
            node = keys >> np.uint64(8 - k)
            first = np.flatnonzero(np.diff(node, prepend=~node[:1]))
            at = np.cumsum(np.diff(node, prepend=node[:1]) != 0)
            ones = np.add.reduceat(count * (keys >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64), first)
            zeros = np.add.reduceat(count, first) - ones
            node, kt = node[first], log_kt(zeros, ones)
            if below is None:
                total, weight = kt, np.ones(len(node))
            else:
                child, logs = below  # the child's key without its farthest context byte
                parent = child >> np.uint64(8 + k) << np.uint64(k) | child & np.uint64((1 << k) - 1)
                down = np.bincount(np.searchsorted(node, parent), logs, len(node))
                total = np.logaddexp(kt, down) - LN2
                weight = np.exp(kt - LN2 - total)
            mixed.append(((ones + 0.5) / (zeros + ones + 1), weight, at[back]))
            below = node, total
        p = None
        for one, weight, at in mixed:
            p = one[at] if p is None else weight[at] * one[at] + (1 - weight[at]) * p
        chance[:, k] = p
        nodes.append((node >> np.uint64(k), (node & np.uint64((1 << k) - 1)) | np.uint64(1 << k), zeros, ones, total))
    return tuple(np.concatenate(x) for x in zip(*nodes)), chance


def _by_run(keys: np.ndarray, size: int = 1 << 18) -> Iterator[slice]:
    """Slices of about ``size`` sorted keys that hold whole runs."""
    runs, a = run_of(keys), 0
    while a < len(keys):
        b = int(np.searchsorted(runs, runs[min(a + size, len(keys)) - 1], "right"))
        yield slice(a, b)
        a = b


def _count(batches: Iterable):
    """Of each bucket (rows in its order): its nodes with UPPER bytes of context as (bucket, context, node, zeros, ones, logs), where
    context is the nearest UPPER - 1 bytes, and its summed grams as one row (bucket, size, grams, counts)."""
    import pyarrow as pa

    kinds = pa.schema([("bucket", pa.int32()), ("context", pa.int32()), ("node", pa.int32()), ("zeros", pa.int64()), ("ones", pa.int64()), ("logs", pa.float64()), ("size", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
    bucket, parts = None, []

    def close():
        if not parts:
            return
        keys, n = tally(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))
        for s in _by_run(keys):
            (context, *rest), _ = weigh(keys[s], n[s])
            cols = [np.full(len(context), bucket), context >> np.uint64(8), *rest]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(cols, kinds)] + [pa.nulls(len(context), f.type) for f in list(kinds)[6:]], schema=kinds)
        row = {"bucket": bucket, "size": len(keys), "grams": squeeze_keys(keys), "counts": squeeze(n)}
        yield pa.RecordBatch.from_pylist([row], schema=kinds)

    for batch in batches:
        for k, size, grams, counts in zip(*[batch.column(c).to_pylist() for c in ("bucket", "size", "grams", "counts")]):
            if k != bucket:
                yield from close()
                bucket, parts = k, []
            parts.append((unsqueeze_keys(grams, size), unsqueeze(counts, size, np.int64)))
            if len(parts) > 1 and sum(len(x) for x, _ in parts) > 2 * PIECE and len(parts[0][0]) < len(parts[-1][0]) * len(parts):
                parts = [tally(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))]
    yield from close()


def _answer(batches: Iterable):
    """(block, piece, bucket, logs) for each block's row of a bucket, from the bucket's rows before: its upper estimates (context,
    node, a, b) and its sums.  logs are log10 of the symbols' probabilities in the order of the block's grams."""
    import pyarrow as pa

    bucket, upper, keys, logs = None, [], None, None
    for batch in batches:
        kinds, buckets = batch.column("kind").to_numpy(), batch.column("bucket").to_numpy()
        order = np.flatnonzero(np.diff(kinds.astype(np.int64) + 4 * buckets.astype(np.int64), prepend=-1))
        out = []
        for a, b in zip(order, [*order[1:], len(kinds)]):
            if buckets[a] != bucket:
                bucket, upper, keys, logs = buckets[a], [], None, None
            part = batch.slice(a, b - a)
            if kinds[a] == 0:
                upper.append([part.column(c).to_numpy() for c in ("context", "node", "a", "b")])
            elif kinds[a] == 1:
                context, node, above, left = (np.concatenate(x) for x in zip(*upper))
                places = context.astype(np.int64) << 8 | node
                order_ = np.argsort(places)
                places, above, left = places[order_], above[order_], left[order_]
                size = part.column("size")[0].as_py()
                keys, n = unsqueeze_keys(part.column("grams")[0].as_py(), size), unsqueeze(part.column("counts")[0].as_py(), size, np.int64)
                logs = np.zeros(size, np.float32)
                for s in _by_run(keys):
                    own, (_, chance) = keys[s].astype(np.int64), weigh(keys[s], n[s])
                    total = np.zeros(len(own))
                    for k in range(8):
                        at = np.searchsorted(places, own >> 8 * (DEPTH + 2 - UPPER) << 8 | 1 << k | (own & 255) >> (8 - k))
                        one = above[at] + left[at] * chance[:, k]
                        total += np.log10(np.where(own >> (7 - k) & 1, one, 1 - one))
                    logs[s] = total
            else:
                for block, piece, size, grams in zip(*[part.column(c).to_pylist() for c in ("block", "piece", "size", "grams")]):
                    out.append((block, piece, int(bucket), squeeze(logs[np.searchsorted(keys, unsqueeze_keys(grams, size))])))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["block", "piece", "bucket", "logs"])


def block_logs(found: DataFrame) -> DataFrame:
    """block, piece, bucket, logs for all rows (block, piece, bucket, size, grams, counts) of ``found``: see :func:`_answer`."""
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = found.select("bucket", "size", "grams", "counts").repartition(parts, "bucket").sortWithinPartitions("bucket")
    grown = stash(asked.mapInArrow(_count, "bucket int, context int, node int, zeros long, ones long, logs double, size int, grams binary, counts binary"), "grown")

    @F.pandas_udf("double")
    def kt(zeros, ones):
        import pandas as pd

        return pd.Series(log_kt(zeros.to_numpy(), ones.to_numpy()))

    def level(nodes: DataFrame, key: list[Column]) -> DataFrame:
        """One level up: sums of the children, the node's own estimate and both mixed."""
        out = nodes.groupBy(*key, "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("logs").alias("down"))
        out = out.withColumn("kt", kt("zeros", "ones"))
        logs = F.greatest("kt", "down") + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("down")))) - LN2
        return out.withColumn("logs", logs).withColumn("w", F.exp(F.col("kt") - LN2 - F.col("logs"))).withColumn("one", (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1))

    # by bytes of context, most first: at most 256 ** (UPPER - 1) contexts and at last one, of at most 255 nodes each
    levels = [stash(level(grown.where("node IS NOT NULL"), [F.col("context")]), "level")]
    for _ in range(UPPER - 1):
        levels.append(stash(level(levels[-1].select(F.shiftright("context", 8).alias("context"), "node", "zeros", "ones", "logs"), [F.col("context")]), "level"))
    # probability of a one from the estimates above, and what weight is left for those below
    upper = levels.pop().select("context", "node", (F.col("w") * F.col("one")).alias("a"), (1 - F.col("w")).alias("b"))
    while levels:
        above = upper.withColumnRenamed("context", "shorter")
        upper = levels.pop().withColumn("shorter", F.shiftright("context", 8)).join(above, ["shorter", "node"])
        upper = upper.select("context", "node", (F.col("a") + F.col("b") * F.col("w") * F.col("one")).alias("a"), (F.col("b") * (1 - F.col("w"))).alias("b"))
    nodes = grown.where("node IS NOT NULL").select("bucket", "context", "node").distinct()
    rows = nodes.join(upper, ["context", "node"]).withColumn("kind", F.lit(0))
    rows = rows.unionByName(grown.where("node IS NULL").select("bucket", "size", "grams", "counts", F.lit(1).alias("kind")), allowMissingColumns=True)
    rows = rows.unionByName(found.select("block", "piece", "bucket", "size", "grams", F.lit(2).alias("kind")), allowMissingColumns=True)
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer, "block long, piece long, bucket int, logs binary")


class Lookup:
    """float32 values by 64-bit key in a numpy hash table with linear probing, for keys that are all in the table.

    A slot is one number: 32 bits of the key's hash and the value.  Two keys might share those bits where one passes the other's
    slot; as only keys of the table are asked for, looking all of them up once shows that, and another hash is taken.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.mask, self.factor = (1 << self.bits) - 1, 0x9E3779B97F4A7C15
        codes = values.astype(np.float32).view(np.uint32)
        while True:
            self.slots = np.zeros(1 << self.bits, np.uint64)  # no value is +0, so 0 is an empty slot
            self._fill(keys, codes)
            if np.array_equal(self(keys).view(np.uint32), codes):
                return
            self.factor = self.factor * 6364136223846793005 + 2 & (1 << 64) - 1 | 1

    def _hash(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot, and 32 further bits of the hash in the upper half."""
        h = keys * np.uint64(self.factor)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        h <<= np.uint64(self.bits)
        h &= np.uint64(0xFFFFFFFF00000000)
        return slot, h

    def _fill(self, keys: np.ndarray, codes: np.ndarray) -> None:
        slot, mark = self._hash(keys)
        full = mark | codes
        while len(slot):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = full[free]
            rest = self.slots[slot] != full
            full, slot = full[rest], (slot[rest] + 1) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot, mark = self._hash(keys)
        found = self.slots[slot]
        mark ^= found
        rest = np.flatnonzero(mark >> np.uint64(32))
        if len(rest):
            want, at = mark[rest] ^ found[rest], slot[rest]
            while len(rest):
                at = (at + 1) & self.mask
                got = self.slots[at]
                hit = (got ^ want) >> np.uint64(32) == 0
                found[rest[hit]] = got[hit]
                rest, at, want = rest[~hit], at[~hit], want[~hit]
        return (found & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.float32)


def _score(batches: Iterable, gathered: str, answered: str, words: str, total: int, distinct: int, keep: list[str]):
    import pyarrow as pa

    block, logs, known = None, None, {}
    below = float(np.log10(total + distinct + 1))
    for batch in batches:
        out = []
        for own, a, b in _parts(batch):
            if own != block:
                block, logs, known = own, None, {}
                answers = {(r["piece"], r["bucket"]): r["logs"] for r in read_part(answered, "block", own).to_pylist()}
                asked = read_part(gathered, "block", own).select(["piece", "bucket", "size", "grams"]).drop_null().to_pylist()
                keys = np.concatenate([unsqueeze_keys(r["grams"], r["size"]) for r in asked])
                values = np.concatenate([unsqueeze(answers[r["piece"], r["bucket"]], r["size"], np.float32) for r in asked])
                logs = Lookup(keys, values)
                del answers, asked, keys, values
                if (got := read_part(words, "block", own)) is not None:
                    known = dict(zip(got.column("word").to_pylist(), got.column("c").to_pylist()))
                ends = known.pop(END, 0)
            texts = [words_of(t) for t in byte_list(batch.column("text").slice(a, b - a))]
            score = np.zeros(len(texts))
            for own_texts, keys, starts in pieces(texts):
                score[own_texts] += np.add.reduceat(logs(keys), starts, dtype=np.float64)
            for i, ws in enumerate(texts):
                c = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
                n = len(ws) + 1
                base = float(np.log10(c + 1.0).sum() + np.log10(ends + 1.0) - n * below)
                out.append((n, int((c > 0).sum()) + (ends > 0), base, score[i]))
        cols = [batch.column(k) for k in keep] + [batch.column("held_out")]
        cols += [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([total] * len(out), pa.int64()), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, [*keep, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_texts(docs: DataFrame, keep: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep``, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row of ``docs`` (doc_id, text).

    base_score is the add-one unigram score, score the weighted context tree's; score / log10(2) / bytes is the code length.
    Rows are counted and scored each, repeated ones too.  A null or empty text is its end token alone; a null doc_id is not
    held out; with no training text all estimates are even (half a chance for each bit).  Long texts are read in pieces.
    Other columns may have any name.
    """
    spark, names = docs.sparkSession, [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(k).alias(n) for k, n in zip(keep, names)], held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    # plain columns again (a name may stand twice in ``keep``): the schema without metadata, and the block
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a block repeats most grams of any other, so small splits share one; about two thirds of a block leaves no small rests
    rows = rows.coalesce(max(1, -(-3 * size // (2 * block_bytes))))
    rows = stash(rows.mapInArrow(lambda b: _deal(b, block_bytes), f"{kinds}, block long"), "scored-texts")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    gathered, answered, dictionary = (new_dir(spark, k) for k in ("gathered", "answered", "dictionary"))
    bounds = bucket_bounds(rows, spread)
    found = rows.select("block", "held_out", "text").mapInArrow(lambda b: _gather(b, bounds), "block long, piece long, bucket int, size int, grams binary, counts binary, word binary, n long")
    found.write.partitionBy("block").option("compression", "zstd").parquet(gathered)
    found = spark.read.schema(found.schema).parquet(gathered)

    def write(df: DataFrame, path: str) -> None:
        df.repartition(spread, "block").sortWithinPartitions("block").write.partitionBy("block").option("compression", "zstd").parquet(path)

    write(block_logs(found.where("bucket IS NOT NULL")), answered)
    counts = stash(found.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")), "words")
    ends = rows.where(~F.col("held_out")).count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.expr("c > 0"))).first()
    write(found.where("word IS NOT NULL").select("block", "word").join(counts, "word").unionByName(rows.select("block").distinct().select("block", F.lit(END).alias("word"), F.lit(ends).cast("long").alias("c"))), dictionary)
    total, distinct = sums[0] + ends, sums[1] + (ends > 0)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    kinds = f"{kinds}{', ' if kinds else ''}held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = rows.mapInArrow(lambda b: _score(b, gathered, answered, dictionary, total, distinct, names), kinds)
    return out.toDF(*keep, *out.columns[len(keep) :])
