"""Token-ID output: fixed-width bit packing in sharded binary files with random access.

Format of one shard file (all numbers little-endian, except that the packed ids are a big-endian bit stream)::

    "TWPACK1\\n"                       8 bytes
    block 0, block 1, ...              each holds ``block_ids`` ids of ``width`` bits (the last one fewer), padded to whole bytes
    block offsets                      uint64 x n_blocks, from the start of the file
    document ids                       int64 x n_docs   (the lowest int64 stands for null)
    document ends                      uint64 x n_docs  (ids up to and with this document, within the shard)
    footer                             width, block_ids, n_ids, n_blocks, n_docs as 5 x uint64, then "TWPACK1\\n"

``width`` is the least number of bits that holds every id of the vocabulary.  Block ``k`` starts at a known offset, so
ids ``[a, b)`` are read by unpacking only blocks ``a // block_ids .. (b - 1) // block_ids`` with vectorised numpy.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import attempt_name, new_dir, open_fs, partition_id, stash

MAGIC = b"TWPACK1\n"
NULL_ID = -(2**63)


def width_of(vocabulary: int) -> int:
    """Bits that hold ids 0 .. vocabulary - 1."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits.ravel()).tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width).reshape(count, width)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - width :] = bits
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class ShardWriter:
    """Appends documents to one shard file; holds one block of ids and the document index in memory."""

    def __init__(self, out, width: int, block_ids: int):
        self.out, self.width, self.block_ids = out, width, block_ids
        self.rest: list[np.ndarray] = []
        self.n_rest = self.n_ids = 0
        self.offsets: list[int] = []
        self.docs: list[int] = []
        self.ends: list[int] = []
        self.out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc is None else doc)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= self.block_ids:
            whole = np.concatenate(self.rest)
            cut = len(whole) - len(whole) % self.block_ids
            for k in range(0, cut, self.block_ids):
                self._block(whole[k : k + self.block_ids])
            self.rest, self.n_rest = [whole[cut:]], len(whole) - cut

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_rest:
            self._block(np.concatenate(self.rest))
        for kind, values in (("<u8", self.offsets), ("<i8", self.docs), ("<u8", self.ends)):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(struct.pack("<5Q", self.width, self.block_ids, self.n_ids, len(self.offsets), len(self.docs)) + MAGIC)
        self.out.close()


class ShardReader:
    """Random access to a shard: ``ids(a, b)`` reads only the blocks that hold ids a .. b - 1."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 48)
        tail = source.read(48)
        if tail[40:] != MAGIC:
            raise ValueError("not a packed-id shard, or one that was cut short")
        self.width, self.block_ids, self.n_ids, n_blocks, n_docs = struct.unpack("<5Q", tail[:40])
        source.seek(size - 48 - 8 * n_blocks - 16 * n_docs)
        self.offsets = np.frombuffer(source.read(8 * n_blocks), "<u8")
        self.docs = np.frombuffer(source.read(8 * n_docs), "<i8")
        self.ends = np.frombuffer(source.read(8 * n_docs), "<u8").astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        count = min(self.block_ids, self.n_ids - k * self.block_ids)
        self.source.seek(int(self.offsets[k]))
        return unpack(self.source.read((count * self.width + 7) // 8), count, self.width)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = start // self.block_ids
        blocks = [self.block(k) for k in range(first, (stop - 1) // self.block_ids + 1)]
        return np.concatenate(blocks)[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start, ids) in file order, one block in memory at a time (more only for a longer document)."""
        held, held_from, k, start = np.zeros(0, np.uint32), 0, 0, 0
        for doc, stop in zip(self.docs.tolist(), self.ends.tolist()):
            if held_from + len(held) < stop:
                parts = [held[start - held_from :]]
                held_from, have = start, held_from + len(held)
                while have < stop:
                    parts.append(self.block(k))
                    have += len(parts[-1])
                    k += 1
                held = np.concatenate(parts)
            yield (None if doc == NULL_ID else doc), start, held[start - held_from : stop - held_from]
            start = stop


# What the word tokenizer does before its model.  Only a tokenizer that does exactly this is taken apart by words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

#: A LATIN text has these bytes and, in UTF-8, À to ÿ without the two signs among them.  It is normalised by lower-casing
#: alone, and for it LETTERS are all of \p{L}, 0-9 all of \p{N}.
ASCII = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F)])
UPPER_LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*").fullmatch
LETTERS = "a-zß-öø-ÿ"
#: SPLIT's pattern on lines of lower-cased words of LATIN; a line end is a piece of its own.
CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|\n|[^{LETTERS}0-9\n]+").findall
#: Stands for a line end among ids: no id has four bytes of this value in a row, or beside those of its neighbour.
LINE_END = b"\xff" * 4


def is_latin(text: bytes) -> bool:
    return bool(UPPER_LATIN(text.translate(None, ASCII)))


class WordEncoder:
    """``encode(text)`` gives the little-endian uint32 ids that the tokenizers library gives for the whole text.

    The word tokenizer drops white space and never joins pieces across it, so a text's ids are its words' ids in a row, and
    bounded memos of words and of pieces save most of the work.  A text's new words of LATIN characters are cut together by
    the tokenizer's own pattern and their pieces go to the library's BPE model; other words go through the library's encode().
    So does the whole of a text that holds an added token, and every text if the tokenizer has another normaliser or pre-tokenizer.
    """

    def __init__(self, path: str, memo_words: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.model, self.memo_words = self.tokenizer.model, memo_words
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_as = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = [t.content for t in added] + [t.content.lower() for t in added]
        self.by_words = self._takes_words(added)
        self.packers = [struct.Struct(f"<{n}I").pack for n in range(32)]
        self.words: dict[str, bytes] = {}
        self.pieces = {"\n": LINE_END}

    def _takes_words(self, added: list) -> bool:
        from tokenizers.models import BPE

        t, made = self.tokenizer, lambda part: json.loads(part.__getstate__()) if part is not None else None
        same = made(t.normalizer) == NORMALIZER and made(t.pre_tokenizer) == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        plain = t.post_processor is None and t.truncation is None and t.padding is None and isinstance(self.model, BPE) and not self.model.dropout
        # an added token that is sought after normalisation may be found in other spellings than its own
        return same and plain and not any(x.normalized for x in added) and self.vocabulary < 1 << 24

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.bytes_as))]
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else np.array(ids, "<u4").tobytes()

    def _learn(self, new: list[str], latin: bool) -> None:
        """Put the ids of these words into the memo."""
        if not latin:
            own = [is_latin(w.encode()) for w in new]
            self.words.update((w, self._whole(w)) for w, x in zip(new, own) if not x)
            new = [w for w, x in zip(new, own) if x]
        if not new:
            return
        cut = CUT("\n".join(new).lower())
        for piece in set(cut).difference(self.pieces):
            self.pieces[piece] = self._piece(piece)
        self.words.update(zip(new, b"".join(map(self.pieces.__getitem__, cut)).split(LINE_END)))

    def encode(self, data: bytes) -> bytes:
        text, latin = data.decode("utf-8", "replace"), self.by_words and is_latin(data)
        if latin:
            text = text.lower()
        if not self.by_words or any(a in text for a in self.added):
            return self._whole(data.decode("utf-8", "replace"))
        # a str is cut at more characters than bytes are, but at none of them in a LATIN text
        words = text.split() if latin else [w.decode("utf-8", "replace") for w in data.split()]
        found = list(map(self.words.get, words))
        lacking = [i for i, x in enumerate(found) if x is None]
        if lacking:
            self._learn(list({words[i] for i in lacking}), latin)
            for i in lacking:
                found[i] = self.words[words[i]]
            if len(self.words) > self.memo_words:
                self.words.clear()
            if len(self.pieces) > self.memo_words:
                self.pieces = {"\n": LINE_END}
        return b"".join(found)


def _write_partition(batches: Iterable, folder: str, tokenizer: str, end_id: int, block_ids: int, shard_ids: int):
    import pyarrow as pa

    fs, path = open_fs(folder)
    encoder, seq, writer = WordEncoder(tokenizer), 0, None
    width = width_of(max(encoder.vocabulary, end_id + 1))
    end = np.array([end_id], "<u4").tobytes()
    fs.create_dir(path, recursive=True)

    def close():
        writer.close()
        final = f"{path}/shard-{partition_id():06d}-{seq:04d}.ids"
        fs.move(f"{path}/{temp}", final)
        return pa.RecordBatch.from_pydict({"part": pa.array([partition_id()], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{folder}/{final.rpartition('/')[2]}"], "n_ids": pa.array([writer.n_ids], pa.int64()), "n_docs": pa.array([len(writer.docs)], pa.int64())})

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            if writer is None:
                temp = f"_tmp-{attempt_name()}-{seq:04d}"
                writer = ShardWriter(fs.open_output_stream(f"{path}/{temp}"), width, block_ids)
            writer.add(doc, np.frombuffer(encoder.encode(text or b"") + end, "<u4"))
            if writer.n_ids >= shard_ids:
                yield close()
                writer, seq = None, seq + 1
    if writer is not None:
        yield close()


def write_packed(docs: DataFrame, tokenizer: str, end_id: int, order: list[Column] | None = None, folder: str | None = None, block_ids: int = 1 << 16, shard_ids: int = 1 << 26) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them, in ``order``, as packed shards; returns the manifest.

    ``order`` defaults to ascending doc_id (nulls first), equal ids by a hash of their text, so one repeated id is dealt to
    many shards.  Each task writes to a temporary name and renames the finished file; the manifest (one row a shard) names
    only the files of the attempts that counted.  Null text is empty and gives the end id alone; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "packed")
    order = order or [F.col("doc_id"), F.xxhash64("text")]
    keys = [f"_k{i}" for i in range(len(order))]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c.alias(k) for c, k in zip(order, keys)])
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    schema = "part int, seq int, path string, n_ids long, n_docs long"
    return stash(rows.mapInArrow(lambda b: _write_partition(b, folder, tokenizer, end_id, block_ids, shard_ids), schema), "manifest")


def read_packed(manifest: DataFrame) -> DataFrame:
    """One row a document, read back from the shards: doc_id, start (ids before it over all shards), n_tokens, ids_crc32."""
    # one row a shard: a window over all of them stays small however large the shards are
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return based.repartition(tasks, "path").mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_shards(batches: Iterable):
    import pyarrow as pa

    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            fs, at = open_fs(path)
            size = fs.get_file_info(at).size
            with fs.open_input_file(at) as source:
                rows = ([], [], [], [])
                for doc, start, ids in ShardReader(source, size).documents():
                    for kept, value in zip(rows, (doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        kept.append(value)
                    if len(rows[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])
