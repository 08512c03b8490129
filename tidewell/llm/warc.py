"""WARC output: records in page order, shards rolled by compressed size, payload digests and revisit records.

Records with equal payloads become one ``response`` (the smallest page_id) and ``revisit`` records that refer to it.  The
verdict is joined as narrow rows only: revisits travel beside the pages through the one range shuffle that sorts them, so
the html is shuffled once and a payload that a third of the pages share makes no hot join.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attempt_name, new_dir, open_fs, partition_id, stash

IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The same pages give the same archive bytes, so the record date is a parameter and not the time of the run.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _line(value: str) -> str:
    """A header value is one line."""
    return re.sub(r"[\r\n]+", " ", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": _line(url or ""),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "WARC-Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        head |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": record_id(refers_to, digest), "WARC-Refers-To-Page-ID": str(refers_to)}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _write_partition(batches: Iterable, folder: str, roll_bytes: int, date: str):
    import pyarrow as pa

    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    seq, out, written, count, seen = 0, None, 0, 0, hashlib.sha256()
    page, verdicts, first = object(), {}, set()

    def close():
        out.close()
        final = f"part-{partition_id():06d}-{seq:04d}.warc.gz"
        fs.move(f"{path}/{temp}", f"{path}/{final}")
        return pa.RecordBatch.from_pydict({"path": [f"{folder}/{final}"], "n_records": pa.array([count], pa.int64()), "n_bytes": pa.array([written], pa.int64()), "sha256": [seen.hexdigest()]})

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("page_id", "digest", "refers_to", "url")]
        payloads = batch.column("html").cast(pa.large_binary()).to_pylist()
        for page_id, digest, refers_to, url, html in zip(*columns, payloads):
            if page_id != page:
                page, verdicts, first = page_id, {}, set()
            if digest is not None:  # a verdict row; it sorts before the rows of its page
                verdicts[digest] = refers_to
                continue
            payload = html or b""
            own = base32_sha1(payload)
            to = verdicts.get(hashlib.sha1(payload).hexdigest()) if verdicts else None
            revisit = to is not None and (to != page_id or own in first)
            if to == page_id:
                first.add(own)
            data = record_bytes(page_id, url, payload, to, revisit, date)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress(data) + packer.flush()
            if out is None:
                temp = f"_tmp-{attempt_name()}-{seq:04d}"
                out, written, count, seen = fs.open_output_stream(f"{path}/{temp}"), 0, 0, hashlib.sha256()
            out.write(data)
            seen.update(data)
            written, count = written + len(data), count + 1
            if written >= roll_bytes:
                yield close()
                out, seq = None, seq + 1
    if out is not None:
        yield close()


def write_warc(pages: DataFrame, folder: str | None = None, roll_bytes: int = 1 << 28, min_payload: int = 0, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files; returns the manifest (path, n_records, n_bytes, sha256).

    Null html is an empty payload.  Payloads under ``min_payload`` bytes are never revisited.  A page without page_id can't be
    referred to: it is always a response.  Rows that repeat a page_id with the same payload: the first is the response, the
    others revisit it.  Further columns are ignored; no pages give no files.
    """
    spark = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    body = F.coalesce("html", F.lit(""))
    slim = pages.where(F.col("page_id").isNotNull() & (F.octet_length(body) >= min_payload)).select("page_id", F.sha1(body.cast("binary")).alias("digest"))
    copies = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    verdicts = slim.join(copies, "digest").select("page_id", "digest", "refers_to").distinct()
    rows = verdicts.select("page_id", "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    rows = rows.unionByName(pages.select("page_id", "url", "html"), allowMissingColumns=True)
    # pages without an id are dealt by their text, so that many of them make no hot range
    spread = F.when(F.col("page_id").isNull(), F.xxhash64("url", "html"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_spread", spread).repartitionByRange(parts, "page_id", "_spread")
    rows = rows.sortWithinPartitions("page_id", "_spread", F.col("digest").isNull(), F.xxhash64("url", "html")).drop("_spread")
    return stash(rows.mapInArrow(lambda b: _write_partition(b, folder, roll_bytes, date), "path string, n_records long, n_bytes long, sha256 string"), "warc-manifest")


def read_records(source, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a gzipped WARC stream; one record is in memory at a time."""
    rest, data, packer = b"", bytearray(), zlib.decompressobj(31)
    while True:
        more = rest or source.read(chunk)
        if not more:
            break
        data += packer.decompress(more)
        rest = packer.unused_data
        if packer.eof:
            head, _, tail = bytes(data).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0]!r}")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            size = int(headers["Content-Length"])
            if tail[size:] != b"\r\n\r\n":
                raise ValueError("a record's length differs from its Content-Length")
            yield headers, tail[:size]
            data, packer = bytearray(), zlib.decompressobj(31)
    if data:
        raise ValueError("the archive ends within a record")


def _read_partition(batches: Iterable):
    import pyarrow as pa

    kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
    number = lambda x: int(x) if x else None
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, at = open_fs(path)
            rows = []
            with fs.open_input_file(at) as source:
                for h, block in read_records(source):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if base32_sha1(block) != h["WARC-Block-Digest"].removeprefix("sha1:") or h["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"{path}: a record of page {h['WARC-Page-ID']} fails its digest")
                    rows.append((number(h["WARC-Page-ID"]), size, digest, h["WARC-Type"], number(h.get("WARC-Refers-To-Page-ID")), h["WARC-Target-URI"]))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)
                        rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row a record, from the archives that the manifest names; digests are verified."""
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(parts, "path").mapInArrow(_read_partition, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
