"""WARC archives with an index, read back by coalesced byte ranges.

Writing gives, per record, a row with file, offset, length, URL and digest. Readers select
rows of that index first; only the bytes of the selected records are read, neighbouring ones
together. A payload that occurs again is not stored again: its record is a ``revisit`` that
names the response with the same payload. Digests are kept once per payload, so copies are
found from digests; payloads are shuffled once. Each record is a gzip member of its own, so
that any of them can be read alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.files import opened, whole_file
from gradeweave.sources.shared import new_path, written

# Smaller payloads are always stored.
MIN_BYTES = 0

# Every record's date: archives of the same table are the same bytes.
DATE = "1970-01-01T00:00:00Z"

# Ranges of one file that are no farther apart are read together, up to so many bytes.
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20

# Records returned at a time, at most, by number and bytes.
_RECORDS = 1024
_BYTES = 4 << 20

_INDEX = (
    "file string, offset bigint, length bigint, page_id bigint, url string, digest string, "
    "record_type string"
)
_RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary"
)
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(v), _ARROW[kind]) for v, (_, kind) in zip(columns, fields)],
        [name for name, _ in fields],
    )


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as archives name payloads."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A URN that the page's id can be read from; the null id has one of its own."""
    number = (1 << 64) if page_id is None else page_id % (1 << 64)
    text = f"{(8 << 76) | number:032x}"  # a UUID of version 8
    return f"<urn:uuid:{text[:8]}-{text[8:12]}-{text[12:16]}-{text[16:20]}-{text[20:]}>"


def page_of(record: str) -> int | None:
    number = int(record[10:-1].replace("-", ""), 16) & ((1 << 65) - 1)
    if number >> 64:
        return None
    return number - (1 << 64) if number >> 63 else number


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes | None, size: int, payload_digest: str,
    refers_to: int | None,
) -> bytes:
    """One record: a response with its payload, or a revisit (payload None) without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if payload is None:
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
        head.append(
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        )
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url: str) -> str:
    """A header holds one line."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in lines.decode().split("\r\n")[1:] if ": " in line)
    return {name: value for name, value in pairs}


def parse_record(data: bytes) -> tuple:
    """The fields of one record's bytes, in the order of ``read_records``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = _headers(head)
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = named["WARC-Type"]
    refers_to = page_of(named["WARC-Refers-To"]) if kind == "revisit" else None
    found = named["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest(payload) != found:
        raise ValueError(f"damaged record {named['WARC-Record-ID']}")
    return (
        page_of(named["WARC-Record-ID"]), named.get("WARC-Target-URI"), kind, refers_to,
        int(_headers(http)["Content-Length"]), found, payload if kind == "response" else None,
    )


def write_archive(
    pages: DataFrame, *, folder: str | None = None, min_bytes: int = MIN_BYTES
) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html); returns the index.

    The payload is the html in UTF-8, empty for null. Of equal payloads of at least
    ``min_bytes`` bytes the one of the smallest page_id is the response; the others are
    revisits of it. Rows that repeat that page_id and payload are responses too, and a
    payload that only rows of null page_id have is stored with each of them. A null url gives a
    record without one; an empty table an empty index. Other columns are not looked at.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))

    seen = written(
        rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "sha1"), "digests"
    )
    copied = (
        seen.groupBy("sha1")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("refers_to").isNotNull())
    )
    revisits = (
        seen.join(copied, "sha1")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("of_page"), F.col("sha1").alias("of_sha1"), "refers_to")
        .distinct()
    )
    marked = rows.join(
        revisits,
        F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("sha1") == F.col("of_sha1")),
        "left",
    ).select("page_id", "url", "payload", "sha1", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        # The index names the attempt that wrote the file: what another attempt left
        # behind is never read.
        context = TaskContext.get()
        file = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        at = 0
        with whole_file(file) as out:
            while first is not None:
                index = []
                for page_id, url, body, sha1, refers_to in zip(*first.to_pydict().values()):
                    name = base64.b32encode(bytes.fromhex(sha1)).decode()
                    stored = body if refers_to is None else None
                    data = record_bytes(page_id, url, stored, len(body), name, refers_to)
                    data = gzip.compress(data, mtime=0)
                    out.write(data)
                    kind = "response" if refers_to is None else "revisit"
                    index.append((file, at, len(data), page_id, url, name, kind))
                    at += len(data)
                yield _batch(index, _INDEX)
                first = next(batches, None)

    marked.mapInArrow(write, _INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, *, parts: int | None = None) -> DataFrame:
    """The records that rows of an index point to.

    page_id, url, record_type, refers_to (page_id of the response, for revisits),
    payload_bytes and payload_digest (of the full payload), payload (null for revisits). Stored
    payloads are checked against their digests.
    """
    parts = parts or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = (
        index.select("file", "offset", "length")
        .repartitionByRange(parts, "file", "offset")
        .sortWithinPartitions("file", "offset")
    )
    return ranges.mapInArrow(_read, _RECORD)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wanted = (
        row
        for batch in batches
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)))
    )
    name, stream, rows, held = None, None, [], 0
    for file, start, end, places in _coalesced(wanted):
        if file != name:
            system, path = opened(file)
            if stream is not None:
                stream.close()
            name, stream = file, system.open_input_file(path)
        data = stream.read_at(end - start, start)
        for offset, length in places:
            record = gzip.decompress(data[offset - start : offset - start + length])
            rows.append(parse_record(record))
            held += len(record)
            if len(rows) >= _RECORDS or held >= _BYTES:
                yield _batch(rows, _RECORD)
                rows, held = [], 0
    if stream is not None:
        stream.close()
    if rows:
        yield _batch(rows, _RECORD)


def _coalesced(wanted: Iterator[tuple]) -> Iterator[tuple[str, int, int, list]]:
    """Sorted ranges of bytes, joined while they are near each other and not too long."""
    file, start, end, places = None, 0, 0, []
    for name, offset, length in wanted:
        near = name == file and offset - end <= GAP_BYTES
        if not near or offset + length - start > READ_BYTES:
            if places:
                yield file, start, end, places
            file, start, places = name, offset, []
        places.append((offset, length))
        end = offset + length
    if places:
        yield file, start, end, places
