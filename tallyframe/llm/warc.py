"""Deterministic sharded WARC archives of pages, and their reader.

``write_warc`` sorts the records by page_id over range partitions; each task rolls its files by their
compressed size (one gzip member per record, fixed header order, record ids and date; digests and lengths are
made anew from the payload), writes them under temporary names and renames them when whole; the manifest is
committed last, and ``read_warc`` reads what it lists. Equal inputs give equal files.

Of records with equal payloads (of ``least`` bytes or more) the one with the largest page_id is a response, the
others are revisits that name it and hold no payload. Which one that is comes from an aggregate of (digest,
page_id) without the payloads; its rows meet the pages in the one range shuffle, as marks that sort directly before
their page, so a payload that a third of all pages share gathers nowhere.

A null html is an empty payload. A null page_id is always a response and never referred to. Repeated rows of the
largest page_id of a payload are all responses. Other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import files
from tallyframe.llm.common import ship

ROLL_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("8a8a6b1e-42f3-5b8e-9d11-0c6f1b1d7a10")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def digest32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(page_id: object, url: str | None, payload: bytes, refers_to: object) -> bytes:
    """One uncompressed record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _pack(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _sorted_records(pages: DataFrame, least: int, partitions: int) -> DataFrame:
    kind = pages.schema["page_id"].dataType
    base = pages.select(
        "page_id",
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    keys = base.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("size"))
    keys = keys.filter(F.col("page_id").isNotNull() & (F.col("size") >= least))
    heads = keys.groupBy("digest").agg(F.max("page_id").alias("head"), F.min("page_id").alias("other")).filter("head > other")
    marks = keys.select("page_id", "digest").join(heads.select("digest", "head"), "digest").filter(F.col("page_id") != F.col("head")).distinct()
    rows = base.select(
        "page_id",
        F.sha1(F.encode("html", "UTF-8")).alias("digest"),
        F.lit(None).cast(kind).alias("head"),
        F.lit(1).alias("part"),
        "url",
        "html",
    )
    marks = marks.select("page_id", "digest", "head", F.lit(0).alias("part"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    dealt = files.by_range(rows.unionByName(marks), "page_id", files.range_bounds(pages, "page_id", partitions), partitions)
    return dealt.sortWithinPartitions("page_id", "digest", "part", "url")


def write_warc(pages: DataFrame, least: int = 0, roll: int = ROLL_BYTES, partitions: int | None = None) -> DataFrame:
    """Write the archives; returns the committed manifest (file, records, bytes, sha256)."""
    spark = ship(pages.sparkSession)
    folder = files.new_folder(spark, "warc")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        mark: tuple = ()

        def close() -> pa.RecordBatch:
            name, check = f"part-{shard:06d}-{seq:06d}.warc.gz", hashlib.sha256()

            def write(out: pa.NativeFile) -> None:
                for member in held:
                    check.update(member)
                    out.write(member)

            uri = files.put(folder, name, write)
            return pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array([len(held)]), pa.array([size]), pa.array([check.hexdigest()])], ["file", "records", "bytes", "sha256"]
            )

        for batch in batches:
            for row in range(batch.num_rows):
                page_id, digest, head, part, url, html = (c[row].as_py() for c in batch.columns)
                if part == 0:
                    mark = (page_id, digest, head)
                    continue
                refers = mark[2] if mark[:2] == (page_id, digest) else None
                held.append(_pack(record(page_id, url, html.encode(), refers)))
                size += len(held[-1])
                if size >= roll:
                    yield close()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield close()

    return files.commit(_sorted_records(pages, least, partitions).mapInArrow(run, MANIFEST), folder)


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(WARC headers, block) of every record of an archive."""
    with gzip.GzipFile(fileobj=files.read_stream(uri)) as f:
        while line := f.readline():
            if not line.strip():
                continue
            headers = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode().partition(":")
                headers[name] = value.strip()
            yield headers, f.read(int(headers["Content-Length"]))


def read_warc(manifest: DataFrame, id_type: T.DataType, partitions: int) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are taken from its payload, a revisit's from its headers.
    """
    fields = [
        ("page_id", id_type),
        ("payload_bytes", T.LongType()),
        ("payload_digest", T.StringType()),
        ("record_type", T.StringType()),
        ("refers_to", id_type),
        ("url", T.StringType()),
    ]

    def read(uri: str) -> Iterator[list]:
        out: list[list] = [[], [], [], [], [], []]
        for headers, block in records(uri):
            http, _, payload = block.partition(b"\r\n\r\n")
            kind = headers["WARC-Type"]
            if kind == "response":
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            else:
                size = int(http.rpartition(b"Content-Length:")[2])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            values = headers.get("X-Page-ID"), size, digest, kind, headers.get("X-Refers-To-Page-ID"), headers["WARC-Target-URI"]
            for column, value in zip(out, values, strict=True):
                column.append(value)
            if len(out[0]) == 4096:
                yield _typed(out)
                out = [[], [], [], [], [], []]
        yield _typed(out)

    return files.map_files(manifest, read, fields, partitions)


def _typed(columns: list[list]) -> list:
    """Ids are written as text; they are read back as the table's type."""
    return [pa.array(c, pa.string()) if i in (0, 4) else c for i, c in enumerate(columns)]
