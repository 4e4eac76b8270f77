import base64
import gzip
import hashlib

import pytest

from tallyframe.llm import files, warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    heads = {}
    for page_id, _, html in rows:
        p = (html or "").encode()
        if page_id is not None and len(p) >= least:
            heads[p] = max(heads.get(p, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        p = (html or "").encode()
        head = heads.get(p) if page_id is not None else None
        kind = ("response", None) if head in (None, page_id) else ("revisit", head)
        out.append((page_id, len(p), digest(html), *kind))
    return sorted(out, key=str)


def read(manifest, spark):
    from pyspark.sql import types as T

    return warc.read_warc(manifest, T.LongType(), 4)


def rows_of(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def odd():
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}é</p>" * (i % 5)) for i in range(300)]
    return [*rows, (None, None, None), (None, "u", "<p>1é</p>"), (400, "x\r\ny", None), (401, "", ""), (402, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (299, "http://h/299", rows[299][2]), (500, "u", "z" * 300_000)]


def test_round_trip(spark, odd):
    pages = spark.createDataFrame([(*r, "e", 1) for r in odd], "page_id bigint, url string, html string, digest string, head int")
    assert rows_of(read(warc.write_warc(pages, partitions=5, roll=2000), spark)) == brute(odd)
    assert rows_of(read(warc.write_warc(pages, least=8, partitions=2), spark)) == brute(odd, 8)
    empty = warc.write_warc(pages.filter("false"), partitions=3)
    assert empty.count() == 0 and read(empty, spark).count() == 0


def test_equal_inputs_give_equal_files(spark, odd):
    pages = spark.createDataFrame(odd, "page_id bigint, url string, html string")
    one, two = (sorted((r.records, r.bytes, r.sha256) for r in warc.write_warc(p, partitions=4, roll=1500).collect()) for p in (pages, pages.repartition(7)))
    assert one == two and len(one) > 4


def test_files_are_plain_warc_in_page_order(spark, odd):
    pages = spark.createDataFrame(odd, "page_id bigint, url string, html string")
    manifest = warc.write_warc(pages, partitions=3, roll=4000).collect()
    seen = []
    for r in sorted(manifest, key=lambda r: r.file):
        with files.read_stream(r.file) as f:
            data = f.read()
        assert hashlib.sha256(data).hexdigest() == r.sha256 and len(data) == r.bytes
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        found = list(warc.records(r.file))
        assert len(found) == r.records
        for headers, block in found:
            assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            seen.append(int(headers.get("X-Page-ID", -1)))
    assert seen == sorted(seen) and len(seen) == len(odd)


def test_query_on_the_table(spark):
    from tallyframe.llm import queries

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = brute([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert rows_of(queries.op8_warc(spark, "/root/testdata/sf0.001")) == want
