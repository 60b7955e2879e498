import base64
import hashlib
import zlib

from rookery.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, archive string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}", h, "extra", "extra") for i, h in rows], SCHEMA)


def through(spark, pages, folder, least_bytes=0):
    archives = warc.write_archives(warc.deduplicated(pages, least_bytes=least_bytes), f"{folder}/streams").collect()
    files = spark.createDataFrame([(r.archive, r.records) for r in archives], "archive string, records long")
    normal = warc.normalise(files, f"{folder}/members").collect()
    made = spark.createDataFrame([(r.archive, r["index"], r.records) for r in normal], "archive string, index string, records long")
    return warc.read_records(made, str(folder)).collect(), normal


def test_round_trip_and_revisits(spark, tmp_path):
    rows = [(5, "same"), (3, "same"), (9, "é😀" * 50_000), (1, None), (2, ""), (7, "head\r\n\r\nContent-Length: 3\r\n\r\nbody"), (None, "x")]
    got, normal = through(spark, pages_of(spark, rows), f"file://{tmp_path}")
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    for i, html in rows:
        raw = (html or "").encode()
        r = by_id[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert bytes(r.payload) == (raw if r.record_type == "response" else b"")
    assert {i: (r.record_type, r.refers_to) for i, r in by_id.items() if r.record_type == "revisit"} == {5: ("revisit", 3), 2: ("revisit", 1)}
    for r in normal:  # every member inflates alone, and together they are the whole file
        data, n = open(r.archive, "rb").read(), 0
        while data:
            machine = zlib.decompressobj(31)
            assert machine.decompress(data).startswith(b"WARC/1.1\r\n")
            data, n = machine.unused_data, n + 1
        assert n == r.records


def test_short_payloads_stay_responses(spark, tmp_path):
    got, _ = through(spark, pages_of(spark, [(1, "ab"), (2, "ab"), (3, "abcd"), (4, "abcd")]), f"file://{tmp_path}", least_bytes=3)
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty_table(spark, tmp_path):
    assert through(spark, pages_of(spark, []), f"file://{tmp_path}")[0] == []


def test_inflates_streams_of_several_members_in_small_pieces():
    import gzip
    import io

    data = gzip.compress(b"a" * 100_000) + gzip.compress(b"b" * 10)
    pieces = list(warc.inflated(io.BytesIO(data), piece=700))
    assert b"".join(pieces) == b"a" * 100_000 + b"b" * 10 and max(map(len, pieces)) <= 700
