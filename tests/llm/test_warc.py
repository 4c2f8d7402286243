import base64
import hashlib
import struct
from collections import defaultdict

import pytest

from spindrift.llm.warc import BundleReader, BundleWriter, make_record, read_bundles, resolve_revisits, write_bundles

SCHEMA = "page_id long, url string, html string"


def pages(spark):
    same = "<p>same</p>" * 30
    rows = [(1, "http://a/1", same), (2, "http://a/2", same), (9, None, same), (3, "http://a/3", None), (4, "http://a/4", ""), (5, "http://é/5\r\nX: y", "<p>é😀</p>"), (6, "u", "long " * 100_000), (None, "n", "<p>none</p>"), (7, "u", "a\r\n\r\nWARC/1.1\r\n"), (8, "u", "z"), (8, "u", "z")]
    return spark.createDataFrame(rows + [(100 + i, f"u{i}", "<html>hot</html>") for i in range(50)], SCHEMA)


def want(rows, least):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.html or "").encode()].append(r.page_id)
    out = []
    for r in rows:
        raw = (r.html or "").encode()
        last = max((i for i in groups[raw] if i is not None), default=None)
        refers = None if len(raw) < least or r.page_id == last else last
        out.append((r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, least):
    df = pages(spark)
    got = read_bundles(write_bundles(resolve_revisits(df, least), frame_bytes=2000, bundle_bytes=1500))
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == want(df.collect(), least)


def test_test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = read_bundles(write_bundles(resolve_revisits(df)))
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == want(df.collect(), 0)


def test_any_record_by_its_frame_offset():
    writer = BundleWriter(500, 3)
    for i in range(40):
        writer.add(i, make_record(i, "u", b"x" * i * 7, i * 7, "D", None))
    data = writer.finish()
    reader = BundleReader(data)
    assert len(reader.starts) > 3
    for e in reversed(writer.index):
        header, block = reader.record(e["frame"], e["offset"])
        assert header["WARC-Record-ID"] == e["record_id"] and block == b"x" * e["page_id"] * 7
    import zstandard

    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert whole.count(b"WARC/1.1\r\n") == 40
    with pytest.raises((ValueError, struct.error)):
        BundleReader(data[:-1])


def test_empty(spark):
    assert read_bundles(write_bundles(resolve_revisits(spark.createDataFrame([], SCHEMA)))).count() == 0
