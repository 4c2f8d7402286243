"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames, each an independent Zstandard frame; frames follow one another in a bundle, which ends in a
skippable frame with the seek table (compressed and original size of each frame). An index maps a record's identifier to its bundle,
frame and offset within the frame, so one record is read by decompressing one frame. Bundles are values of a binary column of a
table in the shared folder, which any store that Spark writes can hold; each value is a complete .warc.zst file.

Of records with equal payloads, that with the largest id is a response and the others are revisits, which carry no payload.
Which payloads may repeat is found by the two-pass Bloom filter of exact_dedup, so unique pages do not shuffle.

Defined cases: null html is an empty payload; null url is an empty URI; a null id sorts below all others and refers_to is null
where only null ids have a payload; repeated ids are separate records
with one record id, and all rows of the largest id of a payload are responses; payloads below min_payload bytes are always responses; whole
pages are stored, whatever their length; columns other than id, url and html are not read; an empty table gives no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, skew_join, small_arrow_batches
from .exact_dedup import RepeatFilter

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

CRLF = b"\r\n"
#: The date of all records: the archive holds tables, not crawls, and reruns must agree.
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def make_record(page_id, url: str, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record: a response, whose block is an HTTP message with the payload, or a revisit without block where refers_to is not null."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
        block = b""
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return CRLF.join(x.encode() for x in lines) + CRLF * 2 + block + CRLF * 2


def parse_record(frame: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of the record that starts at a frame-relative offset: the block without its HTTP head."""
    split = frame.index(CRLF * 2, at)
    first, *fields = frame[at:split].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record here")
    header = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in fields)
    n = int(header["Content-Length"])
    block = frame[split + 4 : split + 4 + n]
    if len(block) != n or frame[split + 4 + n : split + 8 + n] != CRLF * 2:
        raise ValueError("cut off within a record")
    return header, block[block.index(CRLF * 2) + 4 :] if n else block


class BundleWriter:
    """Collects records to frames of about frame_bytes."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frames, self.sizes, self.open, self.index, self.stored = [], [], bytearray(), [], 0

    def add(self, page_id, record: bytes) -> None:
        self.index.append({"record_id": record_id(page_id), "page_id": page_id, "frame": len(self.frames), "offset": len(self.open), "length": len(record)})
        self.open += record
        if len(self.open) >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            self.frames.append(self.pack(bytes(self.open)))
            self.sizes.append((len(self.frames[-1]), len(self.open)))
            self.stored += len(self.frames[-1])
            self.open = bytearray()

    def finish(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


class BundleReader:
    """Reads frames of a bundle by its footer; keeps the frame read last."""

    def __init__(self, data: bytes):
        count, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        at = len(data) - 9 - 8 * count
        if struct.unpack("<II", data[at - 8 : at]) != (SKIPPABLE_MAGIC, 8 * count + 9):
            raise ValueError("damaged seek table")
        self.data, self.starts, start = data, [], 0
        for i in range(count):
            stored, size = struct.unpack_from("<II", data, at + 8 * i)
            self.starts.append((start, stored, size))
            start += stored
        self.last, self.unpack = (None, b""), zstandard.ZstdDecompressor().decompress

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            start, stored, size = self.starts[k]
            frame = self.unpack(self.data[start : start + stored], max_output_size=size)
            if len(frame) != size:
                raise ValueError("frame size differs from the seek table")
            self.last = (k, frame)
        return self.last[1]

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse_record(self.frame(frame), offset)


INDEX_KIND = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
INDEX_SCHEMA = "array<struct<record_id:string,page_id:bigint,frame:int,offset:bigint,length:bigint>>"


def resolve_revisits(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """_page, _url, _payload, _size, _sha1 (hex), _refers: the page a revisit refers to, else null."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("_page"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), payload.alias("_payload"), F.octet_length(payload).alias("_size"), F.sha1(payload.cast("binary")).alias("_sha1"))
    slim = materialise(rows.select("_page", "_size", "_sha1"), "warc-keys")
    n = slim.count()
    seen = RepeatFilter(slim.filter(F.col("_size") >= min_payload), "_sha1", n)
    wide = seen.mark(rows, "_sha1")
    wide = wide.withColumn("_suspect", F.col("_suspect") & (F.col("_size") >= min_payload))
    groups = seen.mark(slim.filter(F.col("_size") >= min_payload), "_sha1").filter("_suspect").groupBy("_sha1").agg(F.count(F.lit(1)).alias("_rows"), F.max("_page").alias("_last"))
    refers = F.when(~F.col("_page").eqNullSafe(F.col("_last")), F.col("_last")).alias("_refers")
    repeated = skew_join(wide.filter("_suspect"), groups, "_sha1", n, "_rows").select("_page", "_url", F.when(refers.isNull(), F.col("_payload")).alias("_payload"), "_size", "_sha1", refers)
    return wide.filter(~F.col("_suspect")).select("_page", "_url", "_payload", "_size", "_sha1", F.lit(None).cast("long").alias("_refers")).unionByName(repeated)


def write_bundles(records: DataFrame, frame_bytes: int = 1 << 18, bundle_bytes: int = 4 << 20, level: int = 3) -> DataFrame:
    """The table of bundles: bundle_id, data, index. A bundle is closed at about bundle_bytes; a record is never split."""
    small_arrow_batches(records.sparkSession)

    def run(batches):
        def finish(w):
            data = w.finish()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest()]), pa.array([data], pa.binary()), pa.array([w.index], INDEX_KIND)], ["bundle_id", "data", "index"])

        writer = BundleWriter(frame_bytes, level)
        for batch in batches:
            for page, url, text, size, sha1, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                writer.add(page, make_record(page, url, (text or "").encode(), size, base64.b32encode(bytes.fromhex(sha1)).decode(), refers))
                if writer.stored >= bundle_bytes:
                    yield finish(writer)
                    writer = BundleWriter(frame_bytes, level)
        if writer.index:
            yield finish(writer)

    made = records.select("_page", "_url", "_payload", "_size", "_sha1", "_refers").mapInArrow(run, f"bundle_id string, data binary, index {INDEX_SCHEMA}")
    return materialise(made, "warc-bundles", "uncompressed")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """A row per record of the bundles, found by the index and read through the seek table; payload digests of responses are tested."""
    small_arrow_batches(bundles.sparkSession)

    def run(batches):
        for batch in batches:
            for bundle, data, index in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                reader, out = BundleReader(data), []
                for entry in index:
                    header, block = reader.record(entry["frame"], entry["offset"])
                    digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = header["WARC-Type"]
                    if header["WARC-Record-ID"] != entry["record_id"]:
                        raise ValueError("the index points to another record")
                    if kind == "response" and (base64.b32encode(hashlib.sha1(block).digest()).decode() != digest or len(block) != int(header["X-Payload-Length"])):
                        raise ValueError("payload digest differs")
                    page, refers = header.get("X-Page"), header.get("X-Refers-To-Page")
                    out.append((int(page) if page else None, int(header["X-Payload-Length"]), digest, kind, int(refers) if refers else None, header["WARC-Target-URI"], bundle, entry["frame"], entry["offset"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "bundle_id", "frame", "frame_offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return bundles.select("bundle_id", "data", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, bundle_id string, frame int, frame_offset long")
