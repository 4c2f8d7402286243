"""Media columns: PNG images held in binary columns, with perceptual hashes.

A payload becomes an 8-bit greyscale PNG 64 samples wide: signature, IHDR, IDAT (zlib), IEND, each chunk with its CRC-32.
The reader tests signature and checksums, inflates and undoes all five row filters with numpy, whole runs of rows at a time
where the filter allows it. The hash is the sign of the 8 x 8 lowest cosine-transform coefficients against their median.

Defined cases: null text is an empty text; an empty payload is padded to 64 zero bytes; null ids stay null;
whole texts are stored, whatever their length; repeated rows and equal texts give equal results; columns other than id and text are not read;
an empty table gives an empty result; a damaged image raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_arrow_batches

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY_8 = (8, 0, 0, 0, 0)  # bit depth, colour type, compression, filter method, interlace
FILTER_NONE, FILTER_SUB, FILTER_UP, FILTER_AVERAGE, FILTER_PAETH = range(5)

WIDTH = 64


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 4) -> bytes:
    """payload (a positive multiple of WIDTH bytes) as a PNG. The filter, one for the image, is that of the least sum of absolute differences."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    tried = [(FILTER_NONE, rows), (FILTER_SUB, sub), (FILTER_UP, up)]
    cost = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for _, x in tried]
    kind, best = tried[int(np.argmin(cost))]
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, best
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">II5B", WIDTH, len(rows), *GREY_8)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_chunks(png: bytes) -> Iterator[tuple[bytes, memoryview]]:
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    view, at = memoryview(png), 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("cut off within a chunk")
        (n,) = struct.unpack_from(">I", png, at)
        body = view[at + 4 : at + 8 + n]
        if at + 12 + n > len(png) or zlib.crc32(body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("chunk checksum differs")
        yield bytes(body[:4]), body[4:]
        at += 12 + n


def unfilter(lines: np.ndarray) -> np.ndarray:
    """The samples of filtered rows; column 0 of lines is each row's filter."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for begin, end in zip(np.r_[0, edges], np.r_[edges, len(kinds)], strict=True):
        kind, part = int(kinds[begin]), out[begin:end]
        above = out[begin - 1] if begin else np.zeros(out.shape[1], np.uint8)
        if kind == FILTER_SUB:
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == FILTER_UP:
            part[0] += above
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (FILTER_AVERAGE, FILTER_PAETH):
            for row in part:
                _sequential(kind, row, above)
                above = row
        elif kind != FILTER_NONE:
            raise ValueError("unknown row filter")
    return out


def _sequential(kind: int, row: np.ndarray, above: np.ndarray) -> None:
    left = corner = 0
    for i, (x, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        if kind == FILTER_AVERAGE:
            guess = (left + b) // 2
        else:
            near = [abs(b - corner), abs(left - corner), abs(left + b - 2 * corner)]
            guess = (left, b, corner)[near.index(min(near))]
        left, corner = (x + guess) & 255, b
        row[i] = left


def decode_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG, checked, as a 2-d array."""
    header, data, ended = None, [], False
    for kind, body in read_chunks(png):
        if kind == b"IHDR":
            header = struct.unpack(">II5B", body)
        elif kind == b"IDAT":
            data.append(bytes(body))
        ended = kind == b"IEND"
    if header is None or not ended or header[2:] != GREY_8:
        raise ValueError("not a whole 8-bit greyscale PNG")
    width, height = header[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if raw.size != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfilter(raw.reshape(height, width + 1))


_k, _n = np.arange(8)[:, None], np.arange(32)[None, :]
DCT = np.cos(np.pi * (2 * _n + 1) * _k / 64)


def cosine_hash(image: np.ndarray) -> bytes:
    """8 bytes: the image is averaged to 32 x 32, and each of its 8 x 8 lowest cosine coefficients compared with their median."""

    def shrink(x: np.ndarray) -> np.ndarray:
        edges = np.arange(33) * len(x) // 32
        return np.add.reduceat(x, np.minimum(edges[:-1], len(x) - 1), axis=0) / np.maximum(np.diff(edges), 1)[:, None]

    small = shrink(shrink(image.astype(np.float64)).T).T
    low = np.round(DCT @ small @ DCT.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 or 64 * (not raw))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media, the stored PNG of each text, written to the shared folder."""
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = [(n, encode_png(p)) for n, p in map(payload_of, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], [id_col, "n_bytes", "media"])

    return materialise(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, n_bytes long, media binary"), "media", "uncompressed")


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads stored images back: id, n_bytes, sizes and digests of payload and media, and phash, a binary column."""

    def run(batches):
        for batch in batches:
            rows = []
            for png in batch.column(2).to_pylist():
                image = decode_png(png)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(image)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash"])

    return media.mapInArrow(run, f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary")
