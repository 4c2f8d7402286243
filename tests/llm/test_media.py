import hashlib
import zlib

import numpy as np
import pytest

from spindrift.llm.media import cosine_hash, decode_png, encode_media, encode_png, media_features, unfilter


def test_round_trip(odd):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((str(i), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    got = media_features(encode_media(odd)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert all(len(r.phash) == 8 for r in got)


@pytest.mark.parametrize("kind", range(5))
def test_all_filters(kind):
    r = np.random.default_rng(kind)
    image = r.integers(0, 256, (9, 64), dtype=np.uint8)
    lines = np.zeros((9, 65), np.uint8)
    lines[:, 0] = kind
    for y in range(9):
        for x in range(64):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x + 1] = (int(image[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    assert (unfilter(lines) == image).all()


def test_damage_is_found():
    png = bytearray(encode_png(bytes(range(64)) * 3))
    assert decode_png(bytes(png)).tobytes() == bytes(range(64)) * 3
    for at in (0, 20, 45, len(png) - 2):
        broken = bytes([*png[:at], png[at] ^ 1, *png[at + 1 :]])
        with pytest.raises(ValueError):
            decode_png(broken)
    with pytest.raises(ValueError):
        decode_png(bytes(png[:-4]))


def test_hash_is_stable_under_small_changes():
    r = np.random.default_rng(1)
    smooth = (np.add.outer(np.arange(640), np.arange(64)) % 251).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + r.integers(-2, 3, smooth.shape), 0, 255).astype(np.uint8)
    far = r.integers(0, 256, smooth.shape, dtype=np.uint8)
    bits = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(cosine_hash(a), cosine_hash(b), strict=True))
    assert bits(smooth, noisy) <= 8 < bits(smooth, far)


def test_empty(empty):
    assert media_features(encode_media(empty)).count() == 0


def test_hash_equals_a_direct_cosine_transform():
    """The sums of the definition, written out: 32 by 32 means, 8 by 8 low frequencies, bits above their median."""
    r = np.random.default_rng(3)
    for height in (1, 5, 40):
        image = r.integers(0, 256, (height, 64), dtype=np.uint8).astype(float)
        rows = [image[min(height * i // 32, height - 1) : max(height * (i + 1) // 32, min(height * i // 32, height - 1) + 1)].mean(0) for i in range(32)]
        small = [[(row[2 * j] + row[2 * j + 1]) / 2 for j in range(32)] for row in rows]
        low = [round(sum(small[y][x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * w / 64) for y in range(32) for x in range(32)), 6) for u in range(8) for w in range(8)]
        middle = sorted(low[1:])[31]
        want = np.packbits([x > middle for x in low]).tobytes()
        assert sum(bin(a ^ b).count("1") for a, b in zip(want, cosine_hash(image.astype(np.uint8)), strict=True)) == 0
