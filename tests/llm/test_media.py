import hashlib
import io
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablegraft.llm import media


def slow_resize(image, height, width):
    """Area means by spreading every sample over fine cells."""
    h, w = image.shape[:2]
    fine = np.repeat(np.repeat(image.astype(float), height, axis=0), width, axis=1)
    return fine.reshape((height, h, width, w) + image.shape[2:]).mean(axis=(1, 3))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 23), st.integers(1, 17), st.integers(1, 9), st.integers(1, 9), st.integers(1, 7), st.booleans(), st.integers(0, 99))
def test_area_resize_is_the_area_mean(h, w, height, width, block, colour, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if colour else (h, w)).astype(np.uint8)
    assert np.allclose(media.area_resize(image, height, width, block), slow_resize(image, height, width))


def test_a_long_row_is_resized_like_a_long_column():
    image = np.random.default_rng(3).integers(0, 256, (3, 1 << 20, 3)).astype(np.uint8)
    tracemalloc.start()
    wide = media.area_resize(image, 2, 32)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 << 20
    assert np.allclose(wide[:, 0], image[:, : 1 << 15].astype(float).reshape(3, -1, 3).mean(axis=1)[[0, 2]] * 2 / 3 + image[1, : 1 << 15].mean(axis=0) / 3)


def test_formats_decode():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert np.array_equal(media.decode(media.encode_pgm(grey)), grey)
    assert np.array_equal(media.decode(b"P2 # note\n4 3\n15\n" + b" ".join(str(x).encode() for x in range(12))), grey)
    assert np.array_equal(media.decode(b"P1\n3 2\n1 0 1\n0 1 0\n"), [[0, 255, 0], [255, 0, 255]])
    assert np.array_equal(media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])), [[0, 255, 0], [255, 0, 255]])
    assert np.array_equal(media.decode(b"P5\n2 1\n65535\n\x01\x02\x00\x05"), [[258, 5]])
    assert np.array_equal(media.decode(b"P6\n1 1\n255\n\x01\x02\x03"), [[[1, 2, 3]]])
    assert np.array_equal(media.decode(b"P3\n1 1\n255\n1 2 3"), [[[1, 2, 3]]])
    pixels = np.random.default_rng(1).integers(0, 256, (5, 3, 3)).astype(np.uint8)
    assert np.array_equal(media.decode(media.encode_bmp(pixels)), pixels)


@pytest.mark.parametrize("bad", [b"", b"P", b"P9", b"P5\n4 3\n255\nxx", b"BM", b"P5\n\n", b"BM" + bytes(60), b"P5 1 1 0 x",
    b"P5 99999999999999999999 1 255\n", b"P5 999999999 999999999 255\nx", b"P2 1 1 255\n99999999999999999999", b"P2 1 1 9\n10", b"P2 1 1 9\n-1", b"P1 2 1\n0x", b"P4 999999999 999999999\nx", b"P6 5 5 65535\nxx",
    b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 54, 40, 2**31 - 1, 2**31 - 1, 1, 24, 0, 0, 0, 0, 0, 0), b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 54, 40, 1, -(2**31), 1, 32, 3, 0, 0, 0, 0, 0),
    b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 58, 40, 1, 1, 1, 8, 0, 0, 0, 0, 1, 0) + bytes(4) + b"\x07\0\0\0"])
def test_damaged_media_give_an_error(spark, bad):
    row = media.decode_media(spark.createDataFrame([(1, bad)], "k long, m binary"), "k", "m").first()
    assert row.error and row.tile is None


def test_bit_fields_say_where_colours_are():
    pixels = np.random.default_rng(3).integers(0, 256, (3, 2, 3)).astype(np.uint8)
    raw = np.zeros((3, 2, 4), np.uint8)
    raw[..., [1, 3, 2]] = pixels[::-1]  # red in byte 1, green in 3, blue in 2
    head = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 66, 40, 2, 3, 1, 32, 3, 0, 0, 0, 0, 0)
    assert np.array_equal(media.decode(head + struct.pack("<III", 0xFF00, 0xFF000000, 0xFF0000) + raw.tobytes()), pixels)
    with pytest.raises(ValueError, match="bit fields"):
        media.decode(head + struct.pack("<III", 0xF800, 0x7E0, 0x1F) + raw.tobytes())


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.booleans(), st.integers(0, 99))
def test_difference_hashes_compare_cell_means(h, w, colour, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if colour else (h, w)).astype(np.uint8)
    plain = image @ np.array([0.299, 0.587, 0.114]) if colour else image
    cells, bits = np.round(slow_resize(plain, 8, 9), 6), ""
    for y in range(8):
        for x in range(8):
            bits += "1" if cells[y, x] > cells[y, x + 1] else "0"
    assert media.difference_hash(image) == f"{int(bits, 2):016x}"


def test_features_of_texts(docs, rows):
    for r in media.text_media(docs).collect():
        data = next((t or "").encode() for i, t, *_ in rows if i == r.doc_id)
        if len(data) < 2000:
            grey = np.frombuffer(data + bytes(-len(data) % 64 if data else 64), np.uint8).reshape(-1, 64)
            cells = np.round(slow_resize(grey, 8, 9), 6)
            assert r.feature == np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes().hex()


def test_tiles_are_npy(spark):
    pixels = np.random.default_rng(2).integers(0, 256, (40, 30, 3)).astype(np.uint8)
    rows = media.decode_media(spark.createDataFrame([(1, media.encode_bmp(pixels)), (2, None)], "k long, m binary"), "k", "m", side=8).orderBy("k").collect()
    tile = np.load(io.BytesIO(rows[0].tile))
    assert tile.shape == (8, 8, 3) and np.allclose(tile, slow_resize(pixels, 8, 8), atol=0.51) and len(rows[0].dhash) == 16
    assert rows[1].error == "no media"


def test_query(docs, rows, no_docs):
    got = media.text_media(docs).collect()
    want = []
    for i, t, *_ in rows:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.media_sha256, r.feature) == r.feature
    assert media.text_media(no_docs).count() == 0
