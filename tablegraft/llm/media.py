"""Operator 2: media columns. Netpbm (P1-P6) and BMP (8, 24 and 32 bit, uncompressed) decode to numpy arrays, are resized by
area through integral images, and leave as NPY tiles with difference hashes.

Area resizing reads the integral image at the output's cell borders, with linear interpolation inside a cell; that is the
exact area mean. The integral image is kept only at those borders while rows stream through in blocks, so an image of any
height takes a bounded amount of memory besides its own bytes.

Null media give null columns; media that can't be decoded give null columns and a text in `error`. An empty table gives an
empty result. For texts stored as media: null text is empty, the payload is padded with bytes 0 to a positive multiple of 64
and stored as a grey map (P5) 64 samples wide, so that equal texts give equal bytes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, raw, slices

WIDTH = 64
_SPACE = b" \t\n\v\f\r"


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """n whole numbers of a Netpbm header, comments skipped, and where the samples start."""
    out, at = [], 2
    while len(out) < n:
        while data[at : at + 1] and (data[at] in _SPACE or data[at : at + 1] == b"#"):
            at = (data.index(b"\n", at) if data[at : at + 1] == b"#" else at) + 1
        to = at
        while data[to : to + 1].isdigit():
            to += 1
        if to == at:
            raise ValueError("bad Netpbm header")
        if to - at > 9:
            raise ValueError("a number in the header is too large")
        out.append(int(data[at:to]))
        at = to
    return out, at + 1


def _samples(data: bytes, kind, count: int, at: int) -> np.ndarray:
    """`count` samples as they stand in the bytes; fewer are an error before anything is reserved for them."""
    if at + count * np.dtype(kind).itemsize > len(data):
        raise ValueError("samples are missing")
    return np.frombuffer(data, kind, count, at)


def _numbers(words: list[bytes], most: int) -> np.ndarray:
    if any(not w.isdigit() or len(w) > 9 for w in words):
        raise ValueError("a sample is no number")
    out = np.array(words, dtype=np.int64)
    if len(out) and out.max() > most:
        raise ValueError("a sample is above the maximum")
    return out


def decode_netpbm(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3); 8-bit or 16-bit samples, bits as 0 (black) and 255."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise ValueError("not Netpbm")
    bits = kind in b"14"
    (w, h, *rest), at = _header(data, 2 if bits else 3)
    most = rest[0] if rest else 1
    depth = 3 if kind in b"36" else 1
    if not 0 < most < 65536:
        raise ValueError("bad maximum")
    n = w * h * depth
    if kind == b"4":
        rows = _samples(data, np.uint8, h * -(-w // 8), at).reshape(h, -1)
        out = (1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255)
    elif kind in b"56":
        out = _samples(data, np.uint8 if most < 256 else ">u2", n, at).astype(np.uint8 if most < 256 else np.uint16, copy=False)
    else:
        text = data[at - 1 :]
        text = b"\n".join(x.partition(b"#")[0] for x in text.split(b"\n"))
        if kind == b"1":
            digits = np.frombuffer(text.translate(None, _SPACE), np.uint8)[:n].astype(np.int64) - 48
            if len(digits) and (digits.min() < 0 or digits.max() > 1):
                raise ValueError("a bit is neither 0 nor 1")
            out = (1 - digits) * 255
        else:
            out = _numbers(text.split(None, n)[:n], most)
        out = out.astype(np.uint8 if most < 256 else np.uint16)
    if out.size != n:
        raise ValueError("samples are missing")
    return out.reshape((h, w) if depth == 1 else (h, w, 3))


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width, 3) in the order red, green, blue. Bit fields are read where each colour is a whole byte of four."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    at, size, w, h, _, bits, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32) or w <= 0 or h == 0 or packed == 3 and bits != 32:
        raise ValueError("unsupported BMP")
    order = [2, 1, 0]
    if packed == 3:
        masks = struct.unpack_from("<III", data, 54)
        if set(masks) - {0xFF << k for k in (0, 8, 16, 24)} or len(set(masks)) < 3:
            raise ValueError("unsupported bit fields")
        order = [m.bit_length() // 8 - 1 for m in masks]
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = _samples(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = _samples(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        if int(rows.max()) >= colours:
            raise ValueError("a sample is beyond the palette")
        return palette[rows]
    return rows.reshape(abs(h), w, bits // 8)[:, :, order]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype(np.uint8, copy=False).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP of (height, width, 3)."""
    h, w, _ = pixels.shape
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _axis(n: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole and fractional part of the `to` + 1 cell borders over n samples."""
    at = np.arange(to + 1) * n
    return at // to, (at % to) / to


def area_resize(image: np.ndarray, height: int, width: int, block: int = 4096) -> np.ndarray:
    """Area means (float64) on a grid of height x width cells, by the integral image at the cells' borders. What is held beside the
    image grows with its shorter side, if the longer one has more than `block` samples."""
    h, w = image.shape[:2]
    if not h or not w:
        return np.zeros((height, width) + image.shape[2:])
    if w > max(h, block):
        return area_resize(image.swapaxes(0, 1), width, height, block).swapaxes(0, 1)
    block = max(1, min(block, (1 << 22) // w))
    rows, part = _axis(h, height)
    cols, cpart = _axis(w, width)
    borders = np.zeros((height + 1, w) + image.shape[2:])
    total, done = np.zeros((w,) + image.shape[2:]), 0
    for at in range(0, h, block):
        cells = image[at : at + block].astype(np.float64)
        sums = total + np.cumsum(cells, axis=0)
        while done <= height and (rows[done] < at + len(cells)):
            k = rows[done] - at
            borders[done] = (sums[k - 1] if k else total) + part[done] * cells[k]
            done += 1
        total = sums[-1]
    borders[done:] = total
    across = np.concatenate([np.zeros((height + 1, 1) + image.shape[2:]), np.cumsum(borders, axis=1)], axis=1)
    padded = np.concatenate([borders, np.zeros((height + 1, 1) + image.shape[2:])], axis=1)
    shape = (1, width + 1) + (1,) * (image.ndim - 2)
    whole = across[:, cols] + cpart.reshape(shape) * padded[:, np.minimum(cols, w)]
    sums = np.diff(np.diff(whole, axis=0), axis=1)
    return sums * (height * width / (h * w))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """A side x side tile (uint8, or uint16 for such samples) as the bytes of an NPY file."""
    tile = np.rint(area_resize(image, side, side)).astype(image.dtype)
    np.save(out := io.BytesIO(), tile, allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether a cell of a 8 x 9 grid is brighter than the one to its right; 16 hex digits."""
    cells = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes().hex()


def store_text(data: bytes) -> bytes:
    """The padded bytes as a grey map 64 samples wide."""
    padded = data + bytes(-len(data) % WIDTH if data else WIDTH)
    return encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))


def decode_media(media: DataFrame, key: str, column: str, side: int = 32) -> DataFrame:
    """(key, height, width, channels, tile, dhash, error) of a binary column of media files; tile is an NPY file."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 16 << 20):
                out = []
                for data in part.column(1).to_pylist():
                    try:
                        if data is None:
                            raise ValueError("no media")
                        image = decode(data)
                        out.append((image.shape[0], image.shape[1], 1 if image.ndim == 2 else 3, npy_tile(image, side), difference_hash(image), None))
                    except (ValueError, struct.error, IndexError, OverflowError, MemoryError) as e:
                        out.append((None, None, None, None, None, str(e)))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["key", "height", "width", "channels", "tile", "dhash", "error"])

    schema = T.StructType([T.StructField("key", media.schema[key].dataType)]).add("height", "integer").add("width", "integer").add("channels", "integer").add("tile", "binary").add("dhash", "string").add("error", "string")
    return media.select(col(key).alias("key"), col(column).alias("media")).mapInArrow(run, schema).withColumnRenamed("key", key)


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", side: int = 32) -> DataFrame:
    """Stores each whole text as a grey map, reads the stored bytes back, and gives digests, tile and hash of what was read:
    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tile_sha256)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 16 << 20):
                out = []
                for data in raw(part.column(1)):
                    media = store_text(data)
                    image = decode(media)
                    payload = image.reshape(-1).data
                    out.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(npy_tile(image, side)).hexdigest()))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)]).add("n_bytes", "long").add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string").add("tile_sha256", "string")
    names = schema.names
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
