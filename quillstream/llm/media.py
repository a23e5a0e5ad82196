"""Media columns: Netpbm and BMP images to numpy arrays, area resizing, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.runtime import ship

WIDTH = 64
UNIT = WIDTH * 3  # bytes of a row of RGB samples
HASH_W, HASH_H, TILE = 9, 8, 16
LUMA = np.array([299, 587, 114], np.float64) / 1000


def encode_ppm(img: np.ndarray) -> bytes:
    """(h, w, 3) or (h, w) of uint8 to binary PPM or PGM."""
    kind = b"P6" if img.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, img.shape[1], img.shape[0]) + np.ascontiguousarray(img).tobytes()


def encode_bmp(img: np.ndarray) -> bytes:
    """(h, w, 3) of uint8 to an uncompressed 24-bit bottom-up BMP."""
    h, w, _ = img.shape
    row = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    row[:, : 3 * w] = img[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHI", 54 + row.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, row.size, 2835, 2835, 0, 0) + row.tobytes()


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Decimal fields after the magic number, with # comments; where the one white space after the last ends."""
    out, at = [], 2
    while len(out) < fields:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: uint8 samples, (h, w) or (h, w, 3); maxima other than 255 are scaled, 16-bit ones reduced to 8."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bits = kind in (b"P1", b"P4")
    (w, h, *top), at = _header(data, 2 if bits else 3)
    top = top[0] if top else 1
    deep = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * deep
    if kind == b"P1":
        a = np.frombuffer(b"".join(data[at - 1 :].split()), np.uint8)[:n] - 48
    elif kind in (b"P2", b"P3"):
        a = np.array(data[at - 1 :].split()[:n], np.int64)
    elif kind == b"P4":
        a = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w].ravel()
    else:
        a = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at)
    if a.size < n:
        raise ValueError("the image is cut short")
    if bits:
        a = np.where(a == 1, 0, 255)
    elif top != 255:
        a = (a.astype(np.int64) * 255 + top // 2) // top
    return a.astype(np.uint8, copy=False).reshape((h, w, 3) if deep == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits to (h, w, 3) of uint8; bottom-up or top-down."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head = struct.unpack_from("<II", data, 10)
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("this kind of BMP is not supported")
    rows = abs(h)
    stride = (w * bits // 8 + 3) // 4 * 4
    a = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : w * bits // 8]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        a = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[a][:, :, :3]
    else:
        a = a.reshape(rows, w, bits // 8)[:, :, :3]
    return np.ascontiguousarray((a if h < 0 else a[::-1])[:, :, ::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _cells(n: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the edges of `to` equal cells fall on n samples: whole part and fraction."""
    edges = np.arange(to + 1, dtype=np.float64) * n / to
    whole = np.minimum(np.floor(edges).astype(np.int64), n)
    return whole, edges - whole


def area_resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over cells of equal area, from an integral image read at fractional corners; float64."""
    a = img.astype(np.float64).reshape(img.shape[0], img.shape[1], -1)
    for axis, to in ((0, h), (1, w)):
        n = a.shape[axis]
        whole, part = _cells(n, to)
        total = np.concatenate([np.zeros_like(a.take([0], axis)), np.cumsum(a, axis)], axis)
        shape = [1, 1, 1]
        shape[axis] = to + 1
        at = total.take(whole, axis) + (total.take(np.minimum(whole + 1, n), axis) - total.take(whole, axis)) * part.reshape(shape)
        a = np.diff(at, axis=axis) * (to / n)
    return a.reshape((h, w) + img.shape[2:])


def grey(img: np.ndarray) -> np.ndarray:
    return img if img.ndim == 2 else img @ LUMA


def difference_hash(img: np.ndarray) -> int:
    """64 bits: whether each of 9 x 8 cells is darker than its right neighbour."""
    small = grey(area_resize(img, HASH_H, HASH_W))
    bits = small[:, 1:] > small[:, :-1] + 1e-9
    return int(np.packbits(bits.ravel()).view(">u8")[0])


def npy_tile(img: np.ndarray, size: int = TILE) -> bytes:
    """The image at size x size as an NPY file of uint8."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(img, size, size)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 of the text, filled with spaces to a positive multiple of UNIT; its length before that."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def store(payload: bytes) -> bytes:
    return encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


MEDIA = "doc_id long, n_bytes long, media binary, tile binary, feature string"


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t in b.column(1):
            n, payload = payload_of(t.as_py())
            media = store(payload)
            img = decode(media)
            out.append((n, media, npy_tile(img), f"{difference_hash(img):016x}"))
        cols = list(zip(*out)) or [()] * 4
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_bytes", "media", "tile", "feature"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for n, media, tile, feature in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4))):
            back = decode(media).tobytes()
            out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, hashlib.sha256(tile).hexdigest()))
        cols = list(zip(*out)) or [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"])


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a PPM file 64 pixels wide: one row per row of docs, columns of MEDIA.

    tile is the NPY tile and feature the difference hash of the image read back. Null texts count as empty; a text of any
    length is one image. Repeated rows come out repeated, an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_media, MEDIA)


def media_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of text_media, the files read back: one row per row of docs, columns of SCHEMA."""
    return text_media(docs, id_col=id_col, text_col=text_col).mapInArrow(_digests, SCHEMA)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for m in b.column(1):
            try:
                img = decode(m.as_py() or b"")
                out.append((img.shape[1], img.shape[0], npy_tile(img), f"{difference_hash(img):016x}"))
            except (ValueError, struct.error, IndexError):
                out.append((None, None, None, None))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int32(), pa.binary(), pa.string()])]], ["id", "width", "height", "tile", "dhash"])


def image_tiles(images: DataFrame, id_col: str = "id", data_col: str = "content") -> DataFrame:
    """Netpbm or BMP files in a binary column to (id, width, height, tile, dhash); nulls where one can't be decoded."""
    ship(images.sparkSession)
    return images.select(F.col(id_col).cast("string").alias("id"), F.col(data_col).alias("data")).mapInArrow(_tiles, "id string, width int, height int, tile binary, dhash string")
