"""Raster images: PNG files written and read, and sizes from the headers of other formats. Plain functions and column functions."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions.codecs import png_rows

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode_png(width: int, height: int, data: bytes, color: int = 6, depth: int = 8, palette: bytes | None = None) -> bytes:
    """A PNG file of rows of samples; color is 0 gray, 2 RGB, 3 palette, 4 gray with alpha, 6 RGBA."""
    size = (width * CHANNELS[color] * depth + 7) // 8
    if len(data) != size * height or not width or not height:
        raise ValueError(f"{len(data)} bytes don't make {width} x {height}")
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + data[i : i + size] for i in range(0, len(data), size))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[int, int, int, int, bytes]:
    """(width, height, color, depth, samples) of a PNG file that isn't interlaced; checksums must hold."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        raise ValueError("no PNG file")
    at, head, packed = 8, None, []
    while at + 12 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind.decode('latin-1')}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if not head or head[6]:
        raise ValueError("no header, or interlaced")
    width, height, depth, color = head[:4]
    return width, height, color, depth, png_rows(zlib.decompress(b"".join(packed)), width, CHANNELS[color], depth)


def _boxes(data: bytes, at: int, end: int):
    """(kind, start, end) of the boxes of a JPEG 2000 file."""
    while at + 8 <= end:
        n, kind, head = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8], 8
        if n == 1:
            n, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        n = n or end - at
        if n < head:
            return
        yield kind, at + head, min(end, at + n)
        at += n


def image_info(data: bytes) -> dict | None:
    """format, width, height, channels and bit depth from an image's header; None where there is none."""
    out = lambda f, w, h, c=None, d=None: {"format": f, "width": w, "height": h, "channels": c, "depth": d}
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            w, h, d, c = struct.unpack_from(">IIBB", data, 16)
            return out("png", w, h, CHANNELS[c], d)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return out("gif", *struct.unpack_from("<HH", data, 6))
        if data.startswith(b"BM"):
            w, h, _, bits = struct.unpack_from("<iiHH", data, 18)
            return out("bmp", w, abs(h), max(1, bits // 8), min(8, bits))
        if data.startswith(b"\xff\xd8"):
            at = 2
            while data[at] == 0xFF:
                kind = data[at + 1]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    d, h, w, c = struct.unpack_from(">BHHB", data, at + 4)
                    return out("jpeg", w, h, c, d)
                at += 2 if kind in (1, *range(0xD0, 0xD8)) else 2 + struct.unpack_from(">H", data, at + 2)[0]
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                return out("webp", *[int.from_bytes(data[i : i + 3], "little") + 1 for i in (24, 27)])
            if kind == b"VP8L":
                bits = struct.unpack_from("<I", data, 21)[0]
                return out("webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
            w, h = struct.unpack_from("<HH", data, 26)
            return out("webp", w & 0x3FFF, h & 0x3FFF)
        at = 0
        if data[4:8] == b"jP  ":
            at = next((s for k, s, _ in _boxes(data, 0, len(data)) if k == b"jp2c"), -1)
            if at < 0:
                for k, s, e in _boxes(data, 0, len(data)):
                    if k == b"jp2h":
                        h, w, c, d = next(struct.unpack_from(">IIHB", data, x) for kk, x, _ in _boxes(data, s, e) if kk == b"ihdr")
                        return out("jp2", w, h, c, (d & 127) + 1)
        if data[at : at + 4] == b"\xff\x4f\xff\x51":
            x1, y1, x0, y0 = struct.unpack_from(">IIII", data, at + 8)
            return out("jp2", x1 - x0, y1 - y0, struct.unpack_from(">H", data, at + 40)[0], (data[at + 42] & 127) + 1)
    except (struct.error, IndexError, KeyError, StopIteration):
        pass
    return None


_INFO = T.StructType([T.StructField("format", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("width", "height", "channels", "depth")]])


@F.pandas_udf(_INFO)
def image_info_column(content: pd.Series) -> pd.DataFrame:
    rows = [(image_info(bytes(b)) if b is not None else None) or dict.fromkeys(_INFO.names) for b in content]
    return pd.DataFrame({n: pd.array([r[n] for r in rows], dtype="string" if n == "format" else "Int32") for n in _INFO.names})


@F.pandas_udf(T.BinaryType())
def gray_png_column(width: pd.Series, height: pd.Series, value: pd.Series) -> pd.Series:
    """An even gray image as a PNG file."""
    return pd.Series([encode_png(int(w), int(h), bytes([int(v)]) * (int(w) * int(h)), 0) for w, h, v in zip(width, height, value, strict=True)])
