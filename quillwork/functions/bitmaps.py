"""Bitmaps of PDF files: bits, fax rows, JBIG2 segments, JPEG 2000 headers, samples of colour spaces, masks. Plain functions on bytes."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from typing import Any

import numpy as np

from quillwork.functions.images import encode_png


class Bits:
    """A cursor over bits, from the most or the least significant one of each byte."""

    def __init__(self, data: bytes, msb_first: bool = True) -> None:
        self.data, self.at, self.msb = data, 0, msb_first

    @property
    def left(self) -> int:
        return 8 * len(self.data) - self.at

    def read(self, n: int = 1) -> int:
        v = self.peek(n)
        self.at += n
        return v

    def peek(self, n: int) -> int:
        """The next n bits as a number; bits beyond the end are zero."""
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        raw = self.data[first:last].ljust(last - first, b"\0")
        shift = self.at & 7
        if self.msb:
            return int.from_bytes(raw, "big") >> (8 * len(raw) - shift - n) & (1 << n) - 1
        return int.from_bytes(raw, "little") >> shift & (1 << n) - 1

    def skip(self, n: int) -> None:
        self.at += n

    def align(self) -> None:
        self.at = (self.at + 7) & ~7


# Fixed values (ITU-T T.4): code words of runs of 0 to 63, of 64 to 1728 in steps of 64, and of 1792 to 2560 of either colour.
WHITE = "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
WHITE_LONG = "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
BLACK = "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
BLACK_LONG = "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
LONGEST = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
# Fixed values (ITU-T T.6): two-dimensional modes, shifts of a vertical one as numbers.
MODES = {"1": 0, "011": 1, "010": -1, "001": "horizontal", "0001": "pass", "000011": 2, "000010": -2, "0000011": 3, "0000010": -3, "000000000001": "end"}


def _codes(short: str, long: str) -> dict[str, int]:
    return {c: i for i, c in enumerate(short.split())} | {c: 64 * (i + 1) for i, c in enumerate(long.split())} | {c: 1792 + 64 * i for i, c in enumerate(LONGEST.split())}


RUNS = [{(len(c), int(c, 2)): v for c, v in t.items()} for t in (_codes(WHITE, WHITE_LONG), _codes(BLACK, BLACK_LONG), MODES)]


def code(bits: Bits, table: dict) -> Any:
    """The value of the next code word; None if there is none in 13 bits."""
    for n in range(1, 14):
        v = table.get((n, bits.peek(n)))
        if v is not None:
            bits.skip(n)
            return v
    return None


def run(bits: Bits, black: int) -> int | None:
    total = 0
    while True:
        n = code(bits, RUNS[black])
        if n is None:
            return None
        total += n
        if n < 64:
            return total


def row_1d(bits: Bits, columns: int) -> list[int] | None:
    """The places at which a row changes colour, the first change being to black."""
    out, at, black = [], 0, 0
    while at < columns:
        n = run(bits, black)
        if n is None:
            return None
        at = min(columns, at + n)
        out.append(at)
        black ^= 1
    return out


def row_2d(bits: Bits, above: list[int], columns: int) -> list[int] | str | None:
    """A row's changes from those of the row above; "end" at the end of the block."""
    out: list[int] = []
    at, black = -1, 0

    def next_above() -> int:
        """The place in `above` of the first change right of `at` to the other colour."""
        i = black
        while i < len(above) and above[i] <= at:
            i += 2
        return i

    while at < columns:
        mode = code(bits, RUNS[2])
        if mode is None or mode == "end":
            return mode
        i = next_above()
        b1 = above[i] if i < len(above) else columns
        if mode == "pass":
            at = above[i + 1] if i + 1 < len(above) else columns
        elif mode == "horizontal":
            one, two = run(bits, black), run(bits, black ^ 1)
            if one is None or two is None:
                return None
            out += [min(columns, max(at, 0) + one), min(columns, max(at, 0) + one + two)]
            at = out[-1]
        else:
            at = min(columns, max(0, b1 + mode))
            out.append(at)
            black ^= 1
        if at >= columns:
            break
    return out


def packed(changes: list[int], columns: int, black_is_1: bool) -> bytes:
    """A row's bytes, most significant bit first."""
    row = np.zeros(columns, np.uint8)
    for i in range(0, len(changes), 2):
        row[changes[i] : changes[i + 1] if i + 1 < len(changes) else columns] = 1
    return np.packbits(row if black_is_1 else 1 - row).tobytes()


def fax(data: bytes, parms: dict | None = None) -> bytes:
    """Group 3 (K of 0 or more) and group 4 (K below 0) rows as packed bits; rows that are missing are white."""
    p = parms or {}
    number = lambda k, d: int(p.get(k) if p.get(k) is not None else d)
    k, columns, rows = number("K", 0), number("Columns", 1728) or 1728, number("Rows", 0)
    flag = lambda n: str(p.get(n, False)).lower() == "true"
    bits, out, above = Bits(data), [], []
    black = flag("BlackIs1")
    while bits.left > 0 and (not rows or len(out) < rows):
        if k >= 0:
            while bits.left >= 12 and bits.peek(11) == 0 and bits.peek(12) != 1:
                bits.skip(1)  # fill bits before an end of line
            ends = 0
            while bits.left >= 12 and bits.peek(12) == 1:
                bits.skip(12)
                ends += 1
                if k > 0:
                    flat = bits.read(1)
            if ends > 1:
                break
            if k > 0 and not ends:
                flat = bits.read(1) if out else 1
        if flag("EncodedByteAlign"):
            bits.align()
        if bits.left <= 0:
            break
        now = row_2d(bits, above, columns) if k < 0 or k > 0 and not flat else row_1d(bits, columns)
        if now is None or now == "end":
            break
        out.append(packed(now, columns, black))
        above = now
    blank = packed([], columns, black)
    return b"".join(out + [blank] * max(0, rows - len(out)))


def fax_encoded(rows: list[list[int]], columns: int) -> bytes:
    """Rows of changes as group 3 one-dimensional code words: the writer that tests and fixtures use."""
    tables = [{v: k for k, v in t.items()} for t in (_codes(WHITE, WHITE_LONG), _codes(BLACK, BLACK_LONG))]
    out = []
    for changes in rows:
        at, black = 0, 0
        for c in [*changes, columns] if not changes or changes[-1] < columns else changes:
            n = c - at
            while n >= 64:
                step = min(2560, n // 64 * 64)
                out.append(tables[black][step])
                n -= step
            out.append(tables[black][n])
            at, black = c, black ^ 1
    s = "".join(out)
    return int(s.ljust(-(-len(s) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(s) // 8), "big") if s else b""


def jbig2_segments(data: bytes) -> list[dict]:
    """Segments of an embedded stream or file: number, type, page and data."""
    at = 0
    if data[:8] == b"\x97JB2\r\n\x1a\n":
        at = 9 if data[8] & 2 else 13
    out = []
    while at + 11 <= len(data):
        number, flags, refs = struct.unpack_from(">IBB", data, at)
        at += 5
        n = refs >> 5
        if n == 7:
            n = struct.unpack_from(">I", data, at)[0] & 0x1FFFFFFF
            at += 4 + (n + 8) // 8
        else:
            at += 1
        at += n * (1 if number <= 256 else 2 if number <= 65536 else 4)
        wide = bool(flags & 0x40)
        if at + (8 if wide else 5) > len(data):
            break
        page = struct.unpack_from(">I", data, at)[0] if wide else data[at]
        at += 4 if wide else 1
        size = struct.unpack_from(">I", data, at)[0]
        at += 4
        body = data[at:] if size == 0xFFFFFFFF else data[at : at + size]
        out.append({"number": number, "type": flags & 63, "page": page, "data": body})
        at += len(body)
    return out


def jbig2(data: bytes, shared: bytes = b"") -> tuple[bytes, int, int, bool]:
    """(packed bits, width, height, whether anything was decoded) of a page: generic regions in fax code; other regions stay white."""
    width = height = 0
    page = np.zeros((0, 0), np.uint8)
    done = False
    for s in jbig2_segments(shared) + jbig2_segments(data):
        if s["type"] == 48 and len(s["data"]) >= 19:
            width, height = struct.unpack_from(">II", s["data"])
            height = 0 if height == 0xFFFFFFFF else height
            page = np.full((height, width), s["data"][16] >> 2 & 1, np.uint8)
        elif s["type"] in (36, 38, 39) and len(s["data"]) >= 18:
            w, h, x, y = struct.unpack_from(">IIII", s["data"])
            how, flags = s["data"][16] & 7, s["data"][17]
            if not flags & 1:
                continue
            rows = np.unpackbits(np.frombuffer(fax(s["data"][18:], {"K": -1, "Columns": w, "Rows": h, "BlackIs1": True}), np.uint8).reshape(h, -1), axis=1)[:, :w]
            if not page.size:
                width, height, page = max(width, x + w), max(height, y + h), np.zeros((max(height, y + h), max(width, x + w)), np.uint8)
            part = page[y : y + h, x : x + w]
            rows = rows[: part.shape[0], : part.shape[1]]
            page[y : y + h, x : x + w] = (part | rows, part & rows, part ^ rows, 1 - (part ^ rows), rows)[min(how, 4)]
            done = True
    return np.packbits(1 - page, axis=1).tobytes(), width, height, done


def jpx_info(data: bytes) -> dict | None:
    """Width, height, components, bits and colour space from the SIZ marker of a codestream, bare or in boxes."""
    at = data.find(b"\xff\x4f\xff\x51")
    if at < 0 or len(data) < at + 42:
        return None
    x1, y1, x0, y0 = struct.unpack_from(">IIII", data, at + 8)
    n = struct.unpack_from(">H", data, at + 40)[0]
    bits = (data[at + 42] & 127) + 1 if len(data) > at + 42 else 8
    box = data.find(b"colr")
    space = {16: "DeviceRGB", 17: "DeviceGray", 18: "DeviceRGB", 12: "DeviceCMYK"}.get(struct.unpack_from(">I", data, box + 7)[0]) if box >= 0 and len(data) >= box + 11 and data[box + 4] == 1 else None
    return {"width": x1 - x0, "height": y1 - y0, "components": n, "bits": bits, "color_space": space or {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(n, "DeviceRGB"), "boxed": data[4:8] == b"jP  "}


def jp2(codestream: bytes) -> bytes:
    """A bare codestream in the boxes that make it a file; anything else as it is."""
    info = jpx_info(codestream)
    if info is None or info["boxed"]:
        return codestream
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    head = box(b"ihdr", struct.pack(">IIHBBBB", info["height"], info["width"], info["components"], info["bits"] - 1, 7, 0, 0))
    color = box(b"colr", struct.pack(">BBBI", 1, 0, 0, {"DeviceGray": 17, "DeviceCMYK": 12}.get(info["color_space"], 16)))
    return box(b"jP  ", b"\r\n\x87\n") + box(b"ftyp", b"jp2 \0\0\0\0jp2 ") + box(b"jp2h", head + color) + box(b"jp2c", codestream)


def placeholder(width: int, height: int, gray: int = 128) -> bytes:
    """Even pixels (RGBA) in the size of an image whose own pixels can't be decoded."""
    return bytes([gray, gray, gray, 255]) * (width * height)


# Components of the device and calibrated colour spaces.
COMPONENTS = {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "RGB": 3, "Lab": 3, "DeviceCMYK": 4, "CMYK": 4}


def color_space(get: Callable[[Any], Any], content: Callable[[Any], bytes], space: Any) -> dict:
    """{kind, n, ...} of a colour space by name or array: its components, and what an indexed, separated or profiled one rests on."""
    space = get(space)
    if isinstance(space, list) and space:
        kind = str(get(space[0]))
        if kind in ("Indexed", "I"):
            table = get(space[3])
            return {"kind": "Indexed", "n": 1, "base": color_space(get, content, space[1]), "high": int(get(space[2])), "table": table if isinstance(table, bytes) else content(space[3])}
        if kind == "ICCBased":
            entries = getattr(get(space[1]), "entries", {})
            n = int(get(entries.get("N")) or 3)
            return {"kind": {1: "DeviceGray", 4: "DeviceCMYK"}.get(n, "DeviceRGB"), "n": n}
        if kind in ("Separation", "DeviceN"):
            names = get(space[1])
            n = len(names) if kind == "DeviceN" else 1
            return {"kind": "Tint", "n": n, "names": [str(get(x)) for x in names] if kind == "DeviceN" else [str(names)]}
        if kind == "Pattern":
            return {"kind": "DeviceGray", "n": 1}
        return {"kind": kind, "n": COMPONENTS.get(kind, 3)}
    name = str(space or "DeviceGray")
    return {"kind": {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "CalGray": "DeviceGray", "CalRGB": "DeviceRGB"}.get(name, name), "n": COMPONENTS.get(name, 1)}


def samples(data: bytes, width: int, height: int, n: int, bits: int) -> np.ndarray:
    """Samples of 1, 2, 4, 8 or 16 bits as (height, width, n); what is missing is zero. Rows start at bytes."""
    stride = (width * n * bits + 7) // 8
    raw = np.frombuffer(data[: stride * height].ljust(stride * height, b"\0"), np.uint8).reshape(height, stride)
    if bits == 8:
        out = raw
    elif bits == 16:
        out = raw[:, : stride // 2 * 2].reshape(height, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    else:
        each = np.unpackbits(raw, axis=1).reshape(height, -1, bits)
        out = each @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
    return out[:, : width * n].reshape(height, width, n)


def to_rgb(values: np.ndarray, space: dict, bits: int, decode: list[float] | None = None) -> np.ndarray:
    """Samples to (height, width, 3) of bytes, through the Decode array if there is one."""
    top = float((1 << bits) - 1)
    if space["kind"] == "Indexed":
        base = space["base"]
        table = samples(space["table"], 1, space["high"] + 1, base["n"], 8)
        colors = to_rgb(table, base, 8)[:, 0]
        if decode:
            values = decode[0] + values * (decode[1] - decode[0]) / top
        return colors[np.clip(np.rint(values[..., 0]).astype(np.int64), 0, space["high"])]
    v = values / top
    if decode and len(decode) >= 2 * values.shape[2]:
        lo, hi = np.array(decode[::2])[: values.shape[2]], np.array(decode[1::2])[: values.shape[2]]
        v = lo + v * (hi - lo)
        if space["kind"] != "Lab":
            v = np.clip(v, 0, 1)
    if space["kind"] == "Lab":
        lab = v if decode else v * np.array([100.0, 200.0, 200.0]) - np.array([0.0, 100.0, 100.0])
        fy = (lab[..., 0] + 16) / 116
        f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], -1)
        xyz = np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29)) * np.array([0.9505, 1.0, 1.089])
        lin = np.clip(xyz @ np.array([[3.2406, -1.5372, -0.4986], [-0.9689, 1.8758, 0.0415], [0.0557, -0.2040, 1.0570]]).T, 0, 1)
        v = np.where(lin <= 0.0031308, 12.92 * lin, 1.055 * lin ** (1 / 2.4) - 0.055)
    elif space["kind"] == "DeviceCMYK":
        v = (1 - v[..., :3]) * (1 - v[..., 3:4])
    elif space["kind"] == "Tint":
        v = np.repeat(1 - np.clip(v.sum(-1, keepdims=True), 0, 1), 3, -1)
    elif v.shape[2] == 1:
        v = np.repeat(v, 3, -1)
    return np.rint(np.clip(v[..., :3], 0, 1) * 255).astype(np.uint8)


def nearest(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """A mask in another size, by the nearest pixels."""
    h, w = mask.shape
    return mask[np.arange(height) * h // height][:, np.arange(width) * w // width]


def key_mask(values: np.ndarray, ranges: list[int]) -> np.ndarray:
    """Alpha of a colour key: pixels whose samples all lie in their ranges are clear."""
    lo, hi = np.array(ranges[::2]), np.array(ranges[1::2])
    n = min(values.shape[2], len(lo), len(hi))
    return np.where(((values[..., :n] >= lo[:n]) & (values[..., :n] <= hi[:n])).all(-1), 0, 255).astype(np.uint8)


def as_png(rgb: np.ndarray, alpha: np.ndarray | None = None) -> bytes:
    """A PNG of pixels; an alpha that is opaque everywhere is left out."""
    if alpha is not None and not (alpha == 255).all():
        pixels = np.concatenate([rgb, alpha[..., None]], -1)
        return encode_png(rgb.shape[1], rgb.shape[0], pixels.tobytes(), 6)
    return encode_png(rgb.shape[1], rgb.shape[0], np.ascontiguousarray(rgb).tobytes(), 2)


def stencil(data: bytes, width: int, height: int, decode: list[float] | None, rgb: int) -> tuple[np.ndarray, np.ndarray]:
    """A stencil mask as pixels of one colour and their alpha: a bit of 0 paints, of 1 if Decode is turned round."""
    paints = samples(data, width, height, 1, 1)[..., 0] == (1 if decode and decode[0] == 1 else 0)
    color = np.array([rgb >> 16, rgb >> 8 & 255, rgb & 255], np.uint8)
    return np.broadcast_to(color, (height, width, 3)).copy(), np.where(paints, 255, 0).astype(np.uint8)


def image(file: Any, stream: Any, rgb: int = 0) -> dict:
    """{format, content, width, height, status} of an image stream: JPEG and JPEG 2000 as they are, else a PNG of its pixels.

    status says what could not be decoded; such images have even pixels.
    """
    get, e = file.get, stream.entries
    width, height = int(get(e.get("Width")) or get(e.get("W")) or 0), int(get(e.get("Height")) or get(e.get("H")) or 0)
    pick = lambda *names: next((get(e[n]) for n in names if n in e), None)
    filters = pick("Filter", "F")
    last = str(get(filters[-1]) if isinstance(filters, list) and filters else filters)
    data = file.content(stream)
    if last in ("DCTDecode", "DCT"):
        return {"format": "jpeg", "content": data, "width": width, "height": height, "status": "ok"}
    if last == "JPXDecode":
        info = jpx_info(data)
        return {"format": "jp2", "content": jp2(data), "width": info["width"] if info else width, "height": info["height"] if info else height, "status": "ok" if info else "no header"}
    if width <= 0 or height <= 0:
        return {"format": "raw", "content": data, "width": width, "height": height, "status": "no size"}
    parms = pick("DecodeParms", "DP")
    parms = get(parms[-1]) if isinstance(parms, list) and parms else parms
    parms = {k: get(v) for k, v in parms.items()} if isinstance(parms, dict) else {}
    status = "ok"
    if last in ("CCITTFaxDecode", "CCF"):
        data = fax(stream.raw if not isinstance(filters, list) or len(filters) == 1 else data, {"Columns": width, "Rows": height} | parms)
    elif last == "JBIG2Decode":
        shared = file.content(parms["JBIG2Globals"]) if parms.get("JBIG2Globals") is not None else b""
        bits_, w, h, done = jbig2(stream.raw if not isinstance(filters, list) or len(filters) == 1 else data, shared)
        status = "ok" if done else "no region that can be decoded"
        data = bits_ if w == width and h == height else bits_.ljust((width + 7) // 8 * height, b"\xff")
    decode = [float(get(x)) for x in pick("Decode", "D") or []] or None
    if bool(pick("ImageMask", "IM")):
        pixels, alpha = stencil(data, width, height, decode, rgb)
        return {"format": "png", "content": as_png(pixels, alpha), "width": width, "height": height, "status": status}
    bits = 1 if last in ("CCITTFaxDecode", "CCF", "JBIG2Decode") else int(pick("BitsPerComponent", "BPC") or 8)
    space = color_space(get, file.content, pick("ColorSpace", "CS"))
    if bits not in (1, 2, 4, 8, 16):
        return {"format": "raw", "content": data, "width": width, "height": height, "status": f"{bits} bits"}
    values = samples(data, width, height, space["n"], bits)
    pixels, alpha = to_rgb(values, space, bits, decode), None
    soft, mask = get(e.get("SMask")), get(e.get("Mask"))
    if hasattr(soft, "entries"):
        s = soft.entries
        sw, sh, sb = int(get(s.get("Width")) or 0), int(get(s.get("Height")) or 0), int(get(s.get("BitsPerComponent")) or 8)
        if sw > 0 and sh > 0 and str(get(s.get("Filter"))) not in ("DCTDecode", "JPXDecode"):
            own = samples(file.content(soft), sw, sh, 1, sb)[..., 0] / float((1 << sb) - 1)
            d = [float(get(x)) for x in get(s.get("Decode")) or [0, 1]]
            alpha = nearest(np.rint(np.clip(d[0] + own * (d[1] - d[0]), 0, 1) * 255).astype(np.uint8), height, width)
    elif hasattr(mask, "entries"):
        s = mask.entries
        mw, mh = int(get(s.get("Width")) or 0), int(get(s.get("Height")) or 0)
        if mw > 0 and mh > 0:
            d = [float(get(x)) for x in get(s.get("Decode")) or []] or None
            alpha = nearest(stencil(file.content(mask), mw, mh, d, 0)[1], height, width)
    elif isinstance(mask, list) and mask:
        alpha = key_mask(values, [int(get(x)) for x in mask])
    return {"format": "png", "content": as_png(pixels, alpha), "width": width, "height": height, "status": status}


def bezier(p0: tuple, p1: tuple, p2: tuple, p3: tuple, t: float) -> tuple[float, float]:
    """A point of a cubic curve."""
    a, b, c, d = (1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t * t, t**3
    return tuple(a * w + b * x + c * y + d * z for w, x, y, z in zip(p0, p1, p2, p3, strict=True))


def bezier_split(p0: tuple, p1: tuple, p2: tuple, p3: tuple, t: float) -> tuple[tuple, tuple]:
    """The two curves on either side of t."""
    mid = lambda a, b: tuple(x + (y - x) * t for x, y in zip(a, b, strict=True))
    q0, q1, q2 = mid(p0, p1), mid(p1, p2), mid(p2, p3)
    r0, r1 = mid(q0, q1), mid(q1, q2)
    s = mid(r0, r1)
    return (p0, q0, r0, s), (s, r1, q2, p3)


def bezier_box(p0: tuple, p1: tuple, p2: tuple, p3: tuple) -> tuple[float, float, float, float]:
    """The box of a curve itself, from its ends and the places where it turns."""
    out = []
    for w, x, y, z in zip(p0, p1, p2, p3, strict=True):
        a, b, c = -w + 3 * x - 3 * y + z, 2 * (w - 2 * x + y), x - w
        turns = [-c / b] if abs(a) < 1e-12 and abs(b) > 1e-12 else []
        if abs(a) >= 1e-12 and b * b - 4 * a * c >= 0:
            root = math.sqrt(b * b - 4 * a * c)
            turns = [(-b + root) / (2 * a), (-b - root) / (2 * a)]
        own = [w, z, *[(1 - t) ** 3 * w + 3 * (1 - t) ** 2 * t * x + 3 * (1 - t) * t * t * y + t**3 * z for t in turns if 0 < t < 1]]
        out.append((min(own), max(own)))
    return out[0][0], out[1][0], out[0][1], out[1][1]
