"""Embedded font programs: TrueType tables, Type 1 with its encryption, CFF. Each gives texts and widths of codes and glyphs. Plain functions on bytes."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field


@dataclass
class Program:
    """What a font program says: names and widths (in thousandths) of glyphs, glyphs of codes and characters."""

    kind: str
    names: list[str | None] = field(default_factory=list)
    widths: dict[int | str, float] = field(default_factory=dict)
    codes: dict[int, int] = field(default_factory=dict)  # codes of the font's own encoding to glyphs
    characters: dict[int, int] = field(default_factory=dict)  # Unicode to glyphs
    encoding: dict[int, str] = field(default_factory=dict)  # codes to glyph names
    cids: dict[int, int] = field(default_factory=dict)  # character ids to glyphs
    box: tuple[float, float, float, float] | None = None
    ascent: float | None = None
    descent: float | None = None

    def texts(self) -> dict[int, str]:
        """Characters of glyphs; of several the least."""
        out: dict[int, str] = {}
        for c, g in sorted(self.characters.items()):
            out.setdefault(g, chr(c))
        return out


def sfnt(data: bytes) -> Program:
    """A TrueType or OpenType font: head, maxp, hhea, hmtx, OS/2, post and cmap (formats 0, 4, 6, 12)."""
    start = struct.unpack_from(">I", data, 12)[0] if data[:4] == b"ttcf" else 0
    n = struct.unpack_from(">H", data, start + 4)[0]
    tables = {}
    for i in range(n):
        tag, _, at, size = struct.unpack_from(">4sIII", data, start + 12 + 16 * i)
        tables[tag.decode("latin-1")] = data[at : at + size]
    if "head" not in tables or len(tables["head"]) < 54:
        raise ValueError("no head table")
    per_em = struct.unpack_from(">H", tables["head"], 18)[0] or 1000
    unit = 1000.0 / per_em
    out = Program("sfnt", box=tuple(v * unit for v in struct.unpack_from(">hhhh", tables["head"], 36)))
    glyphs = struct.unpack_from(">H", tables["maxp"], 4)[0] if len(tables.get("maxp", b"")) >= 6 else 0
    hhea, hmtx = tables.get("hhea", b""), tables.get("hmtx", b"")
    if len(hhea) >= 36:
        up, down = struct.unpack_from(">hh", hhea, 4)
        out.ascent, out.descent = up * unit, down * unit
        long = min(struct.unpack_from(">H", hhea, 34)[0], len(hmtx) // 4)
        last = 0.0
        for g in range(max(glyphs, long)):
            if g < long:
                last = struct.unpack_from(">H", hmtx, 4 * g)[0] * unit
            out.widths[g] = last
    os2 = tables.get("OS/2", b"")
    if len(os2) >= 72 and out.ascent in (None, 0.0):
        up, down = struct.unpack_from(">hh", os2, 68)
        out.ascent, out.descent = up * unit, down * unit
    post = tables.get("post", b"")
    if len(post) >= 34 and post[:4] == b"\0\2\0\0":
        count = struct.unpack_from(">H", post, 32)[0]
        index = struct.unpack_from(f">{count}H", post, 34) if len(post) >= 34 + 2 * count else ()
        own, at = [], 34 + 2 * count
        while at < len(post):
            own.append(post[at + 1 : at + 1 + post[at]].decode("latin-1"))
            at += 1 + post[at]
        # The first 258 names are the standard ones of the format; only a font's own are kept here.
        out.names = [own[i - 258] if 258 <= i < 258 + len(own) else None for i in index]
    cmap = tables.get("cmap", b"")
    for i in range(struct.unpack_from(">H", cmap, 2)[0] if len(cmap) >= 4 else 0):
        platform, encoding, at = struct.unpack_from(">HHI", cmap, 4 + 8 * i)
        try:
            own = _cmap(cmap, at)
        except struct.error:
            continue
        if platform == 0 or platform == 3 and encoding in (1, 10):
            out.characters |= own
        elif platform == 3 and encoding == 0:
            out.codes = {c & 0xFF if 0xF000 <= c <= 0xF0FF else c: g for c, g in own.items()} | out.codes
        elif platform == 1:
            out.codes = out.codes | own
    return out


def _cmap(data: bytes, at: int) -> dict[int, int]:
    kind = struct.unpack_from(">H", data, at)[0]
    if kind == 0:
        return {c: g for c, g in enumerate(data[at + 6 : at + 262]) if g}
    if kind == 6:
        first, n = struct.unpack_from(">HH", data, at + 6)
        return {first + i: g for i, g in enumerate(struct.unpack_from(f">{n}H", data, at + 10)) if g}
    if kind == 12:
        out = {}
        for i in range(struct.unpack_from(">I", data, at + 12)[0]):
            lo, hi, g = struct.unpack_from(">III", data, at + 16 + 12 * i)
            out |= {c: g + c - lo for c in range(lo, min(hi, 0x10FFFF) + 1)}
        return out
    if kind != 4:
        return {}
    n = struct.unpack_from(">H", data, at + 6)[0] // 2
    ends, starts = struct.unpack_from(f">{n}H", data, at + 14), struct.unpack_from(f">{n}H", data, at + 16 + 2 * n)
    deltas, offsets = struct.unpack_from(f">{n}H", data, at + 16 + 4 * n), struct.unpack_from(f">{n}H", data, at + 16 + 6 * n)
    out = {}
    for i in range(n):
        for c in range(starts[i], ends[i] + 1):
            if c == 0xFFFF:
                continue
            if offsets[i] == 0:
                g = (c + deltas[i]) & 0xFFFF
            else:
                place = at + 16 + 6 * n + 2 * i + offsets[i] + 2 * (c - starts[i])
                g = struct.unpack_from(">H", data, place)[0] if place + 2 <= len(data) else 0
                g = (g + deltas[i]) & 0xFFFF if g else 0
            if g:
                out[c] = g
    return out


def eexec(data: bytes, key: int = 55665, discard: int = 4) -> bytes:
    """Type 1 decryption: of the private part with 55665, of charstrings with 4330."""
    out = bytearray()
    for c in data:
        out.append(c ^ key >> 8)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out[discard:])


def eexec_encrypted(data: bytes, key: int = 55665, lead: bytes = b"\0\0\0\0") -> bytes:
    """The inverse of eexec(), for fixtures."""
    out = bytearray()
    for p in lead + data:
        c = p ^ key >> 8
        out.append(c)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out)


def _numbers(code: bytes, stop: tuple[int, ...]) -> tuple[list[float], int | None]:
    """The operands of a Type 1 charstring before the first operator in stop."""
    stack: list[float] = []
    i = 0
    while i < len(code):
        b = code[i]
        i += 1
        if b >= 32:
            if b <= 246:
                stack.append(b - 139)
            elif b <= 250:
                stack.append((b - 247) * 256 + code[i] + 108 if i < len(code) else 0)
                i += 1
            elif b <= 254:
                stack.append(-(b - 251) * 256 - code[i] - 108 if i < len(code) else 0)
                i += 1
            else:
                stack.append(int.from_bytes(code[i : i + 4], "big", signed=True))
                i += 4
        elif b == 12 and i < len(code):
            if code[i] == 12 and len(stack) >= 2 and stack[-1]:
                stack[-2:] = [stack[-2] / stack[-1]]
                i += 1
            elif 100 + code[i] in stop:
                return stack, 100 + code[i]
            else:
                return stack, None
        elif b in stop:
            return stack, b
        else:
            return stack, None
    return stack, None


def type1(data: bytes) -> Program:
    """A Type 1 font, bare or in PFB segments: its encoding and the widths in its charstrings."""
    if data[:1] == b"\x80":
        parts, at = [], 0
        while at + 6 <= len(data) and data[at] == 0x80 and data[at + 1] in (1, 2):
            n = int.from_bytes(data[at + 2 : at + 6], "little")
            parts.append(data[at + 6 : at + 6 + n])
            at += 6 + n
        data = b"".join(parts)
    cut = data.find(b"eexec")
    head, body = (data[:cut], data[cut + 5 :].lstrip(b" \t\r\n")) if cut >= 0 else (data, b"")
    if re.match(rb"[0-9A-Fa-f\s]{8}", body):
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", body)
        body = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
    private = eexec(body)
    out = Program("type1")
    m = re.search(rb"/FontMatrix\s*\[\s*([-+.\deE]+)", head)
    unit = float(m[1]) * 1000 if m else 1.0
    out.encoding = {int(c): n.decode("latin-1") for c, n in re.findall(rb"dup\s+(\d+)\s*/([^\s/]+)\s+put", head)}
    if m := re.search(rb"/FontBBox\s*[\[{]\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", head):
        out.box = tuple(float(x) * unit for x in m.groups())
    m = re.search(rb"/lenIV\s+(-?\d+)", private)
    skip = int(m[1]) if m else 4
    at = private.find(b"/CharStrings")
    for m in re.finditer(rb"/([^\s/]+)\s+(\d+)\s+(?:RD|-\||\S+)\s", private[at + 12 :] if at >= 0 else b""):
        start = at + 12 + m.end()
        code = private[start : start + int(m[2])]
        stack, op = _numbers(code if skip < 0 else eexec(code, 4330, skip), (13, 107))
        if op is not None and len(stack) >= (2 if op == 13 else 4):
            out.names.append(m[1].decode("latin-1"))
            out.widths[out.names[-1]] = stack[1 if op == 13 else 2] * unit
    return out


def _index(data: bytes, at: int) -> tuple[list[bytes], int]:
    n = struct.unpack_from(">H", data, at)[0]
    if not n:
        return [], at + 2
    size = data[at + 2]
    offsets = [int.from_bytes(data[at + 3 + i * size : at + 3 + (i + 1) * size], "big") for i in range(n + 1)]
    base = at + 2 + (n + 1) * size
    return [data[base + a : base + b] for a, b in zip(offsets, offsets[1:], strict=False)], base + offsets[-1]


def _dict(data: bytes) -> dict[int, list[float]]:
    """A CFF dictionary: operators (12 x as 1200 + x) with their operands."""
    out, stack, i = {}, [], 0
    while i < len(data):
        b = data[i]
        i += 1
        if b <= 21:
            if b == 12 and i < len(data):
                b = 1200 + data[i]
                i += 1
            out[b], stack = stack, []
        elif b == 28:
            stack.append(int.from_bytes(data[i : i + 2], "big", signed=True))
            i += 2
        elif b == 29:
            stack.append(int.from_bytes(data[i : i + 4], "big", signed=True))
            i += 4
        elif b == 30:
            s = ""
            while i < len(data):
                pair = data[i]
                i += 1
                for d in (pair >> 4, pair & 15):
                    s += "0123456789.EE -f"[d] if d not in (12, 15) else "E-" if d == 12 else "f"
                if "f" in s:
                    break
            try:
                stack.append(float(s.split("f")[0].replace(" ", "")))
            except ValueError:
                stack.append(0.0)
        elif b <= 246:
            stack.append(b - 139)
        elif b <= 254 and i < len(data):
            stack.append((b - 247) * 256 + data[i] + 108 if b <= 250 else -(b - 251) * 256 - data[i] - 108)
            i += 1
    return out


def _first_width(code: bytes) -> float | None:
    """The width operand that a Type 2 charstring begins with, if it has one."""
    stack, i = [], 0
    even = {1: 0, 3: 0, 18: 0, 23: 0, 19: 0, 20: 0}
    while i < len(code):
        b = code[i]
        i += 1
        if b >= 32 or b == 28:
            if b == 28:
                stack.append(int.from_bytes(code[i : i + 2], "big", signed=True))
                i += 2
            elif b <= 246:
                stack.append(b - 139)
            elif b <= 254:
                stack.append((b - 247) * 256 + code[i] + 108 if b <= 250 else -(b - 251) * 256 - code[i] - 108) if i < len(code) else None
                i += 1
            else:
                stack.append(int.from_bytes(code[i : i + 4], "big", signed=True) / 65536)
                i += 4
            continue
        if b in even:
            return stack[0] if len(stack) % 2 else None
        if b == 21:
            return stack[0] if len(stack) > 2 else None
        if b in (4, 22):
            return stack[0] if len(stack) > 1 else None
        if b == 14:
            return stack[0] if len(stack) in (1, 5) else None
        return None
    return None


def cff(data: bytes) -> Program:
    """A CFF font: names of its glyphs (own names only; standard ones by number), widths, encoding and character ids."""
    at = data[2]
    _, at = _index(data, at)
    tops, at = _index(data, at)
    strings, at = _index(data, at)
    top = _dict(tops[0]) if tops else {}
    if 17 not in top:
        raise ValueError("no charstrings")
    codes, _ = _index(data, int(top[17][0]))
    unit = top.get(1207, [0.001])[0] * 1000 or 1.0
    out = Program("cff", box=tuple(v * unit for v in top[5]) if len(top.get(5, [])) == 4 else None)
    sids, place = [0], int(top.get(15, [0])[0])
    if place > 2:
        kind, place = data[place], place + 1
        while len(sids) < len(codes) and place + 2 <= len(data):
            sid = struct.unpack_from(">H", data, place)[0]
            place += 2
            more = 0
            if kind:
                more = data[place] if kind == 1 else struct.unpack_from(">H", data, place)[0]
                place += kind
            sids += range(sid, sid + more + 1)
    else:
        sids = list(range(len(codes)))
    if 1230 in top:
        out.cids = {c: g for g, c in enumerate(sids[: len(codes)])}
    else:
        name = lambda sid: strings[sid - 391].decode("latin-1") if 391 <= sid < 391 + len(strings) else standard_string(sid)
        out.names = [name(s) for s in sids[: len(codes)]]
    place = int(top.get(16, [0])[0])
    if place > 1 and 1230 not in top:
        kind, n, g = data[place] & 127, data[place + 1], 1
        for i in range(n):
            first, more = (data[place + 2 + i], 0) if kind == 0 else (data[place + 2 + 2 * i], data[place + 3 + 2 * i])
            for c in range(first, first + more + 1):
                out.codes[c] = g
                g += 1
    size, place = (int(v) for v in top.get(18, [0, 0])[:2])
    private = _dict(data[place : place + size])
    default, nominal = private.get(20, [0])[0], private.get(21, [0])[0]
    for g, code in enumerate(codes):
        w = _first_width(code)
        out.widths[g] = (default if w is None else nominal + w) * unit
    return out


def standard_string(sid: int) -> str | None:
    """The name of a standard string that stands for a character of ASCII (numbers 1 to 95); None for others."""
    return f"uni{31 + sid:04X}" if 1 <= sid <= 95 and sid not in (8, 65) else {8: "quoteright", 65: "quoteleft"}.get(sid)


def parse(data: bytes) -> Program:
    """A font program by its first bytes."""
    if data[:4] in (b"\0\1\0\0", b"true", b"ttcf"):
        return sfnt(data)
    if data[:4] == b"OTTO":
        out = sfnt(data)
        n = struct.unpack_from(">H", data, 4)[0]
        for i in range(n):
            tag, _, at, size = struct.unpack_from(">4sIII", data, 12 + 16 * i)
            if tag == b"CFF ":
                own = cff(data[at : at + size])
                out.names, out.cids = own.names, own.cids
        return out
    if data[:1] == b"\x80" or data[:2] == b"%!":
        return type1(data)
    if data[:1] == b"\1":
        return cff(data)
    raise ValueError("no font program")
