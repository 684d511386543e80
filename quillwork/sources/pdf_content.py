"""Page contents of PDF files: a page's operators evaluated to glyphs, vectors and images. Plain functions for use inside a worker."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field, replace
from itertools import accumulate
from typing import Any

from quillwork.sources import pdf_layout
from quillwork.sources.pdf_objects import File, Name, Scanner, Stream, Word

Matrix = tuple[float, float, float, float, float, float]
ONE: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
# Glyph names that aren't a letter's own name, for encodings by difference.
GLYPHS = {"space": " ", "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "hyphen": "-", "endash": "–", "emdash": "—", "bullet": "•", "quotesingle": "'", "quotedbl": '"', "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "parenleft": "(", "parenright": ")", "bracketleft": "[", "bracketright": "]", "braceleft": "{", "braceright": "}", "slash": "/", "backslash": "\\", "exclam": "!", "question": "?", "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "asterisk": "*", "plus": "+", "equal": "=", "less": "<", "greater": ">", "at": "@", "underscore": "_", "bar": "|", "asciitilde": "~", "asciicircum": "^", "grave": "`", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "fi": "fi", "fl": "fl", "germandbls": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedilla": "ç", "udieresis": "ü", "odieresis": "ö", "adieresis": "ä", "ntilde": "ñ", "Euro": "€", "ellipsis": "…"}
#: Colour spaces whose colours are told by the number of their components.
COUNTED = ("DeviceGray", "DeviceRGB", "DeviceCMYK")
CODECS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman", "StandardEncoding": "latin-1", "PDFDocEncoding": "latin-1"}


def times(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def at(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def glyph_text(name: str) -> str | None:
    """The text of a glyph's name: a known one, a single letter, uniXXXX, uXXXXX; variants after a dot count as the name."""
    name = name.split(".")[0]
    if name in GLYPHS or len(name) == 1:
        return GLYPHS.get(name, name)
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})+|u([0-9A-Fa-f]{4,6})", name):
        digits = name.removeprefix("uni") if name.startswith("uni") else m[2]
        return "".join(chr(int(digits[i : i + 4], 16)) for i in range(0, len(digits), 4)) if name.startswith("uni") else chr(int(digits, 16))
    return None


def to_unicode(data: bytes) -> dict[int, str]:
    """Codes to texts of a ToUnicode map."""
    s, out, stack = Scanner(data), {}, []
    text = lambda b: b.decode("utf-16-be", "replace")
    number = lambda b: int.from_bytes(b, "big")
    while (v := s.value()) is not None:
        if not isinstance(v, Word):
            stack.append(v)
            continue
        if v == "endbfchar":
            for a, b in zip(stack[::2], stack[1::2], strict=False):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    out[number(a)] = text(b)
        elif v == "endbfrange":
            for a, b, c in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                if not isinstance(a, bytes) or not isinstance(b, bytes):
                    continue
                for k in range(min(number(b) - number(a) + 1, 1 << 16)):
                    if isinstance(c, list):
                        if k < len(c) and isinstance(c[k], bytes):
                            out[number(a) + k] = text(c[k])
                    elif len(c) == 4:
                        out[number(a) + k] = chr(ord(text(c)) + k) if len(text(c)) == 1 else text(c)
                    else:
                        out[number(a) + k] = text((number(c) + k).to_bytes(len(c), "big"))
        stack = []
    return out


class Font:
    """Widths and texts of a font's codes, and its style by name and descriptor."""

    def __init__(self, file: File, d: dict) -> None:
        get = file.get
        self.wide = get(d.get("Subtype")) == "Type0"
        raw = str(get(d.get("BaseFont")) or "")
        clean = re.sub(r"^[A-Za-z0-9]{6}\+", "", raw)
        self.bold, self.italic = (bool(re.search(p, clean, re.I)) for p in ("Bold|Black|Heavy|Semibold", "Italic|Oblique|Slanted"))
        self.family = re.sub(r"(?i)[-,\s]+(Regular|Bold|Italic|Oblique|BoldItalic|BoldOblique|Book|Medium|MT|PS).*$", "", clean) or clean or "Calibri"
        own = get((get(d.get("DescendantFonts")) or [None])[0]) or {} if self.wide else d
        info = get(own.get("FontDescriptor")) or {}
        self.up, self.down = get(info.get("Ascent")) or 800.0, get(info.get("Descent")) or -200.0
        self.known: dict[int, tuple[str, float]] = {}
        self.map = to_unicode(file.content(d["ToUnicode"])) if "ToUnicode" in d else {}
        self.widths: dict[int, float] = {}
        if self.wide:
            self.default, w = get(own.get("DW", 1000)), list(get(own.get("W")) or [])
            while len(w) > 1:
                first, then = get(w.pop(0)), get(w.pop(0))
                if isinstance(then, list):
                    self.widths |= {first + i: get(x) for i, x in enumerate(then)}
                elif w:
                    self.widths |= dict.fromkeys(range(first, then + 1), get(w.pop(0)))
            self.text: dict[int, str] = {}
        else:
            self.default = get(info.get("MissingWidth")) or 500.0
            first = get(d.get("FirstChar")) or 0
            self.widths = {first + i: get(x) for i, x in enumerate(get(d.get("Widths")) or [])}
            e = get(d.get("Encoding"))
            base = get(e.get("BaseEncoding")) if isinstance(e, dict) else e
            codec = CODECS.get(str(base), "cp1252")
            self.text = {i: bytes([i]).decode(codec, "replace") for i in range(256)}
            code = 0
            for x in get(e.get("Differences")) or [] if isinstance(e, dict) else []:
                x = get(x)
                if isinstance(x, int):
                    code = x
                else:
                    self.text[code] = glyph_text(str(x)) or "�"
                    code += 1

        if not self.map:
            self.embedded(file, own, info, d)

    def embedded(self, file: File, own: dict, info: dict, d: dict) -> None:
        """Texts, and widths where the file gives none, from the font program; without a map to Unicode only it knows the glyphs."""
        from quillwork.functions import font_programs

        stream = next((info[k] for k in ("FontFile", "FontFile2", "FontFile3") if k in info), None)
        if stream is None:
            return
        try:
            program = font_programs.parse(file.content(stream))
        except (ValueError, IndexError, TypeError, struct.error):
            return
        texts = program.texts()
        named = {g: t for g, n in enumerate(program.names) if n and (t := glyph_text(n))}
        if self.wide:
            glyph = lambda code: program.cids.get(code, code)
            known = named | texts
            self.text = {c: known[glyph(c)] for c in (program.cids or known) if glyph(c) in known} | self.text
            if not self.widths and "W" not in own:
                self.widths = {c: w for c, w in program.widths.items() if isinstance(c, int)}
        elif "Encoding" not in d:
            by_name = {c: t for c, n in program.encoding.items() if (t := glyph_text(n))}
            by_glyph = {c: t for c, g in program.codes.items() if (t := texts.get(g) or named.get(g))}
            self.text |= by_glyph | by_name
        if not self.wide and not self.widths:
            self.widths = {c: program.widths[k] for c, k in (program.codes or program.encoding).items() if k in program.widths}

    def codes(self, raw: bytes) -> list[int]:
        if not self.wide:
            return list(raw)
        return list(struct.unpack(f">{len(raw) // 2}H", raw[: len(raw) & ~1])) + ([raw[-1]] if len(raw) & 1 else [])

    def char(self, code: int) -> str:
        return self.map.get(code) or self.text.get(code) or (chr(code) if code < 256 else "�")

    def width(self, code: int) -> float:
        return float(self.widths.get(code, self.default) or 0.0)


@dataclass
class State:
    ctm: Matrix = ONE
    fill: int = 0
    stroke: int = 0
    line_width: float = 1.0
    dash: tuple = ()
    alpha: tuple[float, float] = (1.0, 1.0)
    cap: int = 0
    join: int = 0
    miter: float = 10.0
    fill_space: Any = None
    stroke_space: Any = None
    clip: Any = None


@dataclass
class Text:
    font: Any = None
    size: float = 12.0
    spacing: float = 0.0
    words: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0
    matrix: Matrix = ONE
    line: Matrix = ONE


@dataclass
class Page:
    """What evaluation gathers: glyphs, vectors and images, in order, in bottom-up points. Where there are strips, glyphs are held there."""

    glyphs: list[dict] = field(default_factory=list)
    vectors: list[dict] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    strips: list[pdf_layout.Strip] | None = None


def rgb(values: list[float]) -> int:
    """A colour by its number of components: gray, RGB or CMYK."""
    v = [min(1.0, max(0.0, float(x))) for x in values]
    if len(v) == 1:
        v = v * 3
    elif len(v) >= 4:
        v = [(1 - c) * (1 - v[3]) for c in v[:3]]
    r, g, b = (round(255 * c) for c in v[:3])
    return r << 16 | g << 8 | b


class Evaluator:
    """Evaluates content streams; operators that it doesn't know, or whose operands don't fit, do nothing."""

    def __init__(self, file: File, resources: dict, page: Page, state: State | None = None, depth: int = 0) -> None:
        self.file, self.page, self.depth = file, page, depth
        self.resources = file.get(resources) or {}
        self.state, self.saved, self.text = state or State(), [], Text()
        self.path: list[tuple] = []
        self.fonts: dict[str, Font] = {}

    def named(self, kind: str, name: str) -> Any:
        return self.file.get((self.file.get(self.resources.get(kind)) or {}).get(name))

    def run(self, data: bytes) -> None:
        s, stack = Scanner(data), []
        while (v := s.value()) is not None:
            if not isinstance(v, Word):
                stack.append(v)
                continue
            if v == "BI":  # an inline image: to its end
                entries, key = {}, s.value()
                while key is not None and not isinstance(key, Word):
                    entries[str(key)] = s.value()
                    key = s.value()
                start = s.at + 1
                m = re.compile(rb"\s?EI(?=[\0\t\n\x0c\r ]|\Z)").search(data, start)
                s.at = m.end() if m else len(data)
                self.inline(entries, data[start : m.start() if m else len(data)])
            else:
                try:
                    self.apply(str(v), stack)
                except (TypeError, ValueError, IndexError, AttributeError, KeyError, ZeroDivisionError):
                    pass
            stack = []

    def apply(self, op: str, a: list) -> None:
        s, t = self.state, self.text
        match op:
            case "q":
                self.saved.append(replace(s))
            case "Q":
                if self.saved:
                    self.state = self.saved.pop()
            case "cm":
                s.ctm = times(tuple(map(float, a[:6])), s.ctm)
            case "w":
                s.line_width = float(a[0])
            case "J":
                s.cap = int(a[0])
            case "j":
                s.join = int(a[0])
            case "M":
                s.miter = float(a[0])
            case "d":
                s.dash = tuple(map(float, a[0]))
            case "cs" | "CS":
                space = self.space(a[0])
                if op == "cs":
                    s.fill_space, s.fill = space, 0
                else:
                    s.stroke_space, s.stroke = space, 0
            case "W" | "W*":
                s.clip = (self.box(), "evenodd" if op == "W*" else "nonzero")
            case "Tr":
                t.mode = int(a[0])
            case "gs":
                g = self.named("ExtGState", a[0]) or {}
                s.alpha = float(self.file.get(g.get("ca", s.alpha[0]))), float(self.file.get(g.get("CA", s.alpha[1])))
                s.line_width = float(self.file.get(g.get("LW", s.line_width)))
            case "g" | "rg" | "k":
                s.fill, s.fill_space = rgb([x for x in a if isinstance(x, (int, float))]), None
            case "G" | "RG" | "K":
                s.stroke, s.stroke_space = rgb([x for x in a if isinstance(x, (int, float))]), None
            case "sc" | "scn":
                s.fill = self.color(s.fill_space, a)
            case "SC" | "SCN":
                s.stroke = self.color(s.stroke_space, a)
            case "m" | "l":
                self.path.append((op.upper(), (float(a[0]), float(a[1]))))
            case "c":
                self.path.append(("C", *zip(map(float, a[::2]), map(float, a[1::2]), strict=True)))
            case "v":
                x = tuple(map(float, a))
                self.path.append(("C", self.path[-1][-1], x[:2], x[2:4]))
            case "y":
                x = tuple(map(float, a))
                self.path.append(("C", x[:2], x[2:4], x[2:4]))
            case "re":
                x, y, w, h = map(float, a[:4])
                self.path += [("M", (x, y)), ("L", (x + w, y)), ("L", (x + w, y + h)), ("L", (x, y + h)), ("Z",)]
            case "h":
                self.path.append(("Z",))
            case "S" | "s" | "f" | "F" | "f*" | "B" | "B*" | "b" | "b*":
                if op in ("s", "b", "b*"):
                    self.path.append(("Z",))
                self.paint(fill=op[0] in "fFBb", stroke=op[0] in "SsBb", rule="evenodd" if op.endswith("*") else "nonzero")
            case "n":
                self.path = []
            case "BT":
                t.matrix = t.line = ONE
            case "Tc":
                t.spacing = float(a[0])
            case "Tw":
                t.words = float(a[0])
            case "Tz":
                t.scale = float(a[0]) / 100.0
            case "TL":
                t.leading = float(a[0])
            case "Ts":
                t.rise = float(a[0])
            case "Tf":
                t.font, t.size = self.font(a[0]), float(a[1])
            case "Td":
                self.move(float(a[0]), float(a[1]))
            case "TD":
                t.leading = -float(a[1])
                self.move(float(a[0]), float(a[1]))
            case "Tm":
                t.matrix = t.line = tuple(map(float, a[:6]))
            case "T*":
                self.move(0.0, -t.leading)
            case "Tj":
                self.show(a[0])
            case "'":
                self.move(0.0, -t.leading)
                self.show(a[0])
            case '"':
                t.words, t.spacing = float(a[0]), float(a[1])
                self.move(0.0, -t.leading)
                self.show(a[2])
            case "TJ":
                for x in a[0]:
                    if isinstance(x, bytes):
                        self.show(x)
                    else:
                        t.matrix = times((1, 0, 0, 1, -float(x) / 1000.0 * t.size * t.scale, 0), t.matrix)
            case "Do":
                self.external(a[0])

    def space(self, name: Any) -> dict | None:
        """A colour space by its name, of the resources or of the format."""
        from quillwork.functions import bitmaps

        return bitmaps.color_space(self.file.get, self.file.content, self.named("ColorSpace", name) or name)

    def color(self, space: dict | None, a: list) -> int:
        """A colour's components in a space; without a space, by their number."""
        v = [float(x) for x in a if isinstance(x, (int, float))]
        if not v:
            return 0x808080  # a pattern
        if space is None or space["kind"] in COUNTED and len(v) == space["n"]:
            return rgb(v)
        from quillwork.functions import bitmaps

        import numpy as np

        if space["kind"] == "Indexed":
            made = bitmaps.to_rgb(np.array([[v[:1]]]), space, 8)
        else:
            made = bitmaps.to_rgb(np.array([[v]]), space, 8, [x for _ in v for x in (0.0, 255.0)]) if space["kind"] == "Lab" else bitmaps.to_rgb(np.array([[v]]) * 255.0, space, 8)
        r, g, b = (int(x) for x in made[0, 0])
        return r << 16 | g << 8 | b

    def box(self) -> tuple[float, float, float, float] | None:
        """The box of the path so far, in the page's points."""
        pts = [at(self.state.ctm, *p) for _, *ps in self.path for p in ps]
        return (min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts)) if pts else None

    def move(self, x: float, y: float) -> None:
        self.text.line = self.text.matrix = times((1, 0, 0, 1, x, y), self.text.line)

    def font(self, name: Name) -> Font:
        if name not in self.fonts:
            d = self.named("Font", name) or {}
            # One font for all pages of a file; the entry holds the dictionary, so that its identity stays its own.
            if id(d) not in self.file.fonts:
                self.file.fonts[id(d)] = d, Font(self.file, d)
            self.fonts[name] = self.file.fonts[id(d)][1]
        return self.fonts[name]

    def show(self, raw: bytes) -> None:
        t, s = self.text, self.state
        f = t.font or self.font(Name(""))
        if self.page.strips is not None:
            return self.strip(f, raw)
        for code in f.codes(raw):
            char, w = f.char(code), f.width(code) / 1000.0 * t.size
            m = times(t.matrix, s.ctm)
            corners = [at(m, x, y) for x in (0.0, w * t.scale) for y in (f.down / 1000.0 * t.size + t.rise, f.up / 1000.0 * t.size + t.rise)]
            x, y = at(m, 0.0, t.rise)
            xs, ys = [c[0] for c in corners], [c[1] for c in corners]
            self.page.glyphs.append({"seq": len(self.page.glyphs), "text": char, "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "origin_x": x, "origin_y": y, "font_name": f.family, "font_size": t.size, "color": s.fill, "is_bold": f.bold, "is_italic": f.italic})
            t.matrix = times((1, 0, 0, 1, (w + t.spacing + (t.words if char == " " or code == 32 and not f.wide else 0.0)) * t.scale, 0), t.matrix)

    def strip(self, f: Font, raw: bytes) -> None:
        """show() for lines: a text that is set straight is one strip, with the places that show() computes."""
        t, s, strips = self.text, self.state, self.page.strips
        (a, b, c, d, e, h), ctm = t.matrix, s.ctm
        first = strips[-1].seq + len(strips[-1].chars) if strips else 0
        if b or c or ctm[1] or ctm[2]:
            self.page.strips, glyphs, self.page.glyphs = None, self.page.glyphs, []
            self.show(raw)
            strips += [pdf_layout.Strip(first + i, [g["text"]], [g["x0"]], [g["x1"]], g["y0"], g["y1"], g["origin_y"], g["font_name"], g["font_size"], g["color"], g["is_bold"], g["is_italic"], False) for i, g in enumerate(self.page.glyphs)]
            self.page.strips, self.page.glyphs = strips, glyphs
            return
        known, size, scale, codes = f.known, t.size, t.scale, f.codes(raw)
        if not codes:
            return
        for code in set(codes) - known.keys():
            known[code] = f.char(code), f.width(code)
        chars, widths = map(list, zip(*map(known.__getitem__, codes), strict=True))
        m0, m3, m5 = a * ctm[0], d * ctm[3], h * ctm[3] + ctm[5]
        if min(widths) == max(widths) and not t.words:
            w = widths[0] / 1000.0 * size
            ws, steps = [w * scale] * len(codes), [(w + t.spacing + 0.0) * scale * a] * len(codes)
        else:
            own = [w / 1000.0 * size for w in widths]
            ws = [w * scale for w in own]
            steps = [(w + t.spacing + (t.words if char == " " or code == 32 and not f.wide else 0.0)) * scale * a for w, char, code in zip(own, chars, codes, strict=True)]
        at_ = list(accumulate(steps, initial=e))
        left = [x * ctm[0] + ctm[4] for x in at_[:-1]]
        right = [m0 * w + x for w, x in zip(ws, left, strict=True)]
        low, high = m3 * (f.down / 1000.0 * size + t.rise) + m5, m3 * (f.up / 1000.0 * size + t.rise) + m5
        forward = m0 > 0 and min(ws) >= 0
        x0, x1 = (left, right) if forward else ([*map(min, left, right)], [*map(max, left, right)])
        tight = forward and t.spacing == 0 and size >= 0.01 and abs(left[0]) < 1e6 and abs(right[-1]) < 1e6 and min(steps) >= 0
        strips.append(pdf_layout.Strip(first, chars, x0, x1, min(low, high), max(low, high), m3 * t.rise + m5, f.family, size, s.fill, f.bold, f.italic, tight))
        t.matrix = (a, b, c, d, at_[-1], h)

    def paint(self, fill: bool, stroke: bool, rule: str) -> None:
        s, parts, xs, ys = self.state, [], [], []
        for op, *pts in self.path:
            moved = [at(s.ctm, *p) for p in pts]
            xs += [p[0] for p in moved]
            ys += [p[1] for p in moved]
            parts.append(" ".join([op, *[f"{x:.2f} {y:.2f}" for x, y in moved]]))
        self.path = []
        if xs:
            self.page.vectors.append({"seq": len(self.page.vectors), "svg_path": " ".join(parts), "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "fill_rgb": s.fill if fill else None, "stroke_rgb": s.stroke if stroke else None, "stroke_width": s.line_width, "fill_rule": rule, "dash": list(s.dash), "fill_alpha": s.alpha[0], "stroke_alpha": s.alpha[1]})

    def picture(self, stream: Stream, name: str) -> None:
        """An image with its pixels decoded, in the box that the unit square becomes."""
        from quillwork.functions import bitmaps

        c = [at(self.state.ctm, i, j) for i in (0, 1) for j in (0, 1)]
        try:
            made = bitmaps.image(self.file, stream, self.state.fill)
        except (ValueError, TypeError, IndexError, KeyError) as e:
            made = {"format": "raw", "content": self.file.content(stream), "width": None, "height": None, "status": f"{type(e).__name__}: {e}"}
        self.page.images.append({"seq": len(self.page.images), "name": name, "x0": min(p[0] for p in c), "y0": min(p[1] for p in c), "x1": max(p[0] for p in c), "y1": max(p[1] for p in c), **{k: made[k] for k in ("width", "height", "format", "content", "status")}})

    def inline(self, entries: dict, raw: bytes) -> None:
        """An inline image; a colour space may be one of the resources."""
        space = entries.get("CS", entries.get("ColorSpace"))
        known = self.named("ColorSpace", space) if isinstance(space, Name) else None
        if known is not None:
            entries = entries | {"CS": known}
        names = {"F": "Filter", "DP": "DecodeParms"}
        self.picture(Stream({names.get(k, k): v for k, v in entries.items()}, raw, None), "inline")

    def external(self, name: Name) -> None:
        x = self.named("XObject", name)
        if not isinstance(x, Stream):
            return
        e, get = x.entries, self.file.get
        if get(e.get("Subtype")) == "Image":
            self.picture(x, str(name))
        elif get(e.get("Subtype")) == "Form" and self.depth < 12:
            m = tuple(float(get(v)) for v in get(e.get("Matrix")) or ONE)
            inner = Evaluator(self.file, e.get("Resources") or self.resources, self.page, State(ctm=times(m, self.state.ctm)), self.depth + 1)
            inner.run(self.file.content(x))


def evaluate(file: File, page: dict, origin: tuple[float, float] = (0.0, 0.0), strips: bool = False) -> Page:
    """A page's glyphs, vectors and images; origin is the corner of its box that becomes 0, 0. With strips, glyphs as those."""
    out = Page(strips=[] if strips else None)
    contents = file.get(page.get("Contents"))
    parts = contents if isinstance(contents, list) else [] if contents is None else [contents]
    Evaluator(file, page.get("Resources") or {}, out, State(ctm=(1.0, 0.0, 0.0, 1.0, -origin[0], -origin[1]))).run(b"\n".join(file.content(p) for p in parts))
    return out
