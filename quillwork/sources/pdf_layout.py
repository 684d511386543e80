"""Glyphs of one page to words and lines, inside the worker that has the page: nothing but lines leaves it."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

WORD = "struct<word:string,x0:double,y0:double,x1:double,y1:double,baseline:double,font:string,size:double,color:int,bold:boolean,italic:boolean>"
BARE = "struct<seq:int,text:string,x0:double,y0:double,x1:double,y1:double,baseline_y:double,font_size:double,is_bold:boolean,is_italic:boolean>"
LINE = f"struct<seq:int,text:string,x0:double,y0:double,x1:double,y1:double,baseline_y:double,font_size:double,is_bold:boolean,is_italic:boolean,ws:array<{WORD}>>"


def tenth(x: float) -> float:
    return math.floor(x * 10 + 0.5) / 10


def words(glyphs: list[dict], height: float) -> list[dict]:
    """Neighbours on a baseline (0.35 of the size), apart by -0.2 to 0.15 of the size, of one style. White space parts words. Places are top-down."""
    out: list[dict] = []
    last, blank = None, True
    for base, g in sorted(((height - g["origin_y"], g) for g in glyphs), key=lambda t: (tenth(t[0]), t[1]["x0"], t[1]["seq"])):
        if not g["text"].strip(" "):
            blank = True
            last = (base, g)
            continue
        size = g["font_size"]
        joins = not blank and last is not None
        if joins:
            gap, p = g["x0"] - last[1]["x1"], last[1]
            joins = abs(base - last[0]) <= 0.35 * size and -0.2 * size <= gap <= 0.15 * size and g["font_name"] == p["font_name"] and abs(size - p["font_size"]) <= 0.5 and g["is_bold"] == p["is_bold"]
        if joins:
            w = out[-1]
            w["parts"].append((g["x0"], g["seq"], g["text"]))
            w["x0"], w["x1"] = min(w["x0"], g["x0"]), max(w["x1"], g["x1"])
            w["y0"], w["y1"] = min(w["y0"], height - g["y1"]), max(w["y1"], height - g["y0"])
            w["bases"].append(base)
            w["italic"] = w["italic"] or g["is_italic"]
        else:
            out.append({"parts": [(g["x0"], g["seq"], g["text"])], "bases": [base], "x0": g["x0"], "y0": height - g["y1"], "x1": g["x1"], "y1": height - g["y0"], "font": g["font_name"], "size": size, "color": g["color"], "bold": g["is_bold"], "italic": g["is_italic"]})
        last, blank = (base, g), False
    for w in out:
        w["word"] = "".join(t for _, _, t in sorted(w.pop("parts")))
        bases = w.pop("bases")
        w["baseline"] = sum(bases) / len(bases)
    return out


@dataclass(slots=True)
class Strip:
    """Glyphs of one style on one line of a page, in the order in which they are shown; places are bottom-up. Tight: each begins where the one before ends."""

    seq: int
    chars: list[str]
    x0: list[float]
    x1: list[float]
    y0: float
    y1: float
    origin_y: float
    font: str
    size: float
    color: int
    bold: bool
    italic: bool
    tight: bool

    def glyphs(self) -> list[dict]:
        alike = {"y0": self.y0, "y1": self.y1, "origin_y": self.origin_y, "font_name": self.font, "font_size": self.size, "color": self.color, "is_bold": self.bold, "is_italic": self.italic}
        return [{"seq": self.seq + i, "text": c, "x0": a, "x1": b, **alike} for i, (c, a, b) in enumerate(zip(self.chars, self.x0, self.x1, strict=True))]


_SOLID = re.compile("[^ ]+")


def words_of(strips: list[Strip], height: float) -> list[dict]:
    """words() of the strips' glyphs: strip by strip where these are tight and follow each other, else glyph by glyph."""
    order = sorted(((tenth(height - s.origin_y), s.x0[0], s.seq, s) for s in strips), key=lambda t: t[:3])
    out: list[dict] = []
    before = None
    for row, x0, seq, s in order:
        text = "".join(s.chars)
        follows = before is None or before[0] != row or (before[1].x0[-1], before[1].seq) < (x0, seq)
        # The last word of a strip and the first of the next may be one: where style and place don't tell them apart, glyphs do.
        base, p = height - s.origin_y, before[1] if before else None
        apart = p is None or text[:1] == " " or p.chars[-1] == " " or abs(base - (height - p.origin_y)) > 0.35 * s.size or not -0.2 * s.size <= x0 - p.x1[-1] <= 0.15 * s.size or s.font != p.font or abs(s.size - p.size) > 0.5 or s.bold != p.bold
        if not (s.tight and len(text) == len(s.chars) and follows and apart):
            return words([g for t in strips for g in t.glyphs()], height)
        y0, y1 = height - s.y1, height - s.y0
        for m in _SOLID.finditer(text):
            i, j = m.span()
            out.append({"x0": s.x0[i], "y0": y0, "x1": s.x1[j - 1], "y1": y1, "font": s.font, "size": s.size, "color": s.color, "bold": s.bold, "italic": s.italic, "word": m[0], "baseline": sum([base] * (j - i)) / (j - i)})
        before = row, s
    return out


def lines(found: list[dict]) -> list[dict]:
    """Words on one baseline (0.4 of the size), parted where they stand more than max(24, 2.5 sizes) apart; numbered down the page."""
    rows: list[list[dict]] = []
    last = None
    for w in sorted(found, key=lambda w: (tenth(w["baseline"]), w["x0"])):
        if last is None or abs(w["baseline"] - last["baseline"]) > 0.4 * w["size"]:
            rows.append([])
        rows[-1].append(w)
        last = w
    out = []
    for row in rows:
        part: list[dict] = []
        for w in sorted(row, key=lambda w: w["x0"]):
            if part and w["x0"] - part[-1]["x1"] > max(24.0, 2.5 * max(w["size"], part[-1]["size"])):
                out.append(part)
                part = []
            part.append(w)
        out.append(part)
    made = []
    for part in out:
        n = sum(len(w["word"]) for w in part)
        made.append({"text": " ".join(w["word"] for w in part), "x0": min(w["x0"] for w in part), "y0": min(w["y0"] for w in part), "x1": max(w["x1"] for w in part), "y1": max(w["y1"] for w in part), "baseline_y": sum(w["baseline"] for w in part) / len(part), "font_size": sum(w["size"] * len(w["word"]) for w in part) / n, "is_bold": any(w["bold"] for w in part), "is_italic": any(w["italic"] for w in part), "ws": part})
    made.sort(key=lambda x: (tenth(x["y0"]), x["x0"]))
    for i, x in enumerate(made):
        x["seq"] = i
    return made


def gaps(lo: list[float], hi: list[float], least: float) -> list[float]:
    """The middles of the white gaps of at least `least` between intervals."""
    out, end = [], None
    for a, b in sorted(zip(lo, hi, strict=True)):
        if end is not None and a - end >= least:
            out.append((end + a) / 2)
        end = b if end is None else max(end, b)
    return out


def xy_cut(x0: list[float], y0: list[float], x1: list[float], y1: list[float], x_gap: float, y_gap: float, max_depth: int) -> list[str]:
    """For each box the path of its leaf: a page is cut at white gaps across, where there are none down, until no cut parts it."""
    out = [""] * len(x0)
    todo = [(list(range(len(x0))), "0", 0)]
    while todo:
        own, path, depth = todo.pop()
        parts: dict[int, list[int]] = {}
        if depth < max_depth:
            for lo, hi, least in ((y0, y1, y_gap), (x0, x1, x_gap)):
                cuts = gaps([lo[i] for i in own], [hi[i] for i in own], least)
                parts = {}
                for i in own:
                    m = (lo[i] + hi[i]) / 2
                    parts.setdefault(sum(m >= c for c in cuts), []).append(i)
                if len(parts) > 1:
                    break
        if len(parts) > 1:
            todo += [(p, f"{path}.{k:06d}", depth + 1) for k, p in parts.items()]
        else:
            for i in own:
                out[i] = path
    return out


def columns(x0: list[float], y0: list[float], x1: list[float], y1: list[float], x_gap: float = 15.0, y_gap: float = 10.0) -> list[int]:
    """For each box the number of its stretch of text in reading order: columns side by side are read one after the other, bands without columns go together."""
    out, n = [0] * len(x0), [0]

    def part(own: list[int], lo: list[float], hi: list[float], least: float) -> list[list[int]]:
        cuts = gaps([lo[i] for i in own], [hi[i] for i in own], least)
        found: dict[int, list[int]] = {}
        for i in own:
            found.setdefault(sum((lo[i] + hi[i]) / 2 >= c for c in cuts), []).append(i)
        return [found[k] for k in sorted(found)]

    def leaves(own: list[int], depth: int) -> list[tuple[bool, list[int]]]:
        """(whether it is a column, boxes) in order."""
        down = part(own, x0, x1, x_gap)
        if len(down) > 1 and all(len(p) >= 2 for p in down) and depth < 25:
            return [(True, [i for _, q in leaves(p, depth + 1) for i in q]) for p in down]
        bands = part(own, y0, y1, y_gap)
        if len(bands) == 1 or depth >= 25:
            return [(False, own)]
        return [x for b in bands for x in leaves(b, depth + 1)]

    before = False
    for first, (column, own) in enumerate(leaves(list(range(len(x0))), 0) if x0 else []):
        if first and (column or before):
            n[0] += 1
        before = column
        for i in own:
            out[i] = n[0]
    return out
