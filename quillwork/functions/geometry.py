"""Boxes, affine maps, colours and units as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), BOX, strict=True)])


def normalized(b: Column) -> Column:
    return box(F.least(b.x0, b.x1), F.least(b.y0, b.y1), F.greatest(b.x0, b.x1), F.greatest(b.y0, b.y1))


def flipped(b: Column, height: Column | float) -> Column:
    """Between bottom-up and top-down coordinates of a page."""
    h = F.lit(height) if isinstance(height, (int, float)) else height
    return box(b.x0, h - b.y1, b.x1, h - b.y0)


def intersects(a: Column, b: Column) -> Column:
    return (a.x0 <= b.x1) & (a.x1 >= b.x0) & (a.y0 <= b.y1) & (a.y1 >= b.y0)


def intersection(a: Column, b: Column) -> Column:
    """The common box, or null."""
    return F.when(intersects(a, b), box(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1)))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def expanded(b: Column, dx: Column, dy: Column) -> Column:
    return box(b.x0 - dx, b.y0 - dy, b.x1 + dx, b.y1 + dy)


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b.x0, b.x1) & y.between(b.y0, b.y1)


def contains_box(a: Column, b: Column) -> Column:
    return (a.x0 <= b.x0) & (a.y0 <= b.y0) & (a.x1 >= b.x1) & (a.y1 >= b.y1)


def distance_to(b: Column, x: Column, y: Column) -> Column:
    dx, dy = F.greatest(F.lit(0.0), b.x0 - x, x - b.x1), F.greatest(F.lit(0.0), b.y0 - y, y - b.y1)
    return F.sqrt(dx * dx + dy * dy)


def area(b: Column) -> Column:
    return (b.x1 - b.x0) * (b.y1 - b.y0)


def affine(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """The map (x, y) to (a x + c y + e, b x + d y + f)."""
    return F.struct(*[v.cast("double").alias(n) for v, n in zip((a, b, c, d, e, f), "abcdef", strict=True)])


def multiply(m: Column, n: Column) -> Column:
    """First m, then n."""
    return affine(m.a * n.a + m.b * n.c, m.a * n.b + m.b * n.d, m.c * n.a + m.d * n.c, m.c * n.b + m.d * n.d, m.e * n.a + m.f * n.c + n.e, m.e * n.b + m.f * n.d + n.f)


def determinant(m: Column) -> Column:
    return m.a * m.d - m.b * m.c


def inverse(m: Column) -> Column:
    """Null where there is none."""
    k = determinant(m)
    return F.when(k != 0, affine(m.d / k, -m.b / k, -m.c / k, m.a / k, (m.c * m.f - m.d * m.e) / k, (m.b * m.e - m.a * m.f) / k))


def transform(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m.a * x + m.c * y + m.e).alias("x"), (m.b * x + m.d * y + m.f).alias("y"))


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def gray(g: Column) -> Column:
    v = F.rint(unit(g) * 255.0).cast("int")
    return F.struct(v.alias("r"), v.alias("g"), v.alias("b"))


def cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    part = lambda v: F.rint(255.0 * (1.0 - unit(v)) * (1.0 - unit(k))).cast("int")
    return F.struct(part(c).alias("r"), part(m).alias("g"), part(y).alias("b"))


def to_cmyk(rgb: Column) -> Column:
    r, g, b = (rgb[n] / 255.0 for n in "rgb")
    k = 1.0 - F.greatest(r, g, b)
    part = lambda v: F.when(k >= 1.0, 0.0).otherwise(unit((1.0 - v - k) / (1.0 - k)))
    return F.struct(part(r).alias("c"), part(g).alias("m"), part(b).alias("y"), F.when(k >= 1.0, 1.0).otherwise(unit(k)).alias("k"))


def hex_color(rgb: Column) -> Column:
    return F.concat(*[F.lpad(F.hex(rgb[n]), 2, "0") for n in "rgb"])


def from_hex(text: Column) -> Column:
    """struct(r, g, b, a) of 3, 4, 6 or 8 hex digits, # or not; null for anything else."""
    h = F.regexp_replace(F.trim(text), "^#+", "")
    h = F.when(F.length(h).isin(3, 4), F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    part = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")
    alpha = F.when(F.length(h) == 8, part(3) / 255.0).otherwise(1.0)
    return F.when(h.rlike("^([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"), alias(alpha, "a")))


def alias(c: Column, name: str) -> Column:
    return c.alias(name)


def blend(top: Column, below: Column) -> Column:
    """Source over: struct(r, g, b, a) of two such."""
    a = top.a + below.a * (1.0 - top.a)
    part = lambda n: F.when(a <= 0.0, 0).otherwise(F.rint(255.0 * (top[n] / 255.0 * top.a + below[n] / 255.0 * below.a * (1.0 - top.a)) / a)).cast("int")
    return F.struct(part("r").alias("r"), part("g").alias("g"), part("b").alias("b"), F.greatest(a, F.lit(0.0)).alias("a"))


def points(pt: Column, per_point: int) -> Column:
    """A length in points as whole units, of which per_point make a point: 20 (dxa), 2 (half points), 12700 (EMU), 100."""
    return F.rint(pt * per_point).cast("long")


def image_format(content: Column) -> Column:
    """png, jpeg, jp2, webp, gif, bmp, tiff, svg or unknown, by the first bytes."""
    h = F.hex(F.substring(content, 1, 12))
    head = F.ltrim(F.decode(F.substring(content, 1, 500), "ISO-8859-1"))
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("0000000C6A50") | h.startswith("FF4FFF51"), "jp2")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp").when(h.startswith("474946383761") | h.startswith("474946383961"), "gif")
        .when(h.startswith("424D"), "bmp").when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff")
        .when(head.startswith("<svg") | (head.startswith("<?xml") & head.contains("<svg")), "svg").otherwise("unknown")
    )
