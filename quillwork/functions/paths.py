"""SVG paths of absolute commands (M, L, C, Z and pairs of numbers, parted by spaces) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?\d+(?:\.\d+)?"


def tokens(path: Column) -> Column:
    """Commands and pairs of numbers, in order."""
    return F.regexp_extract_all(path, F.lit(rf"([A-Z]|{NUMBER} {NUMBER})"), 1)


def _x(pair: Column) -> Column:
    return F.split(pair, " ")[0].cast("double")


def _y(pair: Column) -> Column:
    return F.split(pair, " ")[1].cast("double")


def points(path: Column) -> Column:
    """array<struct<x, y>> of all pairs, control points included."""
    return F.transform(F.filter(tokens(path), lambda t: ~t.rlike("^[A-Z]$")), lambda t: F.struct(_x(t).alias("x"), _y(t).alias("y")))


def bounds(path: Column) -> Column:
    """struct<x0, y0, x1, y1> of all pairs; null for a path without any."""
    p = points(path)
    edge = lambda f, k: f(F.transform(p, lambda q: q[k]))
    return F.when(F.size(p) > 0, F.struct(edge(F.array_min, "x").alias("x0"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "x").alias("x1"), edge(F.array_max, "y").alias("y1")))


def flipped(path: Column, height: float) -> Column:
    """The path with y counted from the other edge, numbers with two decimals."""
    pair = lambda t: F.concat(F.format_string("%.2f", _x(t)), F.lit(" "), F.format_string("%.2f", F.lit(height) - _y(t)))
    return F.array_join(F.transform(tokens(path), lambda t: F.when(t.rlike("^[A-Z]$"), t).otherwise(pair(t))), " ")


def subpaths(path: Column) -> Column:
    """The parts of a path, each from its own M on."""
    return F.filter(F.transform(F.split(path, r"(?=M)"), lambda p: F.trim(p)), lambda p: p != "")


def segments(path: Column, steps: int = 8) -> Column:
    """array<struct<x0, y0, x1, y1>> of straight lines; a curve becomes `steps` of them."""
    state = F.struct(F.lit("").alias("op"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), F.array().cast("array<struct<x:double,y:double>>").alias("held"), F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        is_op, close = t.rlike("^[A-Z]$"), t == "Z"
        x, y = F.when(is_op, 0.0).otherwise(_x(F.when(is_op, F.lit("0 0")).otherwise(t))), F.when(is_op, 0.0).otherwise(_y(F.when(is_op, F.lit("0 0")).otherwise(t)))
        line = lambda x1, y1: F.array(F.struct(s.x.alias("x0"), s.y.alias("y0"), x1.alias("x1"), y1.alias("y1")))
        held = F.concat(s.held, F.array(F.struct(x.alias("x"), y.alias("y"))))
        curve, start, full = s.op == "C", s.op == "M", F.size(s.held) == 2

        def at(k: Column, c: str) -> Column:
            u = k.cast("double") / steps
            p = [s[c], s.held[0][c], s.held[1][c], F.struct(x.alias("x"), y.alias("y"))[c]]
            v = 1.0 - u
            return v * v * v * p[0] + 3.0 * v * v * u * p[1] + 3.0 * v * u * u * p[2] + u * u * u * p[3]

        bent = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: F.struct(at(k - 1, "x").alias("x0"), at(k - 1, "y").alias("y0"), at(k, "x").alias("x1"), at(k, "y").alias("y1")))
        ends = ~is_op & (~curve | full)
        return F.struct(
            F.when(is_op & ~close, t).otherwise(F.when(start & ~is_op, "L").otherwise(s.op)).alias("op"),
            F.when(close, s.sx).when(ends, x).otherwise(s.x).alias("x"), F.when(close, s.sy).when(ends, y).otherwise(s.y).alias("y"),
            F.when(~is_op & start, x).otherwise(s.sx).alias("sx"), F.when(~is_op & start, y).otherwise(s.sy).alias("sy"),
            F.when(~is_op & curve & ~full, held).otherwise(F.array().cast("array<struct<x:double,y:double>>")).alias("held"),
            F.when(close, F.concat(s.out, line(s.sx, s.sy))).when(~is_op & curve & full, F.concat(s.out, bent)).when(~is_op & ~start & ~curve, F.concat(s.out, line(x, y))).otherwise(s.out).alias("out"),
        )

    return F.aggregate(tokens(path), state, step, lambda s: s.out)
