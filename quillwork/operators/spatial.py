"""Joins of boxes and points in the plane, bucketed by a grid so that only what is near meets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = 64.0
BOX = ["x0", "y0", "x1", "y1"]


def _cells(boxes: DataFrame, cell: float, grow: float = 0.0) -> DataFrame:
    """boxes with a row for each grid cell that they, grown by `grow`, touch."""
    seq = lambda lo, hi: F.expr(f"sequence(cast(floor(({lo} - {grow}) / {cell}) as long), cast(floor(({hi} + {grow}) / {cell}) as long))")
    return boxes.withColumn("_cx", F.explode(seq("x0", "x1"))).withColumn("_cy", F.explode(seq("y0", "y1")))


def _tasks(spark: SparkSession) -> int:
    """Parts for joins whose work isn't in their bytes: several for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def overlaps(a: DataFrame, b: DataFrame, a_id: str, b_id: str, cell: float = CELL, ordered: bool = False) -> DataFrame:
    """(a_id, b_id) for boxes that overlap or touch, with ordered only where a_id is the smaller. A pair counts in the one cell that holds the lower corner of its overlap, so no distinct is needed.

    Cells are spread over many tasks whatever their bytes: a cell's work is the product of its boxes.
    """
    right = _cells(b.select(F.col(b_id), *[F.col(k).alias(f"b{k}") for k in BOX]).select("*", *[F.col(f"b{k}").alias(k) for k in BOX]), cell).drop(*BOX)
    left = _cells(a.select(a_id, *BOX), cell)
    left, right = (x.repartition(_tasks(a.sparkSession), "_cx", "_cy") for x in (left, right))
    met = left.join(right.hint("shuffle_hash"), ["_cx", "_cy"])
    hit = (F.col("x0") <= F.col("bx1")) & (F.col("x1") >= F.col("bx0")) & (F.col("y0") <= F.col("by1")) & (F.col("y1") >= F.col("by0"))
    corner = (F.floor(F.greatest("x0", "bx0") / cell) == F.col("_cx")) & (F.floor(F.greatest("y0", "by0") / cell) == F.col("_cy"))
    return met.where(hit & corner & (F.col(a_id) < F.col(b_id)) if ordered else hit & corner).select(a_id, b_id)


def containing(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str, cell: float = CELL) -> DataFrame:
    """(point_id, box_id) for points (px, py) in a box or on its edge."""
    at = points.withColumn("_cx", F.floor(F.col("px") / cell)).withColumn("_cy", F.floor(F.col("py") / cell))
    return at.join(_cells(boxes.select(box_id, *BOX), cell), ["_cx", "_cy"]).where("px between x0 and x1 and py between y0 and y1").select(point_id, box_id)


def distance(px: str = "px", py: str = "py") -> F.Column:
    """From a point to a box: 0 inside."""
    dx = F.greatest(F.lit(0.0), F.col("x0") - F.col(px), F.col(px) - F.col("x1"))
    dy = F.greatest(F.lit(0.0), F.col("y0") - F.col(py), F.col(py) - F.col("y1"))
    return F.sqrt(dx * dx + dy * dy)


def _sides() -> tuple[dict, dict]:
    """The lower and the upper side of a box by axis, whichever way round it has them."""
    return {c: F.least(f"{c}0", f"{c}1") for c in "xy"}, {c: F.greatest(f"{c}0", f"{c}1") for c in "xy"}


def uncovered(boxes: DataFrame, box_id: str, k: int, cell: float) -> DataFrame:
    """boxes by the cells (_cx, _cy) that they touch, but for those that k boxes with smaller ids cover (_covers) there."""
    low, high = _sides()
    span = lambda c: F.sequence(F.floor(low[c] / cell), F.floor(high[c] / cell))
    flat = boxes.select(box_id, *BOX).where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    flat = flat.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))
    covers = (F.col("x0") <= F.col("_cx") * cell) & (F.col("x1") >= (F.col("_cx") + 1) * cell) & (F.col("y0") <= F.col("_cy") * cell) & (F.col("y1") >= (F.col("_cy") + 1) * cell)
    own = W.partitionBy("_cx", "_cy")
    before = F.coalesce(F.sum("_covers").over(own.orderBy(box_id).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return flat.repartition(_tasks(boxes.sparkSession), "_cx", "_cy").withColumn("_covers", covers.cast("int")).withColumn("_before", before).where(F.col("_before") < k).drop("_before")


def nearest(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str, k: int, max_dist: float) -> DataFrame:
    """(point_id, rank, box_id, dist): the k boxes nearest to each point within max_dist, ties to the smaller id.

    A box is dropped from a cell that k boxes with smaller ids cover: those are as near to any point there, and to any beyond.
    What a point's own cell holds bounds how far it looks: nowhere else if k boxes cover the cell, to the cell's diagonal if k touch it.
    A pair counts in the one cell that holds the box's place nearest to the point.
    """
    if k < 1:
        return points.select(point_id).where("false").select(point_id, F.lit(0).alias("rank"), F.lit(0).alias(box_id), F.lit(0.0).alias("dist"))
    # A power of two, so that dividing by it is exact.
    cell = 2.0 ** max(4, math.floor(math.log2(max_dist / 4))) if max_dist > 0 else 16.0
    low, high = _sides()
    kept = uncovered(boxes, box_id, k, cell)
    touches = ((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))).cast("int")
    held = kept.groupBy("_cx", "_cy").agg(F.sum("_covers").alias("_full"), F.sum(touches).alias("_n"))
    at = points.withColumn("_cx", F.floor(F.col("px") / cell)).withColumn("_cy", F.floor(F.col("py") / cell)).join(held, ["_cx", "_cy"], "left")
    reach = F.when(F.col("_full") >= k, 0.0).when(F.col("_n") >= k, min(max_dist, 1.5 * cell)).otherwise(float(max_dist))
    # A little more than the reach, for what rounding may take; how far a box is, is measured below.
    around = lambda c: F.sequence(F.floor((F.col(c) - F.col("_r") * 1.000001) / cell), F.floor((F.col(c) + F.col("_r") * 1.000001) / cell))
    seen = at.withColumn("_r", reach).drop("_cx", "_cy", "_full", "_n").withColumn("_cx", F.explode(around("px"))).withColumn("_cy", F.explode(around("py")))
    near = lambda c: F.floor(F.greatest(low[c], F.least(high[c], F.col(f"p{c}"))) / cell)
    met = seen.join(kept.drop("_covers"), ["_cx", "_cy"]).where((near("x") == F.col("_cx")) & (near("y") == F.col("_cy"))).withColumn("dist", distance()).where(F.col("dist") <= max_dist)
    return met.withColumn("rank", F.row_number().over(W.partitionBy(point_id).orderBy("dist", box_id))).where(F.col("rank") <= k).select(point_id, "rank", box_id, "dist")
