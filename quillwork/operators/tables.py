"""Tables from rulings and from aligned words, as range joins and windows.

vectors: doc_id, page_no, x0, y0, x1, y1 (points, top down). Everything is keyed by (doc_id, page_no), so a page's rulings
only meet its own; pages have tens to hundreds of rulings, and the joins within them are bounded by that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]
KEY = list(PAGE)


def rulings(vectors: DataFrame, length: float = 20.0, thickness: float = 4.0) -> DataFrame:
    """(doc_id, page_no, orient, pos, lo, hi): vectors that are horizontal (h) or vertical (v) lines."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    orient = F.when((w >= length) & (h <= thickness), "h").when((h >= length) & (w <= thickness), "v")
    flat = F.col("orient") == "h"
    rows = vectors.withColumn("orient", orient).where("orient is not null")
    return rows.select(*PAGE, "orient", F.when(flat, (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2).alias("pos"), F.when(flat, F.col("x0")).otherwise(F.col("y0")).alias("lo"), F.when(flat, F.col("x1")).otherwise(F.col("y1")).alias("hi"))


def clustered(coords: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, idx, at, n): chains of values no farther apart than tolerance, numbered from 0, at their means."""
    order = W.partitionBy(*keys).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(order) > tolerance).cast("int"), F.lit(0))
    at = coords.withColumn("_new", new).withColumn("idx", F.sum("_new").over(order).cast("int"))
    return at.groupBy(*keys, "idx").agg(F.avg(value).alias("at"), F.count("*").alias("n"))


def grid_lines(lines: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(doc_id, page_no, orient, idx, at, n): rulings() chained to the lines of a grid."""
    return clustered(lines, [*PAGE, "orient"], "pos", tolerance)


def intersections(lines: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(doc_id, page_no, n_crossings): pairs of a horizontal and a vertical ruling that cross or nearly touch."""
    h = lines.where("orient = 'h'").select(*PAGE, F.col("pos").alias("hy"), F.col("lo").alias("hx0"), F.col("hi").alias("hx1"))
    v = lines.where("orient = 'v'").select(*PAGE, F.col("pos").alias("vx"), F.col("lo").alias("vy0"), F.col("hi").alias("vy1"))
    met = h.join(v, PAGE).where((F.col("vx") >= F.col("hx0") - tolerance) & (F.col("vx") <= F.col("hx1") + tolerance) & (F.col("hy") >= F.col("vy0") - tolerance) & (F.col("hy") <= F.col("vy1") + tolerance))
    return met.groupBy(*PAGE).agg(F.count("*").alias("n_crossings"))


def segments(lines: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(doc_id, page_no, orient, idx, span, present): for every grid line and every stretch between two neighbouring grid lines across it, whether a ruling covers it."""
    grid = grid_lines(lines, tolerance)
    other = F.when(F.col("orient") == "h", "v").otherwise("h")
    order = W.partitionBy(*PAGE, "orient").orderBy("idx")
    spans = grid.withColumn("next", F.lead("at").over(order)).where("next is not null").select(*PAGE, other.alias("orient"), F.col("idx").alias("span"), F.col("at").alias("s0"), F.col("next").alias("s1"))
    cells = grid.select(*PAGE, "orient", "idx", "at").join(spans, [*PAGE, "orient"])
    rule = lines.select(*PAGE, "orient", "pos", "lo", "hi")
    covered = cells.join(rule, [*PAGE, "orient"]).where((F.abs(F.col("pos") - F.col("at")) <= tolerance) & (F.col("lo") <= F.col("s0") + tolerance) & (F.col("hi") >= F.col("s1") - tolerance)).select(*PAGE, "orient", "idx", "span").distinct().withColumn("present", F.lit(True))
    return cells.join(covered, [*PAGE, "orient", "idx", "span"], "left").select(*PAGE, "orient", "idx", "span", F.coalesce("present", F.lit(False)).alias("present"))


def borders(lines: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(doc_id, page_no, n_rows, n_cols, x0, y0, x1, y1, n_borders): pages whose rulings make a grid with enough of an outer border.

    At least four crossings, and either opposite borders or three of the four.
    """
    grid = grid_lines(lines, tolerance)
    size = grid.groupBy(*PAGE).agg(
        *[F.count(F.when(F.col("orient") == o, 1)).alias(f"n_{o}") for o in "hv"],
        F.min(F.when(F.col("orient") == "v", F.col("at"))).alias("x0"), F.max(F.when(F.col("orient") == "v", F.col("at"))).alias("x1"),
        F.min(F.when(F.col("orient") == "h", F.col("at"))).alias("y0"), F.max(F.when(F.col("orient") == "h", F.col("at"))).alias("y1"),
    ).where("n_h >= 2 and n_v >= 2")
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance
    flat = (F.col("orient") == "h") & (F.col("lo") <= F.col("x0") + tolerance) & (F.col("hi") >= F.col("x1") - tolerance)
    tall = (F.col("orient") == "v") & (F.col("lo") <= F.col("y0") + tolerance) & (F.col("hi") >= F.col("y1") - tolerance)
    side = lambda cond, name: F.coalesce(F.bool_or(cond), F.lit(False)).alias(name)
    have = size.join(lines, PAGE).groupBy(*PAGE).agg(side(flat & close("pos", "y0"), "top"), side(flat & close("pos", "y1"), "bottom"), side(tall & close("pos", "x0"), "left"), side(tall & close("pos", "x1"), "right"))
    n = sum((F.col(c).cast("int") for c in ("top", "bottom", "left", "right")), F.lit(0))
    ok = (F.col("n_borders") >= 2) & ((F.col("top") & F.col("bottom")) | (F.col("left") & F.col("right")) | (F.col("n_borders") >= 3))
    rows = size.join(have.withColumn("n_borders", n), PAGE).join(intersections(lines, tolerance).where("n_crossings >= 4"), PAGE, "left_semi").where(ok)
    return rows.select(*PAGE, (F.col("n_h") - 1).cast("int").alias("n_rows"), (F.col("n_v") - 1).cast("int").alias("n_cols"), "x0", "y0", "x1", "y1", "n_borders")


def cells(lines: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(doc_id, page_no, row, col, row_span, col_span, x0, y0, x1, y1) of bordered tables; a cell goes on to the right and down while no ruling parts it from the next."""
    table = borders(lines, tolerance).select(*PAGE, "n_rows", "n_cols")
    wall = segments(lines, tolerance).where("present").groupBy(*PAGE).agg(F.collect_set(F.concat_ws(":", "orient", "idx", "span")).alias("walls"))
    at = grid_lines(lines, tolerance).groupBy(*PAGE).agg(*[F.expr(f"transform(array_sort(collect_list(case when orient = '{o}' then struct(idx, at) end)), x -> x.at)").alias(f"at_{o}") for o in "hv"])
    grid = table.join(at, PAGE).join(wall, PAGE, "left")

    # Which cells earlier spans have taken is known only in order: a fold over one page's grid.
    import pandas as pd

    def fold(batches):
        for df in batches:
            out = []
            for t in df.itertuples():
                walls, taken = set(t.walls if t.walls is not None else ()), set()
                for r in range(t.n_rows):
                    for c in range(t.n_cols):
                        if (r, c) in taken:
                            continue
                        w = h = 1
                        while c + w < t.n_cols and f"v:{c + w}:{r}" not in walls:
                            w += 1
                        while r + h < t.n_rows and any(f"h:{r + h}:{k}" not in walls for k in range(c, c + w)):
                            h += 1
                        taken |= {(i, k) for i in range(r, r + h) for k in range(c, c + w)}
                        out.append((t.doc_id, t.page_no, r, c, h, w, t.at_v[c], t.at_h[r], t.at_v[c + w], t.at_h[r + h]))
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "row", "col", "row_span", "col_span", "x0", "y0", "x1", "y1"])

    return grid.mapInPandas(fold, "doc_id long, page_no int, row int, col int, row_span int, col_span int, x0 double, y0 double, x1 double, y1 double")


def lines_in_cells(text_lines: DataFrame, table_cells: DataFrame) -> DataFrame:
    """(doc_id, page_no, seq, row, col): each line whose centre lies in a cell; on a shared edge, in all cells there."""
    c = table_cells.select(*PAGE, "row", "col", *[F.col(k).alias(f"c{k}") for k in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return text_lines.join(c, PAGE).where((cx >= F.col("cx0")) & (cx <= F.col("cx1")) & (cy >= F.col("cy0")) & (cy <= F.col("cy1"))).select(*PAGE, "seq", "row", "col")


def column_starts(words: DataFrame, least_words: int = 2, least_rows: int = 3, snap: float = 8.0, gutter: float = 14.0) -> DataFrame:
    """(doc_id, page_no, col, at): where the words of a page's lines start in columns: snapped starts that 55 % of lines with two or more words share, chained at twice the snap.

    Pages with fewer than two or more than eight columns, or where a word crosses a gutter, have none.
    """
    rows = W.partitionBy(*PAGE, "seq")
    wide = words.withColumn("_n", F.count("*").over(rows)).where(F.col("_n") >= least_words)
    n_lines = wide.groupBy(*PAGE).agg(F.countDistinct("seq").alias("_lines")).where(F.col("_lines") >= least_rows)
    counts = wide.groupBy(*PAGE, (F.rint(F.col("x0") / snap) * snap).alias("x")).agg(F.count("*").alias("n")).join(n_lines, PAGE).where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("_lines") * 0.55)))
    chains = clustered(counts.select(*PAGE, "x"), list(PAGE), "x", 2 * snap)
    cols = chains.withColumn("_n", F.count("*").over(W.partitionBy(*PAGE))).where("_n between 2 and 8")
    crossing = wide.join(cols.where("idx > 0").select(*PAGE, "at"), PAGE).where((F.col("x0") < F.col("at") - snap) & (F.col("x1") > F.col("at") + snap)).select(*PAGE).distinct()
    del gutter  # chains at twice the snap stand farther apart than the gutter
    return cols.join(crossing, PAGE, "left_anti").select(*PAGE, F.col("idx").alias("col"), "at")


def nearest_columns(words: DataFrame, columns: DataFrame) -> DataFrame:
    """words of pages with columns, with col: the nearest start, the left one of two equally near."""
    best = columns.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("col", "at"))).alias("_cols"))
    near = F.expr("array_min(transform(_cols, c -> struct(abs(x0 - c.at) as d, c.col as col))).col")
    return words.join(best, PAGE).withColumn("col", near).drop("_cols")


def borderless_cells(words: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc_id, page_no, row, col, text) of borderless tables with three rows and half their cells filled, at least."""
    placed = nearest_columns(words.withColumn("_n", F.count("*").over(W.partitionBy(*PAGE, "seq"))).where("_n >= 2"), columns)
    rows = placed.withColumn("row", (F.dense_rank().over(W.partitionBy(*PAGE).orderBy("seq")) - 1).cast("int"))
    made = rows.groupBy(*PAGE, "row", "col").agg(F.expr("array_join(transform(array_sort(collect_list(struct(pos, word))), x -> x.word), ' ')").alias("text"))
    n = columns.groupBy(*PAGE).agg(F.count("*").alias("_c"))
    full = made.groupBy(*PAGE).agg(F.count("*").alias("_f"), (F.max("row") + 1).alias("_r")).join(n, PAGE).where("_r >= 3 and _f >= 0.5 * _r * _c")
    return made.join(full.select(*PAGE), PAGE, "left_semi")
