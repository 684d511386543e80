"""Layout operators over frames of lines: regions, paragraphs, headings, lists, alignment, reading order.

A frame of lines has doc_id, page_no, seq (any number that orders a page's lines where positions tie), text, x0, y0, x1,
y1 (points, top down), font_size, is_bold, is_italic. All operators work page by page through windows, so one shuffle by
(doc_id, page_no) serves a whole chain of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]

# What a page number looks like, the marks that open list items, the forms of numbered items and headings.
PAGE_NUMBER = r"^(\d+|\s*-\s*\d+\s*-\s*|(?i:page)\s+\d+(\s+((?i:of)|/)\s+\d+)?|\d+\s*/\s*\d+|[ivxlcdmIVXLCDM]+)$"
BULLETS = "•‣●○◦▪▫◆◇✓➤–—*-"
BULLET_ITEM = r"(?s)^([•‣●○◦▪▫◆◇✓➤–—*\-])\s+(.*)$"
NUMBERED_ITEM = r"(?s)^(\(?\d+(?:\.\d+)*[.)]|\(?[a-zA-Z][.)]|\(?[ivxlcdmIVXLCDM]+[.)])\s+(.*)$"
NUMBERED_HEADING = r"^\d+(?:\.\d+)*\.?\s+[A-Z]"


def is_page_number(text: F.Column) -> F.Column:
    return F.trim(text).rlike(PAGE_NUMBER)


def in_header(top: float = 72.0) -> F.Column:
    return F.col("y0") <= top


def in_footer(height: float = 792.0, bottom: float = 72.0) -> F.Column:
    return F.col("y1") >= height - bottom


def repeated_margins(lines: DataFrame, height: float = 792.0, top: float = 72.0, bottom: float = 72.0) -> DataFrame:
    """(doc_id, region, text, n_pages): margin texts, page numbers aside, that stand on two or more pages of a document."""
    text = F.trim("text")
    region = F.when(in_header(top), "header").when(in_footer(height, bottom), "footer")
    seen = lines.where((text != "") & ~is_page_number(text)).select("doc_id", "page_no", region.alias("region"), text.alias("text")).where("region is not null")
    return seen.groupBy("doc_id", "region", "text").agg(F.countDistinct("page_no").alias("n_pages")).where("n_pages >= 2")


def regions(lines: DataFrame, known: DataFrame | None = None, height: float = 792.0, top: float = 72.0, bottom: float = 72.0) -> DataFrame:
    """lines without blank ones, with region: page_number, header, footer or body; the first rule that fits wins.

    With known, repeated_margins()' result, header and footer are texts found there; without, they are short small lines
    in the margins.
    """
    text = F.trim("text")
    rows = lines.where(text != "")
    number = is_page_number(text) & (in_header(top) | in_footer(height, bottom))
    if known is None:
        small = (F.col("font_size") <= 11.0) & (F.length(text) < 80)
        return rows.withColumn("region", F.when(number, "page_number").when(in_header(top) & small, "header").when(in_footer(height, bottom) & small, "footer").otherwise("body"))
    # A text may be known as header and as footer; header is first in order.
    flags = known.groupBy(F.col("doc_id").alias("_d"), F.col("text").alias("_t")).agg(F.min(F.when(F.col("region") == "header", 0).otherwise(1)).alias("_f"))
    joined = rows.join(flags, (F.col("doc_id") == F.col("_d")) & (text == F.col("_t")), "left")
    return joined.withColumn("region", F.when(number, "page_number").when(F.col("_f") == 0, "header").when(F.col("_f") == 1, "footer").otherwise("body")).drop("_d", "_t", "_f")


def paragraph_numbers(lines: DataFrame, gap_factor: float = 1.6) -> DataFrame:
    """lines with para_no, from 0 on each page: a new one after a wide gap, a change of size or an indent.

    A gap is wide above max(3, gap_factor times the page's upper median of the gaps that aren't negative).
    """
    page = W.partitionBy(*PAGE)
    down = page.orderBy(F.round("y0", 1), "x0", "seq")
    at = lines.withColumn("_gap", F.col("y0") - F.lag("y1").over(down)).withColumn("_size", F.lag("font_size").over(down)).withColumn("_left", F.lag("x0").over(down))
    gaps = F.sort_array(F.collect_list(F.when(F.col("_gap") >= 0, F.col("_gap"))).over(page))
    at = at.withColumn("_gaps", gaps).withColumn("_median", F.when(F.size("_gaps") > 0, F.element_at("_gaps", F.expr("cast(size(_gaps) div 2 + 1 as int)"))).otherwise(4.0))
    new = (F.col("_gap") > F.greatest(F.lit(3.0), F.col("_median") * gap_factor)) | (F.abs(F.col("font_size") - F.col("_size")) > F.greatest(F.lit(2.5), 0.2 * F.col("_size"))) | (F.col("x0") - F.col("_left") > 10.0)
    return at.withColumn("para_no", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(down).cast("int")).drop("_gap", "_size", "_left", "_gaps", "_median")


def paragraphs(lines: DataFrame, gap_factor: float = 1.6) -> DataFrame:
    """One row for each paragraph of a page: text, box, length-weighted size, style, indents, spacing and alignment; ws, where lines have it, as a list of its lines' words."""
    numbered = paragraph_numbers(lines, gap_factor)
    page = W.partitionBy(*PAGE)
    boxed = numbered.withColumn("_px0", F.min("x0").over(page)).withColumn("_px1", F.max("x1").over(page))
    within = W.partitionBy(*PAGE, "para_no").orderBy(F.round("y0", 1), "x0", "seq")
    boxed = boxed.withColumn("_i", F.row_number().over(within)).withColumn("_n", F.count("*").over(W.partitionBy(*PAGE, "para_no")))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 4.0
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("_px0") + F.col("_px1")) / 2) <= 4.0
    rows = boxed.groupBy(*PAGE, "para_no").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(_i, text))), x -> x.text), ' ')").alias("text"),
        F.count("*").cast("int").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        (F.sum(F.col("font_size") * F.length("text")) / F.greatest(F.sum(F.length("text")), F.lit(1))).alias("font_size"),
        F.bool_or("is_bold").alias("is_bold"), F.bool_or("is_italic").alias("is_italic"),
        F.greatest(F.lit(0.0), F.min("x0") - F.first("_px0")).alias("indent_left"), F.greatest(F.lit(0.0), F.first("_px1") - F.max("x1")).alias("indent_right"),
        F.coalesce(F.max(F.when(F.col("_i") == 1, F.col("x0"))) - F.max(F.when(F.col("_i") == 2, F.col("x0"))), F.lit(0.0)).alias("indent_first"),
        F.max(F.when(F.col("_i") == F.col("_n"), F.col("y0"))).alias("_last"), F.max(F.when(F.col("_i") == 1, F.col("y0"))).alias("_top"),
        F.avg(F.col("y1") - F.col("y0")).alias("_height"),
        F.bool_and(near("x0", "_px0")).alias("_left"), F.bool_and(near("x1", "_px1")).alias("_right"),
        F.bool_and((F.col("_i") == F.col("_n")) | near("x1", "_px1")).alias("_body_right"), F.bool_and(centred).alias("_centred"),
        (F.first("_px1") - F.first("_px0") > F.max("x1") - F.min("x0") + 8.0).alias("_room"),
        *([F.expr("transform(array_sort(collect_list(struct(_i, ws))), x -> x.ws)").alias("ws")] if "ws" in lines.columns else []),
    )
    order = W.partitionBy(*PAGE).orderBy("para_no")
    one, two = F.col("n_lines") == 1, F.col("n_lines") == 2
    alignment = (
        F.when(one & F.col("_room") & F.col("_centred"), "center").when(one & F.col("_room") & F.col("_right"), "right").when(one, "left")
        .when(two & F.col("_left") & F.col("_right"), "justified").when(~two & F.col("_left") & F.col("_body_right"), "justified")
        .when(F.col("_centred"), "center").when(F.col("_right"), "right").otherwise("left")
    )
    pitch = F.greatest(F.lit(1.0), F.round((F.col("_last") - F.col("_top")) / (F.col("n_lines") - 1) / F.col("_height"), 2))
    out = rows.withColumn("alignment", alignment).withColumn("line_spacing", F.when(one | (F.col("_height") <= 0), 1.15).otherwise(pitch))
    out = out.withColumn("space_before", F.greatest(F.lit(0.0), F.coalesce(F.col("y0") - F.lag("y1").over(order), F.lit(0.0)))).withColumn("space_after", F.greatest(F.lit(0.0), F.coalesce(F.lead("_top").over(order) - F.col("y1"), F.lit(0.0))))
    return out.drop("_last", "_top", "_height", "_left", "_right", "_body_right", "_centred", "_room")


def modal_sizes(paras: DataFrame) -> DataFrame:
    """(doc_id, page_no, body_size): the size, in half points, that most characters of a page have; the one seen first among equals."""
    sized = paras.where("n_chars > 0").groupBy(*PAGE, (F.rint(F.col("font_size") * 2) / 2).alias("size")).agg(F.sum("n_chars").alias("n"), F.min("para_no").alias("first"))
    return sized.groupBy(*PAGE).agg(F.max_by("size", F.struct(F.col("n"), -F.col("first"))).alias("body_size"))


def headings(paras: DataFrame) -> DataFrame:
    """paras with heading_level (1 to 6, or null), from size against the page's modal size, weight, case and length."""
    # The page's modal size as a window, so that paragraphs are made once and need no further shuffle.
    same = W.partitionBy(*PAGE, "_size")
    sized = paras.withColumn("_size", F.rint(F.col("font_size") * 2) / 2).withColumn("_n", F.sum("n_chars").over(same)).withColumn("_first", F.min(F.when(F.col("n_chars") > 0, F.col("para_no"))).over(same))
    most = F.max(F.when(F.col("_n") > 0, F.struct("_n", (-F.col("_first")).alias("f"), F.col("_size").alias("s")))).over(W.partitionBy(*PAGE))
    at = sized.withColumn("body_size", most.getField("s")).drop("_size", "_n", "_first")
    text, ratio = F.trim("text"), F.col("font_size") / F.coalesce("body_size", F.lit(12.0))
    ends = text.rlike(r"[.?!]$")
    line = F.col("n_lines") == 1
    none = (text == "") | (F.col("n_lines") > 3) | (F.length(text) > 200) | (ends & ~text.rlike(NUMBERED_HEADING) & (F.col("n_lines") > 1))
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    level = (
        F.when(none, F.lit(None).cast("int")).when(ratio >= 1.6, 1).when(ratio >= 1.35, 2).when(ratio >= 1.18, 3).when((ratio >= 1.05) & F.col("is_bold"), 4)
        .when(F.col("is_bold") & line & (F.length(text) < 100) & ~ends, 5).when((F.col("is_italic") | upper) & line & (F.length(text) < 80) & ~ends, 6)
    )
    return at.withColumn("heading_level", level.cast("int")).drop("body_size")


def list_items(paras: DataFrame) -> DataFrame:
    """paras with list_marker (null where there is none), list_level and text_clean, the text without its marker."""
    text = F.trim("text")
    bullet, number = F.regexp_extract(text, BULLET_ITEM, 1), F.regexp_extract(text, NUMBERED_ITEM, 1)
    marker = F.when(F.col("heading_level").isNotNull(), F.lit(None)).when(bullet != "", bullet).when(number != "", number)
    depth = F.least(F.lit(8), F.rint(F.greatest(F.lit(0.0), F.col("indent_left") - F.min("indent_left").over(W.partitionBy(*PAGE))) / 18.0).cast("int"))
    clean = F.when(bullet != "", F.regexp_extract(text, BULLET_ITEM, 2)).otherwise(F.regexp_extract(text, NUMBERED_ITEM, 2))
    return paras.withColumn("list_marker", marker).withColumn("list_level", F.when(F.col("list_marker").isNotNull(), depth).otherwise(0)).withColumn("text_clean", F.when(F.col("list_marker").isNotNull(), F.trim(clean)).otherwise(text))


def list_groups(items: DataFrame) -> DataFrame:
    """items with list_group: runs of neighbouring items of one kind, ordered or bullet, numbered on each page; null outside lists."""
    kind = F.when(F.col("list_marker").isNull(), F.lit(None)).when(F.col("list_marker").rlike(r"[.)]$|^\d+$"), "ordered").otherwise("bullet")
    order = W.partitionBy(*PAGE).orderBy("para_no")
    at = items.withColumn("list_kind", kind)
    new = (F.col("list_kind").isNotNull() & ~F.col("list_kind").eqNullSafe(F.lag("list_kind").over(order))).cast("int")
    return at.withColumn("list_group", F.when(F.col("list_kind").isNotNull(), F.sum(new).over(order)).cast("int"))


def split_lines(words: DataFrame) -> DataFrame:
    """words of lines with part_no: a line is parted where words stand farther apart than max(24, 2.5 times the larger size)."""
    order = W.partitionBy(*PAGE, "seq").orderBy("x0", "pos")
    wide = F.col("x0") - F.lag("x1").over(order) > F.greatest(F.lit(24.0), 2.5 * F.greatest(F.col("font_size"), F.lag("font_size").over(order)))
    return words.withColumn("part_no", F.sum(F.coalesce(wide, F.lit(False)).cast("int")).over(order).cast("int"))


def dominant_fonts(words: DataFrame, font: str = "font_name") -> DataFrame:
    """(doc_id, page_no, seq, font, font_size): of each line the font of most characters, the first among equals, and the mean size by characters."""
    size = (F.sum(F.col("font_size") * F.length("word")) / F.greatest(F.lit(1), F.sum(F.length("word")))).alias("font_size")
    by = words.groupBy(*PAGE, "seq", F.col(font).alias("font")).agg(F.sum(F.length("word")).alias("n"), F.min("pos").alias("first"))
    top = by.groupBy(*PAGE, "seq").agg(F.max_by("font", F.struct(F.col("n"), -F.col("first"))).alias("font"))
    return top.join(words.groupBy(*PAGE, "seq").agg(size), [*PAGE, "seq"])


def underlined(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """words with is_underline: a thin vector (at most 3 high, at least 4 wide) lies just below and under half of the word or more.

    vectors has doc_id, page_no, x0, y0, x1, y1. They meet words of their own band of 32 points only.
    """
    band = 32.0
    middle, bands = (F.col("y0") + F.col("y1")) / 2, lambda y: F.sequence(F.floor((y - band) / band), F.floor((y + band) / band))
    thin = vectors.where("y1 - y0 <= 3 and x1 - x0 >= 4").select(*PAGE, F.struct(F.col("x0").alias("x0"), F.col("x1").alias("x1"), middle.alias("y")).alias("_v"), F.explode(bands(middle)).alias("_b"))
    # A band's vectors come to its words as one array: words are shuffled once and keep their rows.
    known = thin.groupBy(*PAGE, "_b").agg(F.collect_list("_v").alias("_vs"))

    def hit(v: F.Column) -> F.Column:
        dy = v["y"] - F.col("y1")
        return (dy >= -1.5) & (dy <= F.greatest(F.lit(4.0), 0.4 * F.col("font_size"))) & (F.least("x1", v["x1"]) - F.greatest("x0", v["x0"]) >= 0.5 * (F.col("x1") - F.col("x0")))

    met = words.withColumn("_b", F.floor(F.col("y1") / band)).join(known, [*PAGE, "_b"], "left")
    return met.select(*words.columns, F.coalesce(F.exists("_vs", hit), F.lit(False)).alias("is_underline"))


def merged_intervals(boxes: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, run_no, start, end): unions of intervals that overlap or touch."""
    order = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    at = boxes.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(0))).withColumn("run_no", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return at.groupBy(*keys, "run_no").agg(F.min(start).alias("start"), F.max(end).alias("end"))


def cut_once(boxes: DataFrame, axis: str, gap: float, node: str = "node") -> DataFrame:
    """boxes with _cut: the number of the band between white gaps of at least gap along an axis, within each page and node."""
    keys = [*PAGE, node]
    runs = merged_intervals(boxes, keys, f"{axis}0", f"{axis}1")
    order = W.partitionBy(*keys).orderBy("run_no")
    cuts = runs.withColumn("_before", F.lag("end").over(order)).where(F.col("start") - F.col("_before") >= gap).groupBy(*keys).agg(F.sort_array(F.collect_list((F.col("_before") + F.col("start")) / 2)).alias("_cuts"))
    middle = (F.col(f"{axis}0") + F.col(f"{axis}1")) / 2
    return boxes.join(cuts, keys, "left").withColumn("_m", middle).withColumn("_cut", F.expr("coalesce(size(filter(_cuts, c -> _m >= c)), 0)")).withColumn("_cut", F.when(F.col("_cuts").isNull(), 0).otherwise(F.col("_cut"))).drop("_cuts", "_m")


def _sides(boxes: str) -> list:
    """The four sides of an array of boxes, as arrays."""
    return [(lambda k: F.transform(boxes, lambda x: x[k].cast("double")))(k) for k in ("x0", "y0", "x1", "y1")]


def xy_cut(boxes: DataFrame, x_gap: float = 15.0, y_gap: float = 10.0, max_depth: int = 25) -> DataFrame:
    """boxes with node, a path such as 0.2.1 that sorts in reading order: pages are cut at white gaps across, else down, until no gap is left (or max_depth).

    A page's boxes meet in one row and are cut there: one shuffle, whatever the depth.
    """
    from quillwork.sources import pdf_layout

    @F.pandas_udf("array<string>")
    def nodes(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([pdf_layout.xy_cut(*[v.tolist() for v in own], x_gap, y_gap, max_depth) for own in zip(x0, y0, x1, y1, strict=True)])

    rest = [c for c in boxes.columns if c not in PAGE]
    pages = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct(*rest)).alias("b"))
    cut = pages.withColumn("n", nodes(*_sides("b")))
    each = cut.select(*PAGE, F.explode(F.arrays_zip("b", "n")).alias("z"))
    return each.select(*PAGE, *[F.col(f"z.b.{c}").alias(c) for c in rest], F.col("z.n").alias("node")).select(*boxes.columns, "node")


def in_columns(lines: DataFrame) -> DataFrame:
    """lines with block_no: the stretch of a page's text that a line is read in, column after column."""
    from quillwork.sources import pdf_layout

    @F.pandas_udf("array<int>")
    def numbers(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([pdf_layout.columns(*[v.tolist() for v in own]) for own in zip(x0, y0, x1, y1, strict=True)])

    rest = [c for c in lines.columns if c not in PAGE]
    pages = lines.groupBy(*PAGE).agg(F.collect_list(F.struct(*rest)).alias("b"))
    cut = pages.withColumn("n", numbers(*_sides("b")))
    each = cut.select(*PAGE, F.explode(F.arrays_zip("b", "n")).alias("z"))
    return each.select(*PAGE, *[F.col(f"z.b.{c}").alias(c) for c in rest], F.col("z.n").alias("block_no")).select(*lines.columns, "block_no")


def reading_order(cut: DataFrame) -> DataFrame:
    """xy_cut()'s boxes with block_no, the place of their leaf in reading order, and line_no within it."""
    leaf = W.partitionBy(*PAGE).orderBy("node")
    return cut.withColumn("block_no", (F.dense_rank().over(leaf) - 1).cast("int")).withColumn("line_no", (F.row_number().over(W.partitionBy(*PAGE, "node").orderBy(F.round("y0", 1), "x0", "seq")) - 1).cast("int"))
