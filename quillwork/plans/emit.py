"""Documents from blocks: Markdown, HTML, LaTeX, Typst, RTF, plain text, SVG as strings, and office and e-book packages as bytes.

blocks are what layout.list_groups() gives: paragraphs with heading_level, list_marker, list_level, list_kind, list_group,
text (with its marker) and text_clean. A document's text is joined by ordered aggregation; only packages use Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import text as tx

FORMATS = ("docx", "pptx", "odt", "odp", "svg", "html", "md", "epub", "txt", "rtf", "typst", "latex")
ALIASES = {"markdown": "md", "typ": "typst", "tex": "latex", "text": "txt"}
PAGE = ["doc_id", "page_no"]


def format_name(name: str) -> str:
    """A known format's name from an alias, an extension or any case."""
    key = name.strip().lower().lstrip(".")
    key = ALIASES.get(key, key)
    if key not in FORMATS:
        raise ValueError(f"no format {name!r}; there are {', '.join(FORMATS)}")
    return key


def joined(rows: DataFrame, keys: list[str], order: list[str], value: str, sep: str) -> DataFrame:
    """(keys, value): the group's values that aren't empty, in order, with sep between."""
    own = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])
    return rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys).agg(F.array_join(own, sep).alias(value))


def _gathered(rows: DataFrame, keys: list[str], order: list[str], sep: str, *more: Column) -> DataFrame:
    """joined() of content, and what more tells of all rows of a group, in one pass over the rows."""
    there = F.col("content").isNotNull() & (F.col("content") != "")
    own = F.transform(F.array_sort(F.collect_list(F.when(there, F.struct(*order, F.col("content").alias("_v"))))), lambda x: x["_v"])
    return rows.groupBy(*keys).agg(own.alias("_own"), *more).where("size(_own) > 0").withColumn("content", F.array_join("_own", sep)).drop("_own")


def short(number: Column | str) -> Column:
    """A number with at most two decimals and no zeros at the end."""
    c = F.col(number) if isinstance(number, str) else number
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(18,2)").cast("string"), "0+$", ""), r"\.$", "")


def by_page(blocks: DataFrame, rendered: Column, block_sep: str, page_sep: str) -> DataFrame:
    """(doc_id, content): blocks joined to pages, pages to documents."""
    pages = joined(blocks.withColumn("content", rendered), PAGE, ["para_no"], "content", block_sep)
    return joined(pages, ["doc_id"], ["page_no"], "content", page_sep)


def markdown_block(keep_marker: bool = True) -> Column:
    """A block in Markdown. With keep_marker an item keeps the marker that its text has, behind Markdown's own."""
    text = F.trim("text")
    marker = F.col("list_marker")
    number = F.regexp_replace(F.regexp_replace(marker, r"[.)]+$", ""), r"^\(+", "")
    lead = F.when(marker.rlike(r"[.)]$|^\d+$"), F.when(number.rlike(r"^\d+$"), F.concat(number, F.lit("."))).otherwise(marker)).otherwise("-")
    item = F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("list_level"))), lead, F.lit(" "), text if keep_marker else F.col("text_clean"))
    return F.when(text == "", "").when(F.col("heading_level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("heading_level")), F.lit(" "), text)).when(marker.isNotNull(), item).otherwise(text)


def front_matter(meta: dict[str, Column]) -> Column:
    """A YAML block of what isn't null."""
    rows = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), tx.escape_yaml(v))) for k, v in meta.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *rows), F.lit("\n---\n\n"))


def markdown(blocks: DataFrame, keep_marker: bool = True) -> DataFrame:
    return by_page(blocks, markdown_block(keep_marker), "\n\n", "\n\n---\n\n")


def _grouped(blocks: DataFrame, item: Column, block: Column, opening: dict[str, str], closing: dict[str, str], item_sep: str = "\n") -> DataFrame:
    """Blocks with runs of list items joined to one block each, as (doc_id, page_no, para_no, content)."""
    in_list = F.col("list_group").isNotNull()
    rows = blocks.withColumn("content", F.when(in_list, item).otherwise(block)).withColumn("_g", F.when(in_list, F.concat(F.lit("l"), F.col("list_group").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("para_no").cast("string"))))
    made = _gathered(rows, [*PAGE, "_g"], ["para_no"], item_sep, F.min("para_no").alias("_first"), F.first("list_kind").alias("_kind"))
    pick = lambda d: F.when(F.col("_kind") == "ordered", d["ordered"]).when(F.col("_kind") == "bullet", d["bullet"]).otherwise("")
    return made.select(*PAGE, F.col("_first").alias("para_no"), F.concat(pick(opening), F.col("content"), pick(closing)).alias("content"))


def html(blocks: DataFrame, title: str = "Document", css: str = "body{max-width:48em;margin:2em auto;font-family:serif}") -> DataFrame:
    """Self-contained pages: no reference leaves them."""
    level = F.col("heading_level").cast("string")
    style = F.when(F.col("alignment").isin("center", "right"), F.concat(F.lit(' style="text-align:'), F.col("alignment"), F.lit('"'))).otherwise("")
    text = tx.escape_xml(F.trim("text"))
    block = F.when(F.col("heading_level").isNotNull(), F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">"))).otherwise(F.concat(F.lit("<p"), style, F.lit(">"), text, F.lit("</p>")))
    item = F.concat(F.lit("<li>"), tx.escape_xml(F.col("text_clean")), F.lit("</li>"))
    parts = _grouped(blocks, item, block, {"ordered": "<ol>\n", "bullet": "<ul>\n"}, {"ordered": "\n</ol>", "bullet": "\n</ul>"})
    pages = joined(parts, PAGE, ["para_no"], "content", "\n").withColumn("content", F.concat(F.lit('<section id="page-'), F.col("page_no").cast("string"), F.lit('">\n'), F.col("content"), F.lit("\n</section>")))
    head = f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta http-equiv="Content-Security-Policy" content="default-src \'none\'; img-src data:; style-src \'unsafe-inline\'">\n<title>{title}</title>\n<style>{css}</style>\n</head>\n<body>\n'
    return joined(pages, ["doc_id"], ["page_no"], "content", "\n").withColumn("content", F.concat(F.lit(head), F.col("content"), F.lit("\n</body>\n</html>\n")))


def latex(blocks: DataFrame) -> DataFrame:
    command = F.get(F.array(*[F.lit(c) for c in ("section", "subsection", "subsubsection", "paragraph", "subparagraph", "subparagraph")]), F.col("heading_level") - 1)
    text = tx.escape_latex(F.trim("text"))
    block = (
        F.when(F.col("heading_level").isNotNull(), F.concat(F.lit("\\"), command, F.lit("{"), text, F.lit("}")))
        .when(F.col("alignment") == "center", F.concat(F.lit("\\begin{center}\n"), text, F.lit("\n\\end{center}")))
        .when(F.col("alignment") == "right", F.concat(F.lit("\\begin{flushright}\n"), text, F.lit("\n\\end{flushright}"))).otherwise(text)
    )
    item = F.concat(F.lit("\\item "), tx.escape_latex(F.col("text_clean")))
    parts = _grouped(blocks, item, block, {"ordered": "\\begin{enumerate}\n", "bullet": "\\begin{itemize}\n"}, {"ordered": "\n\\end{enumerate}", "bullet": "\n\\end{itemize}"})
    pages = joined(parts, PAGE, ["para_no"], "content", "\n\n")
    head = "\\documentclass[11pt]{article}\n\\usepackage[utf8]{inputenc}\n\\usepackage[T1]{fontenc}\n\\usepackage{textcomp}\n\\usepackage{hyperref}\n\\begin{document}\n\n"
    return joined(pages, ["doc_id"], ["page_no"], "content", "\n\n\\newpage\n\n").withColumn("content", F.concat(F.lit(head), F.col("content"), F.lit("\n\n\\end{document}\n")))


def typst(blocks: DataFrame) -> DataFrame:
    text, clean = tx.escape_typst(F.trim("text")), tx.escape_typst(F.col("text_clean"))
    aligned = F.concat(F.lit("#align("), F.col("alignment"), F.lit(")["), text, F.lit("]"))
    item = F.concat(F.repeat(F.lit("  "), F.col("list_level")), F.when(F.col("list_kind") == "ordered", "+ ").otherwise("- "), clean)
    block = F.when(F.col("heading_level").isNotNull(), F.concat(F.repeat(F.lit("="), F.col("heading_level")), F.lit(" "), text)).when(F.col("list_marker").isNotNull(), item).when(F.col("alignment").isin("center", "right"), aligned).otherwise(text)
    return by_page(blocks, block, "\n\n", "\n\n#pagebreak()\n\n").withColumn("content", F.concat(F.lit("#set page(width: 612pt, height: 792pt)\n\n"), F.col("content"), F.lit("\n")))


def rtf(blocks: DataFrame) -> DataFrame:
    align = F.when(F.col("alignment") == "center", "\\qc").when(F.col("alignment") == "right", "\\qr").when(F.col("alignment") == "justified", "\\qj").otherwise("\\ql")
    size = F.concat(F.lit("\\fs"), F.rint(F.col("font_size") * 2).cast("int").cast("string"))
    bold = F.when(F.col("is_bold"), "\\b").otherwise("")
    indent = F.when(F.col("list_marker").isNotNull(), F.concat(F.lit("\\li"), ((F.col("list_level") + 1) * 360).cast("string"), F.lit("\\fi-360"))).otherwise("")
    block = F.concat(F.lit("{\\pard"), align, indent, bold, size, F.lit(" "), tx.rtf_text(F.trim("text")), F.lit("\\par}"))
    return by_page(blocks, block, "\n", "\n\\page\n").withColumn("content", F.concat(F.lit("{\\rtf1\\ansi\\ansicpg1252\\uc1\\deff0{\\fonttbl{\\f0 Calibri;}}\\paperw12240\\paperh15840\n"), F.col("content"), F.lit("\n}")))


def canvas_rows(lines: DataFrame, width: float = 612.0, height: float = 792.0, cell: tuple[float, float] = (6.0, 12.0)) -> DataFrame:
    """(doc_id, page_no, row, content): lines on a grid of characters; where two meet, the later one shows."""
    cols, rows = int(width / cell[0]), int(height / cell[1])
    place = lambda k, size: F.greatest(F.lit(0), F.rint(F.col(k) / size)).cast("int")
    at = lines.select(*PAGE, "seq", place("y0", cell[1]).alias("row"), place("x0", cell[0]).alias("col"), "text").where((F.col("text") != "") & F.col("col").between(0, cols - 1) & F.col("row").between(0, rows - 1))
    own = at.groupBy(*PAGE, "row").agg(F.array_sort(F.collect_list(F.struct("seq", "col", "text"))).alias("_l"))
    line = F.expr("aggregate(_l, '', (a, x) -> concat(rpad(a, x.col, ' '), x.text, substring(a, x.col + length(x.text) + 1)))")
    return own.select(*PAGE, "row", F.rtrim(F.left(line, F.lit(cols))).alias("content"))


def canvas(lines: DataFrame, height: float = 792.0, cell: tuple[float, float] = (6.0, 12.0)) -> DataFrame:
    """Plain text that keeps every line's place; pages are parted by form feeds."""
    rows = canvas_rows(lines, height=height, cell=cell)
    full = rows.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("row", "content"))).alias("_m"), F.max("row").alias("_last"))
    page = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.coalesce(F.element_at("_m", i), F.lit(""))), "\n")
    return joined(full.withColumn("content", page), ["doc_id"], ["page_no"], "content", "\n\f\n")


def svg(lines: DataFrame, width: float = 612.0, height: float = 792.0, gap: float = 20.0) -> DataFrame:
    """One drawing for each document, its pages below each other."""
    y = F.col("y0") + 10.0 + (F.col("page_no") - 1) * (height + gap)
    item = F.concat(F.lit('<text x="'), short("x0"), F.lit('" y="'), short(y), F.lit('" font-size="'), short("font_size"), F.when(F.col("is_bold"), '" font-weight="bold').otherwise(""), F.lit('">'), tx.escape_xml(F.col("text")), F.lit("</text>"))
    body = _gathered(lines.withColumn("content", item), ["doc_id"], ["page_no", "seq"], "\n", F.max("page_no").alias("_n"))
    tall = short(F.col("_n") * (height + gap) - gap)
    head = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="'), tall, F.lit(f'" viewBox="0 0 {width:g} '), tall, F.lit('">\n'))
    return body.select("doc_id", F.concat(head, F.col("content"), F.lit("\n</svg>\n")).alias("content"))


def documents(blocks: DataFrame, lines: DataFrame, name: str, mode: str = "flow") -> DataFrame:
    """(doc_id, content) of a format: content is a string, of packages bytes. mode 'canvas' keeps places where the format can (txt, svg)."""
    name = format_name(name)
    if name == "txt":
        return canvas(lines) if mode == "canvas" else markdown(blocks)
    if name == "svg":
        return svg(lines)
    made = {"md": markdown, "html": html, "latex": latex, "typst": typst, "rtf": rtf}
    if name in made:
        return made[name](blocks)
    from quillwork.sources.packages import write

    return write(blocks, name)


# The directions of a box's lines at a place, as bits, and the glyph for each set of them.
NORTH, EAST, SOUTH, WEST = 1, 2, 4, 8
BOX_GLYPHS = {1: "│", 2: "─", 3: "└", 4: "│", 5: "│", 6: "┌", 7: "├", 8: "─", 9: "┘", 10: "─", 11: "┴", 12: "┐", 13: "┤", 14: "┬", 15: "┼"}


def box_cells(boxes: DataFrame, cell: tuple[float, float] = (6.0, 12.0)) -> DataFrame:
    """(doc_id, page_no, row, col, mask, glyph): the outlines of boxes on a character grid, joined where they meet."""
    c0, c1 = (F.greatest(F.lit(0), F.rint(F.col(k) / cell[0])).cast("int") for k in ("x0", "x1"))
    r0, r1 = (F.greatest(F.lit(0), F.rint(F.col(k) / cell[1])).cast("int") for k in ("y0", "y1"))
    b = boxes.select(*PAGE, c0.alias("c0"), r0.alias("r0"), c1.alias("c1"), r1.alias("r1")).where("c1 > c0 and r1 > r0")
    flat = b.withColumn("row", F.explode(F.array("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    flat = flat.select(*PAGE, "row", "col", (F.when(F.col("col") < F.col("c1"), EAST).otherwise(0) + F.when(F.col("col") > F.col("c0"), WEST).otherwise(0)).alias("mask"))
    tall = b.withColumn("col", F.explode(F.array("c0", "c1"))).withColumn("row", F.explode(F.sequence("r0", "r1")))
    tall = tall.select(*PAGE, "row", "col", (F.when(F.col("row") < F.col("r1"), SOUTH).otherwise(0) + F.when(F.col("row") > F.col("r0"), NORTH).otherwise(0)).alias("mask"))
    out = flat.unionByName(tall).groupBy(*PAGE, "row", "col").agg(F.bit_or("mask").cast("int").alias("mask"))
    return out.withColumn("glyph", F.get(F.array(*[F.lit(BOX_GLYPHS.get(i, " ")) for i in range(16)]), F.col("mask")))


# Fixed value: numbers with grouped thousands, a currency sign before and a percent sign after.
NUMERIC = r"^[$€£¥₽₹]?\s*-?\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*%?$"


def column_alignments(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, alignment, width): right for columns of which half the filled cells or more are numbers; width is the longest cell's, at least 3."""
    text = F.trim("text")
    number = text.rlike(NUMERIC)
    votes = cells.groupBy(*keys, "col").agg(F.count_if(text != "").alias("n"), F.count_if(number).alias("n_right"), F.greatest(F.lit(3), F.max(F.length(tx.escape_cell(F.col("text"))))).alias("width"))
    return votes.select(*keys, "col", F.when((F.col("n") > 0) & (F.col("n_right") >= F.col("n") / 2), "right").otherwise("left").alias("alignment"), F.col("width").cast("int").alias("width"))


def pipe_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): tables of cells (keys, row, col, text) as pipe tables; row 0 is the header."""
    at = cells.join(column_alignments(cells, keys), [*keys, "col"])
    shown = at.withColumn("_t", tx.padded(tx.escape_cell(F.col("text")), F.col("width"), F.col("alignment")))
    line = lambda df, value: joined(df.withColumn("_x", value), [*keys, "row"], ["col"], "_x", " | ").withColumn("_x", F.concat(F.lit("| "), F.col("_x"), F.lit(" |")))
    rows = line(shown, F.col("_t")).withColumn("_o", F.col("row") * 2)
    rule = line(shown.where("row = 0"), tx.table_delimiter(F.col("width"), F.col("alignment"))).withColumn("_o", F.lit(1))
    return joined(rows.unionByName(rule), keys, ["_o"], "_x", "\n").withColumnRenamed("_x", "content")
