"""Parsed pages to documents of blocks: paragraphs with runs, tables with spans, images and vectors, in reading order."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions import mathtext
from quillwork.operators import layout, tables
from quillwork.plans import rich, rich_packages
from quillwork.sources import pdf

PAGE = ["doc_id", "page_no"]
#: Stretches of text a page may have, for numbers of pages and stretches in one.
STRETCHES = 1 << 12
EMPTY = {k: None for k in ("block_no", "runs", "heading_level", "list_kind", "list_level", "list_marker", "alignment", "cells", "content", "format", "alt", "svg_path", "fill_rgb", "stroke_rgb", "stroke_width", "fill_rule", "dash", "fill_alpha", "stroke_alpha")}


def marks(w: dict, rules: list[dict]) -> tuple[bool, bool]:
    """Whether a thin rule below a word underlines it, and whether one through it strikes it."""
    under = strike = False
    for v in rules:
        y = (v["y0"] + v["y1"]) / 2
        if min(w["x1"], v["x1"]) - max(w["x0"], v["x0"]) < 0.8 * (w["x1"] - w["x0"]):
            continue
        under |= -0.05 * w["size"] <= y - w["baseline"] <= 0.25 * w["size"]
        strike |= 0.15 * w["size"] <= w["baseline"] - y <= 0.45 * w["size"]
    return under, strike


def runs_of(lines: list[list[dict]], rules: list[dict]) -> list[dict]:
    """Words of a paragraph's lines as runs: neighbours of one style, compared with the run's first word, are one."""
    out: list[dict] = []
    base = None
    for w in [w for line in lines for w in line]:
        under, strike = marks(w, rules)
        r = {"text": w["word"], "font": w["font"], "size": w["size"], "color": w["color"] or 0, "bold": w["bold"], "italic": w["italic"], "underline": under, "strike": strike, "script": None, "baseline": w["baseline"]}
        r["script"] = mathtext.script_kind(r, base)
        if not r["script"]:
            base = r
        p = out[-1] if out else None
        if p and all(p[k] == r[k] for k in ("font", "color", "bold", "italic", "underline", "strike", "script")) and abs(p["size"] - r["size"]) <= 0.1 and not rich.link_of(r["text"]) and not rich.link_of(p["text"].strip()):
            p["text"] += " " + r["text"]
        else:
            if p and not r["script"]:
                # The space belongs to what is underlined only if both sides are.
                if p["underline"] and not r["underline"] or p["strike"] and not r["strike"]:
                    r["text"] = " " + r["text"]
                else:
                    p["text"] += " "
            out.append(r)
    return out


def flipped(path: str, height: float) -> str:
    """A path in bottom-up points as one in top-down points."""
    return re.sub(r"(-?[\d.]+) (-?[\d.]+)", lambda m: f"{rich.num(float(m[1]))} {rich.num(height - float(m[2]))}", path)


def by_lines(b: dict) -> list[dict]:
    """A paragraph's lines as paragraphs in their own places."""
    side = lambda pick, line, k: pick(w[k] for w in line)
    return [b | {"ws": [line], "x0": side(min, line, "x0"), "y0": side(min, line, "y0"), "x1": side(max, line, "x1"), "y1": side(max, line, "y1"), "alignment": None} for line in b["ws"]]


def assembled(title: str, meta: dict, pages: list[dict], paras: list[dict], cells: list[dict], margins: list[dict], vectors: list[dict], images: list[dict], placed: bool = False) -> dict:
    """A document from the rows of its pages; placed keeps the lines of paragraphs apart."""
    paras = [x for b in paras for x in by_lines(b)] if placed else paras
    of = lambda rows, n: [r for r in rows if r["page_no"] == n]
    out = []
    for p in sorted(pages, key=lambda p: p["page_no"]):
        n, height = p["page_no"], p["height"]
        own = of(vectors, n)
        rules = [v for v in own if v["y1"] - v["y0"] <= 2.5 and v["x1"] - v["x0"] >= 3]
        table = of(cells, n)
        box = (min(c["x0"] for c in table), min(c["y0"] for c in table), max(c["x1"] for c in table), max(c["y1"] for c in table)) if table else None
        blocks, used = [], set()
        for b in sorted(of(paras, n), key=lambda b: (b["block_no"], b["para_no"])):
            runs = runs_of(b["ws"], rules)
            for line in b["ws"]:
                for w in line:
                    used |= {id(v) for v in rules if any(marks(w, [v]))}
            blocks.append(EMPTY | {k: b[k] for k in ("x0", "y0", "x1", "y1", "heading_level", "list_kind", "list_level", "list_marker", "alignment")} | {"kind": "paragraph", "runs": runs})
        extra = []
        if table:
            made = [{**{k: c[k] for k in ("row", "col", "row_span", "col_span", "x0", "y0", "x1", "y1")}, "runs": runs_of(c["ws"] or [], rules)} for c in table]
            extra.append(EMPTY | {"kind": "table", "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3], "cells": sorted(made, key=lambda c: (c["row"], c["col"]))})
        for x in of(images, n):
            if x["content"] and x["x1"] > x["x0"]:
                extra.append(EMPTY | {"kind": "image", "x0": x["x0"], "y0": x["y0"], "x1": x["x1"], "y1": x["y1"], "content": x["content"], "format": x["format"], "alt": x["name"]})
        for v in own:
            within = box and v["x0"] >= box[0] - 6 and v["x1"] <= box[2] + 6 and v["y0"] >= box[1] - 6 and v["y1"] <= box[3] + 6
            if id(v) not in used and not within and (v["fill_rgb"] is not None or v["stroke_rgb"] is not None):
                extra.append(EMPTY | {k: v[k] for k in ("x0", "y0", "x1", "y1", "fill_rgb", "stroke_rgb", "stroke_width", "fill_rule", "dash", "fill_alpha", "stroke_alpha")} | {"kind": "vector", "svg_path": flipped(v["svg_path"], height)})
        # Tables, images and vectors go before the first paragraph that stands below them.
        for b in sorted(extra, key=lambda b: (b["y0"], b["x0"])):
            at = next((i for i, q in enumerate(blocks) if q["kind"] == "paragraph" and q["y0"] >= b["y0"] and min(q["x1"], b["x1"]) > max(q["x0"], b["x0"])), None)
            if at is None:
                at = next((i for i, q in enumerate(blocks) if q["y0"] >= b["y1"]), len(blocks))
            blocks.insert(at, b)
        for i, b in enumerate(blocks):
            b["block_no"] = i
        line = lambda m: EMPTY | {"kind": "paragraph", "x0": m["x0"], "y0": m["y0"], "x1": m["x1"], "y1": m["y1"], "runs": runs_of([m["ws"]], [])}
        side = lambda kinds: [line(m) for m in sorted(of(margins, n), key=lambda m: (m["y0"], m["x0"])) if m["region"] in kinds]
        top = [m for m in side(("header", "page_number")) if m["y0"] < height / 2]
        low = [m for m in side(("footer", "page_number")) if m["y0"] >= height / 2]
        out.append({"page_no": n, "width": p["width"], "height": height, "header": top, "footer": low, "blocks": blocks})
    return {"title": title, "meta": meta, "pages": out}


def parts(pages: DataFrame) -> DataFrame:
    """A row for each document of pdf.parse(lines=True): the rows of its pages, as arrays of structs."""
    good = pages.where("error is null")
    lines = pdf.page_lines(good)
    vectors = pdf.vectors(good)
    grid = tables.cells(tables.rulings(vectors))
    # A line on an edge counts for the first of its cells.
    inside = tables.lines_in_cells(lines.drop("ws"), grid).groupBy(*PAGE, "seq").agg(F.min(F.struct("row", "col")).alias("c")).select(*PAGE, "seq", "c.row", "c.col")
    in_cells = lines.join(inside, [*PAGE, "seq"]).groupBy(*PAGE, "row", "col").agg(F.expr("transform(array_sort(collect_list(struct(y0, x0, seq, ws))), x -> x.ws)").alias("ws"))
    cells = grid.join(in_cells, [*PAGE, "row", "col"], "left")
    free = lines.join(inside.select(*PAGE, "seq"), [*PAGE, "seq"], "left_anti")
    placed = layout.regions(free, layout.repeated_margins(free.drop("ws")))
    body = layout.in_columns(placed.where("region = 'body'").drop("region"))
    # Paragraphs are made in each stretch of text, headings and lists on each page.
    stretch = body.withColumn("page_no", F.col("page_no") * STRETCHES + F.col("block_no")).drop("block_no")
    paras = layout.paragraphs(stretch).withColumn("block_no", F.col("page_no") % STRETCHES).withColumn("page_no", F.expr(f"page_no div {STRETCHES}").cast("int"))
    numbered = paras.withColumn("para_no", F.col("block_no") * STRETCHES + F.col("para_no"))
    blocks = layout.list_groups(layout.list_items(layout.headings(numbered)))

    def listed(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
        return df.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias(name))

    images = good.select("doc_id", "page_no", "height", F.explode("images").alias("g")).select("doc_id", "page_no", "g.name", "g.x0", (F.col("height") - F.col("g.y1")).alias("y0"), "g.x1", (F.col("height") - F.col("g.y0")).alias("y1"), "g.format", "g.content")
    out = good.groupBy("doc_id").agg(F.first("meta", ignorenulls=True).alias("meta"), F.collect_list(F.struct("page_no", "width", "height")).alias("pages"))
    box = ["page_no", "x0", "y0", "x1", "y1"]
    for df, name, columns in (
        (blocks, "paras", [*box, "block_no", "para_no", "ws", "heading_level", "list_kind", "list_level", "list_marker", "alignment"]),
        (cells, "cells", [*box, "row", "col", "row_span", "col_span", "ws"]), (placed.where("region <> 'body'"), "margins", [*box, "region", "ws"]),
        (vectors, "vectors", [*box, "svg_path", "fill_rgb", "stroke_rgb", "stroke_width", "fill_rule", "dash", "fill_alpha", "stroke_alpha"]), (images, "images", [*box, "name", "format", "content"]),
    ):
        out = out.join(listed(df, name, columns), "doc_id", "left")
    return out


def _document(row: dict, placed: bool = False) -> dict:
    meta = dict(row["meta"] or [])
    return assembled(meta.get("Title") or f"Document {row['doc_id']}", meta, *[row[k] or [] for k in ("pages", "paras", "cells", "margins", "vectors", "images")], placed)


def rendered(pages: DataFrame, name: str, mode: str = "flow", images: bool = True, vectors: bool = True) -> DataFrame:
    """(doc_id, content): each document in a format, as bytes; without images or vectors where those are False."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 20) for i in range(0, whole.num_rows, 20)):
                out = []
                for row in b.to_pylist():
                    d = _document(row, mode == "canvas" or name == "svg")
                    for p in d["pages"]:
                        p["blocks"] = [x for x in p["blocks"] if (images or x["kind"] != "image") and (vectors or x["kind"] != "vector")]
                    out.append(rich.TEXT_FORMATS[name](d, mode).encode() if name in rich.TEXT_FORMATS else rich_packages.WRITERS[name](d, mode))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return parts(pages).mapInArrow(run, "doc_id long, content binary")


def checked(pages: DataFrame) -> DataFrame:
    """(doc_id, violations): what is wrong with each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([rich.violations(_document(r)) for r in b.to_pylist()], pa.list_(pa.string()))], names=["doc_id", "violations"])

    return parts(pages).mapInArrow(run, "doc_id long, violations array<string>")


def as_json(d: dict) -> str:
    """A document as JSON, bytes as base64."""
    import base64

    return json.dumps(d, default=lambda b: base64.b64encode(bytes(b)).decode(), ensure_ascii=False, sort_keys=True)
