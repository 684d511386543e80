"""Documents with runs, tables, images and vectors to text formats. A document is a value of DOCUMENT, rendered whole in a worker.

Blocks come in reading order; runs are stretches of one style; a table's cells have their places and spans. Everything is
in points from the top left of the page. Packages are in rich_packages.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from itertools import groupby
from operator import itemgetter

from quillwork.functions import mathtext
from quillwork.functions.text import LATEX, MONOSPACE

RUN = "struct<text:string,font:string,size:double,color:int,bold:boolean,italic:boolean,underline:boolean,strike:boolean,script:string,baseline:double>"
CELL = f"struct<row:int,col:int,row_span:int,col_span:int,x0:double,y0:double,x1:double,y1:double,runs:array<{RUN}>>"
BLOCK = (
    f"struct<block_no:int,kind:string,x0:double,y0:double,x1:double,y1:double,runs:array<{RUN}>,heading_level:int,list_kind:string,list_level:int,list_marker:string,alignment:string,"
    f"cells:array<{CELL}>,content:binary,format:string,alt:string,svg_path:string,fill_rgb:int,stroke_rgb:int,stroke_width:double,fill_rule:string,dash:array<double>,fill_alpha:double,stroke_alpha:double>"
)
DOCUMENT = f"struct<title:string,meta:map<string,string>,pages:array<struct<page_no:int,width:double,height:double,header:array<{BLOCK}>,footer:array<{BLOCK}>,blocks:array<{BLOCK}>>>>"
# Marks of list items at the start of a text, and addresses that become links.
MARKER = re.compile(r"^\s*(?:[•◦▪‣·*–—-]|\(?\d+[.)]|\(?[A-Za-z][.)])\s+")
ADDRESS = re.compile(r"^(?:https?://|mailto:|www\.)\S+$|^[\w.+-]+@[\w-]+\.[\w.]+$")
_MONO = re.compile(MONOSPACE)
NUMBER = re.compile(r"^[$€£¥₽₹]?\s*-?\d{1,3}(?:,?\d{3})*(?:\.\d+)?\s*%?$")


def hex_color(rgb: int | None) -> str:
    return f"{rgb or 0:06x}"


def num(x: float) -> str:
    return f"{x:.2f}".rstrip("0").rstrip(".")


def remembered(*names: str) -> Callable:
    """For renderers of runs: what came of the last short runs, by the fields that show. Words come again and again."""
    fields = itemgetter("text", "font", "bold", "italic", "underline", "strike", "script", *names)

    def wrap(f: Callable[[dict], str]) -> Callable[[dict], str]:
        known: dict[tuple, str] = {}

        @wraps(f)
        def run(r: dict) -> str:
            key = fields(r)
            t = known.get(key)
            if t is None:
                t = f(r)
                if len(known) >= 1 << 16:
                    known.clear()
                if len(key[0]) <= 64:
                    known[key] = t
            return t

        return run

    return wrap


_NO_XML = re.compile("[\0-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def xml(text: str) -> str:
    text = _NO_XML.sub("", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")


@lru_cache(256)
def is_mono(font: str | None) -> bool:
    return bool(_MONO.search(re.sub(r"[-_ ]", "", (font or "").lower())))


@lru_cache(256)
def is_math(font: str | None) -> bool:
    return bool(re.search(r"cmsy|cmmi|cmex|msbm|lmmi|stix.*math|cambria ?math|^symbol", (font or "").lower()))


def link_of(text: str) -> str | None:
    text = text.strip()
    if not ADDRESS.match(text):
        return None
    return f"http://{text}" if text.startswith("www.") else f"mailto:{text}" if "@" in text and ":" not in text else text


def parted(text: str) -> tuple[str, str, str]:
    """Outer white space, which styles don't cover, and what is between."""
    core = text.strip()
    at = text.find(core) if core else len(text)
    return text[:at], core, text[at + len(core) :]


def text_of(runs: list[dict] | None) -> str:
    return "".join(r["text"] for r in runs or [])


def is_code(b: dict) -> bool:
    """A paragraph of monospaced runs only, neither heading nor item."""
    runs = [r for r in b["runs"] or [] if r["text"].strip()]
    return bool(runs) and not b["heading_level"] and not b["list_kind"] and all(is_mono(r["font"]) for r in runs)


def item_runs(b: dict) -> list[dict]:
    """An item's runs without the marker that its text starts with."""
    runs = [dict(r) for r in b["runs"] or []]
    mark = (b["list_marker"] or "").strip()
    left = len(runs and text_of(runs)) - len(text_of(runs).lstrip())
    m = MARKER.match(text_of(runs))
    gone = left + len(mark) if mark and text_of(runs).lstrip().startswith(mark) else m.end() if m else 0
    for r in runs:
        take = min(gone, len(r["text"]))
        r["text"], gone = r["text"][take:], gone - take
    runs = [r for r in runs if r["text"]]
    if runs:
        runs[0]["text"] = runs[0]["text"].lstrip()
    return runs


def rows_of(cells: list[dict]) -> list[list[dict]]:
    """A table's rows of cells, each in order of column."""
    n = 1 + max((c["row"] + c["row_span"] - 1 for c in cells), default=-1)
    return [sorted((c for c in cells if c["row"] == r), key=lambda c: c["col"]) for r in range(n)]


def n_cols(cells: list[dict]) -> int:
    return max((c["col"] + c["col_span"] for c in cells), default=0)


def occupancy(cells: list[dict]) -> list[list[tuple[dict | None, str]]]:
    """The grid of a table: for each place its cell and whether it begins there, goes on to the right or comes from above."""
    rows = rows_of(cells)
    grid: list[list[tuple[dict | None, str]]] = [[(None, "empty")] * n_cols(cells) for _ in rows]
    for c in cells:
        for r in range(c["row"], min(len(rows), c["row"] + c["row_span"])):
            for k in range(c["col"], c["col"] + c["col_span"]):
                grid[r][k] = (c, "start" if (r, k) == (c["row"], c["col"]) else "right" if r == c["row"] else "below")
    return grid


def matrix(cells: list[dict]) -> list[list[str]]:
    """Cell texts in a full grid; places that a span covers are empty."""
    return [[text_of(c["runs"]).strip() if c and kind == "start" else "" for c, kind in row] for row in occupancy(cells)]


def column_votes(cells: list[dict]) -> list[str]:
    """right for columns of which half the filled cells below the first row, at least, are numbers; else left."""
    grid = matrix(cells)
    out = []
    for k in range(n_cols(cells)):
        own = [r[k] for r in (grid[1:] or grid) if r[k]]
        out.append("right" if own and 2 * sum(bool(NUMBER.match(x)) for x in own) >= len(own) else "left")
    return out


def widths(cells: list[dict], total: float | None = None) -> list[float]:
    """Column widths from the cells' boxes, columns without one alike, scaled to `total` if given."""
    n = n_cols(cells)
    own = [0.0] * n
    for c in cells:
        if c["col_span"] == 1 and c["x1"] is not None:
            own[c["col"]] = max(own[c["col"]], c["x1"] - c["x0"])
    known = [w for w in own if w > 0]
    own = [w or (sum(known) / len(known) if known else 72.0) for w in own]
    return [w * total / sum(own) for w in own] if total and own else own


def data_uri(b: dict) -> str:
    kind = {"jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}.get(b["format"] or "png", "image/png")
    return f"data:{kind};base64,{base64.b64encode(bytes(b['content'] or b'')).decode()}"


# Markdown.
@remembered()
def md_run(r: dict) -> str:
    lead, t, trail = parted(r["text"])
    if not t:
        return r["text"]
    if is_mono(r["font"]):
        ticks = "`" * (1 + max(map(len, re.findall("`+", t)), default=0))
        return f"{lead}{ticks}{t}{ticks}{trail}"
    link = link_of(t)
    if link:
        return f"{lead}<{t}>{trail}" if link == t else f"{lead}[{t}]({link}){trail}"
    mark = "***" if r["bold"] and r["italic"] else "**" if r["bold"] else "*" if r["italic"] else ""
    t = f"{mark}{t}{mark}"
    if r["strike"]:
        t = f"~~{t}~~"
    if r["underline"]:
        t = f"<u>{t}</u>"
    if r["script"]:
        t = f"<{r['script']}>{t}</{r['script']}>"
    return f"{lead}{t}{trail}"


def md_cell(runs: list[dict] | None) -> str:
    return "".join(map(md_run, runs or [])).strip().replace("\r\n", "\n").replace("\n", "<br>").replace("|", "\\|")


def md_table(cells: list[dict]) -> str:
    grid = [[md_cell(c["runs"]) if c and kind == "start" else "" for c, kind in row] for row in occupancy(cells)]
    if not grid:
        return ""
    votes = column_votes(cells)
    wide = [max(3, *[len(r[k]) for r in grid]) for k in range(len(votes))]
    line = lambda row: "| " + " | ".join(x.rjust(w) if v == "right" else x.ljust(w) for x, w, v in zip(row, wide, votes, strict=True)) + " |"
    rule = ["-" * (w - 1) + ":" if v == "right" else ":" + "-" * (w - 1) for w, v in zip(wide, votes, strict=True)]
    return "\n".join([line(grid[0]), "| " + " | ".join(rule) + " |", *map(line, grid[1:])])


def md_block(b: dict) -> str:
    if b["kind"] == "table":
        return md_table(b["cells"])
    if b["kind"] == "image":
        return f"![{b['alt'] or 'Image'}]({data_uri(b)})" if b["content"] else ""
    if b["kind"] != "paragraph":
        return ""
    if b["heading_level"]:
        return "#" * b["heading_level"] + " " + text_of(b["runs"]).strip()
    if b["list_kind"]:
        number = re.sub(r"[.)]+$|^\(+", "", b["list_marker"] or "")
        lead = (f"{number}." if number.isdigit() else b["list_marker"]) if b["list_kind"] == "ordered" else "-"
        return "  " * (b["list_level"] or 0) + f"{lead} " + "".join(map(md_run, b["runs"] or [])).strip()  # the text keeps its marker
    return "".join(map(md_run, b["runs"] or [])).strip()


def fenced(code: str) -> str:
    fence = "`" * max(3, 1 + max(map(len, re.findall("`+", code)), default=0))
    return f"{fence}\n{code}\n{fence}"


def merged(blocks: list[dict], block: Callable[[dict], str], code: Callable[[str], str]) -> list[str]:
    """Rendered blocks; neighbouring paragraphs of code are one."""
    out = []
    for is_c, own in groupby(blocks, key=lambda b: b["kind"] == "paragraph" and is_code(b)):
        own = list(own)
        out += [code("\n".join(text_of(b["runs"]) for b in own))] if is_c else [block(b) for b in own]
    return [x for x in out if x]


def front_matter(meta: dict) -> str:
    rows = [f'{k}: "{_quoted(v)}"' for k, v in sorted(meta.items()) if v]
    return "---\n" + "\n".join(rows) + "\n---\n\n" if rows else ""


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t")


def markdown(d: dict, mode: str = "flow") -> str:
    pages = ["\n\n".join(merged(p["blocks"], md_block, fenced)) for p in d["pages"]]
    return front_matter(d["meta"] or {}) + "\n\n---\n\n".join(p for p in pages if p)


# HTML and XHTML.
def html_run(r: dict, canvas: bool = False) -> str:
    t = xml(r["text"]).replace("\n", "<br/>")
    if not r["text"].strip():
        return t
    if is_mono(r["font"]):
        t = f"<code>{t}</code>"
    for on, tag in ((r["bold"], "strong"), (r["italic"], "em"), (r["underline"], "u"), (r["strike"], "s"), (r["script"], r["script"])):
        if on:
            t = f"<{tag}>{t}</{tag}>"
    style = [f"color:#{hex_color(r['color'])}"] if r["color"] else []
    if canvas:
        style += [f"font-size:{num(r['size'] or 12)}pt", *([f"font-family:'{xml(r['font'])}'"] if r["font"] else [])]
    if style:
        t = f'<span style="{";".join(style)}">{t}</span>'
    link = link_of(r["text"])
    return f'<a href="{xml(link)}">{t}</a>' if link else t


@remembered("color")
def html_flow_run(r: dict) -> str:
    return html_run(r)


def html_runs(runs: list[dict] | None, canvas: bool = False) -> str:
    return "".join([html_run(r, True) for r in runs or []] if canvas else map(html_flow_run, runs or [])).strip()


def html_table(cells: list[dict], style: str = "") -> str:
    def row(own: list[dict], tag: str) -> str:
        span = lambda c: "".join(f' {k}="{c[f]}"' for k, f in (("colspan", "col_span"), ("rowspan", "row_span")) if c[f] > 1)
        return "<tr>" + "".join(f"<{tag}{span(c)}>{html_runs(c['runs'])}</{tag}>" for c in own) + "</tr>"

    rows = rows_of(cells)
    head = 1 if len(rows) > 1 else 0
    top = f"<thead>\n{row(rows[0], 'th')}\n</thead>\n" if head else ""
    return f"<table{style}>\n{top}<tbody>\n" + "\n".join(row(r, "td") for r in rows[head:]) + "\n</tbody>\n</table>"


def svg_path(b: dict, dx: float = 0.0, dy: float = 0.0) -> str:
    """A path with what differs from the defaults of SVG."""
    look = [f'fill="{"#" + hex_color(b["fill_rgb"]) if b["fill_rgb"] is not None else "none"}"']
    if b["stroke_rgb"] is not None:
        look += [f'stroke="#{hex_color(b["stroke_rgb"])}"', f'stroke-width="{num(b["stroke_width"] or 1)}"']
    if b["fill_rule"] == "evenodd":
        look.append('fill-rule="evenodd"')
    if b["dash"]:
        look.append(f'stroke-dasharray="{" ".join(map(num, b["dash"]))}"')
    look += [f'{k}="{num(b[f])}"' for k, f in (("fill-opacity", "fill_alpha"), ("stroke-opacity", "stroke_alpha")) if b[f] is not None and b[f] < 1]
    if dx or dy:
        look.append(f'transform="translate({num(dx)} {num(dy)})"')
    return f'<path d="{b["svg_path"]}" {" ".join(look)}/>'


def html_vector(b: dict) -> str:
    w, h = max(1.0, b["x1"] - b["x0"]), max(1.0, b["y1"] - b["y0"])
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{num(w)}pt" height="{num(h)}pt" viewBox="{num(b["x0"])} {num(b["y0"])} {num(w)} {num(h)}">{svg_path(b)}</svg>'


def html_block(b: dict, image: Callable[[dict], str] = data_uri) -> str:
    if b["kind"] == "table":
        return html_table(b["cells"])
    if b["kind"] == "image":
        return f'<figure><img src="{image(b)}" alt="{xml(b["alt"] or "Image")}" width="{round(b["x1"] - b["x0"])}"/></figure>' if b["content"] else ""
    if b["kind"] == "vector":
        return html_vector(b)
    inner = html_runs(b["runs"])
    if not inner:
        return ""
    if b["heading_level"]:
        return f"<h{b['heading_level']}>{html_runs([r | {'bold': False} for r in b['runs']])}</h{b['heading_level']}>"
    style = f' style="text-align:{b["alignment"]}"' if b["alignment"] in ("center", "right") else ""
    return f"<p{style}>{inner}</p>"


def html_blocks(blocks: list[dict], image: Callable[[dict], str] = data_uri, block: Callable[[dict], str] | None = None) -> Iterator[str]:
    """Blocks with runs of list items as nested lists and runs of code as one block."""
    block = block or (lambda b: html_block(b, image))
    for kind, own in groupby(blocks, key=lambda b: "list" if b["kind"] == "paragraph" and b["list_kind"] else "code" if b["kind"] == "paragraph" and is_code(b) else ""):
        own = list(own)
        if kind == "list":
            yield html_list(own)
        elif kind == "code":
            yield "<pre><code>" + xml("\n".join(text_of(b["runs"]) for b in own)) + "</code></pre>"
        else:
            yield from filter(None, map(block, own))


def html_list(items: list[dict]) -> str:
    """Items with their levels as lists in lists."""
    out, open_ = [], []
    for b in items:
        tag, level = "ol" if b["list_kind"] == "ordered" else "ul", b["list_level"] or 0
        while open_ and (open_[-1][1] > level or open_[-1][1] == level and open_[-1][0] != tag):
            out.append(f"</li>\n</{open_.pop()[0]}>")
        if open_ and open_[-1] == (tag, level):
            out.append("</li>")
        else:
            out.append(f"<{tag}>")
            open_.append((tag, level))
        out.append(f"<li>{html_runs(item_runs(b))}")
    while open_:
        out.append(f"</li>\n</{open_.pop()[0]}>")
    return "\n".join(out).replace("\n</li>", "</li>")


FLOW_CSS = "body{max-width:48em;margin:2em auto;font-family:serif}table{border-collapse:collapse}td,th{border:1px solid #888;padding:.2em .5em}pre{background:#f4f4f4;padding:.5em}@media print{body{margin:0}}"
CANVAS_CSS = "body{margin:0;background:#ddd}.page{position:relative;margin:1em auto;background:#fff;overflow:hidden}.page>*{position:absolute;margin:0;white-space:pre}@media print{.page{margin:0;page-break-after:always}}"


def html_page(title: str, meta: dict, css: str, body: str) -> str:
    tags = "".join(f'\n<meta name="{xml(k.lower())}" content="{xml(v)}">' for k, v in sorted((meta or {}).items()) if v and k.lower() in ("author", "subject", "keywords", "creator", "producer"))
    policy = "default-src 'none'; img-src data:; style-src 'unsafe-inline'"
    return f'<!DOCTYPE html>\n<html lang="{xml((meta or {}).get("Lang") or "en")}">\n<head>\n<meta charset="utf-8">\n<meta http-equiv="Content-Security-Policy" content="{policy}">{tags}\n<title>{xml(title)}</title>\n<style>{css}</style>\n</head>\n<body>\n{body}\n</body>\n</html>\n'


def _placed(b: dict, tag: str, inner: str, more: str = "") -> str:
    return f'<{tag} style="left:{num(b["x0"])}pt;top:{num(b["y0"])}pt;width:{num(max(1.0, b["x1"] - b["x0"]))}pt;height:{num(max(1.0, b["y1"] - b["y0"]))}pt{more}">{inner}</{tag}>'


def canvas_page(p: dict) -> str:
    """Layers from below: vectors, images, tables, header, body, footer."""
    kind = lambda k: [b for b in p["blocks"] if b["kind"] == k]
    paths = "".join(map(svg_path, kind("vector")))
    out = [f'<svg style="left:0;top:0" width="{num(p["width"])}pt" height="{num(p["height"])}pt" viewBox="0 0 {num(p["width"])} {num(p["height"])}">{paths}</svg>'] if paths else []
    out += [_placed(b, "div", f'<img src="{data_uri(b)}" alt="{xml(b["alt"] or "Image")}" style="width:100%;height:100%"/>') for b in kind("image") if b["content"]]
    out += [_placed(b, "div", html_table(b["cells"], ' style="width:100%;height:100%"')) for b in kind("table")]
    for own in (p["header"], kind("paragraph"), p["footer"]):
        out += [_placed(b, "div", html_runs(b["runs"], True), f";text-align:{b['alignment']}" if b["alignment"] in ("center", "right") else "") for b in own or []]
    return f'<div class="page" id="page-{p["page_no"]}" style="width:{num(p["width"])}pt;height:{num(p["height"])}pt">\n' + "\n".join(out) + "\n</div>"


def html(d: dict, mode: str = "flow") -> str:
    if mode == "canvas":
        return html_page(d["title"], d["meta"], CANVAS_CSS, "\n".join(map(canvas_page, d["pages"])))
    body = [f'<section id="page-{p["page_no"]}">\n' + "\n".join(html_blocks(p["blocks"])) + "\n</section>" for p in d["pages"]]
    return html_page(d["title"], d["meta"], FLOW_CSS, "\n".join(body))


# LaTeX.
_LATEX = str.maketrans({**{chr(i): None for i in range(32) if chr(i) != "\n"}, "\t": LATEX.get(" ", " "), **{k: v for k, v in LATEX.items() if k >= " " or k == "\n"}})


def latex_text(text: str) -> str:
    return text.translate(_LATEX).replace("\n", " \\\\\n")


@remembered("color")
def latex_run(r: dict) -> str:
    lead, t, trail = parted(r["text"])
    if not t:
        return r["text"]
    link = link_of(t)
    if link:
        return lead + "\\url{" + t.replace("\\", "/").replace("{", "%7B").replace("}", "%7D").replace("%", "\\%").replace("#", "\\#") + "}" + trail
    t = latex_text(t)
    for on, name in ((is_mono(r["font"]), "texttt"), (r["italic"], "textit"), (r["bold"], "textbf"), (r["underline"], "underline"), (r["strike"], "sout"), (r["script"], {"sup": "textsuperscript", "sub": "textsubscript"}.get(r["script"] or ""))):
        if on:
            t = f"\\{name}{{{t}}}"
    c = r["color"] or 0
    if (c >> 16) + (c >> 8 & 255) + (c & 255) > 45:
        t = f"\\textcolor[HTML]{{{hex_color(c).upper()}}}{{{t}}}"
    return lead + t + trail


def latex_runs(runs: list[dict] | None) -> str:
    return mathtext.math_runs(runs or [], latex_run, is_math)[0].strip()


def latex_table(cells: list[dict]) -> str:
    votes, out = column_votes(cells), []
    for row in occupancy(cells):
        parts, k = [], 0
        while k < len(row):
            c, kind = row[k]
            if c and kind == "start":
                t = latex_runs(c["runs"])
                if c["row_span"] > 1:
                    t = f"\\multirow{{{c['row_span']}}}{{*}}{{{t}}}"
                if c["col_span"] > 1:
                    t = f"\\multicolumn{{{c['col_span']}}}{{|c|}}{{{t}}}"
                parts.append(t)
                k += c["col_span"]
            elif c and kind == "below":
                parts.append(f"\\multicolumn{{{c['col_span']}}}{{|c|}}{{}}" if c["col_span"] > 1 else "")
                k += c["col_span"]
            else:
                parts.append("")
                k += 1
        out.append(" & ".join(parts) + " \\\\ \\hline")
    return "\\begin{tabular}{|" + "|".join(v[0] for v in votes) + "|}\n\\hline\n" + "\n".join(out) + "\n\\end{tabular}"


def latex_code(code: str) -> str:
    return f"\\begin{{verbatim}}\n{code}\n\\end{{verbatim}}" if "\\end{verbatim}" not in code else "\\begin{quote}\\ttfamily\n" + latex_text(code) + "\n\\end{quote}"


def latex_block(b: dict) -> str:
    if b["kind"] == "table":
        return latex_table(b["cells"])
    if b["kind"] == "image":
        return f"\\begin{{center}}\\fbox{{{latex_text(b['alt'] or 'Image')}}}\\end{{center}}"
    if b["kind"] != "paragraph":
        return ""
    t = latex_runs(b["runs"])
    if b["heading_level"]:
        name = ("section", "subsection", "subsubsection", "paragraph", "subparagraph", "subparagraph")[b["heading_level"] - 1]
        return f"\\{name}{{{latex_runs([r | {'bold': False} for r in b['runs']])}}}"
    around = {"center": "center", "right": "flushright"}.get(b["alignment"] or "")
    return f"\\begin{{{around}}}\n{t}\n\\end{{{around}}}" if around and t else t


def latex_blocks(blocks: list[dict]) -> Iterator[str]:
    for kind, own in groupby(blocks, key=lambda b: b["list_kind"] if b["kind"] == "paragraph" and b["list_kind"] else "code" if b["kind"] == "paragraph" and is_code(b) else ""):
        own = list(own)
        if kind in ("ordered", "bullet"):
            name = "enumerate" if kind == "ordered" else "itemize"
            yield f"\\begin{{{name}}}\n" + "\n".join(f"\\item {latex_runs(item_runs(b))}" for b in own) + f"\n\\end{{{name}}}"
        elif kind == "code":
            yield latex_code("\n".join(text_of(b["runs"]) for b in own))
        else:
            yield from filter(None, map(latex_block, own))


def modal(d: dict, key: Callable[[dict], object]) -> object:
    """What most characters of a document's runs have; the first seen among equals."""
    seen: dict[object, int] = {}
    for p in d["pages"]:
        for b in p["blocks"]:
            for r in b["runs"] or []:
                seen[key(r)] = seen.get(key(r), 0) + len(r["text"])
    return max(seen, key=seen.get) if seen else None


def latex(d: dict, mode: str = "flow") -> str:
    size = modal(d, lambda r: r["size"]) or 11
    points = 10 if size < 10.5 else 11 if size < 11.5 else 12
    meta, head = d["meta"] or {}, []
    if meta.get("Title"):
        head.append(f"\\title{{{latex_text(meta['Title'])}}}")
    if meta.get("Author"):
        head.append("\\author{" + " \\and ".join(latex_text(a.strip()) for a in meta["Author"].split(";")) + "}")
    info = [f"pdf{k.lower()}={{{latex_text(meta[k])}}}" for k in ("Title", "Author", "Subject", "Keywords") if meta.get(k)]
    if info:
        head.append("\\hypersetup{" + ",".join(info) + "}")
    names = "\n".join(f"\\usepackage{x}" for x in ("[utf8]{inputenc}", "[T1]{fontenc}", "{textcomp}", "{amsmath}", "{amssymb}", "{multirow}", "{xcolor}", "[normalem]{ulem}", "{graphicx}", "{hyperref}"))
    pages = "\n\n\\newpage\n\n".join("\n\n".join(latex_blocks(p["blocks"])) for p in d["pages"])
    return f"\\documentclass[{points}pt]{{article}}\n{names}\n" + "".join(x + "\n" for x in head) + f"\\begin{{document}}\n\n{pages}\n\n\\end{{document}}\n"


# Typst.
_TYPST = re.compile(r"([\\#*_`$<>@\[\]~])")


def typst_text(text: str) -> str:
    aside = re.sub(r"/(?=[/*])", "\ue000", "".join(c for c in text if c >= " " or c in "\t\n"))
    return _TYPST.sub(r"\\\1", aside).replace("\ue000", "\\/").replace("\n", " \\\n").replace("\t", "  ")


@remembered("color")
def typst_run(r: dict) -> str:
    lead, t, trail = parted(r["text"])
    if not t:
        return r["text"]
    link = link_of(t)
    if is_mono(r["font"]):
        t = f'#raw("{_quoted(t)}")'
    else:
        t = typst_text(t)
    for on, name in ((r["bold"], "strong"), (r["italic"], "emph"), (r["underline"], "underline"), (r["strike"], "strike"), (r["script"], {"sup": "super", "sub": "sub"}.get(r["script"] or ""))):
        if on:
            t = f"#{name}[{t}]"
    if r["color"]:
        t = f'#text(fill: rgb("#{hex_color(r["color"])}"))[{t}]'
    return lead + (f'#link("{_quoted(link)}")[{t}]' if link else t) + trail


def typst_runs(runs: list[dict] | None) -> str:
    return mathtext.math_runs(runs or [], typst_run, is_math, "typst")[0].strip()


def typst_table(cells: list[dict]) -> str:
    votes = column_votes(cells)
    rows = []
    for r in rows_of(cells):
        span = lambda c: ", ".join(f"{k}: {c[f]}" for k, f in (("colspan", "col_span"), ("rowspan", "row_span")) if c[f] > 1)
        rows.append("  " + ", ".join(f"table.cell({span(c)})[{typst_runs(c['runs'])}]" if span(c) else f"[{typst_runs(c['runs'])}]" for c in r) + ",")
    return f"#table(\n  columns: {len(votes)},\n  align: ({', '.join(votes)},),\n" + "\n".join(rows) + "\n)"


def typst_block(b: dict) -> str:
    if b["kind"] == "table":
        return typst_table(b["cells"])
    if b["kind"] == "image":
        return f'#rect(width: {num(b["x1"] - b["x0"])}pt, height: {num(b["y1"] - b["y0"])}pt)[{typst_text(b["alt"] or "Image")}]'
    if b["kind"] != "paragraph":
        return ""
    if b["heading_level"]:
        return "=" * b["heading_level"] + " " + typst_runs([r | {"bold": False} for r in b["runs"]])
    if b["list_kind"]:
        return "  " * (b["list_level"] or 0) + ("+ " if b["list_kind"] == "ordered" else "- ") + typst_runs(item_runs(b))
    t = typst_runs(b["runs"])
    return f"#align({b['alignment']})[{t}]" if b["alignment"] in ("center", "right") and t else t


def typst(d: dict, mode: str = "flow") -> str:
    meta, first = d["meta"] or {}, d["pages"][0] if d["pages"] else {"width": 612.0, "height": 792.0}
    info = [f'{k}: "{_quoted(meta[m])}"' for k, m in (("title", "Title"), ("author", "Author"), ("keywords", "Keywords")) if meta.get(m)]
    head = ["#set document(" + ", ".join(info) + ")"] if info else []
    head.append(f"#set page(width: {num(first['width'])}pt, height: {num(first['height'])}pt)")
    font, size = modal(d, lambda r: r["font"]), modal(d, lambda r: r["size"])
    if font and size:
        head.append(f'#set text(font: "{_quoted(str(font))}", size: {num(min(36.0, max(6.0, float(size))))}pt)')
    pages = ["\n\n".join(merged(p["blocks"], typst_block, fenced)) for p in d["pages"]]
    return "\n".join(head) + "\n\n" + "\n\n#pagebreak()\n\n".join(pages) + "\n"


# RTF.
FAMILIES = {"swiss": "helvetica|arial|calibri|verdana|sans", "modern": MONOSPACE, "roman": "times|serif|georgia|garamond|palatino|roman|cmr"}
RTF_ALIASES = {"helvetica": "Arial", "times": "Times New Roman", "courier": "Courier New", "timesroman": "Times New Roman"}


def rtf_font(name: str | None) -> tuple[str, str]:
    """A font's name as word processors know it, and its family."""
    clean = (name or "Calibri").strip()
    clean = RTF_ALIASES.get(re.sub(r"[-_ ]", "", clean.lower()), clean)
    return clean, next((f for f, p in FAMILIES.items() if re.search(p, clean.lower().replace(" ", ""))), "nil")


def rtf_text(text: str) -> str:
    out = []
    for c in text:
        if c in "\\{}":
            out.append("\\" + c)
        elif c in "\n\t":
            out.append("\\line " if c == "\n" else "\\tab ")
        elif " " <= c < "\x7f":
            out.append(c)
        elif ord(c) > 127:
            units = c.encode("utf-16-be", "replace")
            out += [f"\\u{int.from_bytes(units[i : i + 2], 'big', signed=True)}?" for i in range(0, len(units), 2)]
    return "".join(out)


class Rtf:
    """Font and colour tables in the order of first use, from a pass over the document before it is written."""

    def __init__(self, d: dict) -> None:
        self.fonts, self.colors = {rtf_font(None)[0].lower(): 0}, {0: 1}
        self.names = [rtf_font(None)]
        for p in d["pages"]:
            for b in [*(p["header"] or []), *p["blocks"], *(p["footer"] or [])]:
                for r in [*(b["runs"] or []), *[r for c in b["cells"] or [] for r in c["runs"] or []]]:
                    self.font(r["font"])
                    self.colors.setdefault(r["color"] or 0, len(self.colors) + 1)

    def font(self, name: str | None) -> int:
        own = rtf_font(name)
        if own[0].lower() not in self.fonts:
            self.fonts[own[0].lower()] = len(self.fonts)
            self.names.append(own)
        return self.fonts[own[0].lower()]

    def run(self, r: dict) -> str:
        look = f"\\f{self.font(r['font'])}\\fs{round((r['size'] or 11) * 2)}" + "".join(c for k, c in (("bold", "\\b"), ("italic", "\\i"), ("underline", "\\ul"), ("strike", "\\strike")) if r[k])
        look += {"sup": "\\super", "sub": "\\sub"}.get(r["script"] or "", "")
        if r["color"]:
            look += f"\\cf{self.colors.get(r['color'], 1)}"
        return f"{{{look} {rtf_text(r['text'])}}}"

    def paragraph(self, b: dict) -> str:
        align = {"center": "\\qc", "right": "\\qr", "justified": "\\qj"}.get(b["alignment"] or "", "\\ql")
        level = f"\\s{b['heading_level']}\\outlinelevel{b['heading_level'] - 1}" if b["heading_level"] else ""
        indent = f"\\li{360 * ((b['list_level'] or 0) + 1)}\\fi-360" if b["list_kind"] else ""
        return f"{{\\pard{level}{align}{indent} {''.join(map(self.run, b['runs'] or []))}\\par}}"

    def table(self, cells: list[dict]) -> str:
        at, edges = 0.0, []
        for w in widths(cells):
            at += w * 20
            edges.append(round(min(at, 9360) if at <= 9360 else at))
        if edges and edges[-1] > 9360:
            edges = [round(e * 9360 / edges[-1]) for e in edges]
        out, border = [], "".join(f"\\clbrdr{s}\\brdrs\\brdrw10" for s in "tlbr")
        for row in occupancy(cells):
            defs, texts = [], []
            for k, (c, kind) in enumerate(row):
                merge = ""
                if c and c["row_span"] > 1:
                    merge += "\\clvmgf" if kind != "below" else "\\clvmrg"
                if c and c["col_span"] > 1:
                    merge += "\\clmgf" if k == c["col"] else "\\clmrg"
                defs.append(f"{merge}{border}\\cellx{edges[k]}")
                texts.append("\\pard\\intbl " + ("".join(map(self.run, c["runs"] or [])) if c and kind == "start" else "") + "\\cell")
            out.append("\\trowd\\trgaph108" + "".join(defs) + "\n" + "".join(texts) + "\\row")
        return "\n".join(out) + "\n\\pard"

    def picture(self, b: dict) -> str:
        if b["format"] not in ("png", "jpeg") or not b["content"]:
            return f"{{\\pard\\ql [{rtf_text(b['alt'] or 'Image')}]\\par}}"
        w, h = max(1.0, b["x1"] - b["x0"]) * 20, max(1.0, b["y1"] - b["y0"]) * 20
        scale = min(1.0, 9360 / w)
        raw = bytes(b["content"]).hex()
        lines = "\n".join(raw[i : i + 128] for i in range(0, len(raw), 128))
        return f"{{\\pard\\qc{{\\pict\\{'pngblip' if b['format'] == 'png' else 'jpegblip'}\\picwgoal{round(w * scale)}\\pichgoal{round(h * scale)}\n{lines}}}\\par}}"

    def block(self, b: dict) -> str:
        return {"table": lambda: self.table(b["cells"]), "image": lambda: self.picture(b), "paragraph": lambda: self.paragraph(b) if text_of(b["runs"]).strip() else ""}.get(b["kind"], lambda: "")()


def rtf(d: dict, mode: str = "flow") -> str:
    own, meta = Rtf(d), d["meta"] or {}
    fonts = "".join(f"{{\\f{i}\\f{f}\\fcharset0 {rtf_text(n)};}}" for i, (n, f) in enumerate(own.names))
    colors = ";" + "".join(f"\\red{c >> 16}\\green{c >> 8 & 255}\\blue{c & 255};" for c in own.colors)
    styles = "{\\s0 Normal;}" + "".join(f"{{\\s{i}\\b\\fs{fs} heading {i};}}" for i, fs in enumerate((32, 28, 26, 24, 22, 22), 1))
    info = "".join(f"{{\\{k} {rtf_text(meta[m])}}}" for k, m in (("title", "Title"), ("author", "Author"), ("subject", "Subject"), ("keywords", "Keywords")) if meta.get(m))
    size = lambda p: (round(p["width"] * 20), round(p["height"] * 20))
    first = size(d["pages"][0]) if d["pages"] else (12240, 15840)
    out = []
    for i, p in enumerate(d["pages"]):
        if i:
            out.append("\\page" if size(p) == size(d["pages"][i - 1]) else f"\\sect\\sectd\\pgwsxn{size(p)[0]}\\pghsxn{size(p)[1]}")
        out += [x for x in map(own.block, p["blocks"]) if x]
    return f"{{\\rtf1\\ansi\\ansicpg1252\\uc1\\deff0{{\\fonttbl{fonts}}}{{\\colortbl{colors}}}{{\\stylesheet{styles}}}" + (f"{{\\info{info}}}" if info else "") + f"\\paperw{first[0]}\\paperh{first[1]}\n" + "\n".join(out) + "\n}"


# SVG.
def svg_text(b: dict) -> str:
    size = max((r["size"] or 12 for r in b["runs"] or []), default=12)
    span = lambda r: f'<tspan font-size="{num(r["size"] or 12)}"' + "".join(f' {k}="{v}"' for on, k, v in ((r["bold"], "font-weight", "bold"), (r["italic"], "font-style", "italic"), (r["underline"], "text-decoration", "underline"), (r["strike"] and not r["underline"], "text-decoration", "line-through"), (r["color"], "fill", "#" + hex_color(r["color"]))) if on) + f">{xml(r['text'])}</tspan>"
    return f'<text xml:space="preserve" x="{num(b["x0"])}" y="{num(b["y0"] + size)}">{"".join(map(span, b["runs"] or []))}</text>'


def svg_block(b: dict) -> str:
    if b["kind"] == "vector":
        return svg_path(b)
    if b["kind"] == "image":
        return f'<image x="{num(b["x0"])}" y="{num(b["y0"])}" width="{num(b["x1"] - b["x0"])}" height="{num(b["y1"] - b["y0"])}" href="{data_uri(b)}"/>' if b["content"] else ""
    if b["kind"] == "table":
        boxed = [c for c in b["cells"] if c["x1"] is not None]
        return "\n".join(f'<rect x="{num(c["x0"])}" y="{num(c["y0"])}" width="{num(c["x1"] - c["x0"])}" height="{num(c["y1"] - c["y0"])}" fill="none" stroke="#000"/>' + (svg_text(c | {"x0": c["x0"] + 2}) if text_of(c["runs"]).strip() else "") for c in boxed)
    return svg_text(b) if text_of(b["runs"]).strip() else ""


def svg(d: dict, mode: str = "flow", gap: float = 20.0) -> str:
    """One drawing, its pages below each other."""
    at, out = 0.0, []
    for p in d["pages"]:
        body = "\n".join(x for b in [*(p["header"] or []), *sorted(p["blocks"], key=lambda b: b["kind"] != "vector"), *(p["footer"] or [])] if (x := svg_block(b)))
        out.append(f'<g transform="translate(0 {num(at)})">\n{body}\n</g>')
        at += p["height"] + gap
    wide = max((p["width"] for p in d["pages"]), default=612.0)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{num(wide)}" height="{num(max(0.0, at - gap))}" viewBox="0 0 {num(wide)} {num(max(0.0, at - gap))}">\n' + "\n".join(out) + "\n</svg>\n"


# Plain text.
class Grid:
    """A page as a grid of characters, with the directions in which lines leave each place."""

    # Glyphs by directions (1 north, 2 east, 4 south, 8 west).
    GLYPHS = {1: "│", 2: "─", 3: "└", 4: "│", 5: "│", 6: "┌", 7: "├", 8: "─", 9: "┘", 10: "─", 11: "┴", 12: "┐", 13: "┤", 14: "┬", 15: "┼"}

    def __init__(self, width: float, height: float, cell: tuple[float, float] = (6.0, 12.0)) -> None:
        self.cell, self.n = cell, (max(1, int(width / cell[0])), max(1, int(height / cell[1])))
        self.chars: dict[tuple[int, int], str] = {}
        self.lines: dict[tuple[int, int], int] = {}

    def at(self, x: float, y: float) -> tuple[int, int]:
        return max(0, round(x / self.cell[0])), max(0, round(y / self.cell[1]))

    def write(self, col: int, row: int, text: str, until: int | None = None) -> None:
        for i, c in enumerate(text):
            if col + i < min(self.n[0], until if until is not None else self.n[0]) and row < self.n[1]:
                self.chars[row, col + i] = c

    def line(self, c0: int, r0: int, c1: int, r1: int) -> None:
        if r0 == r1:
            for c in range(min(c0, c1), max(c0, c1) + 1):
                self.lines[r0, c] = self.lines.get((r0, c), 0) | (2 if c < max(c0, c1) else 0) | (8 if c > min(c0, c1) else 0)
        elif c0 == c1:
            for r in range(min(r0, r1), max(r0, r1) + 1):
                self.lines[r, c0] = self.lines.get((r, c0), 0) | (4 if r < max(r0, r1) else 0) | (1 if r > min(r0, r1) else 0)
        else:
            steps = max(abs(c1 - c0), abs(r1 - r0))
            mark = "\\" if (c1 - c0) * (r1 - r0) > 0 else "/"
            for i in range(steps + 1):
                self.chars.setdefault((round(r0 + (r1 - r0) * i / steps), round(c0 + (c1 - c0) * i / steps)), mark)

    def box(self, c0: int, r0: int, c1: int, r1: int) -> None:
        for a in ((c0, r0, c1, r0), (c0, r1, c1, r1), (c0, r0, c0, r1), (c1, r0, c1, r1)):
            self.line(*a)

    def text(self) -> str:
        drawn = {k: self.GLYPHS.get(v, " ") for k, v in self.lines.items()} | self.chars
        drawn = {k: v for k, v in drawn.items() if k[0] < self.n[1] and k[1] < self.n[0]}
        rows = []
        for r in range(1 + max((k[0] for k in drawn), default=-1)):
            own = {k[1]: v for k, v in drawn.items() if k[0] == r}
            rows.append("".join(own.get(c, " ") for c in range(1 + max(own, default=-1))).rstrip())
        return "\n".join(rows)


def column_edges(cells: list[dict], left: int, right: int) -> list[int]:
    """Places of a table's column edges: proportional, two apart at least, none beyond the right one."""
    own, edges, total = widths(cells), [left], sum(widths(cells)) or 1.0
    for i in range(1, len(own)):
        edges.append(min(max(edges[-1] + 2, left + round((right - left) * sum(own[:i]) / total)), right))
    return [*edges, max(right, edges[-1])]


def place(g: Grid, b: dict) -> None:
    if b["kind"] == "paragraph":
        c, r = g.at(b["x0"], b["y0"])
        for i, line in enumerate(text_of(b["runs"]).split("\n")):
            g.write(c, r + i, line)
    elif b["kind"] == "table":
        (c0, r0), (c1, r1) = g.at(b["x0"], b["y0"]), g.at(b["x1"], b["y1"])
        edges, n = column_edges(b["cells"], c0, c1), len(rows_of(b["cells"]))
        rows = [r0 + round((max(r1 - r0, 2 * n)) * i / n) for i in range(n + 1)]
        for c in b["cells"]:
            left, right, top, low = edges[c["col"]], edges[min(c["col"] + c["col_span"], len(edges) - 1)], rows[c["row"]], rows[min(c["row"] + c["row_span"], n)]
            g.box(left, top, right, low)
            g.write(left + 1, top + 1, text_of(c["runs"]).strip().replace("\n", " "), right)
    elif b["kind"] == "image":
        (c0, r0), (c1, r1) = g.at(b["x0"], b["y0"]), g.at(b["x1"], b["y1"])
        c1, r1 = max(c1, c0 + 2), max(r1, r0 + 2)
        g.box(c0, r0, c1, r1)
        label = f"[{b['alt'] or 'Image'}]"[: c1 - c0 - 1]
        g.write(c0 + 1 + (c1 - c0 - 1 - len(label)) // 2, (r0 + r1) // 2, label, c1)
    else:
        points = [tuple(map(float, m)) for m in re.findall(r"(-?[\d.]+)[ ,]+(-?[\d.]+)", b["svg_path"] or "")]
        for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
            if not math.isclose(x0, x1) or not math.isclose(y0, y1):
                g.line(*g.at(x0, y0), *g.at(x1, y1))


def plain(d: dict, mode: str = "flow") -> str:
    if mode == "canvas":
        out = []
        for p in d["pages"]:
            g = Grid(p["width"], p["height"])
            for b in [*[b for b in p["blocks"] if b["kind"] != "paragraph"], *(p["header"] or []), *[b for b in p["blocks"] if b["kind"] == "paragraph"], *(p["footer"] or [])]:
                place(g, b)
            out.append(g.text())
        return "\n\f\n".join(out)

    def block(b: dict) -> str:
        if b["kind"] == "table":
            return "\n".join("\t".join(r) for r in matrix(b["cells"]))
        if b["kind"] == "image":
            return f"[{b['alt'] or 'Image'}]"
        if b["kind"] != "paragraph":
            return ""
        if b["list_kind"]:
            return "  " * (b["list_level"] or 0) + f"{b['list_marker'] or '-'} " + text_of(item_runs(b))
        return text_of(b["runs"]).strip()

    return "\n\n".join("\n\n".join(x for x in map(block, p["blocks"]) if x) for p in d["pages"])


# Rules of a document.
SIGNATURES = {"png": b"\x89PNG", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "webp": b"RIFF"}


def violations(d: dict) -> list[str]:
    """What is wrong with a document, by page and block; empty if nothing is."""
    out = [] if d["pages"] else ["document: no pages"]
    for p in d["pages"]:
        where = f"page {p['page_no']}"
        if not (p["page_no"] or 0) > 0:
            out.append(f"{where}: number")
        if not (p["width"] or 0) > 0 or not (p["height"] or 0) > 0:
            out.append(f"{where}: size")
        for name in ("header", "footer"):
            out += [f"{where} {name}: {b['kind']}" for b in p[name] or [] if b["kind"] not in ("paragraph", "image")]
        for i, b in enumerate(p["blocks"]):
            at = f"{where} block {i}"
            if b["kind"] not in ("paragraph", "table", "image", "vector"):
                out.append(f"{at}: kind")
            elif b["x1"] < b["x0"] or b["y1"] < b["y0"]:
                out.append(f"{at}: box")
            if b["kind"] == "paragraph":
                if not b["runs"]:
                    out.append(f"{at}: no runs")
                out += [f"{at}: run size" for r in b["runs"] or [] if not (r["size"] or 0) > 0]
                if b["heading_level"] is not None and not 1 <= b["heading_level"] <= 6:
                    out.append(f"{at}: heading level")
            elif b["kind"] == "table":
                cells = b["cells"] or []
                if not cells:
                    out.append(f"{at}: no cells")
                out += [f"{at}: span" for c in cells if c["row_span"] < 1 or c["col_span"] < 1]
                taken = [(r, k) for c in cells for r in range(c["row"], c["row"] + c["row_span"]) for k in range(c["col"], c["col"] + c["col_span"])]
                if len(taken) != len(set(taken)):
                    out.append(f"{at}: cells overlap")
            elif b["kind"] == "image":
                if not b["content"]:
                    out.append(f"{at}: no bytes")
                elif b["format"] in SIGNATURES and not bytes(b["content"]).startswith(SIGNATURES[b["format"]]):
                    out.append(f"{at}: not {b['format']}")
                if not (b["x1"] > b["x0"] and b["y1"] > b["y0"]):
                    out.append(f"{at}: box")
            elif b["kind"] == "vector" and not (b["svg_path"] or "").strip():
                out.append(f"{at}: no path")
    return out


TEXT_FORMATS = {"md": markdown, "html": html, "latex": latex, "typst": typst, "rtf": rtf, "svg": svg, "txt": plain}
