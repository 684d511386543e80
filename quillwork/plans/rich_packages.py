"""Documents with runs, tables, images and vectors to office and e-book packages. A document is a value of rich.DOCUMENT."""

from __future__ import annotations

import re
from xml.sax.saxutils import quoteattr

from quillwork.plans import rich
from quillwork.plans.rich import hex_color, html_blocks, item_runs, modal, num, rows_of, text_of, widths, xml
from quillwork.sources.packages import DRAWING, HEAD, MEDIA, ODF, OFFICE, PACKAGE, SLIDES, WORDS, relations, zipped

# Namespaces of drawings in text documents.
WP, PIC, WPS = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing", "http://schemas.openxmlformats.org/drawingml/2006/picture", "http://schemas.microsoft.com/office/word/2010/wordprocessingShape"
EMU = 12700
#: A grey dot, for images in formats that the packages don't show.
DOT = bytes.fromhex("89504e470d0a1a0a0000000d4948445200000001000000010800000000376ef9240000000a49444154789c6368000000820081d4d6e2410000000049454e44ae426082")
SHOWN = {"png": "png", "jpeg": "jpg", "gif": "gif"}


class Media:
    """Image parts of a package, numbered in order, with their relations."""

    def __init__(self, folder: str) -> None:
        self.folder, self.parts = folder, []

    def add(self, b: dict) -> tuple[int, str]:
        kind = SHOWN.get(b["format"] or "")
        n = len(self.parts) + 1
        name = f"image{n}.{kind or 'png'}"
        self.parts.append((f"{self.folder}/{name}", bytes(b["content"]) if kind else DOT))
        return n, name


def types(overrides: list[tuple[str, str]], extensions: set[str]) -> str:
    kinds = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml", "png": "image/png", "jpg": "image/jpeg", "gif": "image/gif"}
    return HEAD + f'<Types xmlns="{PACKAGE}/content-types">' + "".join(f'<Default Extension="{e}" ContentType="{kinds[e]}"/>' for e in sorted({"rels", "xml"} | extensions)) + "".join(f'<Override PartName="{p}" ContentType="{t}"/>' for p, t in sorted(overrides)) + "</Types>"


def core(meta: dict, title: str) -> str:
    rows = "".join(f"<{tag}>{xml(meta[k])}</{tag}>" for k, tag in (("Author", "dc:creator"), ("Subject", "dc:subject"), ("Keywords", "cp:keywords")) if meta.get(k))
    return HEAD + f'<cp:coreProperties xmlns:cp="{PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{xml(title)}</dc:title>{rows}</cp:coreProperties>'


def segments(path: str) -> list[tuple[str, list[tuple[float, float]]]]:
    """A path's commands with their points."""
    return [(op, [(float(x), float(y)) for x, y in re.findall(r"(-?[\d.]+)[ ,]+(-?[\d.]+)", rest)]) for op, rest in re.findall(r"([MLCZ])([^MLCZ]*)", path or "")]


def drawing_path(b: dict, scale: float = 100.0) -> str:
    """A path as a custom geometry, relative to its box."""
    point = lambda p: f'<a:pt x="{round((p[0] - b["x0"]) * scale)}" y="{round((p[1] - b["y0"]) * scale)}"/>'
    out = []
    for op, points in segments(b["svg_path"]):
        tag = {"M": "moveTo", "L": "lnTo", "C": "cubicBezTo"}.get(op)
        if op == "Z":
            out.append("<a:close/>")
        elif tag and points:
            out.append(f"<a:{tag}>{''.join(map(point, points))}</a:{tag}>")
    w, h = (max(1, round((b[k1] - b[k0]) * scale)) for k0, k1 in (("x0", "x1"), ("y0", "y1")))
    return f'<a:custGeom><a:avLst/><a:pathLst><a:path w="{w}" h="{h}">{"".join(out)}</a:path></a:pathLst></a:custGeom>'


def drawing_look(b: dict) -> str:
    solid = lambda c, alpha: f'<a:solidFill><a:srgbClr val="{hex_color(c).upper()}">' + (f'<a:alpha val="{round(alpha * 100000)}"/>' if alpha is not None and alpha < 1 else "") + "</a:srgbClr></a:solidFill>"
    fill = solid(b["fill_rgb"], b["fill_alpha"]) if b["fill_rgb"] is not None else "<a:noFill/>"
    dash = '<a:prstDash val="dash"/>' if b["dash"] else ""
    line = f'<a:ln w="{round((b["stroke_width"] or 1) * EMU)}">{solid(b["stroke_rgb"], b["stroke_alpha"])}{dash}</a:ln>' if b["stroke_rgb"] is not None else "<a:ln><a:noFill/></a:ln>"
    return fill + line


def extent(b: dict) -> tuple[int, int]:
    return max(1, round((b["x1"] - b["x0"]) * EMU)), max(1, round((b["y1"] - b["y0"]) * EMU))


def docx(d: dict, mode: str = "flow") -> bytes:
    media, fonts, meta = Media("word/media"), set(), d["meta"] or {}
    shape = iter(range(1, 1 << 30))

    def run(r: dict, heading: bool = False) -> str:
        look = ""
        if r["font"]:
            fonts.add(r["font"])
            name = quoteattr(xml(r["font"]))
            look += f"<w:rFonts w:ascii={name} w:hAnsi={name} w:cs={name}/>"
        look += "".join(t for k, t in (("bold", "<w:b/>"), ("italic", "<w:i/>"), ("strike", "<w:strike/>")) if r[k])
        if r["color"] and not heading:
            look += f'<w:color w:val="{hex_color(r["color"]).upper()}"/>'
        look += f'<w:sz w:val="{round((r["size"] or 11) * 2)}"/>'
        if r["underline"]:
            look += '<w:u w:val="single"/>'
        if r["script"]:
            look += f'<w:vertAlign w:val="{"superscript" if r["script"] == "sup" else "subscript"}"/>'
        text = "<w:br/>".join(f'<w:t xml:space="preserve">{xml(t)}</w:t>' for t in r["text"].split("\n"))
        return f"<w:r><w:rPr>{look}</w:rPr>{text}</w:r>"

    def paragraph(b: dict, frame: bool = False) -> str:
        look = f'<w:pStyle w:val="Heading{b["heading_level"]}"/>' if b["heading_level"] else ""
        if frame:
            look += f'<w:framePr w:w="{round((b["x1"] - b["x0"]) * 20) + 120}" w:hAnchor="page" w:vAnchor="page" w:x="{round(b["x0"] * 20)}" w:y="{round(b["y0"] * 20)}"/>'
        elif b["list_kind"]:
            look += f'<w:numPr><w:ilvl w:val="{b["list_level"] or 0}"/><w:numId w:val="{2 if b["list_kind"] == "ordered" else 1}"/></w:numPr>'
        align = {"center": "center", "right": "right", "justified": "both"}.get(b["alignment"] or "")
        look += f'<w:jc w:val="{align}"/>' if align else ""
        runs = item_runs(b) if b["list_kind"] and not frame else b["runs"] or []
        return f"<w:p><w:pPr>{look}</w:pPr>{''.join(run(r, bool(b['heading_level'])) for r in runs)}</w:p>"

    def table(b: dict) -> str:
        wide = [round(w * 20) for w in widths(b["cells"])]
        rows = []
        for i, row in enumerate(rich.occupancy(b["cells"])):
            out, k = [], 0
            while k < len(row):
                c, kind = row[k]
                span = c["col_span"] if c else 1
                look = f'<w:tcW w:w="{sum(wide[k : k + span])}" w:type="dxa"/>' + (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "")
                if c and c["row_span"] > 1:
                    look += '<w:vMerge w:val="restart"/>' if c["row"] == i else "<w:vMerge/>"
                inner = "".join(map(run, c["runs"] or [])) if c and kind == "start" else ""
                out.append(f"<w:tc><w:tcPr>{look}</w:tcPr><w:p>{inner}</w:p></w:tc>")
                k += span
            rows.append(f"<w:tr>{''.join(out)}</w:tr>")
        border = "".join(f'<w:{s} w:val="single" w:sz="4" w:space="0" w:color="auto"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
        return f'<w:tbl><w:tblPr><w:tblW w:w="0" w:type="auto"/><w:tblBorders>{border}</w:tblBorders></w:tblPr><w:tblGrid>{"".join(f"<w:gridCol w:w=\"{w}\"/>" for w in wide)}</w:tblGrid>{"".join(rows)}</w:tbl><w:p/>'

    def drawn(b: dict, graphic: str, uri: str, alt: str) -> str:
        cx, cy = extent(b)
        props = f'<wp:docPr id="{next(shape)}" name={quoteattr(xml(alt))}/>'
        inner = f'<a:graphic xmlns:a="{DRAWING}"><a:graphicData uri="{uri}">{graphic}</a:graphicData></a:graphic>'
        if mode == "canvas":
            at = "".join(f'<wp:position{x} relativeFrom="page"><wp:posOffset>{round(b[k] * EMU)}</wp:posOffset></wp:position{x}>' for x, k in (("H", "x0"), ("V", "y0")))
            body = f'<wp:anchor behindDoc="1" distT="0" distB="0" distL="0" distR="0" simplePos="0" locked="0" layoutInCell="1" allowOverlap="1" relativeHeight="0"><wp:simplePos x="0" y="0"/>{at}<wp:extent cx="{cx}" cy="{cy}"/><wp:wrapNone/>{props}{inner}</wp:anchor>'
        else:
            body = f'<wp:inline distT="0" distB="0" distL="0" distR="0"><wp:extent cx="{cx}" cy="{cy}"/>{props}{inner}</wp:inline>'
        return f"<w:p><w:r><w:drawing>{body}</w:drawing></w:r></w:p>"

    def block(b: dict) -> str:
        if b["kind"] == "table":
            return table(b)
        if b["kind"] == "image":
            n, name = media.add(b)
            cx, cy = extent(b)
            pic = f'<pic:pic xmlns:pic="{PIC}"><pic:nvPicPr><pic:cNvPr id="{n}" name="{name}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="img{n}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic>'
            return drawn(b, pic, PIC, b["alt"] or "Image")
        if b["kind"] == "vector":
            cx, cy = extent(b)
            own = f'<wps:wsp xmlns:wps="{WPS}"><wps:cNvSpPr/><wps:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm>{drawing_path(b)}{drawing_look(b)}</wps:spPr><wps:bodyPr/></wps:wsp>'
            return drawn(b, own, WPS, "Shape")
        return paragraph(b, mode == "canvas") if text_of(b["runs"]).strip() else ""

    brk = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    body = brk.join("".join(map(block, p["blocks"])) for p in d["pages"])
    parts, rels, overrides = [], [("rId1", f"{OFFICE}/styles", "styles.xml"), ("rId2", f"{OFFICE}/numbering", "numbering.xml"), ("rId3", f"{OFFICE}/fontTable", "fontTable.xml")], []
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml."
    refs = ""
    for name, tag, i in (("header", "hdr", 4), ("footer", "ftr", 5)):
        own = next((p[name] for p in d["pages"] if p[name]), None)
        if own:
            inner = "".join(paragraph(b) for b in own)
            parts.append((f"word/{name}1.xml", HEAD + f'<w:{tag} xmlns:w="{WORDS}">{inner}</w:{tag}>'))
            rels.append((f"rId{i}", f"{OFFICE}/{name}", f"{name}1.xml"))
            overrides.append((f"/word/{name}1.xml", f"{kind}{name}+xml"))
            refs += f'<w:{name}Reference w:type="default" r:id="rId{i}"/>'
    rels += [(f"img{i + 1}", f"{OFFICE}/image", f"media/{p.rpartition('/')[2]}") for i, (p, _) in enumerate(media.parts)]
    first = d["pages"][0] if d["pages"] else {"width": 612.0, "height": 792.0}
    section = f'<w:sectPr>{refs}<w:pgSz w:w="{round(first["width"] * 20)}" w:h="{round(first["height"] * 20)}"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440" w:header="720" w:footer="720" w:gutter="0"/></w:sectPr>'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:pPr><w:outlineLvl w:val="{i - 1}"/></w:pPr></w:style>' for i in range(1, 7))
    level = lambda i, f, t: f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/><w:pPr><w:ind w:left="{720 * (i + 1)}" w:hanging="360"/></w:pPr></w:lvl>'
    numbering = "".join(f'<w:abstractNum w:abstractNumId="{k}">' + "".join(level(i, f, t if f == "bullet" else f"%{i + 1}.") for i in range(9)) + "</w:abstractNum>" for k, (f, t) in enumerate((("bullet", "•"), ("decimal", "")))) + "".join(f'<w:num w:numId="{k + 1}"><w:abstractNumId w:val="{k}"/></w:num>' for k in range(2))
    table_ = "".join(f"<w:font w:name={quoteattr(xml(f))}/>" for f in sorted(fonts))
    return zipped([
        ("[Content_Types].xml", types([("/word/document.xml", kind + "document.main+xml"), ("/word/styles.xml", kind + "styles+xml"), ("/word/numbering.xml", kind + "numbering+xml"), ("/word/fontTable.xml", kind + "fontTable+xml"), ("/docProps/core.xml", "application/vnd.openxmlformats-package.core-properties+xml"), *overrides], {p.rpartition(".")[2] for p, _ in media.parts})),
        ("_rels/.rels", relations([("rId1", f"{OFFICE}/officeDocument", "word/document.xml"), ("rId2", f"{PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml")])),
        ("docProps/core.xml", core(meta, d["title"])), ("word/_rels/document.xml.rels", relations(rels)),
        ("word/document.xml", HEAD + f'<w:document xmlns:w="{WORDS}" xmlns:r="{OFFICE}" xmlns:wp="{WP}" xmlns:a="{DRAWING}"><w:body>{body}{section}</w:body></w:document>'),
        ("word/fontTable.xml", HEAD + f'<w:fonts xmlns:w="{WORDS}">{table_}</w:fonts>'), *parts, *media.parts,
        ("word/numbering.xml", HEAD + f'<w:numbering xmlns:w="{WORDS}">{numbering}</w:numbering>'), ("word/styles.xml", HEAD + f'<w:styles xmlns:w="{WORDS}">{styles}</w:styles>'),
    ])


def pptx(d: dict, mode: str = "flow") -> bytes:
    media, meta = Media("ppt/media"), d["meta"] or {}
    ns = f'xmlns:a="{DRAWING}" xmlns:r="{OFFICE}" xmlns:p="{SLIDES}"'
    tree = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'

    def run(r: dict) -> str:
        look = "".join(f' {k}="{v}"' for on, k, v in ((True, "sz", round((r["size"] or 11) * 100)), (r["bold"], "b", 1), (r["italic"], "i", 1), (r["underline"], "u", "sng"), (r["strike"], "strike", "sngStrike"), (r["script"], "baseline", 30000 if r["script"] == "sup" else -25000)) if on)
        fill = f'<a:solidFill><a:srgbClr val="{hex_color(r["color"]).upper()}"/></a:solidFill>' if r["color"] else ""
        font = f"<a:latin typeface={quoteattr(xml(r['font']))}/>" if r["font"] else ""
        return f"<a:r><a:rPr{look}>{fill}{font}</a:rPr><a:t>{xml(r['text'])}</a:t></a:r>"

    def box(b: dict, tag: str = "a") -> str:
        cx, cy = extent(b)
        return f'<{tag}:xfrm><a:off x="{round(b["x0"] * EMU)}" y="{round(b["y0"] * EMU)}"/><a:ext cx="{cx}" cy="{cy}"/></{tag}:xfrm>'

    def shape(i: int, b: dict) -> tuple[str, list[tuple[str, str, str]]]:
        if b["kind"] == "image":
            n, name = media.add(b)
            return f'<p:pic><p:nvPicPr><p:cNvPr id="{i}" name="{name}"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="img{n}"/><a:stretch><a:fillRect/></a:stretch></p:blipFill><p:spPr>{box(b)}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr></p:pic>', [(f"img{n}", f"{OFFICE}/image", f"../media/{name}")]
        if b["kind"] == "table":
            rows = []
            grid = rich.occupancy(b["cells"])
            tall = round((b["y1"] - b["y0"]) * EMU / max(1, len(grid)))
            for r in grid:
                cells = []
                for c, kind in r:
                    look = "".join(f' {k}="{c[f]}"' for k, f in (("gridSpan", "col_span"), ("rowSpan", "row_span")) if c and kind == "start" and c[f] > 1) + (' hMerge="1"' if kind == "right" else ' vMerge="1"' if kind == "below" else "")
                    inner = "".join(f"<a:p>{run(x)}</a:p>" for x in (c["runs"] or [])) if c and kind == "start" else ""
                    cells.append(f"<a:tc{look}><a:txBody><a:bodyPr/>{inner or '<a:p/>'}</a:txBody><a:tcPr/></a:tc>")
                rows.append(f'<a:tr h="{tall}">{"".join(cells)}</a:tr>')
            cols = "".join(f'<a:gridCol w="{round(w * EMU)}"/>' for w in widths(b["cells"]))
            return f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{i}" name="Table {i}"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr>{box(b, "p")}<a:graphic><a:graphicData uri="{DRAWING.replace("main", "table")}"><a:tbl><a:tblPr firstRow="1"/><a:tblGrid>{cols}</a:tblGrid>{"".join(rows)}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>', []
        if b["kind"] == "vector":
            return f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="Shape {i}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr>{box(b)}{drawing_path(b)}{drawing_look(b)}</p:spPr></p:sp>', []
        align = {"center": ' algn="ctr"', "right": ' algn="r"', "justified": ' algn="just"'}.get(b["alignment"] or "", "")
        level = f' lvl="{b["list_level"]}"' if b["list_kind"] and b["list_level"] else ""
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="Text {i}"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr>{box(b)}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr wrap="square"/><a:p><a:pPr{level}{align}/>{"".join(map(run, b["runs"] or []))}</a:p></p:txBody></p:sp>', []

    slides, rels = [], []
    for p in d["pages"]:
        made = [shape(i + 2, b) for i, b in enumerate([*(p["header"] or []), *p["blocks"], *(p["footer"] or [])])]
        slides.append(HEAD + f"<p:sld {ns}><p:cSld><p:spTree>{tree}{''.join(m[0] for m in made)}</p:spTree></p:cSld></p:sld>")
        rels.append([r for m in made for r in m[1]])
    from quillwork.sources import packages

    first = d["pages"][0] if d["pages"] else {"width": 612.0, "height": 792.0}
    return packages.presentation(slides, rels, media.parts, core(meta, d["title"]), types, round(first["width"] * EMU), round(first["height"] * EMU))


def _odf(d: dict, kind: str, mode: str) -> bytes:
    media, meta = Media("Pictures"), d["meta"] or {}
    looks: dict[tuple, str] = {}

    def style(family: str, props: str) -> str:
        return looks.setdefault((family, props), f"{family[0].upper()}{len(looks) + 1}")

    def run(r: dict) -> str:
        props = f'fo:font-size="{num(r["size"] or 11)}pt"' + (f" style:font-name={quoteattr(xml(r['font']))}" if r["font"] else "")
        props += "".join(f' {p}="{v}"' for on, p, v in ((r["bold"], "fo:font-weight", "bold"), (r["italic"], "fo:font-style", "italic"), (r["underline"], "style:text-underline-style", "solid"), (r["strike"], "style:text-line-through-style", "solid"), (r["color"], "fo:color", "#" + hex_color(r["color"])), (r["script"], "style:text-position", f"{r['script'] == 'sup' and 'super' or 'sub'} 58%")) if on)
        name = style("text", f"<style:text-properties {props}/>")
        return f'<text:span text:style-name="{name}">{xml(r["text"]).replace(chr(10), "<text:line-break/>")}</text:span>'

    def para(b: dict) -> str:
        align = {"center": "center", "right": "end", "justified": "justify"}.get(b["alignment"] or "", "start")
        return style("paragraph", f'<style:paragraph-properties fo:text-align="{align}"/>')

    def frame(b: dict, inner: str) -> str:
        at = f'svg:x="{num(b["x0"])}pt" svg:y="{num(b["y0"])}pt" ' if kind == "odp" or mode == "canvas" else ""
        anchor = 'text:anchor-type="page" ' if kind == "odt" and mode == "canvas" else 'text:anchor-type="as-char" ' if kind == "odt" else ""
        return f'<draw:frame {anchor}{at}svg:width="{num(max(1.0, b["x1"] - b["x0"]))}pt" svg:height="{num(max(1.0, b["y1"] - b["y0"]))}pt">{inner}</draw:frame>'

    def table(b: dict) -> str:
        cols = "".join(f'<table:table-column table:style-name="{style("table-column", f"<style:table-column-properties style:column-width={chr(34)}{num(w)}pt{chr(34)}/>")}"/>' for w in widths(b["cells"]))
        cell = style("table-cell", '<style:table-cell-properties fo:border="0.5pt solid #000000"/>')
        rows = []
        for row in rich.occupancy(b["cells"]):
            out = []
            for c, how in row:
                if c and how == "start":
                    span = "".join(f' table:number-{k}-spanned="{c[f]}"' for k, f in (("columns", "col_span"), ("rows", "row_span")) if c[f] > 1)
                    out.append(f'<table:table-cell table:style-name="{cell}"{span}><text:p>{"".join(map(run, c["runs"] or []))}</text:p></table:table-cell>')
                else:
                    out.append("<table:covered-table-cell/>" if c else "<table:table-cell/>")
            rows.append(f"<table:table-row>{''.join(out)}</table:table-row>")
        return f"<table:table>{cols}{''.join(rows)}</table:table>"

    def path(b: dict) -> str:
        fill = f'draw:fill="solid" draw:fill-color="#{hex_color(b["fill_rgb"])}"' if b["fill_rgb"] is not None else 'draw:fill="none"'
        line = f'draw:stroke="solid" svg:stroke-color="#{hex_color(b["stroke_rgb"])}" svg:stroke-width="{num(b["stroke_width"] or 1)}pt"' if b["stroke_rgb"] is not None else 'draw:stroke="none"'
        name = style("graphic", f"<style:graphic-properties {fill} {line}/>")
        w, h = max(1.0, b["x1"] - b["x0"]), max(1.0, b["y1"] - b["y0"])
        d_ = " ".join(op + " ".join(f"{round((x - b['x0']) * 100)} {round((y - b['y0']) * 100)}" for x, y in pts) for op, pts in segments(b["svg_path"]))
        anchor = 'text:anchor-type="page" ' if kind == "odt" else ""
        return f'<draw:path draw:style-name="{name}" {anchor}svg:x="{num(b["x0"])}pt" svg:y="{num(b["y0"])}pt" svg:width="{num(w)}pt" svg:height="{num(h)}pt" svg:viewBox="0 0 {round(w * 100)} {round(h * 100)}" svg:d="{d_}"/>'

    def block(b: dict) -> str:
        if b["kind"] == "table":
            return table(b) if kind == "odt" and mode != "canvas" else frame(b, table(b)) if kind == "odp" else f"<text:p>{frame(b, '<draw:text-box>' + table(b) + '</draw:text-box>')}</text:p>"
        if b["kind"] == "image":
            _, name = media.add(b)
            inner = frame(b, f'<draw:image xlink:href="Pictures/{name}" xlink:type="simple"/>')
            return f"<text:p>{inner}</text:p>" if kind == "odt" else inner
        if b["kind"] == "vector":
            return f"<text:p>{path(b)}</text:p>" if kind == "odt" else path(b)
        if not text_of(b["runs"]).strip():
            return ""
        name, listed = para(b), b["list_kind"] and kind == "odt" and mode != "canvas"
        inner = "".join(map(run, item_runs(b) if listed else b["runs"]))
        p = f'<text:h text:style-name="{name}" text:outline-level="{b["heading_level"]}">{inner}</text:h>' if b["heading_level"] and kind == "odt" else f'<text:p text:style-name="{name}">{inner}</text:p>'
        if listed:
            depth = (b["list_level"] or 0) + 1
            return "<text:list><text:list-item>" * depth + p + "</text:list-item></text:list>" * depth
        if kind == "odp" or mode == "canvas":
            p = frame(b, f"<draw:text-box>{p}</draw:text-box>")
            return f"<text:p>{p}</text:p>" if kind == "odt" else p
        return p

    if kind == "odt":
        brk = style("paragraph", '<style:paragraph-properties fo:break-before="page"/>')
        body = f'<text:p text:style-name="{brk}"/>'.join("".join(map(block, p["blocks"])) for p in d["pages"])
        body = f"<office:text>{body}</office:text>"
    else:
        body = "<office:presentation>" + "".join(f'<draw:page draw:name="page{p["page_no"]}" draw:master-page-name="Default">{"".join(map(block, [*(p["header"] or []), *p["blocks"], *(p["footer"] or [])]))}</draw:page>' for p in d["pages"]) + "</office:presentation>"
    styles = "".join(f'<style:style style:name="{n}" style:family="{f}">{props}</style:style>' for (f, props), n in looks.items())
    ns = " ".join(f'xmlns:{k}="{ODF}{v}:1.0"' for k, v in {"office": "office", "style": "style", "text": "text", "table": "table", "draw": "drawing", "presentation": "presentation", "meta": "meta", "fo": "xsl-fo-compatible", "svg": "svg-compatible"}.items()) + ' xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xlink="http://www.w3.org/1999/xlink"'
    fonts = sorted({r["font"] for p in d["pages"] for b in p["blocks"] for r in [*(b["runs"] or []), *[r for c in b["cells"] or [] for r in c["runs"] or []]] if r["font"]})
    faces = "<office:font-face-decls>" + "".join(f"<style:font-face style:name={quoteattr(xml(f))} svg:font-family={quoteattr(xml(f))}/>" for f in fonts) + "</office:font-face-decls>"
    kinds = {"png": "image/png", "jpg": "image/jpeg", "gif": "image/gif"}
    entries = [("/", MEDIA[kind]), ("content.xml", "text/xml"), ("meta.xml", "text/xml"), ("styles.xml", "text/xml"), *[(n, kinds[n.rpartition(".")[2]]) for n, _ in media.parts]]
    files = "".join(f'<manifest:file-entry manifest:full-path={quoteattr(n)} manifest:media-type="{t}"/>' for n, t in entries)
    first = d["pages"][0] if d["pages"] else {"width": 612.0, "height": 792.0}
    info = "".join(f"<{t}>{xml(meta[k])}</{t}>" for k, t in (("Author", "meta:initial-creator"), ("Subject", "dc:subject"), ("Keywords", "meta:keyword")) if meta.get(k))
    head = next((p["header"] for p in d["pages"] if p["header"]), None), next((p["footer"] for p in d["pages"] if p["footer"]), None)
    side = "".join(f"<style:{t}>" + "".join(f"<text:p>{xml(text_of(b['runs']))}</text:p>" for b in own) + f"</style:{t}>" for t, own in zip(("header", "footer"), head, strict=True) if own) if kind == "odt" else ""
    return zipped([
        ("META-INF/manifest.xml", HEAD + f'<manifest:manifest xmlns:manifest="{ODF}manifest:1.0" manifest:version="1.3">{files}</manifest:manifest>'),
        ("content.xml", HEAD + f'<office:document-content {ns} office:version="1.3">{faces}<office:automatic-styles>{styles}</office:automatic-styles><office:body>{body}</office:body></office:document-content>'),
        ("meta.xml", HEAD + f'<office:document-meta {ns} office:version="1.3"><office:meta><dc:title>{xml(d["title"])}</dc:title>{info}</office:meta></office:document-meta>'),
        ("styles.xml", HEAD + f'<office:document-styles {ns} office:version="1.3"><office:automatic-styles><style:page-layout style:name="L1"><style:page-layout-properties fo:page-width="{num(first["width"])}pt" fo:page-height="{num(first["height"])}pt" fo:margin="72pt"/></style:page-layout></office:automatic-styles><office:master-styles><style:master-page style:name="Default" style:page-layout-name="L1">{side}</style:master-page></office:master-styles></office:document-styles>'), *media.parts,
    ], MEDIA[kind])


def nested(entries: list[tuple[int, str, str]], item, group: str) -> str:
    """Entries (level, link, text) as lists in lists; item(link, text) opens an entry whose inner list follows, group names the list."""
    out, open_ = [], []
    for level, href, text in entries:
        while open_ and open_[-1] > level:
            open_.pop()
            out.append(f"</{item('', '')[1]}>" + (f"</{group}>" if group else ""))
        if open_ and open_[-1] == level:
            out.append(f"</{item('', '')[1]}>")
        else:
            out.append(f"<{group}>" if group else "")
            open_.append(level)
        out.append(item(href, text)[0])
    while open_:
        open_.pop()
        out.append(f"</{item('', '')[1]}>" + (f"</{group}>" if group else ""))
    return "".join(out)


def utc_stamp(date: str | None) -> str:
    """A PDF date as an UTC stamp; the start of 1980 where there is none, so that files are alike in every run."""
    m = re.match(r"D?:?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(Z|[+-]\d\d)?'?(\d\d)?", date or "")
    if not m:
        return "1980-01-01T00:00:00Z"
    from datetime import datetime, timedelta

    v = [int(m[i] or d) for i, d in zip(range(1, 7), (1980, 1, 1, 0, 0, 0), strict=True)]
    shift = timedelta(hours=int(m[7] or 0) if m[7] not in (None, "Z") else 0, minutes=int(m[8] or 0) * (-1 if (m[7] or "").startswith("-") else 1))
    try:
        return (datetime(*v) - shift).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1980-01-01T00:00:00Z"


def epub(d: dict, mode: str = "flow") -> bytes:
    """A chapter for each heading of level 1; navigation of headings to level 3, in XHTML and NCX."""
    media, meta, title = Media("OEBPS/Images"), d["meta"] or {}, d["title"]
    chapters: list[list[dict]] = [[]]
    for b in (b for p in d["pages"] for b in p["blocks"]):
        if b["kind"] == "paragraph" and b["heading_level"] == 1 and chapters[-1]:
            chapters.append([])
        chapters[-1].append(b)
    html = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">'
    files, nav, drawn = [], [], []
    for i, own in enumerate(chapters):
        name, at = f"Text/chapter_{i + 1}.xhtml", [0]

        def block(b: dict, name=name, at=at) -> str:
            if b["kind"] == "image":
                return f'<p><img src="../Images/{media.add(b)[1]}" alt="{xml(b["alt"] or "Image")}"/></p>' if b["content"] else ""
            made = rich.html_block(b)
            if b["kind"] == "paragraph" and b["heading_level"] and made:
                at[0] += 1
                if b["heading_level"] <= 3:
                    nav.append((b["heading_level"], f"{name}#h{at[0]}", text_of(b["runs"]).strip()))
                made = made.replace(f"<h{b['heading_level']}>", f'<h{b["heading_level"]} id="h{at[0]}">', 1)
            return made

        body = "\n".join(html_blocks(own, block=block))
        drawn.append(any(b["kind"] == "vector" for b in own))
        files.append((f"OEBPS/{name}", HEAD + html + f"<head><title>{xml(title)}</title></head><body>{body}</body></html>"))
    nav = nav or [(1, "Text/chapter_1.xhtml", title)]
    toc = nested(nav, lambda h, t: (f'<li><a href="{h}">{xml(t)}</a>', "li"), "ol")
    order = iter(range(1, len(nav) + 1))
    points = nested(nav, lambda h, t: ((lambda n: f'<navPoint id="n{n}" playOrder="{n}"><navLabel><text>{xml(t)}</text></navLabel><content src="{h}"/>')(next(order)) if t or h else "", "navPoint"), "")
    ident = "urn:quillwork:" + re.sub(r"\W+", "-", title).strip("-").lower()
    kinds = {"png": "image/png", "jpg": "image/jpeg", "gif": "image/gif"}
    items = "".join(f'<item id="c{i + 1}" href="Text/chapter_{i + 1}.xhtml" media-type="application/xhtml+xml"' + (' properties="svg"' if drawn[i] else "") + "/>" for i in range(len(chapters)))
    items += "".join(f'<item id="i{i + 1}" href="Images/{n.rpartition("/")[2]}" media-type="{kinds[n.rpartition(".")[2]]}"/>' for i, (n, _) in enumerate(media.parts))
    spine = "".join(f'<itemref idref="c{i + 1}"/>' for i in range(len(chapters)))
    info = "".join(f"<dc:{t}>{xml(meta[k])}</dc:{t}>" for k, t in (("Author", "creator"), ("Subject", "description"), ("Keywords", "subject")) if meta.get(k))
    opf = HEAD + f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{ident}</dc:identifier><dc:title>{xml(title)}</dc:title><dc:language>{xml(meta.get("Lang") or "en")}</dc:language>{info}<meta property="dcterms:modified">{utc_stamp(meta.get("ModDate") or meta.get("CreationDate"))}</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>'
    marks = '<nav epub:type="landmarks" hidden=""><ol><li><a epub:type="toc" href="nav.xhtml">Contents</a></li><li><a epub:type="bodymatter" href="Text/chapter_1.xhtml">Start</a></li></ol></nav>'
    depth = max(level for level, _, _ in nav)
    ncx = HEAD + f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{ident}"/><meta name="dtb:depth" content="{depth}"/><meta name="dtb:totalPageCount" content="0"/><meta name="dtb:maxPageNumber" content="0"/></head><docTitle><text>{xml(title)}</text></docTitle><navMap>{points}</navMap></ncx>'
    made = zipped([
        ("META-INF/container.xml", HEAD + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        ("OEBPS/content.opf", opf), ("OEBPS/nav.xhtml", HEAD + html + f'<head><title>{xml(title)}</title></head><body><nav epub:type="toc">{toc}</nav>{marks}</body></html>'), ("OEBPS/toc.ncx", ncx), *files, *media.parts,
    ], MEDIA["epub"])
    return made


def odt(d: dict, mode: str = "flow") -> bytes:
    return _odf(d, "odt", mode)


def odp(d: dict, mode: str = "flow") -> bytes:
    return _odf(d, "odp", mode)


def compliant(data: bytes, media_type: str) -> str | None:
    """Why a package breaks the rule that its first part is its media type, stored, without extra fields; None if it doesn't."""
    if data[:4] != b"PK\x03\x04":
        return "not a zip file"
    name, extra = int.from_bytes(data[26:28], "little"), int.from_bytes(data[28:30], "little")
    if data[30 : 30 + name] != b"mimetype":
        return "mimetype isn't first"
    if int.from_bytes(data[8:10], "little") != 0:
        return "mimetype is compressed"
    if extra:
        return "mimetype has an extra field"
    return None if data[30 + name : 30 + name + len(media_type)] == media_type.encode() else "another media type"


def manifest(opf: str, path: str) -> dict[str, str]:
    """The parts of an e-book's manifest with their media types, by their place in the package."""
    import posixpath
    from xml.etree import ElementTree as ET

    base = posixpath.dirname(path)
    return {posixpath.normpath(posixpath.join(base, i.get("href", ""))): i.get("media-type", "") for i in ET.fromstring(opf).iter() if i.tag.endswith("}item") or i.tag == "item"}


WRITERS = {"docx": docx, "pptx": pptx, "odt": odt, "odp": odp, "epub": epub}
__all__ = ["WRITERS", "compliant", "manifest", "modal", "rows_of"]
