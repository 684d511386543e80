"""Office and e-book packages: documents to zip files and zip files to rows of parts. Bytes are the same in every run."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions import columns

# Namespaces and media types of the formats.
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SLIDES = "http://schemas.openxmlformats.org/presentationml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
ODF = "urn:oasis:names:tc:opendocument:xmlns:"
MEDIA = {"docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "odt": "application/vnd.oasis.opendocument.text", "odp": "application/vnd.oasis.opendocument.presentation", "epub": "application/epub+zip"}


def zipped(parts: list[tuple[str, str | bytes]], first: str | None = None) -> bytes:
    """A zip file with fixed dates; `first` is stored uncompressed as the part mimetype, before all others."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in ([("mimetype", first)] if first else []) + parts:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            info.external_attr = 0o644 << 16
            z.writestr(info, data)
    return out.getvalue()


def clean(text: str) -> str:
    """Text for XML, without characters that it may not hold."""
    return escape("".join(c for c in text if c in "\t\n\r" or c >= " " and ord(c) not in (0xFFFE, 0xFFFF)))


def relations(rows: list[tuple[str, str, str]]) -> str:
    return HEAD + f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{t}" Target="{x}"/>' for i, t, x in rows) + "</Relationships>"


def content_types(overrides: list[tuple[str, str]]) -> str:
    rows = "".join(f'<Override PartName="{p}" ContentType="{t}"/>' for p, t in sorted(overrides))
    return HEAD + f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{rows}</Types>'


def pages_of(blocks: list[dict]) -> list[list[dict]]:
    pages: dict[int, list[dict]] = {}
    for b in blocks:
        pages.setdefault(b["page_no"], []).append(b)
    return [pages[k] for k in sorted(pages)]


def docx(title: str, blocks: list[dict]) -> bytes:
    align = {"center": "center", "right": "right", "justified": "both"}

    def paragraph(b: dict) -> str:
        look = f'<w:pStyle w:val="Heading{b["heading_level"]}"/>' if b["heading_level"] else ""
        if b["list_kind"]:
            look += f'<w:numPr><w:ilvl w:val="{b["list_level"]}"/><w:numId w:val="{2 if b["list_kind"] == "ordered" else 1}"/></w:numPr>'
        if b["alignment"] in align:
            look += f'<w:jc w:val="{align[b["alignment"]]}"/>'
        run = ("<w:b/>" if b["is_bold"] else "") + f'<w:sz w:val="{round(b["font_size"] * 2)}"/>'
        return f'<w:p><w:pPr>{look}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t xml:space="preserve">{clean(b["text_clean"])}</w:t></w:r></w:p>'

    brk = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    body = brk.join("".join(map(paragraph, p)) for p in pages_of(blocks))
    page = '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440" w:header="720" w:footer="720" w:gutter="0"/></w:sectPr>'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:pPr><w:outlineLvl w:val="{i - 1}"/></w:pPr></w:style>' for i in range(1, 7))
    level = lambda i, kind, text: f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{text}"/><w:pPr><w:ind w:left="{720 * (i + 1)}" w:hanging="360"/></w:pPr></w:lvl>'
    numbering = "".join(f'<w:abstractNum w:abstractNumId="{k}">' + "".join(level(i, kind, t if kind == "bullet" else f"%{i + 1}.") for i in range(9)) + "</w:abstractNum>" for k, (kind, t) in enumerate((("bullet", "•"), ("decimal", ""))))
    numbering += "".join(f'<w:num w:numId="{k + 1}"><w:abstractNumId w:val="{k}"/></w:num>' for k in range(2))
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml."
    return zipped([
        ("[Content_Types].xml", content_types([("/word/document.xml", kind + "document.main+xml"), ("/word/styles.xml", kind + "styles+xml"), ("/word/numbering.xml", kind + "numbering+xml"), ("/docProps/core.xml", "application/vnd.openxmlformats-package.core-properties+xml")])),
        ("_rels/.rels", relations([("rId1", f"{OFFICE}/officeDocument", "word/document.xml"), ("rId2", f"{PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml")])),
        ("docProps/core.xml", HEAD + f'<cp:coreProperties xmlns:cp="{PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{clean(title)}</dc:title></cp:coreProperties>'),
        ("word/_rels/document.xml.rels", relations([("rId1", f"{OFFICE}/styles", "styles.xml"), ("rId2", f"{OFFICE}/numbering", "numbering.xml")])),
        ("word/document.xml", HEAD + f'<w:document xmlns:w="{WORDS}"><w:body>{body}{page}</w:body></w:document>'),
        ("word/numbering.xml", HEAD + f'<w:numbering xmlns:w="{WORDS}">{numbering}</w:numbering>'),
        ("word/styles.xml", HEAD + f'<w:styles xmlns:w="{WORDS}">{styles}</w:styles>'),
    ])


def presentation(slides: list[str], relations_: list[list[tuple[str, str, str]]], media: list[tuple[str, bytes]], core: str | None, types, width: int, height: int) -> bytes:
    """A presentation of slide parts: a plain theme, one master and one layout around them. relations_ has each slide's further relations."""
    ns = f'xmlns:a="{DRAWING}" xmlns:r="{OFFICE}" xmlns:p="{SLIDES}"'
    tree = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
    n = len(slides)
    kind = "application/vnd.openxmlformats-officedocument.presentationml."
    colors = "".join(f'<a:{k}><a:srgbClr val="{v}"/></a:{k}>' for k, v in zip(("dk1", "lt1", "dk2", "lt2", *[f"accent{i}" for i in range(1, 7)], "hlink", "folHlink"), ("000000", "FFFFFF") * 6, strict=True))
    fonts = "".join(f'<a:{k}><a:latin typeface="Calibri"/><a:ea typeface=""/><a:cs typeface=""/></a:{k}>' for k in ("majorFont", "minorFont"))
    fill, line, effect = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>', '<a:ln><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>', "<a:effectStyle><a:effectLst/></a:effectStyle>"
    theme = HEAD + f'<a:theme xmlns:a="{DRAWING}" name="Plain"><a:themeElements><a:clrScheme name="Plain">{colors}</a:clrScheme><a:fontScheme name="Plain">{fonts}</a:fontScheme><a:fmtScheme name="Plain"><a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{line * 3}</a:lnStyleLst><a:effectStyleLst>{effect * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    scheme = 'bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" ' + " ".join(f'accent{i}="accent{i}"' for i in range(1, 7)) + ' hlink="hlink" folHlink="folHlink"'
    overrides = [("/ppt/presentation.xml", kind + "presentation.main+xml"), ("/ppt/slideMasters/slideMaster1.xml", kind + "slideMaster+xml"), ("/ppt/slideLayouts/slideLayout1.xml", kind + "slideLayout+xml"), ("/ppt/theme/theme1.xml", "application/vnd.openxmlformats-officedocument.theme+xml"), *[(f"/ppt/slides/slide{i + 1}.xml", kind + "slide+xml") for i in range(n)]]
    tops = [("rId1", f"{OFFICE}/officeDocument", "ppt/presentation.xml")]
    if core:
        overrides.append(("/docProps/core.xml", "application/vnd.openxmlformats-package.core-properties+xml"))
        tops.append(("rId2", f"{PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml"))
    return zipped([
        ("[Content_Types].xml", types(overrides, {p.rpartition(".")[2] for p, _ in media}) if types else content_types(overrides)),
        ("_rels/.rels", relations(tops)), *([("docProps/core.xml", core)] if core else []),
        ("ppt/_rels/presentation.xml.rels", relations([("rId1", f"{OFFICE}/slideMaster", "slideMasters/slideMaster1.xml"), *[(f"rId{i + 2}", f"{OFFICE}/slide", f"slides/slide{i + 1}.xml") for i in range(n)]])),
        ("ppt/presentation.xml", HEAD + f'<p:presentation {ns}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>' + "".join(f'<p:sldId id="{256 + i}" r:id="rId{i + 2}"/>' for i in range(n)) + f'</p:sldIdLst><p:sldSz cx="{width}" cy="{height}"/><p:notesSz cx="{width}" cy="{height}"/></p:presentation>'),
        ("ppt/slideLayouts/_rels/slideLayout1.xml.rels", relations([("rId1", f"{OFFICE}/slideMaster", "../slideMasters/slideMaster1.xml")])),
        ("ppt/slideLayouts/slideLayout1.xml", HEAD + f"<p:sldLayout {ns}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sldLayout>"),
        ("ppt/slideMasters/_rels/slideMaster1.xml.rels", relations([("rId1", f"{OFFICE}/slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId2", f"{OFFICE}/theme", "../theme/theme1.xml")])),
        ("ppt/slideMasters/slideMaster1.xml", HEAD + f'<p:sldMaster {ns}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld><p:clrMap {scheme}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>'),
        *[x for i, s in enumerate(slides) for x in ((f"ppt/slides/_rels/slide{i + 1}.xml.rels", relations([("rId1", f"{OFFICE}/slideLayout", "../slideLayouts/slideLayout1.xml"), *relations_[i]])), (f"ppt/slides/slide{i + 1}.xml", s))],
        ("ppt/theme/theme1.xml", theme), *media,
    ])


def pptx(title: str, blocks: list[dict]) -> bytes:
    pages, emu = pages_of(blocks), 12700
    ns = f'xmlns:a="{DRAWING}" xmlns:r="{OFFICE}" xmlns:p="{SLIDES}"'
    tree = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'

    def shape(i: int, b: dict) -> str:
        x, y, w, h = (round(v * emu) for v in (b["x0"], b["y0"], max(1.0, b["x1"] - b["x0"]), max(1.0, b["y1"] - b["y0"])))
        run = f'<a:rPr sz="{round(b["font_size"] * 100)}"' + (' b="1"' if b["is_bold"] else "") + "/>"
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="Text {i}"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr/><a:p><a:r>{run}<a:t>{clean(b["text"])}</a:t></a:r></a:p></p:txBody></p:sp>'

    slides = [HEAD + f"<p:sld {ns}><p:cSld><p:spTree>{tree}{''.join(shape(i + 2, b) for i, b in enumerate(p))}</p:spTree></p:cSld></p:sld>" for p in pages]
    return presentation(slides, [[] for _ in slides], [], None, None, 612 * emu, 792 * emu)


def _odf(kind: str, title: str, styles: str, body: str) -> bytes:
    ns = " ".join(f'xmlns:{k}="{ODF}{v}:1.0"' for k, v in {"office": "office", "style": "style", "text": "text", "draw": "drawing", "presentation": "presentation", "meta": "meta"}.items())
    ns += f' xmlns:fo="{ODF}xsl-fo-compatible:1.0" xmlns:svg="{ODF}svg-compatible:1.0" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    files = "".join(f'<manifest:file-entry manifest:full-path={quoteattr(p)} manifest:media-type="{t}"/>' for p, t in (("/", MEDIA[kind]), ("content.xml", "text/xml"), ("meta.xml", "text/xml"), ("styles.xml", "text/xml")))
    return zipped([
        ("META-INF/manifest.xml", HEAD + f'<manifest:manifest xmlns:manifest="{ODF}manifest:1.0" manifest:version="1.3">{files}</manifest:manifest>'),
        ("content.xml", HEAD + f'<office:document-content {ns} office:version="1.3"><office:automatic-styles>{styles}</office:automatic-styles><office:body>{body}</office:body></office:document-content>'),
        ("meta.xml", HEAD + f'<office:document-meta {ns} office:version="1.3"><office:meta><dc:title>{clean(title)}</dc:title></office:meta></office:document-meta>'),
        ("styles.xml", HEAD + f'<office:document-styles {ns} office:version="1.3"><office:automatic-styles><style:page-layout style:name="L1"><style:page-layout-properties fo:page-width="612pt" fo:page-height="792pt" fo:margin="72pt"/></style:page-layout></office:automatic-styles><office:master-styles><style:master-page style:name="Default" style:page-layout-name="L1"/></office:master-styles></office:document-styles>'),
    ], MEDIA[kind])


def _odf_styles(blocks: list[dict]) -> tuple[dict[tuple, str], str]:
    looks = {k: f"P{i + 1}" for i, k in enumerate(dict.fromkeys((b["font_size"], b["is_bold"], b["alignment"]) for b in blocks))}
    align = {"center": "center", "right": "end", "justified": "justify"}
    return looks, "".join(f'<style:style style:name="{n}" style:family="paragraph"><style:paragraph-properties fo:text-align="{align.get(a, "start")}"/><style:text-properties fo:font-size="{s:g}pt" fo:font-weight="{"bold" if w else "normal"}"/></style:style>' for (s, w, a), n in looks.items())


def odt(title: str, blocks: list[dict]) -> bytes:
    looks, styles = _odf_styles(blocks)
    out = []
    for b in blocks:
        style = looks[b["font_size"], b["is_bold"], b["alignment"]]
        text = clean(b["text_clean"])
        if b["heading_level"]:
            out.append(f'<text:h text:style-name="{style}" text:outline-level="{b["heading_level"]}">{text}</text:h>')
        elif b["list_kind"]:
            out.append(f'<text:list><text:list-item><text:p text:style-name="{style}">{text}</text:p></text:list-item></text:list>')
        else:
            out.append(f'<text:p text:style-name="{style}">{text}</text:p>')
    return _odf("odt", title, styles, f"<office:text>{''.join(out)}</office:text>")


def odp(title: str, blocks: list[dict]) -> bytes:
    looks, styles = _odf_styles(blocks)
    frame = lambda b: f'<draw:frame svg:x="{b["x0"]:g}pt" svg:y="{b["y0"]:g}pt" svg:width="{max(1.0, b["x1"] - b["x0"]):g}pt" svg:height="{max(1.0, b["y1"] - b["y0"]):g}pt"><draw:text-box><text:p text:style-name="{looks[b["font_size"], b["is_bold"], b["alignment"]]}">{clean(b["text"])}</text:p></draw:text-box></draw:frame>'
    pages = "".join(f'<draw:page draw:name="page{i + 1}" draw:master-page-name="Default">{"".join(map(frame, p))}</draw:page>' for i, p in enumerate(pages_of(blocks)))
    return _odf("odp", title, styles, f"<office:presentation>{pages}</office:presentation>")


def epub(title: str, blocks: list[dict]) -> bytes:
    """A chapter for each heading of level 1; the navigation lists headings down to level 3."""
    chapters: list[list[dict]] = [[]]
    for b in blocks:
        if b["heading_level"] == 1 and chapters[-1]:
            chapters.append([])
        chapters[-1].append(b)
    html = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">'
    files, nav = [], []
    for i, own in enumerate(chapters):
        name, out, at = f"Text/chapter_{i + 1}.xhtml", [], 0
        open_list = ""
        for b in own:
            tag = {"ordered": "ol", "bullet": "ul"}.get(b["list_kind"] or "", "")
            if open_list and tag != open_list:
                out.append(f"</{open_list}>")
            if tag and tag != open_list:
                out.append(f"<{tag}>")
            open_list = tag
            if b["heading_level"]:
                at += 1
                if b["heading_level"] <= 3:
                    nav.append((f"{name}#h{at}", b["text"]))
                out.append(f'<h{b["heading_level"]} id="h{at}">{clean(b["text"])}</h{b["heading_level"]}>')
            else:
                out.append(f"<li>{clean(b['text_clean'])}</li>" if tag else f"<p>{clean(b['text'])}</p>")
        if open_list:
            out.append(f"</{open_list}>")
        files.append((f"OEBPS/{name}", HEAD + html + f"<head><title>{clean(title)}</title></head><body>{''.join(out)}</body></html>"))
    entries = "".join(f'<li><a href="{h}">{clean(t)}</a></li>' for h, t in nav) or f'<li><a href="Text/chapter_1.xhtml">{clean(title)}</a></li>'
    items = "".join(f'<item id="c{i + 1}" href="Text/chapter_{i + 1}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(chapters)))
    spine = "".join(f'<itemref idref="c{i + 1}"/>' for i in range(len(chapters)))
    opf = HEAD + f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:quillwork:{clean(title).replace(" ", "-")}</dc:identifier><dc:title>{clean(title)}</dc:title><dc:language>en</dc:language><meta property="dcterms:modified">1980-01-01T00:00:00Z</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>'
    return zipped([
        ("META-INF/container.xml", HEAD + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        ("OEBPS/content.opf", opf), ("OEBPS/nav.xhtml", HEAD + html + f'<head><title>{clean(title)}</title></head><body><nav epub:type="toc"><ol>{entries}</ol></nav></body></html>'), *files,
    ], MEDIA["epub"])


WRITERS = {"docx": docx, "pptx": pptx, "odt": odt, "odp": odp, "epub": epub}
FIELDS = ["page_no", "para_no", "text", "text_clean", "heading_level", "list_kind", "list_level", "alignment", "font_size", "is_bold", "x0", "y0", "x1", "y1"]


def write(blocks: DataFrame, name: str) -> DataFrame:
    """(doc_id, content): a package for each document of blocks."""
    make = WRITERS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy = lambda b: {k: None if isinstance(v, float) and v != v else v for k, v in b.items()}
        for b in columns.slices(batches):
            made = [make(f"Document {d}", [tidy(x) for x in own]) for d, own in zip(columns.values(b.column(0)), columns.values(b.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])

    own = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("rows"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, content binary")


def read(packages: DataFrame) -> DataFrame:
    """(doc_id, part_no, part_name, is_stored, content): the parts of packages (doc_id long, content binary), in the order of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    info = z.infolist()
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(info), pa.int64()), pa.array(range(len(info)), pa.int32()), pa.array([i.filename for i in info], pa.string()), pa.array([i.compress_type == zipfile.ZIP_STORED for i in info], pa.bool_()), pa.array([z.read(i) for i in info], pa.binary())], names=["doc_id", "part_no", "part_name", "is_stored", "content"])

    return packages.select(F.col("doc_id").cast("long"), F.col("content").cast("binary")).mapInArrow(run, "doc_id long, part_no int, part_name string, is_stored boolean, content binary")
