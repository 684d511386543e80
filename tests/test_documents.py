"""PDF files, emitters, packages and streams, end to end."""

import io
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillwork import api
from quillwork.functions import codecs
from quillwork.functions.aes import decrypt_cbc
from quillwork.plans import emit
from quillwork.sources import packages, pdf, pdf_writer
from quillwork.sources.pdf_content import evaluate, to_unicode
from quillwork.sources.pdf_objects import File, PdfError, Scanner

LINES = [
    {"page_no": 1, "seq": 0, "text": "The Title", "x0": 72.0, "y0": 84.0, "font_size": 18.0, "is_bold": True},
    {"page_no": 1, "seq": 1, "text": "A first line of the body & more", "x0": 72.0, "y0": 114.0, "font_size": 11.0, "is_bold": False},
    {"page_no": 1, "seq": 2, "text": "that goes on in a second line.", "x0": 72.0, "y0": 128.0, "font_size": 11.0, "is_bold": False},
    {"page_no": 1, "seq": 3, "text": "- an item", "x0": 90.0, "y0": 158.0, "font_size": 11.0, "is_bold": False},
    {"page_no": 2, "seq": 0, "text": "Zweite Seite, größer", "x0": 72.0, "y0": 84.0, "font_size": 11.0, "is_bold": False},
]


@pytest.mark.parametrize("variant", pdf_writer.VARIANTS)
def test_round_trip(variant):
    f = File(pdf_writer.document(LINES, variant, "A title"))
    assert f.metadata() == {"Title": "A title"}
    pages = [evaluate(f, p) for p in f.pages()]
    assert ["".join(g["text"] for g in p.glyphs) for p in pages] == ["".join(x["text"] for x in LINES if x["page_no"] == n) for n in (1, 2)]


def test_damaged_references_are_searched():
    data = pdf_writer.document(LINES)
    assert len(File(data.replace(b"startxref\n", b"startxref\n9")).pages()) == 2
    assert len(File(data[: data.rindex(b"xref\n0")]+ b"trailer << /Root 1 0 R >>").pages()) == 2


def test_errors_are_rows(spark):
    files = [(1, bytearray(pdf_writer.document(LINES))), (2, bytearray(b"no pdf")), (3, None), (4, bytearray(b"%PDF-1.4 nothing"))]
    rows = pdf.parse(spark.createDataFrame(files, "doc_id long, content binary")).collect()
    assert sorted((r.doc_id, r.error is None) for r in rows) == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    with pytest.raises(ValueError):
        api.convert_bytes(b"no pdf", "md")
    with pytest.raises(PdfError):
        File(pdf_writer.document(LINES, "rc4").replace(b"/P -4", b"/P -8"))


def test_operators():
    content = b"q 2 0 0 2 10 10 cm 1 0 0 rg 0 0 10 10 re f Q BT /F 10 Tf 2 Tc 5 Ts (ab) Tj 3 Tc [(c) -100 (d)] TJ T* ET 0 0 m 10 0 l S BI /W 1 ID xx EI 1 g"
    data = b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R] /Count 1 >> endobj 3 0 obj << /Contents 4 0 R /MediaBox [0 0 100 100] >> endobj 4 0 obj << /Length %d >> stream\n%s\nendstream endobj trailer << /Root 1 0 R >>" % (len(content), content)
    f = File(data)
    page = evaluate(f, f.pages()[0])
    assert [(v["x0"], v["y1"], v["fill_rgb"], v["stroke_rgb"]) for v in page.vectors] == [(10.0, 30.0, 0xFF0000, None), (0.0, 0.0, None, 0)]
    assert [g["origin_x"] for g in page.glyphs] == [0.0, 7.0, 14.0, 23.0]
    assert {g["origin_y"] for g in page.glyphs} == {5.0}


def test_scanner():
    s = Scanner(rb"<< /A#20B [1 -2.5 true null (a\(b\)\101\n(c)) <48 6> 3 0 R] >> % end")
    (items,) = s.value().values()
    assert items[:3] == [1, -2.5, True] and items[4:6] == [b"a(b)A\n(c)", b"H`"] and items[6].number == 3
    assert to_unicode(b"1 beginbfrange <0001> <0003> <0041> endbfrange 1 beginbfchar <0005> <00660066> endbfchar") == {1: "A", 2: "B", 3: "C", 5: "ff"}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs(data):
    assert codecs.ascii_hex(codecs._encoder("hex")(data)) == data
    assert codecs.ascii_85(codecs._encoder("ascii85")(data)) == data
    assert codecs.run_length(codecs.encode_run_length(data)) == data
    assert codecs.lzw(codecs.encode_lzw(data)) == data
    assert codecs.decode(zlib.compress(data), ["Fl"]) == data
    for kind in (0, 1, 2):
        assert codecs.png_rows(codecs.encode_png_rows(data, 7, kind), 7)[: len(data)] == data
    assert codecs.rc4(b"key", codecs.rc4(b"key", data)) == data


def test_lzw_of_long_data():
    data = bytes(i * i % 251 for i in range(40_000))
    assert codecs.lzw(codecs.encode_lzw(data)) == data


def test_aes(spark):
    key, text = bytes(range(16)), b"some plain text, longer than a block"
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(bytearray(text), bytearray(key))], "t binary, k binary").select(F.aes_encrypt("t", "k", F.lit("CBC"), F.lit("PKCS")).alias("c")).first()
    assert decrypt_cbc(key, bytes(row.c)) == text


@pytest.fixture(scope="module")
def made(spark):
    files = spark.createDataFrame([(7, bytearray(pdf_writer.document(LINES)))], "doc_id long, content binary")
    return {f: bytes(api.convert_files(files, f).first().content) for f in emit.FORMATS}


def test_text_formats(made):
    assert made["md"].decode() == "# The Title\n\nA first line of the body & more that goes on in a second line.\n\n  - - an item\n\n---\n\nZweite Seite, größer"
    assert "<h1>The Title</h1>" in made["html"].decode() and "<ul>\n<li>an item</li>\n</ul>" in made["html"].decode() and "body &amp; more" in made["html"].decode()
    assert "\\section{The Title}" in made["latex"].decode() and "\\begin{itemize}\n\\item an item\n\\end{itemize}" in made["latex"].decode()
    assert "= The Title" in made["typst"].decode() and "- an item" in made["typst"].decode()
    assert made["rtf"].isascii() and made["rtf"].count(b"{") == made["rtf"].count(b"}") and b"gr\\u246?\\u223?er" in made["rtf"]
    assert sum(x.tag.endswith("}text") for x in ET.fromstring(made["svg"]).iter()) == len(LINES)


@pytest.mark.parametrize("name", ["docx", "pptx", "odt", "odp", "epub"])
def test_packages(name, made, spark):
    with zipfile.ZipFile(io.BytesIO(made[name])) as z:
        names = z.namelist()
        for n in names:
            if n.endswith((".xml", ".rels", ".opf", ".xhtml")):
                ET.fromstring(z.read(n))
        if name in ("odt", "odp", "epub"):
            first = z.infolist()[0]
            assert (first.filename, first.compress_type, first.extra) == ("mimetype", zipfile.ZIP_STORED, b"") and z.read("mimetype").decode() == packages.MEDIA[name]
        assert any("größer".encode() in z.read(n) for n in names)
    rows = packages.read(spark.createDataFrame([(1, bytearray(made[name]))], "doc_id long, content binary")).collect()
    assert [r.part_name for r in sorted(rows, key=lambda r: r.part_no)] == names


def test_canvas(spark):
    """The first line's top is at 114 + 10 - 0.8 * 11 = 115.2 points, nearest to row 10 of twelve points."""
    text = api.convert_bytes(pdf_writer.document(LINES), "txt", "canvas").decode()
    pages = text.split("\n\f\n")
    assert len(pages) == 2 and pages[0].split("\n")[10] == " " * 12 + "A first line of the body & more"


def test_repeated_margins_go(spark):
    lines = [{"page_no": p, "seq": i, "text": t, "x0": 72.0, "y0": y, "font_size": 10.0, "is_bold": False} for p in (1, 2) for i, (t, y) in enumerate((("Running head", 40.0), (f"Body of page {'ab'[p - 1]}", 300.0), (f"Page {p} of 2", 750.0)))]
    assert api.convert_bytes(pdf_writer.document(lines), "md").decode() == "Body of page a\n\n---\n\nBody of page b"


def test_formats():
    assert [emit.format_name(x) for x in (".MD", "markdown", "tex", "typ", "Docx")] == ["md", "md", "latex", "typst", "docx"]
    with pytest.raises(ValueError):
        emit.format_name("xls")


def test_command(tmp_path, capsys):
    from quillwork.__main__ import main

    (tmp_path / "a.pdf").write_bytes(pdf_writer.document(LINES))
    assert main([str(tmp_path / "a.pdf"), "-f", "tex"]) == 0 and (tmp_path / "a.tex").exists()
    assert main([str(tmp_path / "none.pdf")]) == 1 and main([str(tmp_path / "a.pdf"), "-f", "xls"]) == 1
    assert "error" in capsys.readouterr().err


def test_stream(spark, tmp_path):
    from quillwork.streaming import ingest

    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.pdf").write_bytes(pdf_writer.document(LINES, "flate"))
        ingest.start(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    assert pdf.read(spark, str(source)).count() == 6


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.sampled_from([0, 2, 4, 6]), st.randoms())
def test_png(width, height, color, random):
    from quillwork.functions import images

    data = random.randbytes(width * height * images.CHANNELS[color])
    png = images.encode_png(width, height, data, color)
    assert images.decode_png(png) == (width, height, color, 8, data)
    assert images.image_info(png) == {"format": "png", "width": width, "height": height, "channels": images.CHANNELS[color], "depth": 8}
    with pytest.raises(ValueError):
        images.decode_png(png[:-6] + b"\0" + png[-5:])


def test_image_headers():
    from quillwork.functions.images import image_info

    size = lambda b: (lambda i: i and (i["format"], i["width"], i["height"]))(image_info(b))
    assert size(b"GIF89a" + (7).to_bytes(2, "little") + (9).to_bytes(2, "little")) == ("gif", 7, 9)
    assert size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x06\x03") == ("jpeg", 6, 5)
    assert size(b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (9).to_bytes(3, "little") + (4).to_bytes(3, "little")) == ("webp", 10, 5)
    assert size(b"\xff\x4f\xff\x51\x00\x29\x00\x00" + b"".join(n.to_bytes(4, "big") for n in (11, 12, 1, 2)) + bytes(16) + b"\x00\x03\x07") == ("jp2", 10, 10)
    assert image_info(b"") is None and image_info(b"\xff\xd8") is None


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from quillwork.functions import geometry, text

    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(text.code_fence(F.lit("a ``` b"))) == "````\na ``` b\n````"
    assert one(text.escape_typst(F.lit("a*b /* c // d\n"))) == "a\\*b \\/\\* c \\// d \\\n"
    assert one(text.rtf_text(F.lit("é😀{"))) == "\\u233?\\u-10179?\\u-8704?\\{"
    assert [one(text.pdf_date(F.lit(x))) for x in ("D:2024", "D:20241301", "D:20240102030405Z", "no date", "D:202401020304-05'30'")] == ["2024", "D:20241301", "2024-01-02T03:04:05Z", "no date", "2024-01-02T03:04:00-05:30"]
    assert tuple(one(text.font_style(F.lit("ABCDEF+Times-BoldItalic")))) == ("Times", True, True)
    assert [one(geometry.from_hex(F.lit(x))) for x in ("#fff", "0a0b0c80", "12")] == [(255, 255, 255, 1.0), (10, 11, 12, 128 / 255), None]
    assert one(geometry.inverse(geometry.affine(*[F.lit(x) for x in (1, 2, 2, 4, 0, 0)]))) is None


def test_hairy_paragraphs(spark):
    """Blank and single lines, gaps, indents and sizes: paragraphs by a plain fold."""
    from quillwork.operators import layout

    import random

    rng, rows = random.Random(5), []
    for page in range(30):
        y = 80.0
        for i in range(rng.randrange(1, 14)):
            rows.append((1, page, i, "words here", 72.0 + rng.choice([0, 0, 0, 12]), y, 300.0, y + 12, float(rng.choice([11, 11, 11, 14])), False, False))
            y += 12 + rng.choice([2, 2, 2, 3, 4, 9])
    df = spark.createDataFrame(rows, "doc_id long, page_no int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean, is_italic boolean")
    got = {(r.page_no, r.seq): r.para_no for r in layout.paragraph_numbers(df).collect()}
    for page in range(30):
        own = [r for r in rows if r[1] == page]
        gaps = sorted(b[5] - a[7] for a, b in zip(own, own[1:], strict=False) if b[5] >= a[7])
        limit, n = max(3.0, 1.6 * (gaps[len(gaps) // 2] if gaps else 4.0)), 0
        for a, b in zip([None, *own], own, strict=False):
            if a and (b[5] - a[7] > limit or abs(b[8] - a[8]) > max(2.5, 0.2 * a[8]) or b[4] - a[4] > 10):
                n += 1
            assert got[page, b[2]] == n
