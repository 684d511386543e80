"""Steps whose time or memory grew faster than their input, each on a small case that shows it."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillwork.functions import codecs, columns
from quillwork.functions import text as tx
from quillwork.operators import fonts, layout, spatial
from quillwork.plans import catalog, emit, rich
from quillwork.sources import pdf, pdf_content, pdf_layout, pdf_writer
from quillwork.sources.pdf_objects import File


def test_columns_as_python_values():
    rows = [{"a": 1, "r": [{"t": "x", "b": True}, {"t": None, "b": None}], "f": 0.5}, None, {"a": None, "r": None, "f": None}, {"a": 4, "r": [], "f": 2.0}, {"a": 5, "r": [{"t": "é", "b": False}], "f": None}]
    a = pa.array(rows)
    assert columns.values(a) == rows
    assert columns.values(a.slice(1, 3)) == rows[1:4] and columns.values(a.slice(4)) == rows[4:] and columns.values(a.slice(5)) == []


def test_slices_hold_few_bytes():
    b = pa.record_batch([pa.array([[{"t": "word "}] * 100] * 1000)], names=["r"])
    parts = list(columns.slices([b], 1 << 14))
    assert sum(p.num_rows for p in parts) == 1000 and max(p.num_rows for p in parts) < 30
    assert [x for p in parts for x in columns.values(p.column(0))] == b.column(0).to_pylist()


def test_words_are_rendered_once():
    run = {"text": "50% ", "font": "Helvetica", "size": 11.0, "color": 0, "bold": True, "italic": False, "underline": False, "strike": False, "script": None, "baseline": None}
    made = []

    @rich.remembered("color")
    def render(r):
        made.append(r)
        return r["text"]

    assert [render(dict(run)) for _ in range(9)] == ["50% "] * 9 and len(made) == 1
    assert render(run | {"color": 255}) == "50% " and len(made) == 2
    assert rich.latex_run(run) == "\\textbf{50\\%} " and rich.latex_run(run | {"bold": False}) == "50\\% "


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_canvas_rows_keep_lines_whole(spark):
    rows = [(1, 1, 0, 24.0, 6.0, "abcdef"), (1, 1, 1, 25.0, 18.0, "X Z"), (1, 1, 2, 24.0, 48.0, "far"), (1, 1, 3, 60.0, 600.0, "cut here"), (1, 1, 4, 72.0, 700.0, "off"), (1, 1, 5, 84.0, 0.0, ""), (1, 1, 6, 96.0, 0.0, "  ")]
    lines = spark.createDataFrame(rows, "doc_id long, page_no int, seq int, y0 double, x0 double, text string")
    made = emit.canvas_rows(lines)
    assert sorted((r.row, r.content) for r in made.collect()) == [(2, " abX Zf far"), (5, " " * 100 + "cu"), (8, "")]
    assert "Generate" not in plan_of(made)


def test_code_page_searches_a_text_once_for_each_script(spark):
    rows = spark.createDataFrame([("plain é",), ("Привет ab",), ("漢字かな",), ("漢字漢字",), ("",), (None,)], "t string")
    made = rows.select(tx.rtf_codepage(F.col("t")).alias("c"))
    assert [r.c for r in made.collect()] == [1252, 1251, 932, 936, 1252, 1252]
    assert plan_of(made).count("regexp_replace") <= len(tx.SCRIPTS) + 1


LINES = [{"page_no": p, "seq": i, "text": f"The line {i} of page {p}, é(ö)", "x0": 72.0 + 18 * (i % 3), "y0": 84.0 + 14 * i, "font_size": 18.0 if i == 0 else 11.0, "is_bold": i == 0} for p in (1, 2, 3) for i in range(20)]


@pytest.mark.parametrize("variant", pdf_writer.VARIANTS)
def test_lines_of_strips_are_those_of_glyphs(variant, monkeypatch):
    f = File(pdf_writer.document(LINES, variant))
    built = []
    monkeypatch.setattr(pdf_content, "to_unicode", lambda data, real=pdf_content.to_unicode: built.append(1) or real(data))
    pages = f.pages()
    strips = [pdf_content.evaluate(f, p, strips=True).strips for p in pages]
    assert len(built) == 2  # two fonts, whatever the pages
    want = [pdf_layout.lines(pdf_layout.words(pdf_content.evaluate(f, p).glyphs, 792.0)) for p in pages]
    monkeypatch.setattr(pdf_layout, "words", None)  # tight strips need no glyphs
    assert [pdf_layout.lines(pdf_layout.words_of(s, 792.0)) for s in strips] == want
    assert [x["text"] for page in want for x in page] == [x["text"] for x in LINES]


def test_strips_that_cross_or_turn_fall_back_to_glyphs():
    f = File(pdf_writer.document(LINES))
    page = f.pages()[0]
    for content in (b"BT /F0 11 Tf 1 0 0 1 72 700 Tm <000500060007> Tj 1 0 0 1 74 700 Tm <0005> Tj ET", b"BT /F0 11 Tf 0 1 -1 0 72 700 Tm <00050006> Tj 2 Tc 1 0 0 1 72 600 Tm <00050006> Tj ET", b"BT /F0 11 Tf 50 Tz 1 0 0 1 72 700 Tm <0005> Tj <0006> Tj ET"):
        made = []
        for strips in (False, True):
            out = pdf_content.Page(strips=[] if strips else None)
            pdf_content.Evaluator(f, page["Resources"], out).run(content)
            made.append(pdf_layout.words_of(out.strips, 792.0) if strips else pdf_layout.words(out.glyphs, 792.0))
        assert made[0] == made[1] and made[0]


def test_pages_are_handed_on_together(spark):
    files = spark.createDataFrame([(1, bytearray(pdf_writer.document(LINES, title="T"))), (2, bytearray(b"no pdf"))], "doc_id long, content binary")
    bare = pdf.parse(files, contents=False).collect()
    assert [(r.doc_id, r.page_no, r.meta and r.meta["Title"]) for r in bare] == [(1, 1, "T"), (1, 2, None), (1, 3, None), (2, None, None)] and not any(r.glyphs for r in bare)
    lines = pdf.parse(files, lines=True, words=False).where("error is null")
    assert pdf.page_lines(lines).columns == ["doc_id", "page_no", *[c for c in pdf.page_lines(pdf.parse(files, lines=True)).columns if c not in ("doc_id", "page_no", "ws")]]
    assert [r.text for r in pdf.page_lines(lines).collect()] == [x["text"] for x in LINES]


def test_nearest_boxes_by_brute_force(spark):
    r = random.Random(5)
    box = lambda i: (i, x := float(r.choice([r.randint(-300, 300), 16 * r.randint(-9, 9)])), y := float(r.randint(-300, 300)), x + r.choice([0, 5, 16, 48, 200, -7]), y + r.choice([0, 8, 32, 64, -3]))
    boxes = [box(i) for i in range(150)] + [(1000 + i, 0.0, 0.0, 64.0, 64.0) for i in range(300)] + [(999, 2000.0, 2000.0, 2001.0, 2001.0), (998, None, 0.0, 1.0, 1.0)]
    points = [(i, r.choice([float(r.randint(-400, 400)), 16.0 * r.randint(-20, 20), r.uniform(-400, 400)]), r.uniform(-400, 400)) for i in range(200)] + [(900, 2081.0, 2000.0), (901, 2081.5, 2000.0), (902, None, 3.0), (903, 32.0, 32.0)]
    b = spark.createDataFrame(boxes, "b long, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(points, "p long, px double, py double")
    for k, far in ((3, 80.0), (1, 80.0), (5, 7.0), (2, 300.0), (2, 0.0)):
        want = set()
        for i, x, y in points:
            ds = sorted((math.hypot(max(0.0, x0 - x, x - x1), max(0.0, y0 - y, y - y1)), j) for j, x0, y0, x1, y1 in boxes if x is not None and x0 is not None)
            want |= {(i, n + 1, j, round(d, 6)) for n, (d, j) in enumerate([t for t in ds if t[0] <= far][:k])}
        assert {(q.p, q.rank, q.b, round(q.dist, 6)) for q in spatial.nearest(p, b, "p", "b", k, far).collect()} == want
    stacked = spatial.uncovered(b.where("b >= 1000"), "b", 3, 16.0).where("_covers = 1").groupBy("_cx", "_cy").count()
    assert {q["count"] for q in stacked.collect()} == {3}


def test_overlaps_are_spread_over_tasks(spark):
    b = spark.createDataFrame([(i, float(i), 0.0, i + 1.5, 9.0) for i in range(40)], "b long, x0 double, y0 double, x1 double, y1 double")
    met = spatial.overlaps(b.withColumnRenamed("b", "a"), b, "a", "b", ordered=True)
    assert sorted(met.collect()) == [(i, i + 1) for i in range(39)]
    assert met.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def test_codecs_hold_few_values_at_a_time(spark):
    assert list(codecs._parts([600_000] * 3 + [5_000_000, 1])) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)] and list(codecs._parts([400_000] * 3)) == [(0, 2), (2, 3)] and list(codecs._parts([])) == []
    rows = spark.createDataFrame([(bytearray(b"pqr" * 9), ["AHx"]), (None, ["AHx"]), (bytearray(b"zz>"), ["AHx"]), (bytearray(b"x"), ["DCT"]), (bytearray(b"q"), None), (bytearray(b"q"), ["No"])], "d binary, f array<string>")
    out = rows.select(codecs.encode_stream("hex")("d").alias("e"), codecs.decode_stream("d", "f", F.lit(None).cast("array<map<string,string>>")).alias("s")).collect()
    assert [r.s.status for r in out if r.e] == ["not hexadecimal", "not hexadecimal", "passed", "ok", "no filter No"] and out[1].s.content is None
    assert [bytes(r.e) if r.e else None for r in out][:2] == [(b"pqr" * 9).hex().encode() + b">", None]


def test_predictors_by_whole_rows():
    data = bytes(i * 7 % 256 for i in range(100))
    up = codecs.encode_png_rows(data, 16, 2)
    assert codecs.png_rows(up, 16)[:100] == data and codecs.png_rows(up[:17] + b"\0" + up[18:], 16)[:16] == data[:16]
    assert codecs.tiff_rows(bytes([1, 2, 3, 250, 10, 5]), 3) == bytes([1, 3, 6, 250, 4, 9]) and codecs.tiff_rows(b"", 3) == b""
    assert codecs.lzw(codecs.encode_lzw(data * 200)) == data * 200 and codecs.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_codes_are_decoded_where_they_are(spark):
    ranges = spark.createDataFrame([(1, 1, 5, 0x410), (1, 3, 4, 0x1F600), (3, 1, 3, 0x410), (3, 1 << 20, 1 << 20, 0x41)], "font_id long, lo long, hi long, target long")
    each = [(i, f, c) for f in (1, 2, 3) for i, c in enumerate([1, 3, 5, 65, 233, 300, 0, 1 << 20, 1 << 40])]
    want = fonts.decoded(spark.createDataFrame(each, "i int, font_id long, code long"), fonts.code_table(ranges)).collect()
    rows = spark.createDataFrame([(f, [c for _, g, c in each if g == f]) for f in (1, 2, 3)] + [(1, [])], "font_id long, codes array<long>")
    made = fonts.decoded_arrays(rows, fonts.code_table(ranges))
    assert sorted(r.text for r in made.collect()) == sorted(["".join(r.text for r in sorted(want, key=lambda r: r.i) if r.font_id == f) for f in (1, 2, 3)] + [""])
    docs = plan_of(catalog.QUERIES["cmap_decode"](spark, "/root/testdata/sf0.001"))
    assert "posexplode" not in docs


def test_steps_do_not_compute_their_input_twice(spark):
    body = spark.createDataFrame([(1, 1, 0, "a<b", 72.0, 84.0, 18.0, True), (1, 2, 0, "c", 72.0, 84.0, 11.0, False), (2, 1, 0, None, 72.0, 84.0, 11.0, False)], "doc_id long, page_no int, seq int, text string, x0 double, y0 double, font_size double, is_bold boolean")
    made = emit.svg(body)
    assert "Join" not in plan_of(made)
    got = {r.doc_id: r.content for r in made.collect()}
    assert list(got) == [1] and 'height="1604"' in got[1] and got[1].index("a&lt;b") < got[1].index(">c<")
    ddl = "doc_id long, page_no int, para_no int, text string, text_clean string, heading_level int, list_group int, list_kind string, alignment string"
    blocks = spark.createDataFrame([(1, 1, 0, "Head", "Head", 1, None, None, "left"), (1, 1, 1, "- x", "x", None, 1, "bullet", "left"), (1, 1, 2, "- y", "y", None, 1, "bullet", "left"), (1, 1, 3, "", "", None, None, None, "left")], ddl)
    made = emit.latex(blocks)
    assert "Join" not in plan_of(made)
    assert "\\section{Head}\n\n\\begin{itemize}\n\\item x\n\\item y\n\\end{itemize}\n\n\\end{document}" in made.first().content


def test_underlines_meet_words_once(spark):
    words = spark.createDataFrame([(1, 1, 0, i, f"w{i}", 50.0 * i, 20.0, 50.0 * i + 40, 31.5, 11.0) for i in range(4)], "doc_id long, page_no int, seq int, pos int, word string, x0 double, y0 double, x1 double, y1 double, font_size double")
    rules = spark.createDataFrame([(1, 1, 0.0, 33.0, 40.0, 34.0), (1, 1, 75.0, 33.0, 120.0, 34.0), (1, 1, 150.0, 45.0, 190.0, 46.0), (2, 1, 50.0, 33.0, 90.0, 34.0)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    made = layout.underlined(words, rules)
    assert sorted((r.pos, r.is_underline) for r in made.collect()) == [(0, True), (1, False), (2, True), (3, False)]
    assert plan_of(made).count("Join") == 1
