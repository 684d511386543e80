"""PDF files as DataFrames: one row a page with its glyphs, vectors and images, and the frames of lines made from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.sources.pdf_layout import BARE, LINE

GLYPH = "struct<seq:int,text:string,x0:double,y0:double,x1:double,y1:double,origin_x:double,origin_y:double,font_name:string,font_size:double,color:int,is_bold:boolean,is_italic:boolean>"
VECTOR = "struct<seq:int,svg_path:string,x0:double,y0:double,x1:double,y1:double,fill_rgb:int,stroke_rgb:int,stroke_width:double,fill_rule:string,dash:array<double>,fill_alpha:double,stroke_alpha:double>"
IMAGE = "struct<seq:int,name:string,x0:double,y0:double,x1:double,y1:double,width:int,height:int,format:string,content:binary,status:string>"
LINES = f"doc_id long, page_no int, width double, height double, rotation int, lines array<{LINE}>, vectors array<{VECTOR}>, images array<{IMAGE}>, meta map<string,string>, error string"
BARE_LINES = LINES.replace(LINE, BARE)
#: Weights of pages that are handed on together: glyphs, or bytes of images over a hundred.
TOGETHER = 20_000
SCHEMA = f"doc_id long, page_no int, width double, height double, rotation int, glyphs array<{GLYPH}>, vectors array<{VECTOR}>, images array<{IMAGE}>, meta map<string,string>, error string"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def parse(files: DataFrame, password: str = "", lines: bool = False, words: bool = True, contents: bool = True) -> DataFrame:
    """A row for each page of files (doc_id long, content binary); a file that can't be read gives one row with its error.

    Files are parsed whole in a worker, a few pages are handed on together, so memory is a file's and theirs, not a batch's.
    With lines, glyphs are joined to words and lines where the page is, and only those are handed on; without words, only lines.
    Without contents, pages are only counted and measured: metadata needs no more.
    """
    ddl = SCHEMA if not lines else LINES if words else BARE_LINES
    schema = _arrow(ddl)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        from quillwork.sources import pdf_layout
        from quillwork.sources.pdf_content import Page, evaluate
        from quillwork.sources.pdf_objects import File, PdfError

        for b in batches:
            for doc_id, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row = {"doc_id": doc_id, "page_no": None, "width": None, "height": None, "rotation": None, "lines" if lines else "glyphs": [], "vectors": [], "images": [], "meta": None, "error": None}
                try:
                    file = File(content.as_py() or b"", password)
                    pages = file.pages()
                    if not pages:
                        raise PdfError("no pages")
                    meta = list(file.metadata().items())
                    for i, page in enumerate(pages):
                        box = page_box(file, page)
                        height = box[3] - box[1]
                        got = evaluate(file, page, (box[0], box[1]), lines) if contents else Page(strips=[] if lines else None)
                        text = pdf_layout.lines(pdf_layout.words_of(got.strips, height)) if lines else got.glyphs
                        made = row | {"page_no": i + 1, "width": box[2] - box[0], "height": height, "rotation": int(file.get(page.get("Rotate")) or 0) % 360, "lines" if lines else "glyphs": text, "vectors": got.vectors, "images": got.images, "meta": meta if i == 0 else None}
                        yield made, 100 + (sum(len(x.chars) for x in got.strips) if lines else len(text)) + len(got.vectors) + sum(len(x["content"] or b"") // 100 for x in got.images)
                except (PdfError, ValueError, TypeError, KeyError, IndexError, RecursionError) as e:
                    yield row | {"error": f"{type(e).__name__}: {e}"}, 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for made, n in rows(batches):
            held.append(made)
            weight += n
            if weight >= TOGETHER:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.select(F.col("doc_id").cast("long"), F.col("content").cast("binary")).mapInArrow(run, ddl)


def page_box(file, page: dict) -> tuple[float, float, float, float]:
    """The part of a page that shows: its crop box within its media box."""

    def corners(name: str) -> tuple[float, ...] | None:
        v = [float(file.get(x)) for x in file.get(page.get(name)) or ()]
        return (min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])) if len(v) == 4 else None

    media = corners("MediaBox") or (0.0, 0.0, 612.0, 792.0)
    crop = corners("CropBox") or media
    both = max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])
    return both if both[2] > both[0] and both[3] > both[1] else media


def page_lines(pages: DataFrame) -> DataFrame:
    """The lines of parse(lines=True), with their words: the frame that the layout operators take."""
    return pages.select("doc_id", "page_no", F.explode("lines").alias("l")).select("doc_id", "page_no", "l.*")


def read(spark: SparkSession, path: str, password: str = "", pattern: str = "*.pdf") -> DataFrame:
    """parse() of the files below a path; doc_id is a hash of the file's path, which comes along as path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    named = files.select(F.xxhash64("path").alias("doc_id"), "path", "content")
    return parse(named, password).join(named.select("doc_id", "path"), "doc_id")


def glyphs(pages: DataFrame) -> DataFrame:
    """Glyph rows in top-down points, with their baseline."""
    g = pages.select("doc_id", "page_no", "height", F.explode("glyphs").alias("g")).select("doc_id", "page_no", "height", "g.*")
    return g.withColumn("top", F.col("height") - F.col("y1")).withColumn("y1", F.col("height") - F.col("y0")).withColumn("y0", F.col("top")).withColumn("baseline_y", F.col("height") - F.col("origin_y")).drop("top", "height")


def vectors(pages: DataFrame) -> DataFrame:
    """Vector rows in top-down points."""
    v = pages.select("doc_id", "page_no", "height", F.explode("vectors").alias("v")).select("doc_id", "page_no", "height", "v.*")
    return v.withColumn("top", F.col("height") - F.col("y1")).withColumn("y1", F.col("height") - F.col("y0")).withColumn("y0", F.col("top")).drop("top", "height")


def words(chars: DataFrame) -> DataFrame:
    """glyphs() joined to words: neighbours on a baseline (0.35 of the size), apart by -0.2 to 0.15 of the size, of one style. White space parts words."""
    order = W.partitionBy("doc_id", "page_no").orderBy(F.round("baseline_y", 1), "x0", "seq")
    prev = lambda c: F.lag(c).over(order)
    gap = F.col("x0") - prev("x1")
    new = (F.trim("text") == "") | (F.trim(prev("text")) == "") | (F.abs(F.col("baseline_y") - prev("baseline_y")) > 0.35 * F.col("font_size")) | (gap > 0.15 * F.col("font_size")) | (gap < -0.2 * F.col("font_size")) | (F.col("font_name") != prev("font_name")) | (F.abs(F.col("font_size") - prev("font_size")) > 0.5) | (F.col("is_bold") != prev("is_bold"))
    at = chars.withColumn("_w", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order)).where(F.trim("text") != "")
    return at.groupBy("doc_id", "page_no", F.col("_w").cast("int").alias("word_no")).agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(x0, seq, text))), g -> g.text), '')").alias("word"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("baseline_y").alias("baseline_y"),
        F.first("font_name").alias("font_name"), F.first("font_size").alias("font_size"), F.bool_or("is_bold").alias("is_bold"), F.bool_or("is_italic").alias("is_italic"),
    )


def lines(page_words: DataFrame) -> DataFrame:
    """words() joined to lines: one baseline (0.4 of the size), parted where words stand more than max(24, 2.5 sizes) apart. The frame that the layout operators take."""
    down = W.partitionBy("doc_id", "page_no").orderBy(F.round("baseline_y", 1), "x0", "word_no")
    new = F.coalesce(F.abs(F.col("baseline_y") - F.lag("baseline_y").over(down)) > 0.4 * F.col("font_size"), F.lit(False))
    at = page_words.withColumn("_l", F.sum(new.cast("int")).over(down))
    right = W.partitionBy("doc_id", "page_no", "_l").orderBy("x0", "word_no")
    wide = F.col("x0") - F.lag("x1").over(right) > F.greatest(F.lit(24.0), 2.5 * F.greatest("font_size", F.lag("font_size").over(right)))
    at = at.withColumn("_p", F.sum(F.coalesce(wide, F.lit(False)).cast("int")).over(right))
    rows = at.groupBy("doc_id", "page_no", "_l", "_p").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(x0, word_no, word))), w -> w.word), ' ')").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("baseline_y").alias("baseline_y"),
        (F.sum(F.col("font_size") * F.length("word")) / F.sum(F.length("word"))).alias("font_size"), F.bool_or("is_bold").alias("is_bold"), F.bool_or("is_italic").alias("is_italic"),
    )
    seq = F.row_number().over(W.partitionBy("doc_id", "page_no").orderBy(F.round("y0", 1), "x0", "_l", "_p")) - 1
    return rows.withColumn("seq", seq.cast("int")).drop("_l", "_p")
