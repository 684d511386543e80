"""Conversion of PDF files: whole folders as DataFrames, or single files and bytes as with a converter."""

from __future__ import annotations

import pathlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.operators import layout
from quillwork.plans import emit, ir
from quillwork.sources import pdf

MODES = ("flow", "canvas")


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("quillwork").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def line_frame(pages: DataFrame) -> DataFrame:
    """The lines of parsed pages."""
    return pdf.lines(pdf.words(pdf.glyphs(pages.where("error is null"))))


def body_lines(lines: DataFrame) -> DataFrame:
    """lines without page numbers and what is repeated in the margins of a document's pages."""
    return layout.regions(lines, layout.repeated_margins(lines)).where("region = 'body'").drop("region")


def blocks(lines: DataFrame) -> DataFrame:
    """Paragraphs with heading levels and list groups, from a frame of lines."""
    return layout.list_groups(layout.list_items(layout.headings(layout.paragraphs(lines))))


def convert_files(files: DataFrame, output_format: str = "docx", mode: str = "flow", password: str = "", images: bool = True, vectors: bool = True) -> DataFrame:
    """(doc_id, content, error) for each of files (doc_id long, content binary): the document in the format, or why it can't be read.

    Flow gives the text in reading order with tables, images and vectors between; canvas keeps places (html, docx, odt, txt,
    and svg, pptx and odp always). images and vectors may be left out.
    """
    name = emit.format_name(output_format)
    if mode not in MODES:
        raise ValueError(f"modes are {', '.join(MODES)}")
    pages = pdf.parse(files, password, lines=True)
    made = ir.rendered(pages, name, mode, images, vectors)
    errors = pages.groupBy("doc_id").agg(F.max("error").alias("error"))
    return errors.join(made, "doc_id", "left").select("doc_id", "content", "error")


def extract_images(files: DataFrame, password: str = "") -> DataFrame:
    """(doc_id, page_no, name, format, width, height, content) of the images of files, for a table or folder of their own."""
    pages = pdf.parse(files, password, lines=True)
    return pages.select("doc_id", "page_no", F.explode("images").alias("i")).select("doc_id", "page_no", "i.name", "i.format", "i.width", "i.height", "i.content")


def image_folder(option: bool | str | None, output_path: str | None) -> tuple[str | None, str | None]:
    """Where images go and how documents name that place: none for None or False, beside the output for True or an empty name, else the folder given."""
    if option is None or option is False:
        return None, None
    if isinstance(option, str) and option.strip():
        return option, pathlib.PurePath(option).name
    name = (pathlib.PurePath(output_path).stem if output_path else "output") + "_images"
    return str(pathlib.PurePath(output_path).parent / name) if output_path else name, name


def convert_bytes(pdf_bytes: bytes, output_format: str = "docx", mode: str = "flow", password: str = "", images: bool = True, vectors: bool = True) -> bytes:
    """One file's bytes to the format's bytes; raises ValueError for a file that can't be read."""
    row = convert_files(session().createDataFrame([(0, bytearray(pdf_bytes))], "doc_id long, content binary"), output_format, mode, password, images, vectors).first()
    if row.error:
        raise ValueError(row.error)
    return bytes(row.content or b"")


def convert(input_path: str, output_format: str = "docx", output_path: str | None = None, mode: str = "flow", password: str = "", images: bool = True, vectors: bool = True, image_option: bool | str | None = None) -> bytes:
    """A local file to the format's bytes, which are also written to output_path if it is given; with image_option its images go to image_folder() as files."""
    source = pathlib.Path(input_path)
    if not source.is_file():
        raise FileNotFoundError(f"no file {input_path}")
    raw = source.read_bytes()
    data = convert_bytes(raw, output_format, mode, password, images, vectors)
    if output_path:
        target = pathlib.Path(output_path)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    folder, _ = image_folder(image_option, output_path)
    if folder:
        pathlib.Path(folder).mkdir(parents=True, exist_ok=True)
        for i, r in enumerate(extract_images(session().createDataFrame([(0, bytearray(raw))], "doc_id long, content binary"), password).collect()):  # one file's
            pathlib.Path(folder, f"page{r.page_no}_{i + 1}.{ {'jpeg': 'jpg'}.get(r.format, r.format) }".replace(" ", "")).write_bytes(bytes(r.content or b""))
    return data
