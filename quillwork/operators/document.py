"""The document model: blocks in order, outlines, chapters, and the rules that a valid document keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]


def ordered_blocks(blocks: DataFrame, order: str = "page") -> DataFrame:
    """blocks with block_no from 0 on each page: by (y0 to a tenth, x0), or with order 'reading' by the path in node."""
    by = [F.round("y0", 1), "x0"] if order == "page" else ["node", F.round("y0", 1), "x0"]
    return blocks.withColumn("block_no", (F.row_number().over(W.partitionBy(*PAGE).orderBy(*by, "para_no")) - 1).cast("int"))


def outline(paras: DataFrame, max_level: int = 3) -> DataFrame:
    """(doc_id, entry_no, page_no, level, title): headings down to max_level, numbered through the document."""
    heads = paras.where((F.col("heading_level") <= max_level) & (F.trim("text") != ""))
    return heads.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("page_no", "para_no"))).cast("int").alias("entry_no"), "page_no", F.col("heading_level").alias("level"), F.trim("text").alias("title"))


def outline_parents(entries: DataFrame, max_level: int = 6) -> DataFrame:
    """outline()'s entries with parent_no, the nearest earlier entry of a smaller level (null at the top)."""
    before = W.partitionBy("doc_id").orderBy("entry_no").rowsBetween(W.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") <= k, F.col("entry_no")), ignorenulls=True).over(before) for k in range(1, max_level)}
    at = entries.withColumns({f"_last{k}": c for k, c in last.items()})
    case = F.lit(None).cast("int")
    for k in range(1, max_level):
        case = F.when(F.col("level") == k + 1, F.col(f"_last{k}")).otherwise(case)
    at = at.withColumn("parent_no", case).drop(*[f"_last{k}" for k in last])
    return at


def outline_depths(entries: DataFrame) -> DataFrame:
    """(doc_id, entry_no, depth): how deep each entry stands, from 1, by a fold over a document's entries that holds the levels open so far."""
    own = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("entry_no", "level"))).alias("e"))
    none = F.array().cast("array<int>")
    state = F.struct(none.alias("open"), F.array().cast("array<struct<entry_no:int,depth:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        above = F.filter(s.open, lambda k: k < x.level)
        return F.struct(F.concat(above, F.array(x.level)).alias("open"), F.concat(s.out, F.array(F.struct(x.entry_no.alias("entry_no"), (F.size(above) + 1).alias("depth")))).alias("out"))

    return own.select("doc_id", F.explode(F.aggregate("e", state, step, lambda s: s.out)).alias("o")).select("doc_id", "o.entry_no", "o.depth")


def chapters(paras: DataFrame, max_pages: int = 10) -> DataFrame:
    """paras with chapter_no from 1: a new chapter at each heading of level 1; documents without any are cut every max_pages pages."""
    order = W.partitionBy("doc_id").orderBy("page_no", "para_no")
    first = ((F.col("heading_level") == 1) & (F.trim("text") != "")).cast("int")
    at = paras.withColumn("_h", F.coalesce(first, F.lit(0))).withColumn("_any", F.max("_h").over(W.partitionBy("doc_id")))
    by_head = F.greatest(F.lit(1), F.sum("_h").over(order) + F.when(F.first("_h").over(order) == 1, 0).otherwise(1))
    by_page = F.expr(f"cast((page_no - 1) div {max_pages} + 1 as int)")
    return at.withColumn("chapter_no", F.when(F.col("_any") == 1, by_head).otherwise(by_page).cast("int")).drop("_h", "_any")


def chapter_titles(chaptered: DataFrame, fallback: str = "Chapter") -> DataFrame:
    """(doc_id, chapter_no, title, n_paras): the first heading of level 1 to 3, else the fallback and the number."""
    head = F.min(F.when((F.col("heading_level") <= 3) & (F.trim("text") != ""), F.struct("page_no", "para_no", F.trim("text").alias("t"))))
    return chaptered.groupBy("doc_id", "chapter_no").agg(head.alias("h"), F.count("*").alias("n_paras")).select("doc_id", "chapter_no", F.coalesce("h.t", F.concat_ws(" ", F.lit(fallback), F.col("chapter_no").cast("string"))).alias("title"), "n_paras")


#: Name and SQL of each rule that a block keeps; a null counts as kept.
RULES = {
    "page_number": "page_no >= 1",
    "box": "x1 >= x0 and y1 >= y0",
    "heading_level": "heading_level is null or heading_level between 1 and 6",
    "list_level": "list_level >= 0",
    "font_size": "font_size > 0",
    "line_spacing": "line_spacing > 0",
}


def violations(blocks: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """blocks with violations, the names of the rules that each one breaks, in the order of the rules."""
    return blocks.withColumn("violations", F.filter(F.array(*[F.when(~F.coalesce(F.expr(sql), F.lit(True)), F.lit(name)) for name, sql in rules.items()]), lambda x: x.isNotNull()))


def metadata_words(raw: Column) -> Column:
    """Keywords parted by commas or semicolons, the first spelling of each, in order."""
    parts = F.filter(F.transform(F.split(raw, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(parts, lambda x, i: F.array_position(F.transform(parts, lambda y: F.lower(y)), F.lower(x)) == i + 1)


# The names that entries of a file's information have in the result.
CANONICAL = {"title": "title", "author": "author", "subject": "description", "description": "description", "keywords": "keywords", "creationdate": "date", "date": "date", "moddate": "lastmod", "lastmod": "lastmod", "creator": "creator", "producer": "producer"}


def metadata(raw: Column) -> Column:
    """A map of a file's information with plain keys: known ones by their canonical names, others in lower case; dates in ISO 8601; nothing empty. Of entries with one name the first stays."""
    from quillwork.functions.text import pdf_date

    known = F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv])
    key = lambda k: F.lower(F.trim(F.regexp_replace(k, "^/+", "")))
    named = F.transform(F.map_entries(raw), lambda e: F.struct(F.coalesce(F.element_at(known, key(e["key"])), F.regexp_replace(key(e["key"]), "[^a-z0-9_-]+", "_")).alias("key"), F.trim(F.replace(e["value"], F.lit("\u0000"), F.lit(""))).alias("value")))
    full = F.filter(named, lambda e: (e["key"] != "") & e["value"].isNotNull() & (e["value"] != ""))
    first = F.filter(full, lambda e, i: F.array_position(F.transform(full, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"].alias("key"), F.when(e["key"].isin("date", "lastmod"), pdf_date(e["value"])).otherwise(e["value"]).alias("value"))))


def inline_images(pages: DataFrame, resources: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, html) with each image's source that resources (path, mime, content) has as a data URI; others stay.

    References are joined by path, so only pages that have any are touched by the shuffle.
    """
    from quillwork.functions.text import external_references

    refs = pages.select(page_id, F.explode(external_references(F.col(html))).alias("r")).where("r like 'image: %'").select(page_id, F.expr("substring(r, 8)").alias("path")).distinct()
    uri = F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.regexp_replace(F.base64("content"), r"\s", ""))
    found = refs.join(resources.select("path", uri.alias("uri")), "path").groupBy(page_id).agg(F.sort_array(F.collect_list(F.struct("path", "uri"))).alias("_found"))
    with_found = pages.join(found, page_id, "left")
    changed = F.aggregate(F.coalesce("_found", F.array().cast("array<struct<path:string,uri:string>>")), F.col(html), lambda h, f: F.replace(F.replace(h, F.concat(F.lit('"'), f.path, F.lit('"')), F.concat(F.lit('"'), f.uri, F.lit('"'))), F.concat(F.lit("'"), f.path, F.lit("'")), F.concat(F.lit("'"), f.uri, F.lit("'"))))
    return with_found.select(page_id, changed.alias(html))


def reading_edges(ordered: DataFrame) -> DataFrame:
    """(doc_id, page_no, block_no, next_no): the chain of blocks in reading order."""
    return ordered.select(*PAGE, "block_no").distinct().withColumn("next_no", F.lead("block_no").over(W.partitionBy(*PAGE).orderBy("block_no"))).where("next_no is not null")
