"""Typeset text corpora: documents become page-positioned lines and words by arithmetic alone, in steps of half a point.

The layout operators and their queries run on these frames where no PDF files are at hand; real files give frames of
the same columns through quillwork.sources.pdf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of a line, lines of a page, and the page in points.
WORDS, ROWS, WIDTH, HEIGHT = 10, 44, 612.0, 792.0


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, page_no, seq, k, text, x0, y0, x1, y1, font_size, is_bold, is_italic for each typeset line of docs.

    A raw line breaks after ten words. The first line of a document is set in 18 point bold, a raw line of at most three
    words in 14 point bold, the rest in 11 point. Every seventh raw line is a bullet item, every seventh a numbered one,
    and lines are indented by 0, 18 or 36 points in turn.
    """
    raw = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("r", "line"))
    ws = raw.select("doc_id", "source", "lang", "r", F.filter(F.split("line", " "), lambda x: x != "").alias("ws")).where("size(ws) > 0")
    phys = ws.select("*", F.explode(F.expr(f"sequence(0, (size(ws) + {WORDS - 1}) div {WORDS} - 1)")).alias("p")).withColumn("own", F.expr(f"slice(ws, cast(p * {WORDS} + 1 as int), {WORDS})"))
    k = phys.withColumn("k", (F.row_number().over(W.partitionBy("doc_id").orderBy("r", "p")) - 1).cast("long"))
    turn = F.col("doc_id") + F.col("r")
    marker = F.when((F.col("p") == 0) & (turn % 7 == 0), "- ").when((F.col("p") == 0) & (turn % 7 == 3), "1. ").otherwise("")
    short = (F.col("p") == 0) & (F.size("ws") <= 3)
    row = F.col("k") % ROWS
    out = k.select(
        "doc_id", "source", "lang", "k",
        F.expr(f"cast(k div {ROWS} + 1 as int)").alias("page_no"), row.cast("int").alias("seq"),
        F.concat(marker, F.array_join("own", " ")).alias("text"),
        (F.lit(72.0) + 18 * (turn % 3)).alias("x0"), (F.lit(84.0) + 14 * row).alias("y0"),
        F.when(F.col("k") == 0, 18.0).when(short, 14.0).otherwise(11.0).alias("font_size"),
        ((F.col("k") == 0) | short).alias("is_bold"), F.lit(False).alias("is_italic"),
    )
    return out.withColumn("x1", F.col("x0") + 5.0 * F.length("text")).withColumn("y1", F.col("y0") + 12.0)


def margins(body: DataFrame) -> DataFrame:
    """Header and footer lines of typeset pages, in the columns of lines(): the source above, "Page n of m" below."""
    pages = body.groupBy("doc_id", "source", "lang").agg(F.max("page_no").alias("m")).withColumn("page_no", F.explode(F.expr("sequence(1, m)")))
    head = pages.select("*", F.lit(-1).alias("seq"), F.col("source").alias("text"), F.lit(40.0).alias("y0"))
    foot = pages.select("*", F.lit(ROWS).alias("seq"), F.concat(F.lit("Page "), F.col("page_no").cast("string"), F.lit(" of "), F.col("m").cast("string")).alias("text"), F.lit(750.0).alias("y0"))
    both = head.unionByName(foot)
    return both.select("doc_id", "source", "lang", F.lit(-1).cast("long").alias("k"), "page_no", "seq", "text", F.lit(72.0).alias("x0"), "y0", F.lit(9.0).alias("font_size"), F.lit(False).alias("is_bold"), F.lit(False).alias("is_italic"), (F.lit(72.0) + 5.0 * F.length("text")).alias("x1"), (F.col("y0") + 12.0).alias("y1"))


def words(body: DataFrame) -> DataFrame:
    """The words of typeset lines: doc_id, page_no, seq, pos, word, x0, y0, x1, y1, font_size, is_bold."""
    each = body.select("doc_id", "page_no", "seq", "x0", "y0", "y1", "font_size", "is_bold", F.split("text", " ").alias("ws")).select("*", F.posexplode("ws").alias("pos", "word"))
    left = F.col("x0") + 5.0 * F.expr("aggregate(slice(ws, 1, pos), 0, (a, w) -> a + length(w) + 1)")
    return each.select("doc_id", "page_no", "seq", "pos", "word", left.alias("x0"), "y0", (left + 5.0 * F.length("word")).alias("x1"), "y1", "font_size", "is_bold")


#: The same frames in DuckDB, for oracles.
SQL = f"""
fx_raw AS (SELECT doc_id, source, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS r, unnest(string_split(text, chr(10))) AS line FROM documents),
fx_ws AS (SELECT doc_id, source, lang, r, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM fx_raw),
fx_phys AS (SELECT *, unnest(range(0, (len(ws) + {WORDS - 1}) // {WORDS})) AS p FROM fx_ws WHERE len(ws) > 0),
fx_k AS (SELECT *, list_slice(ws, p * {WORDS} + 1, p * {WORDS} + {WORDS}) AS own, row_number() OVER (PARTITION BY doc_id ORDER BY r, p) - 1 AS k FROM fx_phys),
fx_l AS (SELECT doc_id, source, lang, CAST(k AS BIGINT) AS k, CAST(k // {ROWS} + 1 AS INTEGER) AS page_no, CAST(k % {ROWS} AS INTEGER) AS seq,
  CASE WHEN p = 0 AND (doc_id + r) % 7 = 0 THEN '- ' WHEN p = 0 AND (doc_id + r) % 7 = 3 THEN '1. ' ELSE '' END || array_to_string(own, ' ') AS text,
  CAST(72 + 18 * ((doc_id + r) % 3) AS DOUBLE) AS x0, CAST(84 + 14 * (k % {ROWS}) AS DOUBLE) AS y0,
  CAST(CASE WHEN k = 0 THEN 18 WHEN p = 0 AND len(ws) <= 3 THEN 14 ELSE 11 END AS DOUBLE) AS font_size,
  (k = 0 OR (p = 0 AND len(ws) <= 3)) AS is_bold, FALSE AS is_italic FROM fx_k),
fx_lines AS (SELECT *, x0 + 5.0 * length(text) AS x1, y0 + 12.0 AS y1 FROM fx_l),
fx_pages AS (SELECT doc_id, source, lang, m, unnest(range(1, m + 1)) AS page_no FROM (SELECT doc_id, source, lang, max(page_no) AS m FROM fx_lines GROUP BY ALL)),
fx_m AS (SELECT doc_id, source, lang, page_no, -1 AS seq, source AS text, 40.0 AS y0 FROM fx_pages UNION ALL SELECT doc_id, source, lang, page_no, {ROWS}, 'Page ' || page_no || ' of ' || m, 750.0 FROM fx_pages),
fx_margins AS (SELECT doc_id, source, lang, CAST(-1 AS BIGINT) AS k, CAST(page_no AS INTEGER) AS page_no, CAST(seq AS INTEGER) AS seq, text, CAST(72 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(9 AS DOUBLE) AS font_size, FALSE AS is_bold, FALSE AS is_italic, 72.0 + 5.0 * length(text) AS x1, CAST(y0 + 12 AS DOUBLE) AS y1 FROM fx_m),
fx_all AS (SELECT * FROM fx_lines UNION ALL BY NAME SELECT * FROM fx_margins),
fx_wl AS (SELECT doc_id, page_no, seq, x0, y0, y1, font_size, is_bold, string_split(text, ' ') AS ws FROM fx_lines),
fx_wp AS (SELECT *, unnest(range(0, len(ws))) AS pos FROM fx_wl),
fx_words AS (SELECT doc_id, page_no, seq, CAST(pos AS INTEGER) AS pos, ws[pos + 1] AS word, x0 + 5.0 * (length(array_to_string(list_slice(ws, 1, pos), ' ')) + CASE WHEN pos > 0 THEN 1 ELSE 0 END) AS x0, y0,
  x0 + 5.0 * (length(array_to_string(list_slice(ws, 1, pos), ' ')) + CASE WHEN pos > 0 THEN 1 ELSE 0 END + length(ws[pos + 1])) AS x1, y1, font_size, is_bold FROM fx_wp)
"""
