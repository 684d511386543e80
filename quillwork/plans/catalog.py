"""Named queries over the driver's tables, each with the SQL that DuckDB answers alike where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.functions import codecs, geometry, images, paths, text
from quillwork.operators import document, fonts, layout, spatial, tables
from quillwork.plans import emit, typeset
from quillwork.sources import pdf, pdf_writer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, fixture: bool = False) -> Callable[[Query], Query]:
    """Register a function under its name; with fixture the SQL may use the typeset frames."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {typeset.SQL.strip()}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if fixture else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typeset.lines(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = body(spark, sf_dir)
    return lines.unionByName(typeset.margins(lines))


# Paragraphs as DuckDB makes them, for the queries that build on them.
PARAS = """
p_gap AS (SELECT *, y0 - lag(y1) OVER w AS gap, lag(font_size) OVER w AS psize, lag(x0) OVER w AS px FROM fx_lines WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y0, x0, seq)),
p_med AS (SELECT doc_id, page_no, coalesce((list_sort(list(gap) FILTER (WHERE gap >= 0)))[(count(*) FILTER (WHERE gap >= 0)) // 2 + 1], 4.0) AS med FROM p_gap GROUP BY ALL),
p_new AS (SELECT g.*, CASE WHEN gap > greatest(3.0, 1.6 * med) OR abs(font_size - psize) > greatest(2.5, 0.2 * psize) OR x0 - px > 10 THEN 1 ELSE 0 END AS isnew FROM p_gap g JOIN p_med USING (doc_id, page_no)),
p_no AS (SELECT *, CAST(sum(isnew) OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, seq) AS INTEGER) AS para_no FROM p_new),
p_page AS (SELECT *, min(x0) OVER w AS cx0, max(x1) OVER w AS cx1, row_number() OVER (PARTITION BY doc_id, page_no, para_no ORDER BY y0, x0, seq) AS i, count(*) OVER (PARTITION BY doc_id, page_no, para_no) AS n FROM p_no WINDOW w AS (PARTITION BY doc_id, page_no)),
paras AS (SELECT doc_id, page_no, para_no, string_agg(text, ' ' ORDER BY i) AS text, CAST(count(*) AS INTEGER) AS n_lines, sum(length(text)) AS n_chars, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  sum(font_size * length(text)) / greatest(sum(length(text)), 1) AS font_size, bool_or(is_bold) AS is_bold, bool_or(is_italic) AS is_italic,
  greatest(0.0, min(x0) - any_value(cx0)) AS indent_left, greatest(0.0, any_value(cx1) - max(x1)) AS indent_right,
  coalesce(max(x0) FILTER (WHERE i = 1) - max(x0) FILTER (WHERE i = 2), 0.0) AS indent_first,
  CASE WHEN count(*) = 1 THEN CASE WHEN any_value(cx1) - any_value(cx0) > max(x1) - min(x0) + 8 AND abs((max(x0) + max(x1)) / 2 - (any_value(cx0) + any_value(cx1)) / 2) <= 4 THEN 'center'
      WHEN any_value(cx1) - any_value(cx0) > max(x1) - min(x0) + 8 AND abs(max(x1) - any_value(cx1)) <= 4 THEN 'right' ELSE 'left' END
    WHEN count(*) = 2 AND bool_and(abs(x0 - cx0) <= 4 AND abs(x1 - cx1) <= 4) THEN 'justified'
    WHEN count(*) > 2 AND bool_and(abs(x0 - cx0) <= 4 AND (i = n OR abs(x1 - cx1) <= 4)) THEN 'justified'
    WHEN bool_and(abs((x0 + x1) / 2 - (cx0 + cx1) / 2) <= 4) THEN 'center' WHEN bool_and(abs(x1 - cx1) <= 4) THEN 'right' ELSE 'left' END AS alignment
  FROM p_page GROUP BY doc_id, page_no, para_no)
"""
HEADS = (
    PARAS
    + r""",
h_hist AS (SELECT doc_id, page_no, round(font_size * 2) / 2 AS size, sum(n_chars) AS n, min(para_no) AS first FROM paras WHERE n_chars > 0 GROUP BY ALL),
h_body AS (SELECT doc_id, page_no, arg_max(size, n * 100000 - first) AS body_size FROM h_hist GROUP BY ALL),
h_at AS (SELECT p.*, body_size, font_size / coalesce(body_size, 12.0) AS ratio, regexp_matches(trim(text), '[.?!]$') AS ends FROM paras p LEFT JOIN h_body USING (doc_id, page_no)),
heads AS (SELECT *, CAST(CASE WHEN trim(text) = '' OR n_lines > 3 OR length(trim(text)) > 200 OR (ends AND NOT regexp_matches(trim(text), '^\d+(\.\d+)*\.?\s+[A-Z]') AND n_lines > 1) THEN NULL
  WHEN ratio >= 1.6 THEN 1 WHEN ratio >= 1.35 THEN 2 WHEN ratio >= 1.18 THEN 3 WHEN ratio >= 1.05 AND is_bold THEN 4
  WHEN is_bold AND n_lines = 1 AND length(trim(text)) < 100 AND NOT ends THEN 5
  WHEN (is_italic OR (upper(trim(text)) = trim(text) AND lower(trim(text)) <> trim(text))) AND n_lines = 1 AND length(trim(text)) < 80 AND NOT ends THEN 6 END AS INTEGER) AS heading_level FROM h_at)
"""
)
NUMBERED = r"^(\(?\d+(?:\.\d+)*[.)]|\(?[a-zA-Z][.)]|\(?[ivxlcdmIVXLCDM]+[.)])\s+((?s).*)$"
LISTS = (
    HEADS
    + rf""",
l_at AS (SELECT *, regexp_extract(trim(text), '^([•‣●○◦▪▫◆◇✓➤–—*-])\s+', 1) AS bullet, regexp_extract(trim(text), '{NUMBERED}', 1) AS number, min(indent_left) OVER (PARTITION BY doc_id, page_no) AS base FROM heads),
lists AS (SELECT *, CASE WHEN heading_level IS NOT NULL THEN NULL WHEN bullet <> '' THEN bullet WHEN number <> '' THEN number END AS list_marker, least(8, CAST(round_even(greatest(0, indent_left - base) / 18.0, 0) AS INTEGER)) AS lv FROM l_at)
"""
)


def paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paragraphs(body(spark, sf_dir))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.headings(paras(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.list_items(heads(spark, sf_dir))


@query(f"+ {HEADS} SELECT lang, heading_level, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM heads JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE heading_level IS NOT NULL GROUP BY ALL", fixture=True)
def heading_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return heads(spark, sf_dir).where("heading_level is not null").join(langs, "doc_id").groupBy("lang", "heading_level").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query(f"+ {HEADS} SELECT doc_id, page_no, body_size FROM h_body", fixture=True)
def modal_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.modal_sizes(paras(spark, sf_dir))


REGIONS = r"""
r_num AS (SELECT *, regexp_matches(trim(text), '^(\d+|\s*-\s*\d+\s*-\s*|(?i:page)\s+\d+(\s+((?i:of)|/)\s+\d+)?|\d+\s*/\s*\d+|[ivxlcdmIVXLCDM]+)$') AND (y0 <= 72 OR y1 >= 720) AS num FROM fx_all WHERE trim(text) <> ''),
r_known AS (SELECT doc_id, CASE WHEN y0 <= 72 THEN 'header' ELSE 'footer' END AS region, trim(text) AS text, count(DISTINCT page_no) AS n_pages FROM r_num WHERE NOT num AND (y0 <= 72 OR y1 >= 720) GROUP BY ALL HAVING count(DISTINCT page_no) >= 2)
"""


@query(f"+ {REGIONS} SELECT doc_id, region, text, n_pages FROM r_known", fixture=True)
def repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repeated_margins(pages(spark, sf_dir))


@query(f"+ {REGIONS} SELECT CASE WHEN num THEN 'page_number' WHEN k.f = 0 THEN 'header' WHEN k.f = 1 THEN 'footer' ELSE 'body' END AS region, source, count(*) AS n, min(r.page_no) AS first_page FROM r_num r LEFT JOIN (SELECT doc_id, text, min(CASE WHEN region = 'header' THEN 0 ELSE 1 END) AS f FROM r_known GROUP BY ALL) k ON k.doc_id = r.doc_id AND k.text = trim(r.text) GROUP BY ALL", fixture=True)
def region_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pages(spark, sf_dir)
    return layout.regions(lines, layout.repeated_margins(lines)).groupBy("region", "source").agg(F.count("*").alias("n"), F.min("page_no").alias("first_page"))


@query("SELECT CASE WHEN num THEN 'page_number' WHEN y0 <= 72 AND font_size <= 11 AND length(trim(text)) < 80 THEN 'header' WHEN y1 >= 720 AND font_size <= 11 AND length(trim(text)) < 80 THEN 'footer' ELSE 'body' END AS region, count(*) AS n FROM r_num GROUP BY ALL".join([f"+ {REGIONS} ", ""]), fixture=True)
def region_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.regions(pages(spark, sf_dir)).groupBy("region").agg(F.count("*").alias("n"))


@query(f"+ {REGIONS} SELECT doc_id, page_no, text FROM r_num WHERE num", fixture=True)
def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.regions(pages(spark, sf_dir)).where("region = 'page_number'").select("doc_id", "page_no", "text")


@query(f"+ {PARAS} SELECT doc_id, page_no, para_no, n_lines, n_chars::BIGINT AS n_chars, text FROM paras", fixture=True)
def paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paras(spark, sf_dir).select("doc_id", "page_no", "para_no", "n_lines", "n_chars", "text")


@query(f"+ {PARAS} SELECT doc_id, page_no, para_no, x0, y0, x1, y1, round(font_size, 6) AS font_size, is_bold, indent_left, indent_right, indent_first, greatest(0.0, coalesce(y0 - lag(y1) OVER w, 0.0)) AS space_before FROM paras WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY para_no)", fixture=True)
def paragraph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paras(spark, sf_dir).select("doc_id", "page_no", "para_no", "x0", "y0", "x1", "y1", F.round("font_size", 6).alias("font_size"), "is_bold", "indent_left", "indent_right", "indent_first", "space_before")


@query(f"+ {PARAS} SELECT alignment, n_lines, count(*) AS n FROM paras GROUP BY ALL", fixture=True)
def paragraph_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paras(spark, sf_dir).groupBy("alignment", "n_lines").agg(F.count("*").alias("n"))


@query(f"+ {LISTS} SELECT doc_id, page_no, para_no, list_marker, lv AS list_level, CASE WHEN bullet <> '' THEN trim(regexp_replace(trim(text), '^[•‣●○◦▪▫◆◇✓➤–—*-]\\s+', '')) ELSE trim(regexp_extract(trim(text), '{NUMBERED}', 2)) END AS text_clean FROM lists WHERE list_marker IS NOT NULL", fixture=True)
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("list_marker is not null").select("doc_id", "page_no", "para_no", "list_marker", "list_level", "text_clean")


@query(f"+ {LISTS}, g_kind AS (SELECT *, CASE WHEN list_marker IS NULL THEN NULL WHEN regexp_matches(list_marker, '[.)]$|^\\d+$') THEN 'ordered' ELSE 'bullet' END AS kind FROM lists), g_new AS (SELECT *, CASE WHEN kind IS NOT NULL AND kind IS DISTINCT FROM lag(kind) OVER w THEN 1 ELSE 0 END AS isnew2 FROM g_kind WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY para_no)), g_no AS (SELECT *, CAST(sum(isnew2) OVER w AS INTEGER) AS list_group FROM g_new WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY para_no)) SELECT doc_id, page_no, list_group, kind AS list_kind, count(*) AS n_items FROM g_no WHERE kind IS NOT NULL GROUP BY ALL", fixture=True)
def list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.list_groups(items(spark, sf_dir)).where("list_group is not null").groupBy("doc_id", "page_no", "list_group", "list_kind").agg(F.count("*").alias("n_items"))


WIDE = "w_x AS (SELECT *, x0 + 30.0 * ((pos * 7 + seq) % 5 // 4) AS wx FROM fx_words), w_s AS (SELECT doc_id, page_no, seq, pos, word, font_size, x0 + 30.0 * sum((pos * 7 + seq) % 5 // 4) OVER (PARTITION BY doc_id, page_no, seq ORDER BY pos) AS x0, x1 + 30.0 * sum((pos * 7 + seq) % 5 // 4) OVER (PARTITION BY doc_id, page_no, seq ORDER BY pos) AS x1 FROM fx_words)"


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a gap of 30 points before some."""
    shift = 30.0 * F.sum(F.expr("((pos * 7 + seq) % 5) div 4")).over(W.partitionBy("doc_id", "page_no", "seq").orderBy("pos"))
    return typeset.words(body(spark, sf_dir)).withColumn("x0", F.col("x0") + shift).withColumn("x1", F.col("x1") + shift)


@query(f"+ {WIDE}, s_new AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w > greatest(24.0, 2.5 * greatest(font_size, lag(font_size) OVER w)) THEN 1 ELSE 0 END AS isnew FROM w_s WINDOW w AS (PARTITION BY doc_id, page_no, seq ORDER BY x0, pos)), s_no AS (SELECT *, CAST(sum(isnew) OVER (PARTITION BY doc_id, page_no, seq ORDER BY x0, pos) AS INTEGER) AS part_no FROM s_new) SELECT doc_id, page_no, seq, part_no, count(*) AS n_words, min(x0) AS x0, max(x1) AS x1 FROM s_no GROUP BY ALL", fixture=True)
def line_split_on_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.split_lines(spread(spark, sf_dir)).groupBy("doc_id", "page_no", "seq", "part_no").agg(F.count("*").alias("n_words"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query("+ f AS (SELECT *, 'F' || (length(word) % 3) AS font_name FROM fx_words), hist AS (SELECT doc_id, page_no, seq, font_name, sum(length(word)) AS n, min(pos) AS first FROM f GROUP BY ALL), top AS (SELECT doc_id, page_no, seq, arg_max(font_name, n * 100000 - first) AS font FROM hist GROUP BY ALL) SELECT font, count(*) AS n, sum(seq)::BIGINT AS seqs FROM top GROUP BY ALL", fixture=True)
def line_dominant_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = typeset.words(body(spark, sf_dir)).withColumn("font_name", F.concat(F.lit("F"), (F.length("word") % 3).cast("string")))
    return layout.dominant_fonts(words).groupBy("font").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("+ v AS (SELECT doc_id, page_no, x0, y1 + 1.5 AS y0, x1, y1 + 2.5 AS y1 FROM fx_words WHERE (doc_id + seq + pos) % 11 = 0), u AS (SELECT DISTINCT w.doc_id, w.page_no, w.seq, w.pos FROM fx_words w JOIN v ON v.doc_id = w.doc_id AND v.page_no = w.page_no AND v.x1 - v.x0 >= 4 AND (v.y0 + v.y1) / 2 - w.y1 BETWEEN -1.5 AND greatest(4.0, 0.4 * w.font_size) AND least(w.x1, v.x1) - greatest(w.x0, v.x0) >= 0.5 * (w.x1 - w.x0)) SELECT doc_id, page_no, count(*) AS n_underlined FROM u GROUP BY ALL", fixture=True)
def underline_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = typeset.words(body(spark, sf_dir))
    vectors = words.where("(doc_id + seq + pos) % 11 = 0").select("doc_id", "page_no", "x0", (F.col("y1") + 1.5).alias("y0"), "x1", (F.col("y1") + 2.5).alias("y1"))
    return layout.underlined(words, vectors).where("is_underline").groupBy("doc_id", "page_no").agg(F.count("*").alias("n_underlined"))


# Rulings: each part has a grid of 2 to 5 rows and columns; every third lacks one inner stretch.
def grid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("p_partkey") % 4 + 2).cast("int").alias("c"), (F.col("p_size") % 4 + 2).cast("int").alias("r"), (F.col("p_partkey") % 3 == 0).alias("gap"))
    flat = part.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("r")))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    flat = flat.select("doc_id", "page_no", (F.lit(50.0) + 60 * F.col("j")).alias("x0"), (F.lit(100.0) + 30 * F.col("i")).alias("y0"), (F.lit(110.0) + 60 * F.col("j")).alias("x1"), (F.lit(101.0) + 30 * F.col("i")).alias("y1"), (~(F.col("gap") & (F.col("i") == 1) & (F.col("j") == 0))).alias("kept"))
    tall = part.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("r") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c"))))
    tall = tall.select("doc_id", "page_no", (F.lit(50.0) + 60 * F.col("j")).alias("x0"), (F.lit(100.0) + 30 * F.col("i")).alias("y0"), (F.lit(51.0) + 60 * F.col("j")).alias("x1"), (F.lit(130.0) + 30 * F.col("i")).alias("y1"), (~(F.col("gap") & (F.col("j") == 1) & (F.col("i") == 0))).alias("kept"))
    frame = part.select("doc_id", "page_no", F.explode(F.array(
        *[F.struct(*[v.cast("double").alias(n) for v, n in zip(b, ("x0", "y0", "x1", "y1"), strict=True)]) for b in (
            (F.lit(50.0), F.lit(100.0), 50 + 60 * F.col("c"), F.lit(101.0)), (F.lit(50.0), 100 + 30 * F.col("r"), 50 + 60 * F.col("c"), 101 + 30 * F.col("r")),
            (F.lit(50.0), F.lit(100.0), F.lit(51.0), 100 + 30 * F.col("r")), (50 + 60 * F.col("c"), F.lit(100.0), 51 + 60 * F.col("c"), 100 + 30 * F.col("r")))])).alias("b")).select("doc_id", "page_no", "b.*")
    return flat.unionByName(tall).where("kept").drop("kept").unionByName(frame)


GRID = """WITH pt AS (SELECT p_partkey AS doc_id, CAST(p_partkey % 4 + 2 AS INTEGER) AS c, CAST(p_size % 4 + 2 AS INTEGER) AS r, p_partkey % 3 = 0 AS gap FROM part),
fi AS (SELECT *, unnest(range(0, r + 1)) AS i FROM pt), fl AS (SELECT *, unnest(range(0, c)) AS j FROM fi),
ti AS (SELECT *, unnest(range(0, r)) AS i FROM pt), tl AS (SELECT *, unnest(range(0, c + 1)) AS j FROM ti),
vec AS (SELECT doc_id, 50.0 + 60 * j AS x0, 100.0 + 30 * i AS y0, 110.0 + 60 * j AS x1, 101.0 + 30 * i AS y1 FROM fl WHERE NOT (gap AND i = 1 AND j = 0)
 UNION ALL SELECT doc_id, 50.0 + 60 * j, 100.0 + 30 * i, 51.0 + 60 * j, 130.0 + 30 * i FROM tl WHERE NOT (gap AND j = 1 AND i = 0)
 UNION ALL SELECT doc_id, 50, 100, 50 + 60 * c, 101 FROM pt UNION ALL SELECT doc_id, 50, 100 + 30 * r, 50 + 60 * c, 101 + 30 * r FROM pt
 UNION ALL SELECT doc_id, 50, 100, 51, 100 + 30 * r FROM pt UNION ALL SELECT doc_id, 50 + 60 * c, 100, 51 + 60 * c, 100 + 30 * r FROM pt),
rul AS (SELECT doc_id, 1 AS page_no, 'h' AS orient, CAST((y0 + y1) / 2 AS DOUBLE) AS pos, CAST(x0 AS DOUBLE) AS lo, CAST(x1 AS DOUBLE) AS hi FROM vec WHERE x1 - x0 >= 20 AND y1 - y0 <= 4
 UNION ALL SELECT doc_id, 1, 'v', CAST((x0 + x1) / 2 AS DOUBLE), CAST(y0 AS DOUBLE), CAST(y1 AS DOUBLE) FROM vec WHERE y1 - y0 >= 20 AND x1 - x0 <= 4 AND NOT (x1 - x0 >= 20 AND y1 - y0 <= 4)),
cl AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, orient ORDER BY pos) > 5 THEN 1 ELSE 0 END AS isnew FROM rul),
cn AS (SELECT *, CAST(sum(isnew) OVER (PARTITION BY doc_id, orient ORDER BY pos) AS INTEGER) AS idx FROM cl),
gl AS (SELECT doc_id, orient, idx, avg(pos) AS at_, count(*) AS n FROM cn GROUP BY ALL),
sp AS (SELECT doc_id, CASE WHEN orient = 'h' THEN 'v' ELSE 'h' END AS orient, idx AS span, at_ AS s0, lead(at_) OVER (PARTITION BY doc_id, orient ORDER BY idx) AS s1 FROM gl),
gs AS (SELECT g.doc_id, g.orient, g.idx, s.span, g.at_, s.s0, s.s1 FROM gl g JOIN sp s ON s.doc_id = g.doc_id AND s.orient = g.orient AND s.s1 IS NOT NULL),
seg AS (SELECT gs.doc_id, gs.orient, gs.idx, gs.span, bool_or(abs(r.pos - gs.at_) <= 5 AND r.lo <= gs.s0 + 5 AND r.hi >= gs.s1 - 5) AS present FROM gs JOIN rul r ON r.doc_id = gs.doc_id AND r.orient = gs.orient GROUP BY ALL)
"""


@query(GRID + "SELECT doc_id, page_no, orient, count(*) AS n, sum(pos) AS pos_sum, min(lo) AS lo, max(hi) AS hi FROM rul GROUP BY ALL")
def ruling_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.rulings(grid_vectors(spark, sf_dir)).groupBy("doc_id", "page_no", "orient").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query(GRID + "SELECT doc_id, 1 AS page_no, orient, idx, round(at_, 6) AS at, n FROM gl")
def ruling_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.grid_lines(tables.rulings(grid_vectors(spark, sf_dir))).withColumn("at", F.round("at", 6))


@query(GRID + "SELECT h.doc_id, 1 AS page_no, count(*) AS n_crossings FROM rul h JOIN rul v ON h.doc_id = v.doc_id AND h.orient = 'h' AND v.orient = 'v' AND v.pos BETWEEN h.lo - 5 AND h.hi + 5 AND h.pos BETWEEN v.lo - 5 AND v.hi + 5 GROUP BY ALL")
def ruling_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.intersections(tables.rulings(grid_vectors(spark, sf_dir)))


@query(GRID + "SELECT doc_id, 1 AS page_no, orient, idx, span, present FROM seg")
def grid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.segments(tables.rulings(grid_vectors(spark, sf_dir)))


@query(GRID + "SELECT p_partkey AS doc_id, CAST(p_size % 4 + 2 AS INTEGER) AS n_rows, CAST(p_partkey % 4 + 2 AS INTEGER) AS n_cols, 4 AS n_borders FROM part")
def grid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.borders(tables.rulings(grid_vectors(spark, sf_dir))).select("doc_id", "n_rows", "n_cols", "n_borders")


# The missing stretches part no cell 0,0 from its right and lower neighbours: it spans two columns and two rows where both of them are open.
@query("""WITH g AS (SELECT p_partkey AS doc_id, p_size % 4 + 2 AS n_rows, unnest(range(p_partkey % 4 + 2)) AS col, p_partkey % 3 = 0 AS open FROM part), c AS (SELECT doc_id, unnest(range(n_rows)) AS row, col, open FROM g)
SELECT doc_id, row::INTEGER AS row, col::INTEGER AS col, CASE WHEN open AND row = 0 AND col = 0 THEN 2 ELSE 1 END AS row_span, CASE WHEN open AND row = 0 AND col = 0 THEN 2 ELSE 1 END AS col_span FROM c WHERE NOT open OR row > 1 OR col > 1 OR (row = 0 AND col = 0)""")
def cell_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells(tables.rulings(grid_vectors(spark, sf_dir))).select("doc_id", "row", "col", "row_span", "col_span")


@query("SELECT p_partkey AS doc_id, CAST((p_partkey % 4 + 2) * (p_size % 4 + 2) - CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 0 END AS BIGINT) AS n_cells FROM part")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells(tables.rulings(grid_vectors(spark, sf_dir))).groupBy("doc_id").agg(F.count("*").alias("n_cells"))


@query("SELECT p_partkey AS doc_id, p_size::INTEGER AS seq, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size % 2 END::INTEGER AS row, 0::INTEGER AS col FROM part")
def line_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("p_size").cast("int").alias("seq"), F.lit(60.0).alias("x0"), (110.0 + 30 * (F.col("p_size") % 2)).alias("y0"), F.lit(100.0).alias("x1"), (120.0 + 30 * (F.col("p_size") % 2)).alias("y1"))
    return tables.lines_in_cells(lines, tables.cells(tables.rulings(grid_vectors(spark, sf_dir)))).select("doc_id", "seq", "row", "col")


# Aligned words: each order is a page of lines; its lineitems' fields stand in columns, every fifth order has one that crosses.
def aligned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))
    item = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), "seq", F.posexplode(F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_returnflag"))).alias("pos", "word"))
    x0 = F.lit(72.0) + 96 * F.col("pos") + (F.col("seq") % 2)
    wide = (F.col("doc_id") % 5 == 0) & (F.col("pos") == 0) & (F.col("seq") == 1)
    return item.select("doc_id", "page_no", "seq", "pos", "word", x0.alias("x0"), (14.0 * F.col("seq")).alias("y0"), (x0 + F.when(wide, 130.0).otherwise(5.0 * F.length("word"))).alias("x1"), (14.0 * F.col("seq") + 12).alias("y1"), F.lit(11.0).alias("font_size"))


ALIGNED = """WITH li AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS INTEGER) AS seq FROM lineitem),
it AS (SELECT l_orderkey AS doc_id, seq, unnest([l_partkey::VARCHAR, l_suppkey::VARCHAR, l_returnflag]) AS word, unnest([0, 1, 2]) AS pos FROM li),
wd AS (SELECT *, 72.0 + 96 * pos + seq % 2 AS x0, 72.0 + 96 * pos + seq % 2 + CASE WHEN doc_id % 5 = 0 AND pos = 0 AND seq = 1 THEN 130.0 ELSE 5.0 * length(word) END AS x1 FROM it),
nl AS (SELECT doc_id, count(DISTINCT seq) AS n_lines FROM wd GROUP BY ALL HAVING count(DISTINCT seq) >= 3),
sx AS (SELECT doc_id, round_even(x0 / 8.0, 0) * 8 AS x, count(*) AS n, any_value(n_lines) AS n_lines FROM wd JOIN nl USING (doc_id) GROUP BY ALL HAVING count(*) >= greatest(3, floor(any_value(n_lines) * 0.55))),
sc AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) > 16 THEN 1 ELSE 0 END AS isnew FROM sx),
sn AS (SELECT doc_id, x, CAST(sum(isnew) OVER (PARTITION BY doc_id ORDER BY x) AS INTEGER) AS col FROM sc),
co AS (SELECT doc_id, col, avg(x) AS at_ FROM sn GROUP BY ALL),
ok AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM co),
cr AS (SELECT DISTINCT w.doc_id FROM wd w JOIN ok ON ok.doc_id = w.doc_id AND col > 0 AND n BETWEEN 2 AND 8 WHERE w.x0 < at_ - 8 AND w.x1 > at_ + 8),
cols AS (SELECT doc_id, col, CAST(at_ AS DOUBLE) AS at_ FROM ok WHERE n BETWEEN 2 AND 8 AND doc_id NOT IN (SELECT doc_id FROM cr))
"""


@query(ALIGNED + "SELECT doc_id, col, at_ AS at FROM cols")
def borderless_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_starts(aligned_words(spark, sf_dir)).select("doc_id", "col", "at")


@query(ALIGNED + "SELECT doc_id FROM nl WHERE doc_id NOT IN (SELECT doc_id FROM cols)")
def borderless_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = aligned_words(spark, sf_dir)
    return words.groupBy("doc_id").agg(F.countDistinct("seq").alias("n")).where("n >= 3").select("doc_id").join(tables.column_starts(words), "doc_id", "left_anti")


@query(ALIGNED + ", nr AS (SELECT w.doc_id, w.seq, w.word, arg_min(c.col, abs(w.x0 - c.at_) * 100 + c.col) AS col FROM wd w JOIN cols c USING (doc_id) GROUP BY w.doc_id, w.seq, w.word, w.pos) SELECT doc_id, col, count(*) AS n_words FROM nr GROUP BY ALL")
def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = aligned_words(spark, sf_dir)
    return tables.nearest_columns(words, tables.column_starts(words)).groupBy("doc_id", "col").agg(F.count("*").alias("n_words"))


@query(ALIGNED + ", ce AS (SELECT DISTINCT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS r, word, pos AS c FROM wd WHERE doc_id IN (SELECT doc_id FROM cols)) SELECT doc_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, word AS text FROM ce JOIN (SELECT doc_id, count(*) AS nc FROM cols GROUP BY ALL) USING (doc_id) WHERE nc = 3")
def borderless_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = aligned_words(spark, sf_dir)
    columns = tables.column_starts(words)
    three = columns.groupBy("doc_id").agg(F.count("*").alias("nc")).where("nc = 3")
    return tables.borderless_cells(words, columns).join(three, "doc_id", "left_semi").select("doc_id", "row", "col", "text")


# Boxes in the plane from part keys.
def boxes(spark: SparkSession, sf_dir: str, cut: str = "true") -> DataFrame:
    k = F.col("p_partkey")
    x0, y0 = (k * 37 % 1500).cast("double"), (k * 91 % 1100).cast("double")
    return table(spark, sf_dir, "part").where(cut).select(k.alias("box_id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("p_size") + 5).alias("x1"), (y0 + F.col("p_size") % 20 + 5).alias("y1"))


BOXES = "WITH bx AS (SELECT p_partkey AS box_id, CAST(p_partkey * 37 % 1500 AS DOUBLE) AS x0, CAST(p_partkey * 91 % 1100 AS DOUBLE) AS y0, p_partkey * 37 % 1500 + p_size + 5.0 AS x1, p_partkey * 91 % 1100 + p_size % 20 + 5.0 AS y1 FROM part), po AS (SELECT s_suppkey AS point_id, CAST(s_suppkey * 53 % 1500 AS DOUBLE) AS px, CAST(s_suppkey * 29 % 1100 AS DOUBLE) AS py FROM supplier) "


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("point_id"), (k * 53 % 1500).cast("double").alias("px"), (k * 29 % 1100).cast("double").alias("py"))


@query(BOXES + "SELECT a.box_id AS a_id, b.box_id AS b_id FROM bx a JOIN bx b ON a.box_id < b.box_id AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0")
def spatial_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = boxes(spark, sf_dir)
    return spatial.overlaps(a.withColumnRenamed("box_id", "a_id"), a.withColumnRenamed("box_id", "b_id"), "a_id", "b_id", ordered=True)


@query(BOXES + "SELECT point_id, box_id FROM po JOIN bx ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1")
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.containing(points(spark, sf_dir), boxes(spark, sf_dir), "point_id", "box_id")


@query(BOXES + ", ds AS (SELECT point_id, box_id, sqrt(greatest(0.0, x0 - px, px - x1) ** 2 + greatest(0.0, y0 - py, py - y1) ** 2) AS dist FROM po, bx), rk AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, box_id) AS rank FROM ds WHERE dist <= 80) SELECT point_id, CAST(rank AS INTEGER) AS rank, box_id, round(dist, 6) AS dist FROM rk WHERE rank <= 3")
def knn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(points(spark, sf_dir), boxes(spark, sf_dir), "point_id", "box_id", 3, 80.0).withColumn("dist", F.round("dist", 6))


@query("WITH e AS (SELECT user_id, CAST(event_id * 13 % 5000 AS DOUBLE) AS s, CAST(event_id * 13 % 5000 + event_id % 90 AS DOUBLE) AS e FROM events), r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e), n AS (SELECT *, CAST(sum(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS INTEGER) AS run_no FROM r) SELECT user_id, run_no, min(s) AS start, max(e) AS \"end\" FROM n GROUP BY ALL")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 13 % 5000).cast("double").alias("s"), (F.col("event_id") * 13 % 5000 + F.col("event_id") % 90).cast("double").alias("e"))
    return layout.merged_intervals(e, ["user_id"], "s", "e")


def columns_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines set in a full-width head, two columns and a full-width foot, by their place on the page."""
    left = F.col("seq").between(4, 21)
    right = F.col("seq").between(22, 39)
    row = F.when(left, F.col("seq") - 4).when(right, F.col("seq") - 22)
    y0 = F.when(F.col("seq") < 4, 40.0 + 14 * F.col("seq")).when(left | right, 120.0 + 14 * row).otherwise(400.0 + 14 * (F.col("seq") - 40))
    x0 = F.when(right, 320.0).otherwise(72.0)
    return body(spark, sf_dir).select("doc_id", "page_no", "seq", "text", x0.alias("x0"), y0.alias("y0"), (x0 + F.when(left | right, 220.0).otherwise(468.0)).alias("x1"), (y0 + 12.0).alias("y1"))


@query("+ c AS (SELECT *, CASE WHEN seq BETWEEN 4 AND 39 THEN 1 WHEN seq > 39 THEN 2 ELSE 0 END AS band FROM fx_lines) SELECT doc_id, page_no, CAST(dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY band) - 1 AS INTEGER) AS band, count(*) AS n FROM c GROUP BY doc_id, page_no, c.band", fixture=True)
def xycut_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = layout.cut_once(columns_page(spark, sf_dir).withColumn("node", F.lit("0")), "y", 10.0)
    return cut.groupBy("doc_id", "page_no", F.col("_cut").cast("int").alias("band")).agg(F.count("*").alias("n"))


@query("+ c AS (SELECT *, CASE WHEN seq BETWEEN 4 AND 21 THEN 1 WHEN seq BETWEEN 22 AND 39 THEN 2 WHEN seq > 39 THEN 3 ELSE 0 END AS leaf FROM fx_lines) SELECT doc_id, page_no, seq, CAST(dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY leaf) - 1 AS INTEGER) AS block_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no, leaf ORDER BY seq) - 1 AS INTEGER) AS line_no FROM c", fixture=True)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(layout.xy_cut(columns_page(spark, sf_dir))).select("doc_id", "page_no", "seq", "block_no", "line_no")


@query(f"+ {HEADS} SELECT doc_id, page_no, para_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round(y0, 1), x0, para_no) - 1 AS INTEGER) AS block_no FROM heads", fixture=True)
def block_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.ordered_blocks(heads(spark, sf_dir)).select("doc_id", "page_no", "para_no", "block_no")


TOC = HEADS + ", toc AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, para_no) AS INTEGER) AS entry_no, page_no, heading_level AS level, trim(text) AS title FROM heads WHERE heading_level <= 6 AND trim(text) <> '')"


@query(f"+ {TOC} SELECT t.doc_id, t.entry_no, t.level, (SELECT max(p.entry_no) FROM toc p WHERE p.doc_id = t.doc_id AND p.entry_no < t.entry_no AND p.level < t.level) AS parent_no FROM toc t", fixture=True)
def toc_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.outline_parents(document.outline(heads(spark, sf_dir), 6)).select("doc_id", "entry_no", "level", "parent_no")


@query(f"RECURSIVE {TOC}, pa AS (SELECT t.doc_id, t.entry_no, (SELECT max(p.entry_no) FROM toc p WHERE p.doc_id = t.doc_id AND p.entry_no < t.entry_no AND p.level < t.level) AS parent_no FROM toc t), de AS (SELECT doc_id, entry_no, 1 AS depth FROM pa WHERE parent_no IS NULL UNION ALL SELECT pa.doc_id, pa.entry_no, depth + 1 FROM pa JOIN de ON de.doc_id = pa.doc_id AND de.entry_no = pa.parent_no) SELECT doc_id, CAST(max(depth) AS INTEGER) AS depth FROM de GROUP BY ALL")
def toc_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.outline_depths(document.outline(heads(spark, sf_dir), 6)).groupBy("doc_id").agg(F.max("depth").alias("depth"))


ORACLES["toc_depth"] = f"WITH RECURSIVE {typeset.SQL.strip()}, " + ORACLES["toc_depth"].removeprefix("RECURSIVE ")


@query(f"+ {HEADS}, hh AS (SELECT *, CASE WHEN heading_level = 1 AND trim(text) <> '' THEN 1 ELSE 0 END AS h FROM heads), aa AS (SELECT *, max(h) OVER (PARTITION BY doc_id) AS anyh, sum(h) OVER w + CASE WHEN first_value(h) OVER w = 1 THEN 0 ELSE 1 END AS byhead FROM hh WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, para_no)) SELECT doc_id, CAST(CASE WHEN anyh = 1 THEN greatest(1, byhead) ELSE (page_no - 1) // 10 + 1 END AS INTEGER) AS chapter_no, count(*) AS n_paras FROM aa GROUP BY ALL", fixture=True)
def chapters_by_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.chapter_titles(document.chapters(heads(spark, sf_dir))).select("doc_id", "chapter_no", "n_paras")


@query("WITH b AS (SELECT doc_id, CAST(doc_id % 9 AS INTEGER) AS heading_level, CAST(n_chars % 5 - 1 AS INTEGER) AS page_no, CAST(doc_id % 7 - 1 AS DOUBLE) AS font_size FROM documents), v AS (SELECT doc_id, list_filter([CASE WHEN page_no < 1 THEN 'page_number' END, CASE WHEN heading_level NOT BETWEEN 1 AND 6 THEN 'heading_level' END, CASE WHEN font_size <= 0 THEN 'font_size' END], lambda x: x IS NOT NULL) AS v FROM b) SELECT doc_id, array_to_string(v, ',') AS violations FROM v")
def ir_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 9).cast("int").alias("heading_level"), (F.col("n_chars") % 5 - 1).cast("int").alias("page_no"), (F.col("doc_id") % 7 - 1).cast("double").alias("font_size"))
    rules = {k: document.RULES[k] for k in ("page_number", "heading_level", "font_size")}
    return document.violations(b, rules).select("doc_id", F.array_join("violations", ",").alias("violations"))


# Text functions, on texts with what they must escape put in.
SPICED = "'<a & \"b\"> ''' || text || chr(10) || '| {x}_$1 #50% ~^ \\\\ // *c* `d` [e]'"


def spiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<a & \"b\"> '"), F.col("text"), F.lit("\n| {x}_$1 #50% ~^ \\\\ // *c* `d` [e]")).alias("t"))


def duck_replace(expr: str, pairs: dict[str, str]) -> str:
    lit = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for a, b in pairs.items():
        expr = f"replace({expr}, {lit(a)}, {lit(b)})"
    return expr


@query(f"SELECT doc_id, {duck_replace(SPICED, {'&': '&amp;', '<': '&lt;', '>': '&gt;', chr(34): '&quot;', chr(39): '&apos;'})} AS t FROM documents")
def escape_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiced(spark, sf_dir).withColumn("t", text.escape_xml(F.col("t")))


_MARKS = {k: chr(0xE000 + i) for i, k in enumerate(text.LATEX)}


@query(f"SELECT doc_id, {duck_replace(duck_replace(duck_replace(SPICED, _MARKS), {m: text.LATEX[k] for k, m in _MARKS.items()}), {chr(10): ' ' + chr(92) * 2 + chr(10)})} AS t FROM documents")
def escape_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiced(spark, sf_dir).withColumn("t", text.escape_latex(F.col("t")))


@query(f"SELECT doc_id, replace(replace(regexp_replace({SPICED}, '([\\\\#*_`$<>@\\[\\]~])', '\\\\\\1', 'g'), '//', '\\//'), chr(10), ' \\' || chr(10)) AS t FROM documents")
def escape_typst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiced(spark, sf_dir).withColumn("t", text.escape_typst(F.col("t")))


@query(f"SELECT doc_id, '\"' || {duck_replace(SPICED, {chr(92): chr(92) * 2, chr(34): chr(92) + chr(34), chr(10): chr(92) + 'n'})} || '\"' AS t FROM documents")
def escape_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiced(spark, sf_dir).withColumn("t", text.escape_yaml(F.col("t")))


@query(f"SELECT doc_id, trim(replace(replace({SPICED}, chr(10), '<br>'), '|', '\\|')) AS t FROM documents")
def escape_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiced(spark, sf_dir).withColumn("t", text.escape_cell(F.col("t")))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1251 WHEN 1 THEN 1253 WHEN 2 THEN 932 WHEN 3 THEN 936 ELSE 1252 END::INTEGER AS codepage FROM documents")
def rtf_codepage(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(*[F.lit(x) for x in ("Привет", "Ελλάδα", "漢字かな", "漢字漢字", "plain é")])
    return table(spark, sf_dir, "documents").select("doc_id", text.rtf_codepage(F.concat(F.regexp_replace("text", "[^\u0001-\u007f]", ""), F.get(parts, (F.col("doc_id") % 5).cast("int")))).alias("codepage"))


@query("WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents) SELECT doc_id, string_agg(CASE WHEN ch IN ('\\', '{', '}') THEN '\\' || ch WHEN ch = chr(10) THEN '\\line ' WHEN ch = chr(9) THEN '\\tab ' WHEN unicode(ch) < 127 THEN ch ELSE '\\u' || CASE WHEN unicode(ch) > 32767 THEN unicode(ch) - 65536 ELSE unicode(ch) END || '?' END, '' ORDER BY i) AS t FROM c GROUP BY ALL")
def rtf_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.rtf_text(F.col("text")).alias("t"))


@query("SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'bash' WHEN 2 THEN 'json' WHEN 3 THEN 'xml' WHEN 4 THEN 'sql' WHEN 5 THEN 'rust' WHEN 6 THEN 'c' ELSE '' END AS language FROM documents")
def code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = ["def f():\n  pass", "#!/bin/bash\nls", '{"a": 1}', "<html><body>", "select 1\nfrom t", "fn main() {", "#include <stdio.h>", "just words"]
    return table(spark, sf_dir, "documents").select("doc_id", text.code_language(F.get(F.array(*[F.lit(s) for s in samples]), (F.col("doc_id") % 8).cast("int"))).alias("language"))


@query("SELECT p_partkey, p_brand IN ('Courier New', 'DejaVu Sans Mono') AS mono, NULL::VARCHAR AS family FROM part WHERE false UNION ALL SELECT p_partkey, p_partkey % 4 IN (0, 1), CASE p_partkey % 4 WHEN 2 THEN 'cmsy' WHEN 3 THEN 'symbol' END FROM part")
def font_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*[F.lit(x) for x in ("ABCDEF+Courier-New", "DejaVu Sans Mono", "ABCDEF+CMSY10", "SymbolMT")]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.is_monospace(name).alias("mono"), text.math_font(name).alias("family"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN strftime(o_orderdate, 'T%H:%M:%S') ELSE strftime(o_orderdate, 'T%H:%M:%S') || '+02:00' END AS iso FROM orders")
def pdf_date_to_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, time = F.date_format("o_orderdate", "yyyyMMdd"), F.date_format("o_orderdate", "HHmmss")
    raw = F.concat(F.lit("D:"), day, F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, time).otherwise(F.concat(time, F.lit("+02'00'"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.pdf_date(raw).alias("iso"))


@query("WITH k AS (SELECT doc_id, lang || ', ' || upper(lang) || '; ' || source || ',' || lang || ' ,, x' AS raw FROM documents) SELECT doc_id, lang_ || '|' || source_ || '|x' AS words FROM (SELECT doc_id, lang AS lang_, source AS source_ FROM documents)")
def keyword_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("lang", F.lit(", "), F.upper("lang"), F.lit("; "), "source", F.lit(","), "lang", F.lit(" ,, x"))
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).select("doc_id", F.array_join(document.metadata_words(F.col("raw")), "|").alias("words"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image: http://x/a.png' WHEN 1 THEN 'style sheet: s.css' WHEN 2 THEN 'script: //x/j.js' ELSE 'import: f.css' END AS found, false AS alone FROM pages")
def html_self_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(*[F.lit(x) for x in ('<img src="http://x/a.png"><img src="data:image/png;base64,AA==">', '<link rel="stylesheet" href="s.css">', '<script async src="//x/j.js"></script>', "<style>@import url('f.css')</style>")])
    made = table(spark, sf_dir, "pages").select("page_id", text.external_references(F.concat("html", F.get(tags, (F.col("page_id") % 4).cast("int")))).alias("f"))
    return made.select("page_id", F.array_join("f", ",").alias("found"), (F.size("f") == 0).alias("alone"))


@query("SELECT page_id, 'image/png' AS mime, url AS content FROM pages")
def html_data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat("html", F.lit('<img src="data:image/png;base64,'), F.regexp_replace(F.base64(F.encode("url", "UTF-8")), r"\s", ""), F.lit('">'))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(text.embedded_images(made)).alias("i"))
    return rows.select("page_id", "i.mime", F.decode("i.content", "UTF-8").alias("content"))


@query("WITH c AS (SELECT p_partkey, (p_partkey % 5) / 4.0 AS c, (p_partkey % 3) / 2.0 AS m, (p_size % 5) / 4.0 AS y, (p_size % 3) / 4.0 AS k FROM part), r AS (SELECT p_partkey, CAST(round_even(255 * (1 - c) * (1 - k), 0) AS INTEGER) AS r, CAST(round_even(255 * (1 - m) * (1 - k), 0) AS INTEGER) AS g, CAST(round_even(255 * (1 - y) * (1 - k), 0) AS INTEGER) AS b FROM c) SELECT p_partkey, r, g, b, printf('%02X%02X%02X', r, g, b) AS hex, round(1 - greatest(r, g, b) / 255.0, 9) AS k FROM r")
def color_cmyk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = geometry.cmyk((F.col("p_partkey") % 5) / 4.0, (F.col("p_partkey") % 3) / 2.0, (F.col("p_size") % 5) / 4.0, (F.col("p_size") % 3) / 4.0)
    return table(spark, sf_dir, "part").select("p_partkey", rgb.alias("c")).select("p_partkey", "c.r", "c.g", "c.b", geometry.hex_color(F.col("c")).alias("hex"), F.round(geometry.to_cmyk(F.col("c")).k, 9).alias("k"))


@query("WITH c AS (SELECT p_partkey, CAST(p_partkey % 256 AS INTEGER) AS r, (p_size % 4) / 4.0 AS a FROM part) SELECT p_partkey, CAST(round_even(255 * (r / 255.0 * a + 200 / 255.0 * (1 - a)) / (a + 1 * (1 - a)), 0) AS INTEGER) AS r, 1.0::DOUBLE AS a FROM c")
def color_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda r, a: F.struct(r.cast("int").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), a.cast("double").alias("a"))
    rows = table(spark, sf_dir, "part").select("p_partkey", c(F.col("p_partkey") % 256, (F.col("p_size") % 4) / 4.0).alias("top"), c(F.lit(200), F.lit(1.0)).alias("below"))
    return rows.select("p_partkey", geometry.blend(F.col("top"), F.col("below")).alias("o")).select("p_partkey", "o.r", "o.a")


@query("SELECT p_partkey, CAST(p_size * 10 AS BIGINT) AS dxa, CAST(p_size AS BIGINT) AS half, CAST(p_size * 6350 AS BIGINT) AS emu, CAST(p_size * 50 AS BIGINT) AS hundredth FROM part")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = F.col("p_size") / 2.0
    return table(spark, sf_dir, "part").select("p_partkey", *[geometry.points(pt, n).alias(a) for a, n in (("dxa", 20), ("half", 2), ("emu", 12700), ("hundredth", 100))])


@query(BOXES + "SELECT a.box_id, b.box_id IS NOT NULL AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 AS hit, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * CASE WHEN a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 THEN 1 END AS common, (greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) AS hull FROM bx a JOIN bx b ON b.box_id = a.box_id + 500")
def bbox_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = lambda p: geometry.box(*[F.col(f"{p}.{k}") for k in geometry.BOX])
    b = boxes(spark, sf_dir)
    rows = b.alias("a").join(b.alias("b"), F.col("b.box_id") == F.col("a.box_id") + 500).select(F.col("a.box_id").alias("box_id"), st("a").alias("p"), st("b").alias("q"))
    p, q = F.col("p"), F.col("q")
    return rows.select("box_id", geometry.intersects(p, q).alias("hit"), geometry.area(geometry.intersection(p, q)).alias("common"), geometry.area(geometry.union(p, q)).alias("hull"))


@query("SELECT p_partkey, CAST(2 * p_size + 10 AS DOUBLE) AS x, CAST(4 * p_size - 10 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS back FROM part")
def affine_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = [F.lit(float(v)) for v in (2, 0, 0, 4, 0, 0)], [F.lit(float(v)) for v in (1, 0, 0, 1, 10, -10)]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), geometry.multiply(geometry.affine(*n[0]), geometry.affine(*n[1])).alias("m"))
    rows = rows.select("p_partkey", "m", geometry.transform(F.col("m"), F.col("s"), F.col("s")).alias("t"))
    return rows.select("p_partkey", "t.x", "t.y", geometry.transform(geometry.inverse(F.col("m")), F.col("t.x"), F.col("t.y")).x.alias("back"))


def _roundtrip(name: str, filters: list[str], parms: dict[str, str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
        chain = F.array(*[F.lit(f) for f in filters])
        own = F.array(F.create_map(*[F.lit(x) for kv in parms.items() for x in kv])) if parms else F.lit(None).cast("array<map<string,string>>")
        out = rows.select("doc_id", F.length("raw").alias("n"), codecs.decode_stream(codecs.encode_stream(name)("raw"), chain, own).alias("d"))
        return out.select("doc_id", F.decode(F.substring("d.content", 1, F.col("n")) if parms else F.col("d.content"), "UTF-8").alias("t"), F.col("d.status").alias("status"))

    run.__name__ = f"codec_{name}" if name not in ("png", "tiff") else f"predictor_{name}"
    query("SELECT doc_id, text AS t, 'ok' AS status FROM documents")(run)


_roundtrip("hex", ["ASCIIHexDecode"])
_roundtrip("ascii85", ["A85"])
_roundtrip("runlength", ["RunLengthDecode"])
_roundtrip("lzw", ["LZWDecode"])
_roundtrip("flate", ["/FlateDecode"])
_roundtrip("png", ["FlateDecode"], {"Predictor": "12", "Columns": "16"})
_roundtrip("tiff", ["FlateDecode"], {"Predictor": "2", "Columns": "16"})


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'svg' ELSE 'unknown' END AS format FROM documents")
def image_format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads_ = F.array(*[F.unhex(F.lit(h)) for h in ("89504E470D0A1A0A00", "FFD8FFE000", "47494638396100", "524946460000000057454250", "20203C737667", "68656C6C6F")])
    return table(spark, sf_dir, "documents").select("doc_id", geometry.image_format(F.get(heads_, (F.col("doc_id") % 6).cast("int"))).alias("format"))


@query("SELECT doc_id, text AS t FROM documents")
def rc4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.unhex(F.md5(F.col("doc_id").cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", key.alias("k"), F.encode("text", "UTF-8").alias("raw"))
    return rows.select("doc_id", F.decode(codecs.rc4_column("k", codecs.rc4_column("k", "raw")), "UTF-8").alias("t"))


@query("SELECT doc_id, text AS t FROM documents")
def aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.unhex(F.md5(F.col("doc_id").cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", key.alias("k"), F.encode("text", "UTF-8").alias("raw"))
    return rows.select("doc_id", F.decode(F.aes_decrypt(F.aes_encrypt("raw", "k", F.lit("CBC"), F.lit("PKCS")), "k", F.lit("CBC"), F.lit("PKCS")), "UTF-8").alias("t"))


def _pdf_roundtrip(variant: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = pdf.parse(pdf_writer.write(body(spark, sf_dir), variant), lines=True, words=False)
        return pdf.page_lines(made).select("doc_id", "page_no", F.round("y0", 3).alias("top"), "text", F.round("x0", 3).alias("x0"), F.round("font_size", 3).alias("font_size"), "is_bold")

    run.__name__ = "pdf_roundtrip" if variant == "plain" else f"pdf_roundtrip_{variant}"
    # The glyphs' upper edge is 0.8 of the size above the baseline, which is ten points below the line's top.
    query("+ o AS (SELECT doc_id, page_no, round(y0 + 10 - 0.8 * font_size, 3) AS top, text, x0, font_size, is_bold FROM fx_lines) SELECT * FROM o", fixture=True)(run)


for _v in pdf_writer.VARIANTS:
    _pdf_roundtrip(_v)


@query("SELECT doc_id, 'Document ' || doc_id AS title FROM documents WHERE len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '')) > 0")
def pdf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pdf.parse(pdf_writer.write(body(spark, sf_dir), "rc4"), contents=False)
    return made.where("page_no = 1").select("doc_id", F.element_at("meta", "Title").alias("title"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.list_groups(items(spark, sf_dir))


MD = LISTS + r"""
, md_b AS (SELECT doc_id, page_no, para_no, CASE WHEN trim(text) = '' THEN '' WHEN heading_level IS NOT NULL THEN repeat('#', heading_level) || ' ' || trim(text)
  WHEN list_marker IS NOT NULL THEN repeat('  ', lv) || CASE WHEN list_marker ~ '^.*[.)]$' THEN CASE WHEN regexp_matches(ltrim(rtrim(list_marker, '.)'), '('), '^\d+$') THEN ltrim(rtrim(list_marker, '.)'), '(') || '.' ELSE list_marker END ELSE '-' END || ' ' || trim(text) ELSE trim(text) END AS b FROM lists),
md_p AS (SELECT doc_id, page_no, string_agg(b, chr(10) || chr(10) ORDER BY para_no) AS p FROM md_b WHERE b <> '' GROUP BY ALL)
"""


@query(f"+ {MD} SELECT doc_id, page_no, para_no, b AS content FROM md_b", fixture=True)
def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "page_no", "para_no", emit.markdown_block().alias("content"))


@query(f"+ {MD} SELECT doc_id, string_agg(p, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_no) AS content FROM md_p GROUP BY ALL", fixture=True)
def md_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.markdown(blocks(spark, sf_dir))


@query("+ g AS (SELECT doc_id, page_no, CAST(round_even(y0 / 12, 0) AS INTEGER) AS row, rtrim(left(repeat(' ', CAST(round_even(x0 / 6, 0) AS BIGINT)) || text, 102)) AS content FROM fx_lines) SELECT * FROM g", fixture=True)
def canvas_grid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.canvas_rows(body(spark, sf_dir))


@query("+ t AS (SELECT doc_id, page_no, seq, '<text x=\"' || CAST(CAST(x0 AS INTEGER) AS VARCHAR) || '\" y=\"' || CAST(CAST(y0 + 10 + (page_no - 1) * 812 AS INTEGER) AS VARCHAR) || '\" font-size=\"' || CAST(CAST(font_size AS INTEGER) AS VARCHAR) || CASE WHEN is_bold THEN '\" font-weight=\"bold' ELSE '' END || '\">' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') || '</text>' AS t FROM fx_lines) SELECT doc_id, '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"612\" height=\"' || (max(page_no) * 812 - 20) || '\" viewBox=\"0 0 612 ' || (max(page_no) * 812 - 20) || '\">' || chr(10) || string_agg(t, chr(10) ORDER BY page_no, seq) || chr(10) || '</svg>' || chr(10) AS content FROM t GROUP BY doc_id", fixture=True)
def svg_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.svg(body(spark, sf_dir))


def _emitted(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return emit.documents(blocks(spark, sf_dir), body(spark, sf_dir), name)

    run.__name__ = f"emit_{name}"
    query()(run)


for _n in ("html", "latex", "typst", "rtf"):
    _emitted(_n)


# Parts by name, and in the main ones how many blocks they hold: documents of `lists` by page, or by chapter.
_OF = "nb AS (SELECT doc_id, count(*) AS n, count(DISTINCT page_no) AS pages, max(page_no) AS last FROM lists GROUP BY doc_id)"
_FIXED = {
    "docx": ("[Content_Types].xml", "_rels/.rels", "docProps/core.xml", "word/_rels/document.xml.rels", "word/document.xml", "word/numbering.xml", "word/styles.xml"),
    "odt": ("mimetype", "META-INF/manifest.xml", "content.xml", "meta.xml", "styles.xml"), "odp": ("mimetype", "META-INF/manifest.xml", "content.xml", "meta.xml", "styles.xml"),
}
_MAIN = {"docx": ("word/document.xml", "<w:p>", "n + pages - 1"), "odt": ("content.xml", "<text:[ph] ", "n"), "odp": ("content.xml", "<draw:frame ", "n")}


def _parts_sql(name: str) -> str:
    if name in _FIXED:
        main, _, marks = _MAIN[name]
        names = ", ".join(f"'{x}'" for x in _FIXED[name])
        return f"+ {LISTS}, {_OF}, p AS (SELECT *, unnest([{names}]) AS part_name, unnest(range({len(_FIXED[name])})) AS i FROM nb) SELECT doc_id, i::INTEGER AS part_no, part_name, part_name = 'mimetype' AS is_stored, (CASE WHEN part_name = '{main}' THEN {marks} ELSE 0 END)::INTEGER AS n_marks FROM p"
    if name == "pptx":
        # Pages with blocks are numbered without gaps.
        return f"""+ {LISTS}, p0 AS (SELECT doc_id, page_no, count(*) AS n FROM lists GROUP BY doc_id, page_no), pg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS i, count(*) OVER (PARTITION BY doc_id) AS pages FROM p0),
f AS (SELECT doc_id, pages, unnest(['[Content_Types].xml', '_rels/.rels', 'ppt/_rels/presentation.xml.rels', 'ppt/presentation.xml', 'ppt/slideLayouts/_rels/slideLayout1.xml.rels', 'ppt/slideLayouts/slideLayout1.xml', 'ppt/slideMasters/_rels/slideMaster1.xml.rels', 'ppt/slideMasters/slideMaster1.xml', 'ppt/theme/theme1.xml']) AS part_name, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS k FROM pg WHERE i = 1)
SELECT doc_id, (CASE WHEN k = 8 THEN 8 + 2 * pages ELSE k END)::INTEGER AS part_no, part_name, FALSE AS is_stored, 0::INTEGER AS n_marks FROM f
UNION ALL SELECT doc_id, (6 + 2 * i)::INTEGER, 'ppt/slides/_rels/slide' || i || '.xml.rels', FALSE, 0::INTEGER FROM pg UNION ALL SELECT doc_id, (7 + 2 * i)::INTEGER, 'ppt/slides/slide' || i || '.xml', FALSE, n::INTEGER FROM pg"""
    return f"""+ {LISTS}, o AS (SELECT doc_id, heading_level, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, para_no) AS r FROM lists),
c AS (SELECT doc_id, sum(CASE WHEN heading_level = 1 OR r = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY r) AS ch FROM o), m AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY ALL),
f AS (SELECT doc_id, unnest(['mimetype', 'META-INF/container.xml', 'OEBPS/content.opf', 'OEBPS/nav.xhtml']) AS part_name, unnest([0, 1, 2, 3]) AS k FROM m WHERE ch = 1)
SELECT doc_id, k::INTEGER AS part_no, part_name, k = 0 AS is_stored, 0::INTEGER AS n_marks FROM f UNION ALL SELECT doc_id, (3 + ch)::INTEGER, 'OEBPS/Text/chapter_' || ch::INTEGER || '.xhtml', FALSE, n::INTEGER FROM m"""


def _packaged(name: str) -> None:
    from quillwork.sources import packages

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = packages.read(packages.write(blocks(spark, sf_dir), name))
        main, mark = (_MAIN[name][:2]) if name in _MAIN else ("ppt/slides/slide", "<p:sp>") if name == "pptx" else ("OEBPS/Text/", "<p>|<li>|<h[1-6] ")
        return parts.select("doc_id", "part_no", "part_name", "is_stored", F.when(F.col("part_name").startswith(main), F.regexp_count(F.decode("content", "UTF-8"), F.lit(mark))).otherwise(0).alias("n_marks"))

    run.__name__ = f"zip_parts_{name}"
    query(_parts_sql(name), fixture=True)(run)


for _n in ("epub", "docx", "pptx", "odt", "odp"):
    _packaged(_n)


# Documents with tables and runs through the renderers that conversion uses.
RUN = "named_struct('text', {t}, 'bold', {b}, 'italic', {i})"
#: What the runs of these queries have alike.
PLAIN_RUN = {"text": None, "font": "Helvetica", "size": 11.0, "color": 0, "bold": None, "italic": None, "underline": False, "strike": False, "script": None, "baseline": None}


def rendered_blocks(rows: DataFrame, name: str, block: str) -> DataFrame:
    """(doc_id, content): one block for each row, rendered alone; block names a column with the fields that it has. Runs have only text, bold and italic."""
    import pyarrow as pa

    from quillwork.functions import columns
    from quillwork.plans import ir, rich

    make = {"md": rich.md_block, "html": rich.html_block, "latex": rich.latex_block, "typst": rich.typst_block}[name]

    def whole(x: dict) -> dict:
        own = {**ir.EMPTY, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, **x}
        for y in (own, *(own["cells"] or [])):
            y["runs"] = [{**PLAIN_RUN, **r} for r in y["runs"]] if y["runs"] is not None else None
        return own

    def run(batches):
        for b in columns.slices(batches):
            made = [make(whole(x)) for x in columns.values(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["doc_id", "content"])

    return rows.select(F.col("doc_id").cast("long"), block).mapInArrow(run, "doc_id long, content string")


def _tables(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = tables.cells(tables.rulings(grid_vectors(spark, sf_dir)))
        own = cells.withColumn("runs", F.array(F.expr(RUN.format(t="concat('r', row, 'c', col)", b="row = 0", i="false"))))
        tabs = own.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("row", "col", "row_span", "col_span", "x0", "y0", "x1", "y1", "runs"))).alias("cells"))
        return rendered_blocks(tabs.select("doc_id", F.struct(F.lit("table").alias("kind"), "cells").alias("b")), name, "b")

    run.__name__ = f"{name}_tables_documents"
    query(sql)(run)


# Tables of the grid fixture: the header row is bold, and where stretches are missing the first cell spans two columns and rows.
_GRID_CELLS = """WITH g AS (SELECT p_partkey AS doc_id, p_size % 4 + 2 AS nr, p_partkey % 4 + 2 AS nc, p_partkey % 3 = 0 AS open FROM part), gr AS (SELECT *, unnest(range(nr)) AS r FROM g), gc AS (SELECT *, unnest(range(nc)) AS c FROM gr),
ce AS (SELECT *, open AND r < 2 AND c < 2 AS inside, NOT (open AND r < 2 AND c < 2) OR (r = 0 AND c = 0) AS starts FROM gc)"""
_tables("md", _GRID_CELLS + """, t AS (SELECT doc_id, nr, nc, r, c, CASE WHEN NOT starts THEN '' WHEN r = 0 THEN '**r0c' || c || '**' ELSE 'r' || r || 'c' || c END AS x FROM ce), w AS (SELECT doc_id, c, greatest(3, max(length(x))) AS w FROM t GROUP BY ALL),
l AS (SELECT doc_id, r, '| ' || string_agg(rpad(x, w::INTEGER, ' '), ' | ' ORDER BY c) || ' |' AS x FROM t JOIN w USING (doc_id, c) GROUP BY ALL), d AS (SELECT doc_id, '| ' || string_agg(':' || repeat('-', w - 1), ' | ' ORDER BY c) || ' |' AS x FROM w GROUP BY ALL),
a AS (SELECT doc_id, 2 * r AS o, x FROM l UNION ALL SELECT doc_id, 1, x FROM d) SELECT doc_id, string_agg(x, chr(10) ORDER BY o) AS content FROM a GROUP BY ALL""")
_HTML_ROWS = """, h AS (SELECT doc_id, nr, r, '<tr>' || coalesce(string_agg('<' || CASE WHEN r = 0 THEN 'th' ELSE 'td' END || CASE WHEN inside THEN ' colspan="2" rowspan="2"' ELSE '' END || '>' || CASE WHEN r = 0 THEN '<strong>r0c' || c || '</strong></th>' ELSE 'r' || r || 'c' || c || '</td>' END, '' ORDER BY c) FILTER (WHERE starts), '') || '</tr>' AS x FROM ce GROUP BY ALL)
SELECT doc_id, '<table>' || chr(10) || '<thead>' || chr(10) || max(x) FILTER (WHERE r = 0) || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) || string_agg(x, chr(10) ORDER BY r) FILTER (WHERE r > 0) || chr(10) || '</tbody>' || chr(10) || '</table>' AS content FROM h GROUP BY doc_id"""
_tables("html", _GRID_CELLS + _HTML_ROWS)


def _styled(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ws = table(spark, sf_dir, "documents").select("doc_id", F.expr("filter(split(translate(text, '\n', ' '), ' '), x -> x <> '')").alias("ws")).where("size(ws) > 0")
        runs = ws.select("doc_id", F.expr(f"transform(ws, (w, k) -> {RUN.format(t="concat(w, ' ')", b='k % 5 = 0', i='k % 7 = 0')})").alias("runs"))
        return rendered_blocks(runs.select("doc_id", F.struct(F.lit("paragraph").alias("kind"), "runs").alias("b")), name, "b")

    run.__name__ = f"{name}_runs"
    query("WITH w AS (SELECT doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS ws FROM documents), k AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM w), a AS (SELECT *, CASE WHEN regexp_matches(w, '^(https?://|mailto:)') THEN w WHEN regexp_matches(w, '^www\\..') THEN 'http://' || w WHEN regexp_matches(w, '^[\\w.+-]+@[\\w-]+\\.[\\w.]+$') THEN 'mailto:' || w END AS link FROM k) " + sql)(run)


_styled("md", "SELECT doc_id, trim(string_agg(CASE WHEN link = w THEN '<' || w || '> ' WHEN link IS NOT NULL THEN '[' || w || '](' || link || ') ' ELSE repeat('*', CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) || w || repeat('*', CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) || ' ' END, '' ORDER BY k)) AS content FROM a GROUP BY doc_id")
_HTML_W = duck_replace("w || ' '", {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"})
_styled("html", f"SELECT doc_id, '<p>' || trim(string_agg(coalesce('<a href=\"' || link || '\">', '') || CASE WHEN k % 7 = 0 THEN '<em>' ELSE '' END || CASE WHEN k % 5 = 0 THEN '<strong>' ELSE '' END || {_HTML_W} || CASE WHEN k % 5 = 0 THEN '</strong>' ELSE '' END || CASE WHEN k % 7 = 0 THEN '</em>' ELSE '' END || CASE WHEN link IS NOT NULL THEN '</a>' ELSE '' END, '' ORDER BY k)) || '</p>' AS content FROM a GROUP BY doc_id")
_TEX_W = duck_replace(duck_replace("w", _MARKS), {m: text.LATEX[k] for k, m in _MARKS.items()})
_styled("latex", rf"SELECT doc_id, trim(string_agg(CASE WHEN link IS NOT NULL THEN '\url{{' || w || '}} ' ELSE CASE WHEN k % 5 = 0 THEN '\textbf{{' ELSE '' END || CASE WHEN k % 7 = 0 THEN '\textit{{' ELSE '' END || {_TEX_W} || CASE WHEN k % 7 = 0 THEN '}}' ELSE '' END || CASE WHEN k % 5 = 0 THEN '}}' ELSE '' END || ' ' END, '' ORDER BY k)) AS content FROM a GROUP BY doc_id")


@query("SELECT * FROM (VALUES ('aes128', '69c4e0d86a7b0430d8cdb78070b4c55a'), ('aes256', '8ea2b7ca516745bfeafc49904b496089'), ('aes256 back', '00112233445566778899aabbccddeeff'), ('rc4 40', 'b2396305f03dc027ccc3524a0a1118a8'), ('rc4 128', '9ac7cc9a609d1ef7b2932899cde41b97')) AS t(name, hex)")
def cipher_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published vectors (FIPS 197 C.1 and C.3, RFC 6229) through the functions that open encrypted files."""
    from quillwork.functions import aes

    plain, keys = bytes(16 * x + x for x in range(16)), [bytes(range(16)), bytes(range(32))]

    @F.pandas_udf("string")
    def made(names: pd.Series) -> pd.Series:
        of = {"aes128": lambda: aes.raw_cbc(keys[0], bytes(16), plain, False), "aes256": lambda: aes.raw_cbc(keys[1], bytes(16), plain, False), "aes256 back": lambda: aes.raw_cbc(keys[1], bytes(16), bytes.fromhex("8ea2b7ca516745bfeafc49904b496089"))}
        of |= {"rc4 40": lambda: codecs.rc4(bytes(range(1, 6)), bytes(16)), "rc4 128": lambda: codecs.rc4(bytes(range(1, 17)), bytes(16))}
        return pd.Series([of[n]().hex() for n in names])

    return spark.createDataFrame([(n,) for n in ("aes128", "aes256", "aes256 back", "rc4 40", "rc4 128")], "name string").select("name", made("name").alias("hex"))


@query("SELECT p_partkey, (least(p_size, 32, 64 - p_size) + 7)::INTEGER AS ink, 24::INTEGER AS n_bytes FROM part")
def fax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of runs as fax code words and back: black from p_size on for p_size and for seven places, and a white row."""
    from quillwork.functions import bitmaps

    @F.pandas_udf("binary")
    def decoded(size: pd.Series) -> pd.Series:
        return pd.Series([bitmaps.fax(bitmaps.fax_encoded([[n, min(64, 2 * n)], [n, n + 7], []], 64), {"K": 0, "Columns": 64, "Rows": 3, "BlackIs1": True}) for n in size])

    ink = F.expr("aggregate(sequence(1, length(d)), 0, (a, i) -> a + bit_count(cast(conv(hex(substring(d, i, 1)), 16, 10) as int)))")
    rows = table(spark, sf_dir, "part").select("p_partkey", decoded(F.least(F.col("p_size"), F.lit(50)).cast("int")).alias("d"))
    return rows.select("p_partkey", ink.cast("int").alias("ink"), F.length("d").alias("n_bytes"))


@query("SELECT p_partkey, (p_size * 4)::INTEGER AS gray, round_even((1 - p_size / 50.0) * (1 - (p_partkey % 5) / 5.0) * 255, 0)::INTEGER AS red, (p_partkey % 4 * 60)::INTEGER AS indexed, CASE WHEN p_size * 4 BETWEEN 40 AND 120 THEN 0 ELSE 255 END::INTEGER AS keyed FROM part")
def image_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel each of gray, CMYK and indexed samples and of a colour key."""
    import numpy as np

    from quillwork.functions import bitmaps

    space = lambda name: bitmaps.color_space(lambda x: x, lambda x: x, name)
    table_ = bytes(v for i in range(4) for v in (60 * i, 0, 0))

    @F.pandas_udf("struct<gray:int,red:int,indexed:int,keyed:int>")
    def pixels(size: pd.Series, key: pd.Series) -> pd.DataFrame:
        gray = bitmaps.samples(bytes(int(4 * s) for s in size), len(size), 1, 1, 8)
        cmyk = np.stack([size.to_numpy() / 50.0 * 65535, *[np.zeros(len(size))] * 2, (key.to_numpy() % 5) / 5.0 * 65535], -1)[None]
        indexed = bitmaps.to_rgb((key.to_numpy() % 4)[None, :, None], space(["Indexed", "DeviceRGB", 3, table_]), 8)
        return pd.DataFrame({"gray": bitmaps.to_rgb(gray, space("DeviceGray"), 8)[0, :, 0], "red": bitmaps.to_rgb(cmyk, space("DeviceCMYK"), 16)[0, :, 0], "indexed": indexed[0, :, 0], "keyed": bitmaps.key_mask(gray, [40, 120])[0]})

    return table(spark, sf_dir, "part").select("p_partkey", pixels("p_size", "p_partkey").alias("x")).select("p_partkey", "x.gray", "x.red", "x.indexed", "x.keyed")


@query(r"SELECT o_orderkey, (length(o_orderpriority))::INTEGER AS n, '\alpha x^{2} \leq ' || (o_orderkey % 10) AS latex, 'alpha x^(2) lt.eq ' || (o_orderkey % 10) AS typst FROM orders")
def math_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas with Greek, a raised digit and a relation in LaTeX and Typst."""
    from quillwork.functions import mathtext

    @F.pandas_udf("struct<latex:string,typst:string>")
    def both(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({k: [mathtext.translated(x, "", k) for x in t] for k in ("latex", "typst")})

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.length("o_orderpriority").alias("n"), both(F.concat(F.lit("αx² ≤"), (F.col("o_orderkey") % 10).cast("string"))).alias("x"))
    return rows.select("o_orderkey", "n", "x.latex", "x.typst")


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation as table cells: a header, then name, balance and segment."""
    c = table(spark, sf_dir, "customer")
    rows = c.withColumn("row", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")))
    body_ = rows.select(F.col("c_nationkey").alias("table_id"), "row", F.posexplode(F.array("c_name", F.col("c_custkey").cast("string"), F.concat("c_mktsegment", F.lit("|x")))).alias("col", "text"))
    head = c.select("c_nationkey").distinct().select(F.col("c_nationkey").alias("table_id"), F.lit(0).alias("row"), F.posexplode(F.array(F.lit("name"), F.lit("key"), F.lit("segment"))).alias("col", "text"))
    return head.unionByName(body_)


CELLS = """WITH cr AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row FROM customer),
ce AS (SELECT c_nationkey AS table_id, CAST(row AS INTEGER) AS row, unnest([0, 1, 2]) AS col, unnest([c_name, c_custkey::VARCHAR, c_mktsegment || '|x']) AS text FROM cr
 UNION ALL SELECT DISTINCT c_nationkey, 0, unnest([0, 1, 2]), unnest(['name', 'key', 'segment']) FROM customer),
al AS (SELECT table_id, col, CASE WHEN count(*) FILTER (WHERE regexp_matches(trim(text), '^[$€£¥₽₹]?\\s*-?\\d{1,3}(,\\d{3})*(\\.\\d+)?\\s*%?$')) >= count(*) / 2.0 THEN 'right' ELSE 'left' END AS alignment, CAST(greatest(3, max(length(replace(text, '|', '\\|')))) AS INTEGER) AS width FROM ce GROUP BY ALL)
"""


@query(CELLS + "SELECT table_id, col, alignment, width FROM al")
def gfm_alignment_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.column_alignments(order_cells(spark, sf_dir), ["table_id"])


@query(CELLS + ", tt AS (SELECT table_id, row, col, CASE WHEN alignment = 'right' THEN lpad(replace(text, '|', '\\|'), width, ' ') ELSE rpad(replace(text, '|', '\\|'), width, ' ') END AS t, CASE WHEN alignment = 'right' THEN repeat('-', width - 1) || ':' ELSE ':' || repeat('-', width - 1) END AS d FROM ce JOIN al USING (table_id, col)), rr AS (SELECT table_id, row * 2 AS o, '| ' || string_agg(t, ' | ' ORDER BY col) || ' |' AS x FROM tt GROUP BY table_id, row UNION ALL SELECT table_id, 1, '| ' || string_agg(d, ' | ' ORDER BY col) || ' |' FROM tt WHERE row = 0 GROUP BY table_id) SELECT table_id, string_agg(x, chr(10) ORDER BY o) AS content FROM rr GROUP BY ALL")
def md_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.pipe_tables(order_cells(spark, sf_dir), ["table_id"])


@query("WITH b AS (SELECT s_suppkey AS doc_id, CAST(s_suppkey % 7 AS INTEGER) AS c0, CAST(s_suppkey % 7 + 3 AS INTEGER) AS c1, CAST(s_suppkey % 5 AS INTEGER) AS r0, CAST(s_suppkey % 5 + 2 AS INTEGER) AS r1 FROM supplier), b2 AS (SELECT * FROM b UNION ALL SELECT doc_id, c1, c1 + 3, r0, r1 FROM b), f AS (SELECT doc_id, unnest([r0, r1]) AS row, c0, c1, unnest([range(c0, c1 + 1), range(c0, c1 + 1)]) AS cs FROM b2), ff AS (SELECT doc_id, row, c0, c1, unnest(cs) AS col FROM f), t AS (SELECT doc_id, unnest([c0, c1]) AS col, r0, r1, unnest([range(r0, r1 + 1), range(r0, r1 + 1)]) AS rs FROM b2), tt AS (SELECT doc_id, col, r0, r1, unnest(rs) AS row FROM t), m AS (SELECT doc_id, row, col, CASE WHEN col < c1 THEN 2 ELSE 0 END + CASE WHEN col > c0 THEN 8 ELSE 0 END AS mask FROM ff UNION ALL SELECT doc_id, row, col, CASE WHEN row < r1 THEN 4 ELSE 0 END + CASE WHEN row > r0 THEN 1 ELSE 0 END FROM tt) SELECT doc_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(bit_or(mask) AS INTEGER) AS mask FROM m GROUP BY doc_id, row, col")
def box_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    one = table(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.lit(1).alias("page_no"), (6.0 * (k % 7)).alias("x0"), (6.0 * (k % 7 + 3)).alias("x1"), (12.0 * (k % 5)).alias("y0"), (12.0 * (k % 5 + 2)).alias("y1"))
    two = one.select("doc_id", "page_no", F.col("x1").alias("x0"), (F.col("x1") + 18.0).alias("x1"), "y0", "y1")
    return emit.box_cells(one.unionByName(two)).select("doc_id", "row", "col", "mask")


# Codes beyond the font's table and Latin-1 have no text.
@query("SELECT doc_id, regexp_replace(text, '[^\\x{0}-\\x{ff}]', '\ufffd', 'g') AS t FROM documents WHERE text <> ''")
def cmap_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    code = lambda c, font: F.when(F.ascii(c) < 128, F.ascii(c) + 1000 * font).otherwise(F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))
    codes = docs.where("text <> ''").select("doc_id", (F.col("doc_id") % 3).alias("font_id"), F.transform(F.split("text", ""), lambda c: code(c, F.col("doc_id") % 3)).alias("codes"))
    ranges = spark.range(3).select(F.col("id").alias("font_id"), (F.col("id") * 1000 + 1).alias("lo"), (F.col("id") * 1000 + 127).alias("hi"), F.lit(1).cast("long").alias("target"))
    return fonts.decoded_arrays(codes, fonts.code_table(ranges)).select("doc_id", F.col("text").alias("t"))


@query("WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN -(l_quantity * 10 / 1000.0 * 12 * 0.5) ELSE ((500 + l_quantity) / 1000.0 * 12 + 0.25 + CASE WHEN l_linenumber % 4 = 0 THEN 1.5 ELSE 0 END) * 0.5 END AS step, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq FROM lineitem) SELECT l_orderkey, seq::INTEGER AS seq, round(coalesce(sum(step) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS x FROM s")
def kerning_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    kern = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") * 10)
    shown = li.select("l_orderkey", "seq", kern.alias("kern"), (500 + F.col("l_quantity")).alias("width"), (F.col("l_linenumber") % 4 == 0).alias("is_space"), F.lit(12.0).alias("size"), F.lit(0.25).alias("spacing"), F.lit(1.5).alias("word_spacing"), F.lit(0.5).alias("scale"))
    return fonts.placed(shown, ["l_orderkey"]).select("l_orderkey", "seq", F.round("x", 6).alias("x"))


@query("SELECT p_partkey, CAST(p_partkey % 40 + 1 AS INTEGER) AS width, CAST(p_size AS INTEGER) AS height, 'png' AS format, 1::INTEGER AS channels, 8::INTEGER AS depth FROM part")
def image_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select("p_partkey", images.gray_png_column((F.col("p_partkey") % 40 + 1).cast("int"), "p_size", F.lit(7)).alias("png"))
    return made.select("p_partkey", images.image_info_column("png").alias("i")).select("p_partkey", "i.width", "i.height", "i.format", "i.channels", "i.depth")


@query("SELECT o_orderkey, 'date=' || strftime(o_orderdate, '%Y-%m-%d') || '|lang=' || o_orderpriority || '|title=Order ' || o_orderkey AS meta FROM orders")
def metadata_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.create_map(F.lit("/Title"), F.concat(F.lit(" Order "), F.col("o_orderkey").cast("string")), F.lit("CreationDate"), F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd")), F.lit("Lang"), F.col("o_orderpriority"), F.lit("Empty"), F.lit("  "))
    entries = F.map_entries(document.metadata(raw))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("meta"))


@query("SELECT p_partkey, 'M 0.00 ' || printf('%.2f', 792.0 - p_size) || ' L 10.00 792.00 C 1.00 791.00 2.00 790.00 ' || printf('%.2f', p_size::DOUBLE) || ' 789.50 Z' AS flipped, 10::INTEGER AS n_segments, greatest(10.0, p_size)::DOUBLE AS x1, greatest(2.5, p_size)::DOUBLE AS y1 FROM part")
def path_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    path = F.concat(F.lit("M 0 "), size, F.lit(" L 10 0 C 1 1 2 2 "), size, F.lit(" 2.5 Z"))
    b = paths.bounds(path)
    return table(spark, sf_dir, "part").select("p_partkey", paths.flipped(path, 792.0).alias("flipped"), F.size(paths.segments(path)).alias("n_segments"), b.x1.alias("x1"), b.y1.alias("y1"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html || '<img src=\"data:image/png;base64,' || 'QUI=' || '\"><img src=\"b.png\">' ELSE html END AS html FROM pages")
def html_inline_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_ = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit('<img src="a.png"><img src="b.png">'))).otherwise(F.col("html")).alias("html"))
    have = spark.range(1).select(F.lit("a.png").alias("path"), F.lit("image/png").alias("mime"), F.encode(F.lit("AB"), "UTF-8").alias("content"))
    return document.inline_images(pages_, have)


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'OEBPS/img' || p_partkey WHEN 1 THEN NULL ELSE 'b/c.x' END AS href, '_' || p_partkey || '_a_b' AS id FROM part")
def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    href = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("OEBPS/Text/../img"), k)).when(F.col("p_partkey") % 3 == 1, "a/../../b").otherwise("./a/..//b/c.x")
    return table(spark, sf_dir, "part").select("p_partkey", text.package_path(href).alias("href"), text.manifest_id(F.concat(k, F.lit(" a:b"))).alias("id"))


@query("+ c AS (SELECT DISTINCT doc_id, page_no, CASE WHEN seq BETWEEN 4 AND 21 THEN 1 WHEN seq BETWEEN 22 AND 39 THEN 2 WHEN seq > 39 THEN 3 ELSE 0 END AS leaf FROM fx_lines), n AS (SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY leaf) - 1 AS INTEGER) AS block_no FROM c) SELECT doc_id, page_no, block_no, block_no + 1 AS next_no FROM n WHERE EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND m.page_no = n.page_no AND m.block_no = n.block_no + 1)", fixture=True)
def reading_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.reading_edges(layout.reading_order(layout.xy_cut(columns_page(spark, sf_dir))))
