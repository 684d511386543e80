"""Codes of fonts to texts and places, as joins and windows over tables of fonts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def code_table(ranges: DataFrame) -> DataFrame:
    """(font_id, code, text) from ranges (font_id, lo, hi, target): target is the Unicode number of lo's text, and rises with the code. Of ranges that overlap, the one with the largest lo counts."""
    each = ranges.select("font_id", "lo", "target", F.explode(F.sequence("lo", "hi")).alias("code"))
    text = F.decode(F.unhex(F.lpad(F.hex(F.col("target") + F.col("code") - F.col("lo")), 8, "0")), "UTF-32")
    return each.groupBy("font_id", "code").agg(F.max_by(F.struct(text.alias("t")), "lo").alias("v")).select("font_id", "code", F.col("v.t").alias("text"))


def decoded(codes: DataFrame, table: DataFrame) -> DataFrame:
    """codes (font_id, code, ...) with text: the table's, else the Latin character of a code below 256, else the replacement character."""
    own = table.select("font_id", "code", F.col("text").alias("_t"))
    latin = F.when(F.col("code") < 256, F.decode(F.unhex(F.lpad(F.hex("code"), 2, "0")), "ISO-8859-1"))
    return codes.join(own, ["font_id", "code"], "left").withColumn("text", F.coalesce("_t", latin, F.lit("�"))).drop("_t")


#: Codes from the first to the last of a font that is looked up by place; a font with more is looked up by key.
SPAN = 1 << 17


def decoded_arrays(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (font_id, codes, ...) with text: what decoded() gives for each code, joined where the codes are. The table goes to all tasks as one row for each font."""
    ends = table.groupBy("font_id").agg(F.min("code").alias("_lo"), F.max("code").alias("_hi"))
    places = ends.where(F.col("_hi") - F.col("_lo") < SPAN).select("font_id", F.explode(F.sequence("_lo", "_hi")).alias("code"))
    dense = places.join(table, ["font_id", "code"], "left").groupBy("font_id").agg(F.expr("transform(array_sort(collect_list(struct(code, text))), x -> x.text)").alias("_a"))
    wide = table.join(ends, "font_id").where(F.col("_hi") - F.col("_lo") >= SPAN).groupBy("font_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "text"))).alias("_m"))
    fonts = ends.join(dense, "font_id", "left").join(wide, "font_id", "left")
    latin = lambda c: F.when(c < 256, F.decode(F.unhex(F.lpad(F.hex(c), 2, "0")), "ISO-8859-1"))
    known = lambda c: F.when(c.between(F.col("_lo"), F.col("_hi")), F.coalesce(F.get("_a", (c - F.col("_lo")).cast("int")), F.try_element_at("_m", c)))
    text = F.array_join(F.transform("codes", lambda c: F.coalesce(known(c), latin(c), F.lit("\ufffd"))), "")
    return rows.join(F.broadcast(fonts), "font_id", "left").withColumn("text", text).drop("_lo", "_hi", "_a", "_m")


def placed(shown: DataFrame, keys: list[str]) -> DataFrame:
    """shown with x, where each glyph of a line starts: the sum of the advances before it.

    Rows have seq and either width (thousandths of the size) or kern (thousandths taken back); size, spacing, word_spacing
    and scale hold for the row, is_space adds the word spacing.
    """
    glyph = (F.col("width") / 1000.0 * F.col("size") + F.col("spacing") + F.when(F.col("is_space"), F.col("word_spacing")).otherwise(0.0)) * F.col("scale")
    step = F.when(F.col("kern").isNotNull(), -F.col("kern") / 1000.0 * F.col("size") * F.col("scale")).otherwise(glyph)
    before = W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return shown.withColumn("x", F.coalesce(F.sum(step).over(before), F.lit(0.0)))
