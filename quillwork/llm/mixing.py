"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document starts with rate 1. The rates that stay nearest to that in relative entropy, meet each source's word
target and never exceed a limit are exponentially tilted, rate = min(limit, exp(lambda * size / scale)), with one dual
variable lambda for each source. Newton's steps on the convex dual find all of them at once over the table of
(source, size) counts; the rates are then rounded to whole copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import WORD, checked, cut, ranged, running

#: Rates are rounded from multiples of 2^-20, so that sums of them are exact in any order.
UNIT = 1 << 20


def word_count(text: F.Column) -> F.Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def _skey(column: str = "source") -> F.Column:
    """A source as a key that is never null and sorts by code point, null last."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column).cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """(skey, source_size, target) from (skey, source_size): shares of the total by weight, each at most limit times its size, the excess reshared by weight.

    The final level is total share per weight over those not held: sources are taken in the order of limit * size /
    weight, and the held ones are the first in it. Their order and sums come from range partitions and a row for each, so
    no task sees the list of all sources; the driver sees the one source that fixes the level.
    """
    listed = running(ranged(sizes, "skey"), [], ["skey"], {"_place": F.lit(1).cast("long")}).drop("_pid")
    ranked = listed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))).drop("_place")
    ranked = ranked.withColumn("most", F.lit(float(limit)) * F.col("source_size")).withColumn("level", F.col("most") / F.col("weight"))
    # Sizes and limits are whole numbers, and so are these sums: they are the same in any order.
    at = running(ranged(ranked, "level", "skey"), [], ["level", "skey"], {"_size": F.col("source_size").cast("double"), "_most": "most", "_weight": "weight"}, totals=True)
    at = at.withColumn("share", (F.col("_size_total") - F.col("_most")) / (F.col("_weight_total") - F.col("_weight")))
    # The level once all sources held so far are out; the first source below its limit fixes it for the rest.
    final = at.where(F.col("share") < F.col("level")).agg(F.min(F.struct("level", "skey", "share")).alias("f")).first().f
    if final is None:
        return at.select("skey", "source_size", F.col("most").alias("target"))
    held = F.struct("level", "skey") < F.struct(F.lit(final.level).alias("level"), F.lit(final.skey).alias("skey"))
    return at.select("skey", "source_size", F.when(held, F.col("most")).otherwise(F.lit(final.share) * F.col("weight")).alias("target"))


def tilts(counts: DataFrame, goals: DataFrame, n_sources: int, limit: int = 3, tolerance: float = 1e-10, width: int = 64) -> DataFrame:
    """(skey, tilt, scale): the dual variable of each source; null where every rate is the limit.

    counts has (skey, size, n), goals (skey, source_size, target). A Newton step that leaves the bracket known so far
    is replaced by the bracket's middle, and so is one after a step that didn't halve the gap: gaps or brackets shrink
    until each source meets its target or its bracket has no room. The driver sees one number a step; n_sources rows of about width bytes are what
    a step may broadcast.
    """
    scale = counts.groupBy("skey").agg((F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("scale"))
    full = F.col("target") >= F.col("source_size") * (limit * (1 - 1e-9))
    state = goals.join(scale, "skey").select(
        "skey", "target", "scale",
        F.when(full | (F.col("source_size") == 0), F.lit(None).cast("double")).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("tilt"),
        F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), F.lit(float("inf")).alias("off"),
    )
    state = cut(state)
    counts = counts.where("size > 0")
    while True:
        z = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("tilt") * z, F.lit(700.0)))
        mass = F.col("n") * F.col("size").cast("double")
        seen = counts.join(checked(state.where("tilt is not null").select("skey", "tilt", "scale"), n_sources, width), "skey").groupBy("skey").agg(F.sum(mass * F.least(rate, F.lit(float(limit)))).alias("have"), F.sum(F.when(rate < limit, mass * z * rate).otherwise(0.0)).alias("slope"))
        joined = state.join(seen, "skey", "left").withColumn("gap", F.col("have") - F.col("target"))
        joined = joined.withColumn("low", F.when(F.col("gap") < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") > 0, F.least("high", "tilt")).otherwise(F.col("high")))
        newton = F.when((F.col("slope") > 0) & (F.abs("gap") <= 0.5 * F.col("off") * F.col("target")), F.col("tilt") - F.col("gap") / F.col("slope"))
        middle = (F.greatest("low", F.col("tilt") - 8.0) + F.least("high", F.col("tilt") + 8.0)) / 2
        settled = (F.abs("gap") <= tolerance * F.col("target")) | (F.col("high") - F.col("low") <= 1e-13 * F.greatest(F.abs("low"), F.abs("high")))
        state = cut(joined.select("skey", "target", "scale", F.when(settled | F.col("tilt").isNull(), F.col("tilt")).when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle).alias("tilt"), "low", "high", F.when(F.col("tilt").isNull(), F.lit(0.0)).when(settled, F.lit(0.0)).otherwise(F.abs("gap") / F.col("target")).alias("off")))
        if not (state.agg(F.max("off")).first()[0] or 0.0) > 0.0:
            break
    # Sums of doubles differ in their last digits from run to run; ten significant digits don't.
    digits = F.pow(F.lit(10.0), F.lit(9) - F.floor(F.log10(F.greatest(F.abs("tilt"), F.lit(1e-300)))))
    return state.select("skey", F.when(F.abs("tilt") < 1e-9, F.lit(0.0)).otherwise(F.round(F.col("tilt") * digits) / digits).alias("tilt"), F.round("scale", 6).alias("scale"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, passes: int = 3, carried: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of docs, with the column `carried` names.

    Copies come from systematic rounding: within a source, by size from large to small, a row gets as many copies as
    the running sum of rates passes half-integers, so a source's taken words miss its target by one row's size at most.
    Further passes then add or drop one copy of rows, large to small, as far as their sizes fit into what is still
    missing, and at last one copy of single rows until none would bring its source nearer. A null text has size 0, gets
    the copies that its rate 1 gives, and takes no words; a text of any length counts whole. A null source is a source of
    its own, last in order. Rows alike in source, size and doc_id may trade copies among themselves only. An empty table
    gives an empty result; other columns are ignored.
    """
    kept = [carried] if carried else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *kept, _skey().alias("skey"), word_count(F.col("text").cast("string")).alias("size"))
    base = cut(base)
    counts = cut(base.groupBy("skey", "size").agg(F.count("*").alias("n")))
    goals = cut(targets(counts.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, limit))
    facts = goals.agg(F.count("*").alias("n"), F.max(F.octet_length("skey")).alias("width")).first()
    n_sources, width = facts.n, 64 + (facts.width or 0)
    solved = cut(goals.join(tilts(counts, goals, n_sources, limit, width=width), "skey"))
    rated = base.join(checked(solved, n_sources, width), "skey").withColumn(
        "rate",
        F.when((F.col("size") == 0) | (F.col("source_size") == 0), F.lit(1.0))
        .when(F.col("tilt").isNull(), F.lit(float(limit)))
        .otherwise(F.least(F.lit(float(limit)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(700.0))))),
    )
    rated = rated.select("doc_id", "source", "skey", *kept, "size", "source_size", "target", F.round(F.col("rate") * UNIT).cast("long").alias("rate"), (-F.col("size")).alias("_large"), F.xxhash64("doc_id").alias("_mixed"))
    order = ["_large", "_mixed", "doc_id"]
    rows = ranged(rated, "skey", *order).withColumn("_n", F.monotonically_increasing_id())  # over written rows: the numbers stay
    rounded = running(rows, ["skey"], order, {"before": "rate"})
    half = UNIT // 2
    rows = cut(rounded.withColumn("copies", F.expr(f"(before + rate + {half}) div {UNIT} - (before + {half}) div {UNIT}")).drop("before", "rate"))
    for _ in range(passes):
        missing = rows.groupBy("skey").agg((F.round(F.first("target")) - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("missing"))
        fits = F.expr(f"size > 0 and size <= abs(missing) and ((missing > 0 and copies < {limit}) or (missing < 0 and copies > 0))")
        marked = rows.join(checked(missing, n_sources, width), "skey").withColumn("fit", F.when(fits, F.col("size")).otherwise(F.lit(0).cast("long")))
        summed = running(marked, ["skey"], order, {"used": "fit"})
        rows = cut(summed.withColumn("copies", F.col("copies") + F.expr("case when fit > 0 and used + fit <= abs(missing) then sign(missing) else 0 end").cast("long")).drop("missing", "fit", "used"))
    # What no row fits into may still come nearer by the one row whose size is nearest to what is missing. Each turn
    # lessens what its sources miss, in whole words, until no such row is left; rows stay as they are written, and what
    # changes is a list of one row for each source and turn.
    changes, n_changes = None, 0
    while True:
        now = rows if changes is None else rows.join(checked(changes, n_changes), "_n", "left").withColumn("copies", F.col("copies") + F.coalesce("_by", F.lit(0))).drop("_by")
        missing = now.groupBy("skey").agg((F.round(F.first("target")) - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("missing"))
        off = F.abs(F.col("size") - F.abs("missing"))
        could = F.expr(f"(missing > 0 and copies < {limit}) or (missing < 0 and copies > 0)") & (off < F.abs("missing"))
        best = cut(now.join(checked(missing, n_sources, width), "skey").where(could).groupBy("skey").agg(F.min(F.struct(off.alias("off"), F.col("_mixed"), F.col("_n"), F.signum("missing").cast("long").alias("by"))).alias("b")).select(F.col("b._n").alias("_n"), F.col("b.by").alias("_by")))
        if best.isEmpty():
            rows = now
            break
        changes = best if changes is None else cut(changes.union(best).groupBy("_n").agg(F.sum("_by").alias("_by")))
        n_changes += n_sources
    return rows.select("doc_id", "source", *kept, "size", "source_size", "target", "copies")
