"""Quality rules: lines that many documents of one host share go, and documents that lose too much with them are rejected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import bytes_of, checked, cut, salted_join, tidied

SYMBOLS = b"#*$%&|<>"
#: Words hashed at once.
CHUNK = 1 << 16


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more among the word hashes, the first find included."""
    if len(words) < 4:
        return 0
    grams = (words[:-2] * MIX[0]) ^ (words[1:-1] * MIX[1] + (words[2:] * MIX[2] >> np.uint64(7)))
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(words), bool)
    again[order[np.r_[False, same] | np.r_[same, False]]] = True
    return int((again | np.r_[False, again[:-1]] | np.r_[False, False, again[:-2]]).sum())


MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _line_hash(own: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(own).lower()) - (1 << 63)


def text_features(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a hash of the words in lower case, then the distinct line hashes of the text and the words that stand in lines with each.

    Of a text it holds a hash for each word and each distinct line, besides the words of the line it is at.
    """
    raw = (text or "").encode("utf-8", "replace")
    lines: dict[int, int] = {}
    seen: set[bytes] = set()
    hashes: list[np.ndarray] = []
    waiting: list[bytes] = []
    copy = xxhash.xxh3_64(seed=1)
    n = chars = symbols = dup = 0

    def count() -> None:
        nonlocal chars, symbols
        if not waiting:
            return
        joined = b"".join(waiting)
        chars += len(joined.decode("utf-8"))
        symbols += len(joined) - len(joined.translate(None, SYMBOLS))
        hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, waiting), np.uint64, len(waiting)))
        copy.update(b" ".join(waiting).lower() + b" ")
        waiting.clear()

    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        key = line if len(line) < 64 else xxhash.xxh3_128_digest(line)
        dup += key in seen
        seen.add(key)
        n += len(own)
        h = _line_hash(own)
        lines[h] = lines.get(h, 0) + len(own)
        waiting += own
        if len(waiting) >= CHUNK:
            count()
    count()
    return n, chars, symbols, dup, repeated_words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), copy.intdigest() - (1 << 63), list(lines), list(lines.values())


def features(docs: DataFrame, carried: str | None = None) -> DataFrame:
    """A row for each of docs, with a row number of its own, host, base figures and line hashes; carried names a column of longs that stays."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "copy"]
    kept = [carried] if carried else []
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("row", pa.int64()), *[(c, pa.int64()) for c in kept], *[(n, pa.int64()) for n in names], ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            made = [text_features(t.as_py()) for t in b.column("text")]
            cols = list(zip(*made, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "host", "row", *kept)], *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[3 + len(kept) :], strict=True)]], schema=schema)

    sql = "doc_id long, host string, row long, " + ", ".join(f"{n} long" for n in [*kept, *names]) + ", lines array<long>, line_words array<long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.monotonically_increasing_id().alias("row"), *kept, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), sql)


def _frequent(lines: DataFrame, known: DataFrame, max_docs: int) -> DataFrame:
    """The (host, line) that more than max_docs distinct documents of the host hold. Rows of one doc_id are one document, and so are copies; every row without a doc_id is one."""
    single = known.where(F.size("lines") > 0).groupBy("host", "copy").agg(F.min("row").alias("row")).select("row")
    # A document has an entry for each of its lines; of a line that a third of all documents hold, tasks send sums.
    per = lines.join(single, "row", "left_semi").groupBy("host", "line", F.coalesce("doc_id", -1 - F.col("row")).alias("id"), F.col("doc_id").isNull().alias("none")).agg(F.count("*").alias("rows"))
    return cut(per.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs).select("host", "line"))


def judge(docs: DataFrame, max_docs: int = 20, keep_share: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, carried: str | None = None, removed: bool = False) -> DataFrame:
    """doc_id, row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed, kept for every row of docs, with the column `carried` names.

    A line is its words, in lower case and joined by one space, hashed. For each host and line the distinct documents
    are counted: rows of one doc_id are one document, and so are copies, whose words are equal but for case and white
    space. A line above max_docs goes, and a document that keeps less than keep_share of its words is rejected. Base
    rules reject fewer than min_words words, or a share of repeated words above max_repeat_percent. `removed` adds
    removed_lines, the hashes of the lines that go (null for none).

    A null text is an empty one, a null source the host ""; a text of any length is read whole. Repeated rows are judged
    alike, one for each row. An empty table gives an empty result; other columns are ignored.
    """
    known = cut(features(docs, carried))
    lines = known.select("row", "host", "doc_id", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row", "host", "doc_id", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    common = _frequent(lines, known, max_docs)
    hashes = [F.collect_list("line").alias("removed_lines")] if removed else []
    lost = salted_join(lines, common, ["host", "line"], "row").groupBy("row").agg(F.sum("words").alias("n_removed"), *hashes)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = known.drop("lines", "line_words", "copy").join(lost, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long"))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed") >= keep_share * F.col("n_words")))


def without_lines(text: str | None, gone: list[int] | None) -> str | None:
    """text without its lines whose hashes are in gone; the other lines stay as they are."""
    if text is None or not gone:
        return text
    out = set(gone)
    return "\n".join(x for x in text.split("\n") if not (own := x.encode("utf-8", "replace").split()) or _line_hash(own) not in out)


def apply(docs: DataFrame, **limits: int | float) -> DataFrame:
    """The rows of docs that judge() keeps, their texts without the lines above its limits, and n_chars where docs has it and lines went."""

    @F.arrow_udf("string")
    def stripped(texts: pa.Array, gone: pa.Array) -> pa.Array:
        return pa.array((without_lines(t.as_py(), g.as_py()) for t, g in zip(texts, gone, strict=True)), pa.string())

    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    judged = judge(docs.withColumn("_text_key", key), carried="_text_key", removed=True, **limits)
    facts = cut(judged.where("not kept or removed_lines is not null").select(F.col("doc_id").alias("_doc"), F.col("host").alias("_host"), F.col("_text_key").alias("_key"), F.col("kept").alias("_kept"), F.when(F.col("kept"), F.array_sort("removed_lines")).alias("_gone")).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("_host")) & (key == F.col("_key"))
    left = docs.join(checked(facts, bytes_of(facts), 1), same, "left").where("_kept is null or _kept")
    cleaned = left.withColumn("_new", F.when(F.col("_gone").isNotNull(), stripped(F.col("text").cast("string"), F.col("_gone"))))
    made = {"text": F.coalesce("_new", "text"), "n_chars": F.coalesce(F.length("_new").cast("long"), "n_chars") if "n_chars" in docs.columns else None}
    return cleaned.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])
