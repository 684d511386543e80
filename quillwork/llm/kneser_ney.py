"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted arrays that workers map into memory.

Three tables, each in blocks that one task makes and one file holds:
 vocabulary  word hashes in order with their counts; a word's number is its place among all blocks
 pairs       (number before << 32 | number) in order with counts, and for each word before: its total, and how many
             of its followers occur once, twice, more often
 follows     for each number, how many different words stand before it
Tasks send counts as sorted packed arrays, one for each block, made from millions of words each, so a word that makes up
a third of a corpus is a few entries in each array. Discounts come from the counts of counts, eight sums.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm._common import cut, shared_dir, shuffle_width, tidied
from quillwork.llm.sstable import file_system

CHUNK_WORDS, BLOCK_BYTES = 1_500_000, 24 << 20
#: The end of a text: no word is empty.
END = np.uint64(xxhash.xxh3_64_intdigest(b""))


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words in lower case (A to Z), then of the end."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    return np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), END)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    raw = len(keys).to_bytes(8, "little") + np.diff(keys, prepend=np.uint64(0)).tobytes() + counts.astype(np.uint64).astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    width = (len(raw) - 8 - 8 * n) // max(n, 1)
    return np.cumsum(np.frombuffer(raw, np.uint64, n, 8), dtype=np.uint64), np.frombuffer(raw, np.uint32 if width == 4 else np.uint64, n, 8 + 8 * n).astype(np.uint64)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _merged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    got = [_unpack(p) for p in parts]
    return _sums(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))


def _dealt(keys: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(block, packed) for each block that sorted keys have part in; edges are the first keys of blocks 1, 2, ..."""
    at = [0, *np.searchsorted(keys, edges), len(keys)]
    for b, (s, e) in enumerate(zip(at, at[1:], strict=False)):
        if e > s:
            yield b, _pack(keys[s:e], counts[s:e])


def _batches(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 32):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 32], strict=True), types, strict=True)], names=names)


_PART = ("block int, data binary", ["block", "data"], [pa.int32(), pa.binary()])


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(block, its parts) from rows sorted by block."""
    now, parts = None, []
    for b in batches:
        for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if block != now and parts:
                yield now, parts
                parts = []
            now = block
            parts.append(data.as_py())
    if parts:
        yield now, parts


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under a name of its own, then rename it: a task that runs again leaves a whole file."""
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    temp = posixpath.join(root, f".{uuid.uuid4().hex}")
    with fs.open_output_stream(temp) as f:
        f.write(np.ascontiguousarray(array).data)
    fs.move(temp, posixpath.join(root, name))


_local: dict[str, str] = {}


def _load(folder: str, name: str, kind: str) -> np.ndarray:
    """A saved array, mapped into memory; from a store without local paths it is first copied to the worker's own folder, once."""
    fs, root = file_system(folder)
    path = posixpath.join(root, name)
    if fs.type_name != "local":
        key = posixpath.join(folder, name)
        if key not in _local:
            import shutil
            import tempfile

            handle, _local[key] = tempfile.mkstemp(prefix="quillwork-")
            with os.fdopen(handle, "wb") as to, fs.open_input_stream(path) as f:
                shutil.copyfileobj(f, to)
        path = _local[key]
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts of one, two and more, from how many entries occur once, twice, three and four times; half the count where the sample is too small to tell."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3.0)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))  # type: ignore[return-value]


@dataclass
class Model:
    """What the driver knows of a trained model: where its files are, how the blocks divide the numbers, and sums."""

    folder: str
    blocks: int
    starts: list[int]  # first number of each block, and the number of words
    n_tokens: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    pair_types: int
    word_types: tuple[int, int, int]

    @property
    def n_words(self) -> int:
        return self.starts[-1]


class Files:
    """A worker's view of a model's files."""

    def __init__(self, model: Model) -> None:
        self.m, self.edges = model, _hash_edges(model.blocks)
        self.starts = np.array(model.starts, np.int64)
        self.open: dict[tuple[str, int], np.ndarray] = {}

    def get(self, name: str, block: int, kind: str) -> np.ndarray:
        if (name, block) not in self.open:
            self.open[name, block] = _load(self.m.folder, f"{name}-{block:06d}", kind)
        return self.open[name, block]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of sorted word hashes; number -1 and count 0 for a word that isn't known."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        at = [0, *np.searchsorted(hashes, self.edges), len(hashes)]
        for b, (s, e) in enumerate(zip(at, at[1:], strict=False)):
            if e > s and self.starts[b + 1] > self.starts[b]:
                known = self.get("word", b, "<u8")
                i = np.minimum(np.searchsorted(known, hashes[s:e]), len(known) - 1)
                hit = known[i] == hashes[s:e]
                number[s:e][hit] = self.starts[b] + i[hit]
                count[s:e][hit] = self.get("count", b, "<u8")[i[hit]]
        return number, count

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """(count, total, once, twice, more) for sorted pairs; the last four belong to the word before, total 0 where nothing followed it."""
        out = np.zeros((5, len(keys)), np.int64)
        if not self.m.pair_types:
            return tuple(out)
        at = [0, *np.searchsorted(keys, _pair_edges(self.m.starts)), len(keys)]
        for b, (s, e) in enumerate(zip(at, at[1:], strict=False)):
            if e <= s:
                continue
            known = self.get("pair", b, "<u8")
            if not len(known):
                continue
            k = keys[s:e]
            i = np.minimum(np.searchsorted(known, k), len(known) - 1)
            hit = known[i] == k
            out[0, s:e][hit] = self.get("pair_count", b, "<u4")[i[hit]]
            before = self.get("before", b, "<u4")
            j = np.minimum(np.searchsorted(before, (k >> np.uint64(32)).astype(np.uint32)), len(before) - 1)
            hit = before[j] == (k >> np.uint64(32))
            out[1:, s:e][:, hit] = self.get("after", b, "<u8").reshape(-1, 4)[j[hit]].T
        return tuple(out)

    def follows(self, numbers: np.ndarray) -> np.ndarray:
        """How many different words stand before each of sorted numbers."""
        out = np.zeros(len(numbers), np.int64)
        at = np.searchsorted(numbers, self.starts)
        for b, (s, e) in enumerate(zip(at, at[1:], strict=False)):
            if e > s:
                out[s:e] = self.get("follow", b, "<u4")[numbers[s:e] - self.starts[b]]
        return out


def _hash_edges(blocks: int) -> np.ndarray:
    return np.array([(b << 64) // blocks for b in range(1, blocks)], np.uint64)


def _pair_edges(starts: list[int]) -> np.ndarray:
    """Pairs are in the block of the word before; the start of a text (number n_words) in the last."""
    return np.array(starts[1:-1], np.uint64) << np.uint64(32)


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(rows, token hashes, tokens of each row) for runs of about CHUNK_WORDS tokens; rows are the other columns' values."""
    rows, parts, total = [], [], 0
    for b in batches:
        others = [b.column(k).to_pylist() for k in range(b.num_columns) if k != column]
        for i, t in enumerate(b.column(column)):
            rows.append(tuple(c[i] for c in others))
            parts.append(tokens(t.as_py()))
            total += len(parts[-1])
            if total >= CHUNK_WORDS:
                yield rows, np.concatenate(parts), np.array([len(p) for p in parts])
                rows, parts, total = [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.array([len(p) for p in parts])


def _pair_keys(number: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """Pairs of each token with the one before it, or the start; both numbers must be known."""
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[np.cumsum(lengths) - lengths] = start
    return (before.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)


def train(texts: DataFrame, folder: str | None = None) -> Model:
    """Count the column text of texts (null: empty) and write the model's files below folder (by default a new one in the shared folder). Nothing is pruned."""
    spark = texts.sparkSession
    folder = folder or posixpath.join(shared_dir(spark), f"lm-{uuid.uuid4().hex}")
    texts = texts.select(F.col("text").cast("string").alias("text"))
    n_bytes = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(shuffle_width(spark), n_bytes // BLOCK_BYTES)
    sql, names, types = _PART

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, _ in _chunks(batches, 0):
            yield from _batches(list(_dealt(*np.unique(h, return_counts=True), _hash_edges(blocks))), names, types)

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _blocks_of(batches):
            keys, counts = _merged(parts)
            _save(folder, f"word-{block:06d}", keys)
            _save(folder, f"count-{block:06d}", counts)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["block", "n", "total"])

    gather = lambda df: df.repartition(blocks, "block").sortWithinPartitions("block")
    sizes = {r.block: r for r in cut(gather(texts.mapInArrow(tidied(words), sql)).mapInArrow(tidied(vocabulary), "block int, n long, total long")).collect()}  # a row for each file
    starts = np.cumsum([0, *[sizes[b].n if b in sizes else 0 for b in range(blocks)]]).tolist()
    if starts[-1] >= (1 << 32) - 1:
        raise ValueError("numbers of words have 32 bits")
    model = Model(folder, blocks, starts, sum(r.total for r in sizes.values()), (0, 0, 0), (0, 0, 0), 0, (0, 0, 0))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(model)
        for _, h, lengths in _chunks(batches, 0):
            distinct, place = np.unique(h, return_inverse=True)
            number = files.numbers(distinct)[0][place]
            yield from _batches(list(_dealt(*np.unique(_pair_keys(number, lengths, model.n_words), return_counts=True), _pair_edges(starts))), names, types)

    def pair_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _blocks_of(batches):
            keys, counts = _merged(parts)
            before = (keys >> np.uint64(32)).astype(np.uint32)
            first = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
            after = np.stack([np.add.reduceat(x.astype(np.uint64), first) for x in (counts, counts == 1, counts == 2, counts > 2)], 1)
            for name, array in (("pair", keys), ("pair_count", counts.astype(np.uint32)), ("before", before[first]), ("after", after)):
                _save(folder, f"{name}-{block:06d}", array)
            sums = [int((counts == k).sum()) for k in range(1, 5)] + [len(keys)]
            number, n = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
            rows = [(b, data, None) for b, data in _dealt(number, n, np.array(starts[1:-1], np.uint64))]
            for i in range(0, len(rows) + 1, 32):
                own = rows[i : i + 32] + ([(-1, None, sums)] if i + 32 > len(rows) else [])
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True), [*types, pa.list_(pa.int64())], strict=True)], names=[*names, "sums"])

    counted = cut(gather(texts.mapInArrow(tidied(pairs), sql)).mapInArrow(tidied(pair_table), "block int, data binary, sums array<long>"))
    add = lambda df, k: [df.agg(*[F.sum(F.element_at("sums", i + 1)) for i in range(k)]).first()[i] or 0 for i in range(k)]
    of_pairs = add(counted.where("block < 0"), 5)

    def follow_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _blocks_of(batches):
            number, n = _merged(parts)
            dense = np.zeros(starts[block + 1] - starts[block], np.uint32)
            dense[number.astype(np.int64) - starts[block]] = n
            _save(folder, f"follow-{block:06d}", dense)
            sums = [int((dense == k).sum()) for k in range(1, 5)] + [int((dense > 2).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.int64()))], names=["sums"])

    of_words = add(cut(gather(counted.where("block >= 0").select("block", "data")).mapInArrow(tidied(follow_table), "sums array<long>")), 5)
    model.pair_discounts, model.pair_types = _discounts(of_pairs[:4]), of_pairs[4]
    model.word_discounts, model.word_types = _discounts(of_words[:4]), (of_words[0], of_words[1], of_words[4])
    return model


def _discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3)], 0.0)


def score(docs: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """The columns `carried` (longs) of docs, n_tokens, n_known, base_score and score for every row.

    base_score is the add-0.1 unigram log10 probability, score the model's: P(w|v) = (c(vw) - D) / c(v.) + g(v) P(w), and
    P(w) is (n(.w) - d) / n(..) plus what the discounts leave, spread evenly over the known words and one unknown.
    """
    names = [*carried, "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(model)
        v, n = model.n_words, model.n_tokens
        left = sum(x * d for x, d in zip(model.word_types, model.word_discounts, strict=True))
        d1, d2, d3 = model.pair_discounts
        for rows, h, lengths in _chunks(batches, len(carried)):
            distinct, place = np.unique(h, return_inverse=True)
            number, count = files.numbers(distinct)
            base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
            # Words of one number each, in order of number, for the files of what they follow.
            order = np.argsort(number, kind="stable")
            known = order[np.searchsorted(number[order], 0) :]
            alone = np.full(len(distinct), (left / model.pair_types if model.pair_types else 1.0) / (v + 1))
            if model.pair_types:
                alone[known] += _discounted(files.follows(number[known]), model.word_discounts) / model.pair_types
            # Numbers beyond the start stand for unknown words: no file has them.
            number = np.where(number < 0, v + 1, number)[place]
            keys, at = np.unique(_pair_keys(number, lengths, v), return_inverse=True)
            c, total, once, twice, more = files.pairs(keys)
            seen = total > 0
            safe = np.where(seen, total, 1)
            first = _discounted(c, model.pair_discounts) / safe
            rest = np.where(seen, (d1 * once + d2 * twice + d3 * more) / safe, 1.0)
            p = np.log10(first[at] + rest[at] * alone[place])
            starts = np.cumsum(lengths) - lengths
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            sums = [pa.array(np.add.reduceat(x, starts)) for x in ((count > 0).astype(np.int64)[place], base[place], p)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lengths.astype(np.int64)), *sums], names=names)

    sql = ", ".join(f"{c} long" for c in names[:-2]) + ", base_score double, score double"
    return docs.select(*carried, F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), sql)


def held_out(tenth: int = 10) -> F.Column:
    """Whether a row's doc_id, as text (null: empty), has a checksum divisible by tenth."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % tenth == 0


def train_and_score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs, by a model of the rows that aren't held out.

    A null or empty text is one token, the end. Repeated rows train and are scored each. Without training rows every
    word is unknown. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().cast("long").alias("out"), "text")
    model = train(rows.where("out = 0"))
    done = score(rows, model, ["doc_id", "out"])
    return done.select("doc_id", (F.col("out") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def fresh_folder(spark: SparkSession) -> str:
    return posixpath.join(shared_dir(spark), f"lm-{uuid.uuid4().hex}")
