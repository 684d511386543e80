"""Substring deduplication by relative Lempel-Ziv parsing against an index in blocks.

The index holds, for every phrase of `length` words in the corpus, where it starts first; its blocks are ranges of the
phrase's hash, each built and searched by one task. Documents are sent to all blocks at once: every phrase of a document
goes to the one block that can hold it, as part of a sorted, packed array that a task makes from millions of words.
The answers come back to the document, which is parsed greedily: a factor starts at the first word whose phrase has an
earlier start elsewhere and goes on while the next phrase's answer moves on with it. Phrases across a factor's boundary
are phrases of the index as well and are looked up like any other, so no repeat is missed where two sources meet.
Factors are at least `length` words long; the words they cover are the duplicate spans.

The index knows phrases by 64-bit hashes, so each factor is checked in the end: a digest of its words goes to the document
that it is said to repeat, and is compared with that of the words there. Where they differ, the factor's phrases are
compared one by one, and those that differ repeat nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import WORD, checked, cut, shuffle_width, tidied

#: Words whose phrases a task sorts and packs together, and bytes of text for each block of the index: about 100 bytes of
#: a worker's memory for each word. With more memory and a larger corpus both should grow, as the parts of the index
#: that a task makes, one for each block, are best when they hold hundreds of phrases.
CHUNK_WORDS, BLOCK_BYTES = 1_000_000, 8 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWEST = -(1 << 63)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, byte by byte of like weight, compressed."""
    raw = b"".join([len(columns).to_bytes(1, "little"), *[c.dtype.char.encode() + len(c).to_bytes(8, "little") + np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 1, []
    for _ in range(raw[0]):
        kind, n = np.dtype(chr(raw[at])), int.from_bytes(raw[at + 1 : at + 9], "little")
        at += 9
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        at += size
    return out


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "replace").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def phrase_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of length words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(length):
        h *= BASE
        h += words[j : j + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _answers(doc: np.ndarray, tie: np.ndarray, at: np.ndarray, pos: np.ndarray, ref_doc: np.ndarray, ref_pos: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """(to, answers): packed phrases at word pos of document `at` that start earlier at (ref_doc, ref_pos), for the tasks that gather each document's."""
    if not len(at):
        return
    to = ((doc.view(np.uint64) * BASE >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)[at]
    order = np.lexsort((pos, at, to))
    at, pos, ref_doc, ref_pos, to = at[order], pos[order], ref_doc[order], ref_pos[order], to[order]
    edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
    for s, e in zip(edges, edges[1:], strict=False):
        used, n = np.unique(at[s:e], return_counts=True)
        yield int(to[s]), _pack(doc[used], tie[used], n.astype(np.uint32), pos[s:e].astype(np.uint32), ref_pos[s:e].astype(np.uint32), ref_doc[s:e])


#: Parts of the index go to the block they belong to; answers, marked by block -1, to the task that gathers them.
KIND = "block int, to int, data binary"


def _rows(made: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(made), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[i : i + 64], strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "to", "data"])


def _phrases(blocks: int, length: int):
    """Texts to packed parts of the index, one for each block, and answers for what repeats within a task's chunk.

    Only the first start of a phrase in a chunk goes to the index: a phrase that a third of all documents hold adds one
    entry for each chunk to its block, not one for each document.
    """

    def chunk(docs: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = sorted(docs)
        words = [docs[k] for k in keys]
        n = np.array([len(w) for w in words], np.int64)
        doc, tie = np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)
        at = np.repeat(np.arange(len(keys)), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h = phrase_hashes(np.concatenate(words), length)
        whole = (np.repeat(n, n) - pos >= length)[: len(h)]
        h, at, pos = h[whole], at[: len(whole)][whole], pos[: len(whole)][whole]
        order = np.argsort(h, kind="stable")  # within a phrase by document and word, as texts are in order
        h, at, pos = h[order], at[order], pos[order]
        first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else np.zeros(0, np.int64)
        again = ~first
        yield from _rows([(-1, to, data) for to, data in _answers(doc, tie, at[again], pos[again], doc[at[lead[again]]], pos[lead[again]], blocks)])
        starts = np.cumsum(n) - n
        h, place = h[first], (starts[at] + pos)[first].astype(np.uint32)
        edges = np.searchsorted(h >> np.uint64(32), [(b << 32) // blocks for b in range(1, blocks)])
        for b, (s, e) in enumerate(zip([0, *edges], [*edges, len(h)], strict=True)):
            if e > s:
                used, of = np.unique(np.searchsorted(starts, place[s:e], side="right") - 1, return_inverse=True)
                shift = starts[used] - np.cumsum(np.r_[0, n[used][:-1]])  # the words of unused documents fall out
                yield from _rows([(b, b, _pack(doc[used], tie[used], n[used].astype(np.uint32), np.diff(h[s:e], prepend=np.uint64(0)), (place[s:e] - shift[of]).astype(np.uint32)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[tuple[int, int], np.ndarray] = {}
        total = 0
        for b in batches:
            for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = word_hashes(text.as_py() or "")
                if len(words) >= length and (d, t) not in docs:
                    docs[d, t] = words
                    total += len(words)
                if total >= CHUNK_WORDS:
                    yield from chunk(docs)
                    docs, total = {}, 0
        if docs:
            yield from chunk(docs)

    return run


def _search(blocks: int):
    """Blocks of the index, each as the run of its parts, to answers; answers pass through."""

    def block(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = [_unpack(p) for p in parts]
        doc, tie, n = (np.concatenate([g[k] for g in got]) for k in range(3))
        starts, words, place, h = np.cumsum(n, dtype=np.int64) - n, 0, [], []
        for g in got:
            place.append(g[4].astype(np.int64) + words)
            h.append(np.cumsum(g[3], dtype=np.uint64))
            words += int(g[2].sum(dtype=np.int64))
        del got
        h, place = np.concatenate(h), np.concatenate(place)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        member = order[np.r_[False, same] | np.r_[same, False]] if len(h) else order
        h, place = h[member], place[member]
        if not len(h):
            return
        at = np.searchsorted(starts, place, side="right") - 1
        pos = place - starts[at]
        # A document has parts from one chunk, or from several where its row repeats: then they have one rank.
        by = np.lexsort((tie, doc))
        new = np.r_[True, (doc[by][1:] != doc[by][:-1]) | (tie[by][1:] != tie[by][:-1])]
        rank = np.empty(len(doc), np.int64)
        rank[by] = np.cumsum(new)
        rank = rank[at]
        order = np.lexsort((pos, rank, h))
        h, at, pos, rank = h[order], at[order], pos[order], rank[order]
        first = np.r_[True, h[1:] != h[:-1]]
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        again = ~first & ((rank != rank[lead]) | (pos != pos[lead]))
        yield from _rows([(-1, to, data) for to, data in _answers(doc, tie, at[again], pos[again], doc[at[lead[again]]], pos[lead[again]], blocks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for own, to, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if own < 0:
                    yield from _rows([(-1, to, data.as_py())])
                    continue
                if own != now and parts:
                    yield from block(parts)
                    parts = []
                now = own
                parts.append(data.as_py())
        if parts:
            yield from block(parts)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of all blocks to one row for each document: word numbers, earlier words, earlier documents."""
    got = [_unpack(x.as_py()) for b in batches for x in b.column(2)]
    if not got:
        return
    n = np.concatenate([g[2] for g in got])
    doc, tie = (np.repeat(np.concatenate([g[k] for g in got]), n) for k in (0, 1))
    pos, ref_pos, ref_doc = (np.concatenate([g[k] for g in got]) for k in (3, 4, 5))
    order = np.lexsort((pos, tie, doc))
    doc, tie, pos, ref_pos, ref_doc = doc[order], tie[order], pos[order], ref_pos[order], ref_doc[order]
    edges = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]), True])
    for i in range(0, len(edges) - 1, 500):
        own = list(zip(edges[i : i + 501], edges[i + 1 : i + 501], strict=False))
        first = [s for s, _ in own]
        yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(tie[first]), pa.array([_pack(pos[s:e], ref_pos[s:e], ref_doc[s:e]) for s, e in own], pa.binary())], names=["doc", "tie", "data"])


def repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """(doc, tie, data) for documents with phrases that also start earlier: packed word numbers and earlier starts. doc is the doc_id (the lowest long for null), tie a 64-bit hash of the text that tells rows of one doc_id apart."""
    spark = docs.sparkSession
    n_bytes = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(shuffle_width(spark), n_bytes // BLOCK_BYTES)
    texts = docs.select(_doc(), _tie(), F.col("text").cast("string").alias("text"))
    parts = texts.mapInArrow(tidied(_phrases(blocks, length)), KIND)
    answers = parts.repartitionById(blocks, F.col("to")).sortWithinPartitions("block").mapInArrow(tidied(_search(blocks)), KIND)
    return cut(answers.repartitionById(blocks, F.col("to")).mapInArrow(tidied(_gather), "doc long, tie long, data binary"))


def _doc() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc")


def _tie() -> F.Column:
    return F.xxhash64(F.col("text").cast("string")).alias("tie")


def factors(data: bytes, length: int, unequal: set[tuple[int, int]] = frozenset(), own: int = 0) -> list[tuple[int, int, int, int]]:
    """The greedy parse: (first word, number of words, document and first word of the earlier start), in order. unequal has the (tie, word) of phrases that are no repeats; own is the document's tie."""
    pos, ref_pos, ref_doc = (c.astype(np.int64) for c in _unpack(data))
    # A phrase may have an answer from its own chunk and one from the index; either is earlier.
    order = np.lexsort((ref_pos, ref_doc, pos))
    pos, ref_pos, ref_doc = pos[order], ref_pos[order], ref_doc[order]
    keep = np.r_[True, pos[1:] != pos[:-1]]
    if unequal:
        keep &= np.array([(own, p) not in unequal for p in pos.tolist()])
    pos, ref_pos, ref_doc = pos[keep], ref_pos[keep], ref_doc[keep]
    if not len(pos):
        return []
    broken = np.r_[True, (np.diff(pos) != 1) | (np.diff(ref_pos) != 1) | (np.diff(ref_doc) != 0)]
    at = np.flatnonzero(broken)
    ends = np.r_[at[1:], len(pos)] - 1
    return [(int(pos[s]), int(pos[e] - pos[s] + length), int(ref_doc[s]), int(ref_pos[s])) for s, e in zip(at, ends, strict=True)]


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


#: Spans compared in one row.
SPANS = 4096


def _unequal(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Those of spans (ref_doc, ref_word, words, digest) that no document of that id has: their words are others."""
    asked = cut(spans.distinct())
    listed = cut(asked.groupBy("ref_doc", F.pmod(F.xxhash64("ref_word", "words"), F.lit(64)).alias("part")).agg(F.collect_set(F.struct("ref_word", "words")).alias("spans")))
    n = listed.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for b in batches:
            for i in range(b.num_rows):
                text, doc = b.column(0)[i].as_py() or "", b.column(1)[i].as_py()
                if text is not last:
                    last, own = text, text.encode("utf-8", "replace").split()
                found = [(x["ref_word"], x["words"]) for x in b.column(2)[i].as_py()]
                for k in range(0, len(found), SPANS):
                    some = found[k : k + SPANS]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(some)), pa.array([w for w, _ in some]), pa.array([m for _, m in some]), pa.array([digest(own[w : w + m]) for w, m in some], pa.binary())], names=["ref_doc", "ref_word", "words", "digest"])

    texts = docs.select(_doc().alias("ref_doc"), F.col("text").cast("string").alias("text"))
    wanted = texts.join(checked(listed.select("ref_doc").distinct(), n), "ref_doc", "left_semi")
    theirs = wanted.join(checked(listed, n, 4096), "ref_doc").select("text", "ref_doc", "spans").mapInArrow(tidied(run), "ref_doc long, ref_word long, words long, digest binary")
    return cut(asked.join(theirs, ["ref_doc", "ref_word", "words", "digest"], "left_anti"))


_WORD = re.compile(WORD)


def without(text: str, gone: np.ndarray) -> str:
    """text without the words marked in gone; white space before a dropped word goes with it."""
    out, last = [], 0
    for m, g in zip(_WORD.finditer(text), gone, strict=True):
        if not g:
            out.append(text[last : m.end()])
        last = m.end()
    return "".join(out).lstrip() if gone[0] else "".join(out)


def deduplicate(docs: DataFrame, length: int = 20, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors for every row of docs; with texts also all columns of docs, text without what was removed.

    A word is removed if a run of length words that covers it also starts earlier: in a smaller doc_id, or earlier in
    the same document. All runs are judged on the input. factors is the parse: word, words, earlier doc_id and word. A
    null text has no words. Rows of one doc_id are told apart by their texts, in the order of a hash; rows alike in both
    are one document and get the same result each. A null doc_id comes first. A text of any length is read whole. An
    empty table gives an empty result.
    """
    found = repeats(docs, length)
    carried = docs.columns if texts else ["doc_id"]
    rows = docs.select(_doc(), _tie(), F.col("text").cast("string").alias("_text"), F.struct(*[F.col(c) for c in carried if c != "text"]).alias("_row"))
    joined = rows.join(found, ["doc", "tie"], "left").select("_row", "_text", "data", "tie")
    row_type = joined.schema["_row"].dataType.simpleString()
    names = ["_row", "n_words", "n_removed", "kept_sha256", "factors", "tie", *(["_text"] if texts else [])]
    span = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("ref_doc_id", pa.int64()), ("ref_word", pa.int64()), ("digest", pa.binary())]))
    kind = f"_row {row_type}, n_words long, n_removed long, kept_sha256 string, factors array<struct<word:long,words:long,ref_doc_id:long,ref_word:long,digest:binary>>, tie long" + (", _text string" if texts else "")

    def parsed(unequal: set[tuple[int, int]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[] for _ in names[1:]]
                for text, data, tie in zip(b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                    text = text.as_py()
                    words = (text or "").encode("utf-8", "replace").split()
                    found = factors(data.as_py(), length, unequal, tie) if data.is_valid else []
                    gone = np.zeros(len(words), bool)
                    for s, n, _, _ in found:
                        gone[s : s + n] = True
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words
                    spans = [{"word": s, "words": n, "ref_doc_id": d, "ref_word": p, "digest": digest(words[s : s + n])} for s, n, d, p in found]
                    for o, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), spans, tie, without(text, gone) if texts and found else text), strict=False):
                        o.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), span, pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(o, k) for o, k in zip(out, kinds, strict=False)]], names=names)

        return cut(joined.mapInArrow(tidied(run), kind))

    done = parsed(set())
    of = lambda df: df.select(F.col("f.ref_doc_id").alias("ref_doc"), F.col("f.ref_word").alias("ref_word"), F.col("f.words").alias("words"), F.col("f.digest").alias("digest"))
    wrong = _unequal(docs, of(done.select(F.explode("factors").alias("f"))))
    if not wrong.isEmpty():
        done = parsed(_collisions(docs, rows, found, wrong, length))
    factor = F.transform("factors", lambda f: F.struct(f.word.alias("word"), f.words.alias("words"), F.when(f.ref_doc_id != LOWEST, f.ref_doc_id).alias("ref_doc_id"), f.ref_word.alias("ref_word"))).alias("factors")
    if not texts:
        return done.select("_row.doc_id", "n_words", "n_removed", "kept_sha256", factor)
    return done.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns], "n_words", "n_removed", "kept_sha256", factor)


def _collisions(docs: DataFrame, rows: DataFrame, found: DataFrame, wrong: DataFrame, length: int) -> set[tuple[int, int]]:
    """The (tie, word) of the phrases of wrong factors whose words differ from those of their earlier starts: as many as there are equal hashes of different phrases, one for each 10^19 pairs."""
    spans = {(r.ref_doc, r.ref_word, r.words, bytes(r.digest)) for r in wrong.toLocalIterator()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, data, tie in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                for s, n, d, p in factors(data.as_py(), length):
                    if (d, p, n, digest(words[s : s + n])) in spans:
                        out += [(tie, s + i, d, p + i, length, digest(words[s + i : s + i + length])) for i in range(n - length + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 5, pa.binary()), strict=True)], names=["tie", "word", "ref_doc", "ref_word", "words", "digest"])

    phrases = cut(rows.join(found, ["doc", "tie"]).select("_text", "data", "tie").mapInArrow(tidied(run), "tie long, word long, ref_doc long, ref_word long, words long, digest binary"))
    unequal = _unequal(docs, phrases.select("ref_doc", "ref_word", "words", "digest"))
    return {(r.tie, r.word) for r in phrases.join(unequal, ["ref_doc", "ref_word", "words", "digest"], "left_semi").toLocalIterator()}
