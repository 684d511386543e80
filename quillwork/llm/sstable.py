"""Token ids as sorted-string tables: shards of prefix-compressed blocks with a sparse index, a Bloom filter and a footer.

A file is a run of blocks, then the index, then the Bloom filter, then the footer. A key is nine bytes that sort as
doc_ids do (null first). An entry of a block is three variable-length integers (bytes shared with the key before, bytes
not shared, number of ids), the rest of the key and the ids; blocks are compressed. The index has for each block its
last key, place, lengths, checksum, and how many documents and ids come before it. A lookup asks the filter, searches the
index by bisection and reads one block.
"""

from __future__ import annotations

import bisect
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.llm._common import cut, ranged, running, shared_dir, tidied
from quillwork.llm.tokens import encoded, id_type

MAGIC = b"QWSST001"
FOOTER = struct.Struct("<QQQQQQIB8s")
INDEX = struct.Struct("<9sQIIIQQ")
BLOCK = 1 << 16
BITS, HASHES = 10, 7


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; a plain path is a local one."""
    return pafs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (pafs.LocalFileSystem(), uri)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """Takes (doc_id, ids) in key order; ids are bytes of width-byte little-endian integers."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.at = out.write(MAGIC) and len(MAGIC)
        self.block, self.size, self.last = [], 0, b""
        self.index, self.keys = [], []
        self.first = b""
        self.docs = self.ids = self.docs_before = self.ids_before = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = key_of(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must not fall")
        shared = 0
        while shared < 9 and self.block and self.last[shared] == key[shared]:
            shared += 1
        n = len(ids) // self.width
        entry = _varint(shared) + _varint(9 - shared) + _varint(n) + key[shared:]
        self.block += [entry, ids]
        self.size += len(entry) + len(ids)
        self.last, self.first = key, self.first or key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.docs += 1
        self.ids += n
        if self.size >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.block)
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.index.append(INDEX.pack(self.last, self.at, len(packed), len(raw), zlib.crc32(packed), self.docs_before, self.ids_before))
        self.at += len(packed)
        self.block, self.size, self.docs_before, self.ids_before = [], 0, self.docs, self.ids

    def close(self) -> None:
        if self.block:
            self._flush()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * BITS + 7 & ~7)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        packed = bytes(bloom)
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.docs, self.ids, zlib.crc32(index + packed), self.width, MAGIC))


class Reader:
    """A file of Writer; f is a seekable binary file."""

    def __init__(self, f) -> None:
        self.f = f
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - FOOTER.size)
        at, n, bloom_at, bloom_n, self.docs, self.n_ids, crc, self.width, magic = FOOTER.unpack(f.read(FOOTER.size))
        f.seek(at)
        raw = f.read(n + bloom_n)
        if magic != MAGIC or zlib.crc32(raw) != crc:
            raise ValueError("not a whole sorted-string table")
        self.blocks = list(INDEX.iter_unpack(raw[:n]))
        self.last = [b[0] for b in self.blocks]
        self.bloom, self.bits = raw[n:], 8 * bloom_n
        self.dtype, self.unpack = f"<u{self.width}", zstandard.ZstdDecompressor()

    def block(self, i: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids of the file before it, ids) for the entries of block i."""
        _, at, n, full, crc, _, start = self.blocks[i]
        self.f.seek(at)
        packed = self.f.read(n)
        if zlib.crc32(packed) != crc:
            raise ValueError(f"block {i} is damaged")
        raw, pos, key = self.unpack.decompress(packed, max_output_size=full), 0, b""
        while pos < len(raw):
            shared, pos = _read_varint(raw, pos)
            rest, pos = _read_varint(raw, pos)
            count, pos = _read_varint(raw, pos)
            key = key[:shared] + raw[pos : pos + rest]
            pos += rest
            yield key, start, np.frombuffer(raw, self.dtype, count, pos)
            pos += count * self.width
            start += count

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of this doc_id; none if there is none."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        found = []
        for i in range(bisect.bisect_left(self.last, key), len(self.blocks)):
            found += [ids.copy() for k, _, ids in self.block(i) if k == key]
            if self.last[i] > key:
                break
        return found

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for i in range(len(self.blocks)):
            for key, start, ids in self.block(i):
                yield id_of(key), start, ids


def _limits(docs: DataFrame, shard_bytes: int) -> list[tuple[int, int, int]]:
    """The (known, key, row number) at which each shard but the first begins, as sums of text bytes in that order pass multiples of shard_bytes."""
    sized = cut(docs.select(*_order(), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("size")))  # texts are read once for it
    order = list(ORDER)
    at = running(ranged(sized, *order), [], order, {"before": "size"})
    crossed = at.where(F.expr(f"(before + size) div {shard_bytes} > before div {shard_bytes}"))
    return [tuple(x) for x in crossed.select(*order).orderBy(*order).collect()]  # a row for each shard


ORDER = ("known", "key", "row")


def _order() -> list[F.Column]:
    """What rows are ordered by: doc_id, null first, then the row's number in the table. Rows of one doc_id, or none, can thus lie in several shards."""
    return [F.col("doc_id").isNotNull().cast("long").alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), F.monotonically_increasing_id().alias("row")]


def write_tables(docs: DataFrame, folder: str, path: str, end_id: int = 0, shard_bytes: int = 64 << 20) -> DataFrame:
    """Write docs' ids into files below folder in ascending doc_id order; (shard, file, docs, ids, first, last) for each file, first and last being its least and greatest key as hexadecimal digits.

    path is a file of the tokenizers library; end_id follows the ids of each text. Shards are cut where the sum of text
    bytes passes a multiple of shard_bytes, so a shard has that many bytes and less than one document more, however
    many rows have one doc_id; the driver and the tasks hold one limit for each. Each file is written under a name of its
    own and then renamed, so a task that runs again leaves a whole file. A null text is empty; a null doc_id comes
    first; rows of one doc_id are in the order of the table, each with an entry; a text of
    any length is one entry. An empty table makes no file; other columns are ignored.
    """
    spark = docs.sparkSession
    limits = spark.sparkContext.broadcast(_limits(docs, shard_bytes))  # 24 bytes for each shard_bytes of text
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(limits.value) + 1)
    item = id_type(path)

    def deal(batch: pa.RecordBatch) -> list[int]:
        at = limits.value
        return [bisect.bisect_left(at, k) for k in zip(*[c.to_pylist() for c in batch.columns], strict=True)]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        now = temp = out = sink = None
        made = []

        def end() -> None:
            out.close()
            sink.close()
            name = f"shard-{now:08d}.sst"
            fs.move(temp, posixpath.join(root, name))
            made.append((now, posixpath.join(folder, name), out.docs, out.ids, out.first.hex(), out.last.hex()))

        for b in batches:
            for shard, known, key, ids in zip(*[b.column(c).to_pylist() for c in ("shard", "known", "key")], b.column("ids"), strict=True):
                if shard != now:
                    if out:
                        end()
                    parts = posixpath.join(root, "unfinished")
                    fs.create_dir(parts, recursive=True)
                    now, temp = shard, posixpath.join(parts, uuid.uuid4().hex)
                    sink = fs.open_output_stream(temp)
                    out = Writer(sink, item.itemsize)
                out.add(key if known else None, ids.as_py())
        if out:
            end()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["shard", "file", "docs", "ids", "first", "last"])

    *keys, row = _order()
    known = encoded(docs.select("doc_id", "text", *keys, row.alias("place")), path, end_id, packed=False, dealt=("known key place", deal))
    dealt = known.select(F.col("to").alias("shard"), "known", "key", F.col("place").alias("row"), "ids").repartitionById(n, F.col("shard"))
    files = cut(dealt.sortWithinPartitions("shard", *ORDER).mapInArrow(tidied(write), "shard int, file string, docs long, ids long, first string, last string"))
    fs, root = file_system(folder)
    if fs.get_file_info(posixpath.join(root, "unfinished")).type.name != "NotFound":
        fs.delete_dir(posixpath.join(root, "unfinished"))  # what lost tasks have left
    return files


def read_tables(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) for every document of write_tables()' files, from the files; start counts the ids of all documents before it."""
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    at = files.select("shard", "file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "file"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            for _, file, base in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                fs, name = file_system(file)
                with fs.open_input_file(name) as f:
                    rows = []
                    for doc_id, start, ids in Reader(f).scan():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4")), file))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return at.repartition(n, "shard").mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def lookup(files: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of every document of this doc_id: only files whose keys enclose it are opened, and in each the filter, the index and one block are read."""
    key = key_of(doc_id).hex()
    found = []
    for x in files.where((F.col("first") <= key) & (F.col("last") >= key)).orderBy("shard").select("file").toLocalIterator():
        fs, name = file_system(x.file)
        with fs.open_input_file(name) as f:
            found += Reader(f).get(doc_id)
    return found


def fresh_folder(spark) -> str:
    return posixpath.join(shared_dir(spark), f"sst-{uuid.uuid4().hex}")
