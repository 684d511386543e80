"""Token ids of whole texts through the tokenizers library, each distinct piece of text encoded once."""

from __future__ import annotations

import bisect
import contextlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, filterfalse, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import tidied

#: A worker keeps the ids of at most so many units (about 300 bytes each), and of so many characters of them.
KEPT_UNITS, KEPT_CHARS = 800_000, 16_000_000
#: Rows whose texts and ids a worker holds as Python objects at once.
ROWS = 1000
#: Marks at the end of a word that both kinds of rule part from the letter before.
MARKS = ".,"
#: Units given to the library in one text; characters cut at once.
JOINED, CUT_CHARS = 16_000, 2_000_000
#: A word of its own between units where nothing else marks their ends; no text that holds it is cut.
MARK = "\x01"
#: Characters that Python and the library lower alike, and that no normal form changes: so not U+0130.
PLAIN_CASE = re.compile("[^\0-įı-ɏ]")
#: White space other than space and line feed, in the widest sense of either library.
OTHER_SPACE = re.compile("[" + "".join(map(chr, [9, 11, 12, 13, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")


def id_type(path: str) -> np.dtype:
    """The integers that hold a file's ids: two bytes if none is larger. Found without loading the tokenizer, for the driver."""
    with open(path, encoding="utf-8") as f:
        rules = f.read()
    most = max((int(m[1]) for m in re.finditer(r'(?:"id"\s*:|"\s*:)\s*(\d+)\s*[,}]', rules)), default=0)
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


class Encoder:
    """ids(texts) for one tokenizer file, equal to the library's ids with add_special_tokens=False.

    Where the file's rules never join what a space or line feed separates, texts are cut there and each distinct unit
    is given to the library once: a byte-level rule keeps white space with the word that follows, a rule that drops
    white space needs none of it. A unit that holds the string of a special token is given alone, so that it becomes
    that token's id as in the whole text. Any other file, and a text for which the cut isn't safe, is encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with contextlib.suppress(AttributeError):  # every unit is new to the library: its own cache would only cost
            model = self.tokenizer.model
            model._resize_cache(0)
            self.tokenizer.model = model
        self.dtype = id_type(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        pre = rules.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [{}])[0]
        added = rules.get("added_tokens", [])
        self.special = [t["content"] for t in added]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or " " in t["content"] or "\n" in t["content"] for t in added)
        self.units, self.unsafe, self.leads = None, None, False
        if plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not rules.get("normalizer") and not rules.get("post_processor"):
            self.units, self.unsafe, self.leads = re.compile("[ \n]*[^ \n]+|[ \n]+"), OTHER_SPACE, True
        elif plain and first.get("type") == "Split" and first.get("behavior") == "Removed" and "\\s" in str(rules.get("normalizer")) and not rules.get("post_processor"):
            self.units = re.compile("[^ \n]+")
        self.lowers = self.units is not None and not self.leads and "'Lowercase'" in str(rules.get("normalizer"))
        # Units given to the library side by side are told apart by their ids: each starts with white space, or a mark
        # that the library makes one id of stands between them.
        self.first = self.mark = None
        if self.leads:
            vocabulary = rules["model"]["vocab"]
            self.first = np.zeros(max(vocabulary.values()) + 1, bool)
            self.first[[i for t, i in vocabulary.items() if t[0] in "ĠĊ"]] = True
        elif self.units is not None:
            a, b, ab = ([*self.tokenizer.encode(t, add_special_tokens=False).ids] for t in ("ab", "ba", f"ab {MARK} ba"))
            if len(ab) == len(a) + len(b) + 1 and ab[: len(a)] == a and ab[len(a) + 1 :] == b:
                self.mark = ab[len(a)]
        # A unit of letters only, with its separator if that stays, is one word to the library's rules: such units are
        # cut by a tokenizer of the same model whose only rule is a separator, and their first or last ids tell them apart.
        self.words = self.edge = None
        suffix = rules["model"].get("end_of_word_suffix")
        if self.leads or self.lowers and suffix:
            from tokenizers import pre_tokenizers

            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\0", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = rules["model"]["vocab"]
            self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
            self.edge[[i for t, i in vocabulary.items() if (t[0] in "ĠĊ" if self.leads else t.endswith(suffix))]] = True
        self.always = {"": b"", **dict(zip(MARKS, self._whole(list(MARKS)), strict=True))}
        self.kept, self.chars, self.limit = dict(self.always), 0, KEPT_UNITS

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _side_by_side(self, run: list[str]) -> Iterator[bytes] | None:
        """The ids of each of run's units from one call; None if the ids don't tell them apart."""
        (e,) = self.tokenizer.encode_batch_fast([("" if self.leads else f" {MARK} ").join(run)], add_special_tokens=False)
        ids, width = np.array(e.ids, self.dtype), self.dtype.itemsize
        if self.leads:
            at = np.flatnonzero(self.first[ids]) * width
            starts, ends = at.tolist(), [*at[1:].tolist(), len(ids) * width]
        else:
            at = np.flatnonzero(ids == self.mark) * width
            starts, ends = [0, *(at + width).tolist()], [*at.tolist(), len(ids) * width]
        if len(starts) != len(run) or self.leads and starts[0]:
            return None
        raw = ids.tobytes()
        return (raw[s:e] for s, e in zip(starts, ends, strict=True))

    def _learn(self, missing: list[str]) -> None:
        """Keep the ids of units; of a word with a mark after it, the word is learnt apart."""
        kept = self.kept
        marked = [u for u in missing if u[-1] in MARKS and u[-2:-1].isalpha() and u[-2] < "\u0250" and u[-2] != "\u0130"]
        apart = set(marked)
        bare = [u[:-1] for u in marked]
        self._encode([u for u in set(bare).union(missing).difference(apart) if u not in kept])
        kept.update(zip(marked, [kept[w] + kept[u[-1]] for w, u in zip(bare, marked, strict=True)], strict=True))
        self.chars += sum(map(len, missing))

    def _encode(self, missing: list[str]) -> None:
        if self.words is not None:
            letters = [u for u in missing if (u[1:].isalpha() and u[0] in " \n" if self.leads else u.isalpha()) and (u.isascii() or not PLAIN_CASE.search(u))]
            if not self.leads:
                letters = [u for u in letters if u == u.lower()]
            for i in range(0, len(letters), JOINED):
                run = letters[i : i + JOINED]
                (e,) = self.words.encode_batch_fast(["\0".join(run)], add_special_tokens=False)
                ids, width = np.array(e.ids, self.dtype), self.dtype.itemsize
                at = np.flatnonzero(self.edge[ids])
                edges = ([*at.tolist(), len(ids)] if self.leads else [0, *(at + 1).tolist()])
                if len(edges) != len(run) + 1 or edges[0] or edges[-1] != len(ids):
                    letters = letters[:i]
                    break
                raw = ids.tobytes()
                self.kept.update(zip(run, (raw[s * width : e * width] for s, e in zip(edges, edges[1:], strict=False)), strict=True))
            done = set(letters)
            missing = [u for u in missing if u not in done]
        if self.leads:
            side = [u for u in missing if len(u) > 1 and u[0] in " \n" and u[1] not in " \n"]
            alone = [u for u in missing if not (len(u) > 1 and u[0] in " \n" and u[1] not in " \n")]
        elif self.mark is not None:
            side, alone = missing, []
        else:
            side, alone = [], missing
        joined = "\0".join(side)
        if any(t in joined for t in self.special) or MARK in joined:
            odd = (*self.special, MARK)
            alone += [u for u in side if any(t in u for t in odd)]
            side = [u for u in side if not any(t in u for t in odd)]
        for i in range(0, len(side), JOINED):
            run = side[i : i + JOINED]
            got = self._side_by_side(run)
            if got is None:
                alone += run
            else:
                self.kept.update(zip(run, got, strict=True))
        self.kept.update(zip(alone, self._whole(alone), strict=True))

    def _cut(self, text: str) -> list[str] | None:
        """The units of a text; None if it must be encoded whole."""
        if self.units is None or self.unsafe is not None and self.unsafe.search(text):
            return None
        if not self.leads:
            if self.lowers and (text.isascii() or not PLAIN_CASE.search(text)):
                lower = text.lower()
                if not any(t in lower for t in self.special):
                    text = lower
            return text.replace("\n", " ").split(" ")  # between two separators lies the empty unit, of no ids
        if "  " in text or " \n" in text or "\n\n" in text or "\n " in text or text[:1] in " \n" or "\0" in text:
            return self.units.findall(text)
        # Every separator is one character: a space leads its word, a line feed too.
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers of dtype."""
        out, at = [], 0
        while at < len(texts):
            end = at + 1
            chars = len(texts[at])
            while end < len(texts) and chars + len(texts[end]) <= CUT_CHARS:
                chars += len(texts[end])
                end += 1
            out += self._some(texts[at:end])
            at = end
        return out

    def _forget(self) -> None:
        """Keep the units learnt first, up to half of either limit: what is frequent is met early, most of what came later is rare."""
        first = list(islice(self.kept, self.limit // 2))
        chars = list(accumulate(map(len, first)))
        n = bisect.bisect_right(chars, KEPT_CHARS // 2)
        self.kept = self.always | {u: self.kept[u] for u in first[:n]}
        self.chars = chars[n - 1] if n else 0

    def _some(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        if len(self.kept) > self.limit or self.chars > KEPT_CHARS:
            self._forget()
        missing = list(filterfalse(self.kept.__contains__, set().union(*[c for c in cut if c])))
        if missing:
            self._learn(missing)
        known = self.kept.__getitem__
        return [self._whole([t])[0] if c is None else b"".join(map(known, c)) for t, c in zip(texts, cut, strict=True)]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ROWS rows."""
    return (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; tasks that a worker runs one after the other share it."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str, end_id: int, kept_units: int = KEPT_UNITS, packed: bool = True, dealt: tuple[str, Callable[[pa.RecordBatch], list[int]]] | None = None) -> DataFrame:
    """(row, doc_id, n, ids) for each of docs: a row number, the number of ids with the end id, and all those ids, compressed if packed. A null text is empty.

    dealt names columns of docs (longs) that stay, and makes of a batch with them first the int column `to`.
    """
    carried, to = (dealt[0].split(), dealt[1]) if dealt else ([], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        own.limit = kept_units
        end = np.array([end_id], own.dtype).tobytes()
        pack = zstandard.ZstdCompressor(level=1)
        for b in parts(batches):
            raw = [x + end for x in own.ids([t or "" for t in b.column(2).to_pylist()])]
            n, ids = [len(x) // own.dtype.itemsize for x in raw], [pack.compress(x) for x in raw] if packed else raw
            more = [*b.columns[3:], pa.array(to(b.select(carried)), pa.int32())] if to else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), *more], names=["row", "doc_id", "n", "ids", *carried, *(["to"] if to else [])])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    return rows.mapInArrow(tidied(run), "row long, doc_id long, n long, ids binary" + "".join(f", {c} long" for c in carried) + (", to int" if to else ""))


_unpacker = zstandard.ZstdDecompressor()


def id_bytes(ids: bytes) -> bytes:
    """The ids of a row of encoded(), as bytes of the encoder's dtype."""
    return _unpacker.decompress(ids)


def id_array(ids: bytes, dtype: str) -> np.ndarray:
    """The ids of a row of encoded() as unsigned 32-bit integers."""
    return np.frombuffer(id_bytes(ids), dtype).astype("<u4")
