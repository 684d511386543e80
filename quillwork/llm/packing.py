"""Hierarchical multi-length packing of token ids.

Documents of more than the longest window fill windows of their own; what remains of a document, its rest, is routed to
the smallest tier that holds it. The plan is made from the histogram of rests, at most as many numbers as the longest
window has places: from the longest length down, a rest opens a window of its tier, and the gap behind it takes whole
rests of the shorter tiers, longest first, until no length fits. Gaps that are left are filled to the last id with pieces
of a reserve, the least share of all rests that suffices; only these are cut, and only they and what remains of the
reserve meet in a final window that may need padding. Where a row goes follows from its number among the rows of its
length, by arithmetic.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import cut, ranged, running, tidied
from quillwork.llm.tokens import KEPT_UNITS, encoded, id_array, id_type

TIERS = (512, 1024, 2048, 4096)
#: The reserve's share of the rests is found to one part in so many.
RESERVE_STEPS = 1024


def filled(counts: np.ndarray, tiers: tuple[int, ...]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(tier, windows, [(length, rests of it in each window)]) for counts of rests by length, largest first."""
    left = {int(n): int(counts[n]) for n in np.flatnonzero(counts)}
    lengths, out = sorted(left), []
    while lengths:
        top = lengths[-1]
        tier = next(t for t in tiers if t >= top)
        used, gap = {top: 1}, tier - top
        at = len(lengths)
        while gap and at:
            at = bisect.bisect_right(lengths, gap, 0, at) - 1
            if at < 0:
                break
            n = lengths[at]
            take = min(gap // n, left[n] - used.get(n, 0))
            if take:
                used[n] = used.get(n, 0) + take
                gap -= take * n
        windows = min(left[n] // k for n, k in used.items())
        out.append((tier, windows, list(used.items())))
        for n, k in used.items():
            left[n] -= k * windows
            if not left[n]:
                del lengths[bisect.bisect_left(lengths, n)]
    return out


@dataclass
class Plan:
    """Where rests go. Whole rests are found by their length and number; the reserve lies end to end over all gaps, then over final windows."""

    tiers: tuple[int, ...]
    full: int  # windows that long documents fill alone; they come first
    groups: int
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # rests shorter than each length
    whole: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # rests of each length that stay whole
    before: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # ids of the reserve in shorter lengths
    slots: dict = field(default_factory=dict)  # by length: (first number, rests a window, pattern, offset) as arrays
    tier: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each pattern
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # its first window, counted from the first rest's
    of_tier: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the same among windows of its tier
    gap: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # ids left in each of its windows
    gap_at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # ids of the gaps before it; then of all
    windows: int = 0
    top_windows: int = 0


def plan(counts: np.ndarray, full: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 20) -> Plan:
    """The plan for counts of rests by length (0 to the longest tier) and `full` windows of long documents."""
    lengths = np.arange(len(counts))
    lo, hi = 0, RESERVE_STEPS
    while True:
        i = (lo + hi) // 2
        reserve = np.diff(np.cumsum(counts) * i // RESERVE_STEPS, prepend=0)  # spread over all lengths
        made = filled(counts - reserve, tiers)
        gaps = sum((t - sum(n * k for n, k in used)) * m for t, m, used in made)
        if lo == hi:
            break
        lo, hi = (lo, i) if int((reserve * lengths).sum()) >= gaps else (i + 1, hi)
    out = Plan(tiers, full, 1, np.cumsum(counts) - counts, counts - reserve, np.cumsum(reserve * lengths) - reserve * lengths)
    tier, windows, gap, slots = [], [], [], {}
    taken: dict[int, int] = {}
    for p, (t, m, used) in enumerate(made):
        offset = 0
        for n, k in used:
            slots.setdefault(n, []).append((taken.get(n, 0), k, p, offset))
            taken[n] = taken.get(n, 0) + m * k
            offset += n * k
        tier.append(t)
        windows.append(m)
        gap.append(t - offset)
    m = np.array(windows, np.int64)
    out.tier, out.gap = np.array(tier, np.int64), np.array(gap, np.int64)
    out.first, out.gap_at = np.cumsum(m) - m, np.concatenate([[0], np.cumsum(m * out.gap)]).astype(np.int64)
    out.of_tier = np.zeros(len(m), np.int64)
    for t in tiers:
        own = out.tier == t
        out.of_tier[own] = np.cumsum(m[own]) - m[own]
    out.slots = {n: tuple(np.array(c, np.int64) for c in zip(*s, strict=True)) for n, s in slots.items()}
    out.windows, out.top_windows = int(m.sum()), int(m[out.tier == tiers[-1]].sum())
    tail = max(0, int((reserve * lengths).sum()) - int(out.gap_at[-1]))
    padded = tiers[-1] * (full - (-tail // tiers[-1])) + int((m * out.tier).sum())
    out.groups = max(1, -(-padded // step_tokens))
    return out


def pieces(p: Plan, n: int, number: int, k_at: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(start, length, sequence_id, offset, tier, step_group, cut) for a document of n ids whose rest is the number-th of all rests by length, and before which k_at windows are full."""
    top = p.tiers[-1]
    k, r = divmod(n, top)
    out = [(i * top, top, k_at + i, 0, top, (k_at + i) % p.groups, 0) for i in range(k)]
    if not r:
        return out
    own = number - int(p.seen[r])
    if own < p.whole[r]:
        first, each, pattern, offset = p.slots[r]
        s = int(np.searchsorted(first, own, side="right")) - 1
        w, c = divmod(own - int(first[s]), int(each[s]))
        q = int(pattern[s])
        tier, index = int(p.tier[q]), int(p.of_tier[q]) + w
        group = index + (p.full if tier == top else 0)
        return [*out, (k * top, r, p.full + int(p.first[q]) + w, int(offset[s]) + c * r, tier, group % p.groups, 0)]
    x, start, gaps = int(p.before[r]) + (own - int(p.whole[r])) * r, k * top, int(p.gap_at[-1])
    end = x + r
    while x < end:
        if x < gaps:
            q = int(np.searchsorted(p.gap_at, x, side="right")) - 1
            w, into = divmod(x - int(p.gap_at[q]), int(p.gap[q]))
            tier, index = int(p.tier[q]), int(p.of_tier[q]) + w
            sequence, offset, room = p.full + int(p.first[q]) + w, int(p.tier[q] - p.gap[q]) + into, int(p.gap[q]) - into
            group = index + (p.full if tier == top else 0)
        else:
            w, offset = divmod(x - gaps, top)
            tier, room, sequence, group = top, top - offset, p.full + p.windows + w, p.full + p.top_windows + w
        length = min(room, end - x)
        out.append((start, length, sequence, offset, tier, group % p.groups, int(length < r)))
        x, start = x + length, start + length
    return out


def pack(docs: DataFrame, path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 20, ids: bool = True, kept_units: int = KEPT_UNITS // 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, cut, row, ids) for every piece; row numbers the rows of docs, ids may be left out.

    path is a file of the tokenizers library; a document's ids are those of its whole text, then end_id. tiers are powers
    of two, the last the longest. cut is 1 for a piece of a rest that was cut to fill gaps: of a table with short and
    long documents, that is a few in a hundred at most; no other rest is. step_group deals the sequences of every tier
    round robin over as many groups as there are steps of step_tokens, so groups hold equally many of each tier, give or
    take one. A null or empty text has the end id only; a text of any length is encoded and placed whole. Every row is
    a document of its own, also where doc_ids repeat or are null; the doc_id only labels its pieces. An empty table
    gives an empty result; other columns are ignored.
    """
    known = cut(encoded(docs, path, end_id, kept_units=kept_units))
    dtype, top = id_type(path).str, tiers[-1]
    sizes = known.select("row", F.expr(f"n div {top}").alias("k"), F.expr(f"n % {top}").alias("r"))
    counts, full = np.zeros(top, np.int64), 0
    for x in sizes.groupBy("r").agg(F.count("*").alias("n"), F.sum("k").alias("k")).collect():  # a row for each length of a rest at most
        full += x.k
        if x.r:
            counts[x.r] = x.n
    made = plan(counts, full, tiers, step_tokens)
    at = running(ranged(sizes, "r", "row"), [], ["r", "row"], {"number": F.expr("cast(r > 0 as long)"), "k_at": "k"}).select("row", "number", "k_at")
    names = ["start", "length", "sequence_id", "offset", "tier", "step_group", "cut"]
    with_ids = ids
    out_names = ["doc_id", *names, "ids_crc32", "doc_tokens", "row", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                doc, placed, parts = [], [], []
                for i, (n, raw, number, k_at) in enumerate(zip(*[b.column(c).to_pylist() for c in (1, 2, 3, 4)], strict=True)):
                    own = id_array(raw, dtype)
                    for piece in pieces(made, n, number, k_at):
                        doc.append(i)
                        placed.append(piece)
                        parts.append(own[piece[0] : piece[0] + piece[1]])
                at = pa.array(doc, pa.int64())
                fields = np.array(placed, np.int64).reshape(-1, len(names))
                cols = [b.column(0).take(at), *[pa.array(fields[:, c]) for c in range(len(names))], pa.array([zlib.crc32(x) for x in parts], pa.int64()), b.column(1).take(at), b.column(5).take(at)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(np.concatenate(parts or [np.zeros(0)]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=out_names)

    joined = known.join(at, "row").select("doc_id", "n", "ids", "number", "k_at", "row")
    out = joined.mapInArrow(tidied(run), ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in out_names))
    return out.withColumn("tier", F.col("tier").cast("int")).withColumn("cut", F.col("cut") == 1).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "cut", "row", *(["ids"] if ids else []))
