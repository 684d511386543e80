"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most three bits, one half differs in
at most one. The anchors of a half are the words of a covering code: the Hamming code over the low 31 bits (covering
radius 1) with the top bit free. Each half is sent to every anchor within covering radius plus threshold (1 + 1): its
own anchor, the fifteen others at distance two, and its own with the top bit turned: 17 copies. If x and y differ in at
most one bit of the half, y is at x's own anchor, so comparing the fingerprints that meet at an anchor finds every link.
There are 2^27 anchors for each half, so an anchor's company stays small at any size of corpus.

Three bits are few: of documents that share 0.8 to 0.85 of their word shingles, one fingerprint in twenty-five or so is
that near. similar() therefore takes several fingerprints of a document's set of words, which differ in fewer bits, finds
what is near in any of them by the same covering, and compares the shingles of what it found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import HOT_ROWS, checked, cut, hot_join, shuffle_width, swept, tidied
from quillwork.llm._graph import components

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 18
#: Up to so many fingerprints at an anchor are compared by shifts of the whole batch.
SMALL = 24
#: Leads of a cluster in the first round of similar()'s completion; each later round takes ROUND times as many.
LEADS, ROUND = 64, 8
#: Members of a cluster that a lead meets in one block.
BLOCK = 1024
#: Pairs of one text from which its shingles are sent to the pairs, not the pairs to them; words sketched at once.
HUB_PAIRS, STEP = 20_000, 1 << 14


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*[words[j:] for j in range(shingle)], strict=False))
    digest, counts, left = xxhash.xxh64_intdigest, np.zeros(64, np.int64), n
    while left:
        take = min(left, CHUNK)
        h = np.fromiter((digest(next(grams), SEED) for _ in range(take)), "<u8", take)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(take, 64).sum(axis=0, dtype=np.int64)
        left -= take
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of docs; fp is the fingerprint's bits as a signed long. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Exclusive or of the positions 1 to 31 of the bits set in the low 31 bits."""
    s = np.zeros(x.shape, np.uint64)
    for k in range(5):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1))
        s |= (np.bitwise_count(x & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) pairs for an array of 32-bit halves: all anchors within covering radius plus one."""
    half = half.astype(np.uint64)
    one, s = np.uint64(1), _syndrome(half)
    flip = lambda p: np.where(p > 0, one << (np.maximum(p, one) - one), np.uint64(0))
    own = half ^ flip(s)
    rows, at = [np.arange(len(half))] * 2, [own, own ^ np.uint64(1 << 31)]
    for i in range(1, 32):
        i = np.uint64(i)
        j = i ^ s
        ok = (s > 0) & (i < j)
        rows.append(np.flatnonzero(ok))
        at.append(half[ok] ^ flip(np.full(ok.sum(), i)) ^ flip(j[ok]))
    return np.concatenate(rows), np.concatenate(at)


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1 << 12):
            fp, kind = (np.asarray(c.slice(at, 1 << 12)).astype(np.int64) for c in b.columns)
            fp = fp.view(np.uint64)
            out_a, out_r = [], []
            for side in (0, 1):
                half = fp >> np.uint64(32) if side else fp & np.uint64(0xFFFFFFFF)
                rows, key = anchors(half)
                out_a.append(key | (kind[rows].astype(np.uint64) << np.uint64(1) | np.uint64(side)) << np.uint64(32))
                out_r.append(rows)
            rows = np.concatenate(out_r)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(out_a).view(np.int64), fp[rows].view(np.int64))], names=["anchor", "fp"])


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join what is connected at one anchor: each fingerprint reached, from the first on, meets those not yet reached once."""
    links, rest = [], fp
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                found = rest[near]
                links += [(x, y) for y in found]
                frontier += list(found)
                rest = rest[~near]
    return links


def _compare(anchor: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    """Links among rows sorted by anchor, as an array of (kind, one, other)."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    small = np.repeat(sizes <= SMALL, sizes)
    out = []
    a, f = anchor[small], fp[small]
    for s in range(1, SMALL):
        if len(a) <= s:
            break
        same = a[s:] == a[:-s]
        if not same.any():
            break
        hit = same & (np.bitwise_count(f[s:] ^ f[:-s]) <= bits)
        out.append(np.stack([a[s:][hit].view(np.uint64) >> np.uint64(33), f[:-s][hit], f[s:][hit]], 1))
    for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        links = _forest(fp[at : at + n], bits)
        if links:
            pairs = np.array(links, np.uint64)
            out.append(np.column_stack([np.full(len(pairs), anchor[at] >> 33, np.uint64), pairs]))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.uint64)


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """Links (kind, a, b) between fingerprints that differ in at most bits bits (1 to 3), enough of them to connect all that are connected.

    distinct has (fp, kind): fingerprints of different kinds (0 to 255) aren't compared, and in large companies the links
    go out from the least fingerprints.
    """
    if not 0 < bits <= 3:
        raise ValueError("two halves cover one to three bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_a, kept_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def made(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1, 2)], names=["kind", "a", "b"])

        for b in batches:
            a = np.concatenate([kept_a, np.asarray(b.column(0))])
            f = np.concatenate([kept_f, np.asarray(b.column(1)).view(np.uint64)])
            if not len(a):
                continue
            done = int(np.searchsorted(a, a[-1]))  # the last anchor may go on in the next batch
            if done:
                yield made(_compare(a[:done], f[:done], bits))
            kept_a, kept_f = a[done:], f[done:]
        if len(kept_a):
            yield made(_compare(kept_a, kept_f, bits))

    n = shuffle_width(distinct.sparkSession)
    met = distinct.select("fp", F.col("kind").cast("long").alias("kind")).mapInArrow(tidied(_covered), "anchor long, fp long")
    return met.repartition(n, "anchor").sortWithinPartitions("anchor", "fp").mapInArrow(tidied(run), "kind long, a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Fingerprints that differ in at most bits bits are linked; component_id is the least doc_id that can be reached.
    Copies share a fingerprint and are one node, however many they are. Rows with a null or repeated doc_id keep a row
    each; a component of null ids only has a null component_id. Texts without words share fingerprint 0; a text of any
    length counts whole. An empty table gives an empty result; other columns of docs are ignored.
    """
    known = cut(fingerprints(docs, shingle))
    least = cut(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    hot = cut(least.where(F.col("n") > HOT_ROWS).select("fp"))
    roots = components(links(least.select("fp", F.lit(0).alias("kind")), bits))
    groups = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = cut(groups.select("fp", "root").join(of_root, "root").select("fp", "component_id"))
    return hot_join(known, of_fp, "fp", None if hot.isEmpty() else hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _mixers(kinds: int) -> np.ndarray:
    """Odd multipliers, one for each kind of fingerprint."""
    return np.array([xxhash.xxh64_intdigest(b"kind", k) | 1 for k in range(kinds)], np.uint64)


def _sketch(text: str | None, mixers: np.ndarray) -> tuple[bytes, list[int]]:
    """A digest of a text's words in lower case, and a fingerprint of its set of words for each of mixers."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    own = set(words)
    base = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    counts = np.zeros((len(mixers), 64), np.int64)
    for i in range(0, len(base), STEP):
        h = base[i : i + STEP] * mixers[:, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(len(mixers), -1, 64).sum(axis=1, dtype=np.uint16)
    bits = np.packbits(2 * counts > len(own), axis=1, bitorder="little").view("<i8")[:, 0]
    return xxhash.xxh3_128_digest(b" ".join(words)), bits.tolist()


def sketches(docs: DataFrame, kinds: int) -> DataFrame:
    """(doc_id, digest, fps) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = _mixers(kinds)
        for b in batches:
            made = [_sketch(t.as_py(), mixers) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.int64()))], names=["doc_id", "digest", "fps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, digest binary, fps array<long>")


def _shingles(docs: DataFrame, shingle: int) -> DataFrame:
    """(digest, shingles): the hashes of the different word shingles of each row of docs, in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            digests, sets = [], []
            for t in b.column(0):
                words = (t.as_py() or "").encode("utf-8", "replace").lower().split()
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                own = {xxhash.xxh3_64_intdigest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))}
                sets.append(np.fromiter(own, np.uint64, len(own)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "digest binary, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, hubs: DataFrame | None) -> DataFrame:
    """Those of pairs (one, other) whose sets of shingles are alike, as (a, b); hubs are the digests with many pairs."""
    both = pairs
    for end, to in (("one", "x"), ("other", "y")):
        both = hot_join(both, sets.select(F.col("digest").alias(end), F.col("s").alias(to)), end, hubs and hubs.select(F.col("digest").alias(end)))
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select(F.col("one").alias("a"), F.col("other").alias("b"))


def _hubs(pairs: DataFrame) -> DataFrame | None:
    """The digests that stand in more than HUB_PAIRS of pairs; None if there are none."""
    hubs = cut(pairs.select(F.explode(F.array("one", "other")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > HUB_PAIRS).select("digest"))
    return None if hubs.isEmpty() else hubs


def _labelled(pairs: DataFrame, roots: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """(rx, ry): the groups of each of pairs, where they differ."""
    both = pairs
    for end, to in (("one", "rx"), ("other", "ry")):
        both = hot_join(both, roots.select(F.col("node").alias(end), F.col("root").alias(to)), end, hubs and hubs.select(F.col("digest").alias(end)), "left").withColumn(to, F.coalesce(to, end))
    return both.where("rx <> ry").select("rx", "ry").distinct()


def _completed(texts: DataFrame, sets: DataFrame, pairs: DataFrame, alike: DataFrame, hubs: DataFrame | None, bits: int, similarity: float, kinds: int) -> DataFrame:
    """(node, root) of the groups of all candidates that are alike, from the pairs of links() and those alike among them.

    pairs only connect the candidates: all others lie within its clusters, and only clusters of several groups are open.
    In rounds, leads of each such cluster meet all its members of other groups that are near in any fingerprint. Leads
    are texts outside a cluster's largest group, drawn by a salted hash, and of each group the text with most links, as
    an original stands nearer to its edits than they do to each other. A text that was a lead has met all others, so the
    rounds end when every text outside the largest group was one.
    """
    spark = texts.sparkSession
    roots = components(alike)
    unlike = cut(_labelled(pairs, roots, hubs))
    if unlike.isEmpty():
        return roots
    clusters = components(unlike, "rx", "ry").select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    sized = texts.select("digest", "fps").join(sets.select("digest", F.size("s").alias("n")), "digest")
    placed = sized.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    now = cut(placed.join(clusters, "root").withColumn("met", F.lit(False)))
    seen, turn, most = pairs, 0, LEADS
    links = alike
    while True:
        parts = now.groupBy("cluster", "root").agg(F.count("*").alias("size"), F.count_if(~F.col("met")).alias("open"))
        main = parts.groupBy("cluster").agg(F.max(F.struct("size", "root", "open")).alias("m"), F.sum("size").alias("all"), F.sum("open").alias("open"))
        facts = cut(main.select("cluster", F.col("m.root").alias("main"), "all", (F.col("open") - F.col("m.open")).alias("outside")).where("outside > 0"))
        n = facts.count()
        if not n:
            return roots
        alive = cut(now.join(checked(facts, n), "cluster"))
        degree = links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("degree")).where("degree > 2")
        first = alive.where("not met").join(degree, "digest").groupBy("cluster", "root").agg(F.max(F.struct("degree", "digest")).alias("h")).select("h.digest")
        drawn = alive.where((F.col("root") != F.col("main")) & ~F.col("met") & (F.pmod(F.xxhash64("digest", F.lit(str(turn))), F.col("outside")) < most)).select("digest")
        leads = cut(first.union(drawn).distinct())
        blocks = F.ceil(F.col("all") / BLOCK).cast("int")
        a = alive.join(leads, "digest", "left_semi").select("cluster", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("digest").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("fps").alias("fx"))
        b = alive.where("not met").select("cluster", F.pmod(F.xxhash64("digest"), blocks).cast("int").alias("block"), F.col("digest").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("fps").alias("fy"))
        near = " or ".join(f"bit_count(fx[{k}] ^ fy[{k}]) <= {bits}" for k in range(kinds))
        met = a.join(b, ["cluster", "block"]).where(f"rx <> ry and least(nx, ny) >= {similarity} * greatest(nx, ny) and ({near})")
        fresh = cut(met.select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("other")).distinct().join(seen, ["one", "other"], "left_anti"))
        found = cut(_verified(fresh, sets, similarity, _hubs(fresh)))
        if not found.isEmpty():
            links = cut(links.union(found))
            joined = components(_labelled(found.toDF("one", "other"), roots, None), "rx", "ry").select(F.col("node").alias("root"), F.col("root").alias("to"))
            merged = lambda df: df.join(joined, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")  # noqa: E731, B023
            single = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").withColumn("root", F.col("node"))
            roots = cut(merged(roots.unionByName(single)))
            now = merged(now)
        now = cut(now.join(leads.withColumn("lead", F.lit(True)), "digest", "left").withColumn("met", F.col("met") | F.coalesce("lead", F.lit(False))).drop("lead"))
        turn, most = turn + 1, most * ROUND
        swept(spark)


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, kinds: int = 12, bits: int = 3) -> tuple[DataFrame, DataFrame]:
    """Groups of documents whose sets of word shingles are alike to the Jaccard similarity or more: (sketches, groups).

    sketches has doc_id and digest for every row of docs, groups has digest, first and root for each different text; first
    is its least doc_id (null if any is null), and texts of a group share a root. Texts that are equal but for case and
    white space are one. Others are candidates if one of `kinds` fingerprints of their words differs in at most bits
    bits; the shingles of candidate pairs are compared in full, until every pair is compared or known to be of one group.
    Of pairs of 200 words with a similarity of 0.80 to 0.85 about 97 in a hundred are candidates, of more similar ones
    nearly all; a pair that isn't is found only through other copies. A null text is an empty one; a text of any length
    counts whole. An empty table gives empty results; other columns of docs are ignored.
    """
    swept(docs.sparkSession)
    known = cut(sketches(docs, kinds))
    first = F.when(F.max(F.col("doc_id").isNull().cast("int")) == 0, F.min("doc_id")).alias("first")
    texts = cut(known.groupBy("digest").agg(first, F.first("fps").alias("fps")))
    each = texts.select("digest", "first", F.posexplode("fps").alias("kind", "fp"))
    lead = cut(each.groupBy("kind", "fp").agg(F.min(F.struct("first", "digest")).alias("lead")).select("kind", "fp", "lead.first", "lead.digest"))
    near = links(lead, bits)
    a = lead.select("kind", F.col("fp").alias("a"), F.col("digest").alias("one"))
    b = lead.select("kind", F.col("fp").alias("b"), F.col("digest").alias("other"))
    between = near.join(a, ["kind", "a"]).join(b, ["kind", "b"]).select("one", "other")
    within = each.select("kind", "fp", F.col("digest").alias("other")).join(lead.select("kind", "fp", F.col("digest").alias("one")), ["kind", "fp"]).select("one", "other")
    pairs = cut(between.unionByName(within).where("one <> other").select(F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other")).distinct())
    wanted = cut(pairs.select(F.col("one").alias("digest")).union(pairs.select("other")).distinct().join(texts.select("digest", "first"), "digest"))
    n = wanted.count()
    # One row of each wanted text: its first doc_id finds it; rows of one doc_id are told apart by the digest.
    found = docs.join(checked(wanted.select(F.col("first").alias("_first")).distinct(), n), F.col("doc_id").cast("long").eqNullSafe(F.col("_first")), "left_semi")
    sets = cut(_shingles(found, shingle).join(checked(wanted.select("digest"), n), "digest", "left_semi").groupBy("digest").agg(F.first("shingles").alias("s")))
    swept(docs.sparkSession)
    hubs = _hubs(pairs)
    alike = cut(_verified(pairs, sets, similarity, hubs))
    roots = _completed(texts, sets, pairs, alike, hubs, bits, similarity, kinds).withColumnRenamed("node", "digest")
    return known.select("doc_id", "digest"), texts.select("digest", "first").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row for each group of similar(): that of the least doc_id (null first), of equal rows any one. All columns stay."""
    known, groups = similar(docs, shingle, similarity)
    best = cut(groups.groupBy("root").agg(F.min(F.struct("first", "digest")).alias("k")).select(F.col("k.first").alias("doc_id"), F.col("k.digest").alias("digest")))
    rows = cut(known.groupBy("doc_id", "digest").agg(F.count("*").alias("n")))
    gone = cut(rows.join(best, rows.doc_id.eqNullSafe(best.doc_id) & (rows.digest == best.digest), "left_anti").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")))
    stays = _with_digest(docs)
    left = stays.join(checked(gone, gone.count()), F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_digest")), "left_anti")
    if (rows.agg(F.max("n")).first()[0] or 0) > 1:
        left = left.dropDuplicates(["doc_id", "_key"])
    return left.select(*docs.columns)


def _with_digest(docs: DataFrame) -> DataFrame:
    """docs and the digest of similar() as _key."""

    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        return pa.array((xxhash.xxh3_128_digest(b" ".join((t.as_py() or "").encode("utf-8", "replace").lower().split())) for t in texts), pa.binary())

    return docs.withColumn("_key", digest(F.col("text").cast("string")))
