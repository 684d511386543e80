"""Approximate nearest neighbours with a permutation index.

A vector stands in the index as its nearest pivots, in order. Each pivot has an inverted file: the vectors that have it
among their nearest, with its place there. A query's files are added up to footrule distances between its order and
that of the vectors; the vectors with the least are compared in full. With m places, the footrule distance of two orders
is m(m+1) less twice the sum, over pivots in both, of m less the worse place, so only shared pivots need be visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.llm._common import HOT_ROWS, cut, hot_join, shuffle_width, tidied

#: Numbers in the vectors of one index block at most, about; vectors for which a block of its own is worth a task; queries
#: answered between two results. Each block answers each query with k rows.
BLOCK_NUMBERS, BLOCK_ROWS, QUERY_ROWS = 1 << 21, 4096, 512


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dims)


class Index:
    """The inverted files of a block of vectors."""

    def __init__(self, vectors: np.ndarray, extra: np.ndarray, pivots: np.ndarray, places: int) -> None:
        self.vectors, self.pivots, self.places = vectors, pivots, places
        order = self.order(vectors, extra)
        n = len(vectors)
        pivot, row, place = order.ravel(), np.repeat(np.arange(n), order.shape[1]), np.tile(np.arange(order.shape[1]), n)
        by = np.argsort(pivot, kind="stable")
        self.row, self.place = row[by].astype(np.int32), place[by].astype(np.int32)
        self.edges = np.searchsorted(pivot[by], np.arange(len(pivots) + 1))

    def order(self, vectors: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first; extra is the coordinate that makes all norms equal."""
        near = vectors @ self.pivots[:, :-1].T + np.outer(extra, self.pivots[:, -1])
        m = min(self.places, len(self.pivots))
        if not m or not len(near):
            return np.zeros((len(near), m), np.int64)
        first = np.sort(np.argpartition(-near, m - 1, axis=1)[:, :m], axis=1)
        return np.take_along_axis(first, np.argsort(-np.take_along_axis(near, first, axis=1), axis=1, kind="stable"), axis=1)

    def search(self, query: np.ndarray, order: np.ndarray, k: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, inner product) of the k best among the candidates of least footrule distance."""
        n, m = len(self.vectors), len(order)
        shared = np.zeros(n, np.int32)
        for place, pivot in enumerate(order):
            s, e = self.edges[pivot], self.edges[pivot + 1]
            shared[self.row[s:e]] += m - np.maximum(self.place[s:e], place)
        rows = np.argpartition(-shared, min(candidates, n) - 1)[:candidates]
        score = self.vectors[rows] @ query
        if len(rows) > k:
            best = np.argpartition(-score, k - 1)[:k]
            rows = rows[score >= score[best].min()]
        exact = (self.vectors[rows] * query).sum(axis=1)
        best = np.lexsort((rows, -exact))[:k]
        return rows[best], exact[best]


def usable(table: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) for the vectors that take part, and their dimension: the commonest length, no null, NaN, infinity, nor all zeros."""
    v = F.col(vector).cast("array<double>")
    ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.where(F.col(key).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = top.n if top else 0
    return rows.where(F.size("v") == dims), dims


def neighbours(table: DataFrame, every: int = 20, k: int = 20, pivots: int = 1024, places: int = 64, share: float = 0.1, each: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by every, the k vectors of largest inner product that the index finds.

    Equal vectors are one entry of the index, which holds the k + 1 least ids of each: no further id of an entry can be
    among anyone's k nearest, as ties go to the smaller id. Entries are dealt by hash into blocks; every query visits
    every block, whose candidates of least footrule distance, the part `share` of its entries and `each` for each of k,
    are reranked with full vectors. Vectors whose directions are all but even need such a part: of those the 20 nearest
    are found with a recall of 0.9 or more, and the work is a fixed share of all comparisons. Pivots are the vectors of
    the first `pivots` ids by hash: a bounded sample, the one thing that the driver holds. Shorter vectors get a further
    coordinate that makes all norms equal, which turns the largest inner product into the nearest direction. Vectors that
    are null, zero, of another length than most, or hold null or non-finite numbers take no part, nor do null ids;
    repeated ids are entries like others. An empty table gives an empty result; other columns are ignored.
    """
    rows, dims = usable(table, key, vector)
    first = W.partitionBy("v").orderBy("id")
    entries = rows.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    entries = cut(entries.withColumn("entry", F.element_at("ids", 1)).withColumn("norm", norm))
    facts = entries.agg(F.max("norm").alias("norm"), F.count("*").alias("n")).first()
    blocks = max(1, -(-facts.n * max(dims, 1) // BLOCK_NUMBERS), min(shuffle_width(table.sparkSession), -(-facts.n // BLOCK_ROWS)))
    chosen = entries.orderBy(F.xxhash64("entry"), "entry").limit(pivots).select("v", "norm").collect()
    longest = facts.norm or 0.0
    base = np.zeros((0, 1))
    if chosen:
        extra = np.sqrt(np.maximum(longest**2 - np.array([x.norm for x in chosen]) ** 2, 0))
        base = np.column_stack([np.array([x.v for x in chosen]), extra])

    wanted = rows.where(F.col("id") % every == 0).distinct()
    often = cut(wanted.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).join(entries.select("v", "entry"), "v").select("v", "entry"))
    often = None if often.isEmpty() else often
    asked = cut(hot_join(wanted, entries.select("v", "entry"), "v", often and often.select("v")).select(F.col("id").alias("query_id"), "entry"))
    queries = entries.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "v").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = entries.select(F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"), "entry", "norm", "v")
    stream = dealt.unionByName(queries.select("block", F.lit(True).alias("query"), "entry", F.lit(0.0).alias("norm"), "v")).repartition(blocks, "block").sortWithinPartitions("block", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, names, held = None, None, None, []
        for whole in batches:
            for b in (whole.slice(i, QUERY_ROWS) for i in range(0, whole.num_rows, QUERY_ROWS)):
                block, query = np.asarray(b.column(0)), np.asarray(b.column(1).to_numpy(zero_copy_only=False))
                entry, norms, v = np.asarray(b.column(2)), np.asarray(b.column(3)), matrix(b.column(4), dims)
                out: list[tuple] = []
                for i in np.unique(block):
                    own = block == i
                    if i != now:
                        now, index, held = i, None, []
                    data = own & ~query
                    if data.any():
                        held.append((entry[data], norms[data], v[data]))
                    ask = own & query
                    if not ask.any() or not held and index is None:
                        continue
                    if index is None:
                        names = np.concatenate([h[0] for h in held])
                        place = np.argsort(names)  # ties of a score go to the smaller id
                        vectors = np.concatenate([h[2] for h in held])[place]
                        extra = np.sqrt(np.maximum(longest**2 - np.concatenate([h[1] for h in held])[place] ** 2, 0))
                        names, held = names[place], []
                        index = Index(vectors, extra, base, places)
                    take = int(share * len(names)) + each * k
                    for q, e, o in zip(v[ask], entry[ask], index.order(v[ask], np.zeros(ask.sum())), strict=True):
                        found, score = index.search(q, o, k + 1, take)
                        out.append((np.full(len(found), e), names[found], score))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["asked", "entry", "score"])

    met = stream.mapInArrow(tidied(run), "asked long, entry long, score double")
    best = W.partitionBy("asked").orderBy(F.desc("score"), "entry")
    met = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).join(entries.select("entry", "ids"), "entry")
    ids = met.select("asked", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = ids.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("id")))).alias("near"))
    out = hot_join(asked, lists.withColumnRenamed("asked", "entry"), "entry", often and often.select("entry")).select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x.id != F.col("query_id")), 1, k)).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
