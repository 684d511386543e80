"""Connected components by randomised contraction, distributed while the graph is large, in one task once it is small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import HOT_ROWS, cut, hot_join, planned_once, tidied

#: Edges from which a graph is contracted by jobs; what has no more, or is left with no more, is solved by one task.
LAST_EDGES = 1 << 20


def components(edges: DataFrame, a: str = "a", b: str = "b", last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); nodes of one component share a root.

    Each round every node goes over to that one of itself and its neighbours whose salted hash is least, and the edges
    between the new nodes are what remains: a constant share of nodes vanishes in each round whatever the shape
    (chains included), so rounds are logarithmic. Once no more than last_edges remain, one task goes on in the same way:
    its work is bounded, and the driver plans no jobs for it. The mappings, each smaller than the one before, are composed
    from the last back to the first. A hub of more than HOT_ROWS edges meets them by broadcast, so its edges stay where
    they are; there are at most as many such hubs as edges by HOT_ROWS. Only counts come to the driver.
    """
    left = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    with planned_once(edges.sparkSession):
        out = _contracted(left, last_edges)
    if out is None:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("root")).where("false")
    return out


def _least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least one that it reaches over the edges (a, b)."""
    root, drawn = np.arange(n), np.random.default_rng(0)
    while len(a):
        rank = drawn.permutation(n)
        best, at = rank.copy(), np.argsort(rank)
        np.minimum.at(best, a, rank[b])
        np.minimum.at(best, b, rank[a])
        to = at[best]
        while not np.array_equal(to, further := to[to]):
            to = further
        root, a, b = to[root], to[a], to[b]
        a, b = a[a != b], b[a != b]
    least = np.full(n, n)
    np.minimum.at(least, root, np.arange(n))
    return least[root]


def _solved(left: DataFrame) -> DataFrame:
    """components() of few edges (a, b) that are written down; the root is a component's least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        both = pa.concat_arrays([b.column(k) for k in (0, 1) for b in got]).dictionary_encode()
        nodes = both.dictionary
        order = np.asarray(pc.sort_indices(nodes))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes, nodes = rank[np.asarray(both.indices)], nodes.take(pa.array(order))
        n = len(codes) // 2
        root = _least_reached(codes[:n], codes[n:], len(nodes))
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([nodes.slice(i, 1 << 16), nodes.take(pa.array(root[i : i + (1 << 16)]))], names=["node", "root"])

    kind = left.schema["a"].dataType.simpleString()
    return cut(left.coalesce(1).mapInArrow(tidied(run), f"node {kind}, root {kind}"))


def _contracted(left: DataFrame, last_edges: int) -> DataFrame | None:
    """components() of distinct edges (a, b) that are written down; None if there are none."""
    maps: list[tuple[DataFrame, DataFrame | None]] = []
    out = None
    while n := left.count():
        if n <= last_edges:
            out = _solved(left)
            break
        salt = F.lit(str(len(maps)))  # a text, which compiled code refers to: all rounds share one
        key = lambda c: F.xxhash64(F.col(c), salt)  # noqa: E731, B023
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(key("b").alias("h"), F.col("b").alias("n"))).alias("m"), F.count("*").alias("degree"))
        step = cut(best.select(F.col("a").alias("node"), F.when(F.struct(key("a").alias("h"), F.col("a").alias("n")) < F.col("m"), F.col("a")).otherwise(F.col("m.n")).alias("to"), "degree"))
        most = step.agg(F.max("degree")).first()[0]
        hot = cut(step.where(F.col("degree") > HOT_ROWS).select("node")) if most > HOT_ROWS else None
        step = step.select("node", "to")
        maps.append((step, hot))
        moved = left
        for end, to in (("a", "ra"), ("b", "rb")):
            moved = hot_join(moved, step.select(F.col("node").alias(end), F.col("to").alias(to)), end, hot and hot.select(F.col("node").alias(end)))
        left = cut(moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if out is None:
        if not maps:
            return None
        out = maps.pop()[0].withColumnRenamed("to", "root")
    while maps:
        step, hot = maps.pop()
        later = out.select(F.col("node").alias("to"), "root")
        out = hot_join(step, later, "to", hot and hot.select(F.col("node").alias("to")), "left").select("node", F.coalesce("root", "to").alias("root"))
        if len(maps) % 4 == 0:
            out = cut(out)
    return out
