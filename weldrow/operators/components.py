"""Connected components by contraction: every round hooks nodes to their least neighbour and shrinks the edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weldrow.session import cut

#: Nodes that one task can join: Arrow sorts these as Spark does.
ORDERED = {"tinyint", "smallint", "int", "bigint", "string", "binary"}


def _hooks(edges: DataFrame, most: int) -> DataFrame:
    """(node, up): each of up to ``most`` nodes hooks to its least neighbour or itself, and follows hooks to their end.

    Following doubles its reach each time, so a chain of any length ends after the logarithm of it.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("up")), most)
    while True:
        top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = cut(up.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), most)
        if up.where("moved").isEmpty():
            return up.drop("moved")


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all edges ``a, b`` in one partition: every node with the least node of its component."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    coded = pa.chunked_array([b.column(i) for i in range(2) for b in held]).combine_chunks().dictionary_encode()
    names = coded.dictionary
    order = pc.array_sort_indices(names)
    rank = [0] * len(names)
    for i, x in enumerate(order.to_pylist()):
        rank[x] = i
    ends = coded.indices.to_pylist()
    up = list(range(len(names)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    half = len(ends) // 2
    for x, y in zip(ends[:half], ends[half:], strict=True):
        x, y = find(rank[x]), find(rank[y])
        up[max(x, y)] = min(x, y)
    names = names.take(order)
    for i in range(0, len(names), 10_000):
        tops = pa.array([find(x) for x in range(i, min(i + 10_000, len(names)))], pa.int64())
        yield pa.RecordBatch.from_arrays([names.slice(i, 10_000), names.take(tops)], names=["node", "up"])


def connected_components(edges: DataFrame, left: str, right: str, alone: int = 0) -> DataFrame:
    """Label every node that has an edge with the least node of its component.

    Returns ``(node, component)``. Nulls and self loops are ignored; repeated and reversed edges count once. Only
    joins and partial minima are used, so no task holds a whole component of more than ``alone`` edges; edges shrink geometrically and the
    loop ends when none is left. Skewed nodes are split by adaptive execution, as the joins are plain equi-joins.
    Once the edges are counted, each cut leaves as many files as its rows need and not one for every partition.

    Once at most ``alone`` edges are left, one task joins them all instead of further rounds. Every round is several
    queries whose plans, code and folders the driver pays for, whatever their size.
    """
    e = edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
    e = e.where(F.col(left).isNotNull() & F.col(right).isNotNull()).where("a <> b").distinct()
    e = cut(e)
    n = first = e.count()
    labels = None
    kind = e.schema["a"].dataType.simpleString()
    while True:
        last = n <= alone and kind in ORDERED
        up = e.coalesce(1).mapInArrow(_tops, f"node {kind}, up {kind}") if last else _hooks(e, 2 * n)
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            nxt = up.select(F.col("node").alias("component"), F.col("up").alias("top"))
            labels = labels.join(nxt, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        if last:
            return cut(labels, 2 * first)
        ua, ub = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        e = e.join(ua, "a").join(ub, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        e = cut(e, n)
        labels = cut(labels, 2 * first)
        n = e.count()
        if not n:
            return labels
