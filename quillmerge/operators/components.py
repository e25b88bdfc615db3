"""Connected components on an edge DataFrame.

The alternating large-star / small-star scheme: every round re-hangs neighbours
on the smallest label seen so far, so a component shrinks to a star around its
smallest node in a logarithmic number of rounds even for long chains.  Each step
gives every edge the smallest label of its node.  A hub, with over a ten-thousandth
of all edges, is labelled by a map-side combined ``min`` and a broadcast (there are
at most ten thousand hubs); the edges of any other node are few and meet in a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmerge.sources.scratch import materialise

#: Hubs of one step at most; and edges that a node has at least to be one.
HUBS, HUB_EDGES = 10_000, 64


def _with_min(pairs: DataFrame, n_pairs: int) -> DataFrame:
    """(u, v) with m = the smallest of u and all v that share u; ``n_pairs``: rows of ``pairs`` at most."""
    most = max(HUB_EDGES, n_pairs // HUBS)
    label = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
    hubs = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where(F.col("n") > most)
    hubs = materialise(hubs.select("u", F.least("u", "m").alias("m")), "hubs")
    if hubs.isEmpty():
        return pairs.withColumn("m", label)
    hubs = F.broadcast(hubs)  # fewer than HUBS rows
    rest = pairs.join(hubs.select("u"), "u", "left_anti")
    return rest.withColumn("m", label).unionByName(pairs.join(hubs, "u"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _with_min(down, n)
    own = hung.select("u", F.col("m").alias("v"))
    rest = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return own.unionByName(rest).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    """A digest of the edge set: its size and an order-free sum of row hashes."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of edges (u, v) that are all in one partition."""
    parent: dict = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kind = None
    for part in parts:
        kind = part.schema.field("u").type
        for u, v in zip(part.column("u").to_pylist(), part.column("v").to_pylist(), strict=True):
            u, v = find(u), find(v)
            parent[max(u, v)] = min(u, v)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(parent, kind), pa.array([find(x) for x in list(parent)], kind)], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, small: int = 0) -> DataFrame:
    """(node, component) for every node of ``edges``; component = the smallest node reachable.

    Nodes may be of any orderable type.  Rows with a null end and self loops link
    nothing; a node that has only such rows is not returned.  An empty input gives
    an empty result.  Rounds are materialised in the shared scratch folder, so a
    lost executor costs at most one round.  Up to ``small`` distinct edges go through
    one task instead; then nodes are to be integers or text.
    """
    whole = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = whole.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    now = materialise(now, "edges")
    if small and now.count() <= small:
        kind = now.schema["u"].dataType.simpleString()
        return now.repartition(1).mapInArrow(_joined, f"node {kind}, component {kind}")
    mark = _mark(now)
    for _ in range(max_rounds):
        large = materialise(_large_star(now, mark[0]), "edges")
        now = materialise(_small_star(large, 2 * mark[0]), "edges")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
