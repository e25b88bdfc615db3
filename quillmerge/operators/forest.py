"""The links that a sequential union-find would make, without a sequence.

Taken in order, a link joins two clusters exactly if it is in the minimum spanning
forest under that order.  Borůvka's rounds find it: every cluster takes its first
link outward, the chosen links join clusters, the rest is relabelled, and of parallel
links only the first stays.  Each round at least halves the clusters that still have
links; once few links are left, one task goes through them in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmerge.operators.components import connected_components
from quillmerge.sources.scratch import materialise

#: Links that one task takes on.
SMALL = 100_000


def _in_order(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of links (a, b, ...) sorted by rank in one partition, those that join two clusters."""
    parent: dict = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for part in parts:
        keep = []
        for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            keep.append(a != b)
            parent[a] = b
        yield part.filter(pa.array(keep, pa.bool_()))


def minimum_forest(links: DataFrame, rank: str, small: int = SMALL) -> DataFrame:
    """The rows of ``links`` (a, b, rank, ...) that join two clusters when taken in order of ``rank``.

    ``rank`` is orderable and no two links share one; ``a`` and ``b`` are the clusters
    that a link starts from, of one type.  Loops and null ends join nothing.
    """
    columns = links.columns
    live = links.where("a <> b").withColumn("link", F.struct(*columns))
    chosen = None
    while True:
        pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        live = live.groupBy(*pair).agg(F.min_by("link", F.col(f"link.{rank}")).alias("link"))
        live = materialise(live, "links")
        n = live.count()
        if n <= small:
            last = live.withColumn("rank", F.col(f"link.{rank}")).repartition(1).sortWithinPartitions("rank").drop("rank")
            found = last.mapInArrow(_in_order, last.schema).select("link.*") if n else live.select("link.*")
            return found if chosen is None else chosen.unionByName(found)
        ends = live.select(F.col("a").alias("x"), "a", "b", "link").unionByName(live.select(F.col("b").alias("x"), "a", "b", "link"))
        best = ends.groupBy("x").agg(F.min_by(F.struct("a", "b", "link"), F.col(f"link.{rank}")).alias("best"))
        best = materialise(best.select("best.*").distinct(), "chosen-links")
        part = best.select("link.*")
        chosen = part if chosen is None else chosen.unionByName(part)
        label = connected_components(best.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        of = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
        live = live.join(of("a"), "a").join(of("b"), "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b"), "link").where("a <> b")
