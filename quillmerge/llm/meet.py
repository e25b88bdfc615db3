"""Links inside groups of any size, without all pairs of a group.

Every pair of a group's members must be able to meet, but what is wanted is a
spanning forest of its links.  A group too large for one task is dealt to parts by
hash, and the group's first member, its pivot, is in all of them:

1. each part links its own members.  Members connected to the pivot are settled
   among each other, whatever part they are in;
2. only members that no chain of links led to the pivot are left over.  They meet
   the members of all parts, themselves included, in cells of (part, share of the
   left over).

In a group of near copies nearly all members are settled in the first step, so it is
shuffled once.  A group that falls to pieces costs its size times the number of
shares of what is left over, and no pair of members is ever missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmerge.llm.arrow import give_back
from quillmerge.sources.scratch import materialise

Local = Callable[[list], list[tuple[int, int]]]


def reached(n: int, pairs: list[tuple[int, int]], start: int) -> set[int]:
    """Positions that the pairs connect to ``start``, itself included."""
    beside: dict[int, list[int]] = {}
    for a, b in pairs:
        beside.setdefault(a, []).append(b)
        beside.setdefault(b, []).append(a)
    seen, stack = {start}, [start]
    while stack:
        for y in beside.get(stack.pop(), ()):
            if y not in seen:
                seen.add(y)
                stack.append(y)
    return seen


def _met(read: Callable[[bytes], object], local: Local):
    """Rows (group, part, pivot, row, payload) sorted by the first two: links, and rows apart from the pivot.

    ``pivot`` is null where the group is not split, and in the second step.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pivot, rows, held = None, None, [], []

        def flush():
            pairs = local(held) if len(held) > 1 else []
            out = [(rows[i], rows[j], False) for i, j in pairs]
            if pivot is not None:
                settled = reached(len(rows), pairs, rows.index(pivot))
                out += [(here[0], r, True) for i, r in enumerate(rows) if i not in settled]
            if out:
                a, b, left = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(left, pa.bool_())], names=["src", "dst", "left"])

        for part in parts:
            cells = zip(part.column("group").to_pylist(), part.column("part").to_pylist(), strict=True)
            rest = (part.column("pivot").to_pylist(), part.column("row").to_pylist(), part.column("payload").to_pylist())
            for cell, middle, row, payload in zip(cells, *rest, strict=True):
                if cell != here:
                    yield from flush()
                    here, pivot, rows, held = cell, middle, [], []
                rows.append(row)
                held.append(read(payload))
        yield from flush()
        give_back()

    return run


def _gathered(dealt: DataFrame, payload: DataFrame, read, local) -> DataFrame:
    met = payload.join(dealt, "row").select("group", "part", "pivot", "row", F.col("payload").cast("binary").alias("payload"))
    met = met.repartition("group", "part").sortWithinPartitions("group", "part")
    return met.mapInArrow(_met(read, local), "src long, dst long, left boolean")


def links_within(members: DataFrame, payload: DataFrame, read: Callable[[bytes], object], local: Local, part_weight: int) -> DataFrame:
    """(src, dst): links that connect all that ``local`` would connect in each group of ``members``.

    ``members`` holds (group long, row long, weight long), ``payload`` (row, payload) of
    those rows.  ``read`` turns a payload into what ``local`` is given a list of;
    ``local`` gives positions of a spanning forest of the links in its list.  A part
    holds about ``part_weight``, a task of the second step two of them.  Groups of one
    member, and an empty input, give no links.  A row may be in many groups.
    """
    sized = members.groupBy("group").agg(F.ceil(F.sum("weight") / part_weight).cast("long").alias("parts"), F.min("row").alias("pivot"), F.count("*").alias("n"))
    sized = materialise(sized.where("n > 1").select("group", F.greatest("parts", F.lit(1)).alias("parts"), "pivot"), "groups")
    own = F.pmod(F.xxhash64("row"), F.col("parts"))
    split = F.when(F.col("parts") > 1, F.col("pivot")).alias("pivot")
    dealt = members.join(sized, "group").where("parts = 1 or row <> pivot").select("group", own.alias("part"), split, "row")
    everywhere = sized.where("parts > 1").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "pivot", F.col("pivot").alias("row"))
    first = materialise(_gathered(dealt.unionByName(everywhere), payload, read, local), "links")
    links = first.where("not left").select("src", "dst")

    left = first.where("left").select(F.col("src").alias("group"), F.col("dst").alias("row"))
    if left.isEmpty():
        return links
    left = members.join(left, ["group", "row"])
    shares = left.groupBy("group").agg(F.ceil(F.sum("weight") / part_weight).cast("long").alias("shares"))
    wide = sized.join(shares, "group").select("group", "parts", F.greatest("shares", F.lit(1)).alias("shares"))
    wide = materialise(wide, "groups")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    theirs = F.pmod(F.xxhash64("row", F.lit(1)), F.col("shares"))
    every = members.join(wide, "group").select("group", F.explode(F.transform(upto("shares"), lambda j: own * F.col("shares") + j)).alias("part"), "row")
    again = left.join(wide, "group").select("group", F.explode(F.transform(upto("parts"), lambda i: i * F.col("shares") + theirs)).alias("part"), "row")
    cells = every.unionByName(again).distinct().withColumn("pivot", F.lit(None).cast("long"))
    second = _gathered(cells, payload, read, local).select("src", "dst")
    return links.unionByName(materialise(second, "links"))
