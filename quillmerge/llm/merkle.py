"""Merkle manifest of a dataset: a ternary tree for each group, and one over the groups.

Leaves are numbered without sorting them.  Ids of a group become compressed bitmaps of
4,096 ids each; partial bitmaps are merged by ``or``, a directory of popcounts runs
over the bitmaps of a group, and a leaf's coordinate is the directory's entry plus the
rank of its id in its bitmap (popcounts of the words before, and of the bits below).
Ids that several rows share have one bit; such rows, and only they, are numbered among
each other by range partitions.

A coordinate names a block of 6,561 leaves and a slot in it.  A task fills the slots of
one block and reduces them by eight levels, the blocks' digests are leaves of the next
tier, and so on.  Paths go back the same way: a block's path is found once, and each leaf
adds what lies inside its block.  No task holds more than a block or a bitmap.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmerge.sources.scratch import materialise

#: Children of a node; levels that one task reduces.
ARITY, LEVELS = 3, 8
#: Ids of one bitmap, as a power of two; bits of one directory word.
CHUNK_BITS = 12
#: A bitmap with fewer ids is a list of them.
SPARSE = 256
#: Null ids stand before all others.
NULL_HI = -(1 << (63 - CHUNK_BITS)) - 1


def field(value: Column) -> Column:
    """UTF-8 byte count, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields in this order."""
    return F.sha2(F.concat(*map(field, values)), 256)


def node(children: list[bytes]) -> bytes:
    """Digest of digests, all as lower-case hex."""
    return sha256(b"".join(children)).hexdigest().encode()


def depth(n: int) -> int:
    """Levels from n leaves to one node."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


# ---------------------------------------------------------------- coordinates


def pack(low: np.ndarray) -> bytes:
    """Distinct sorted numbers of a chunk as a compressed bitmap, or as a list where they are few."""
    if len(low) < SPARSE:
        return b"l" + zstandard.ZstdCompressor(level=1).compress(low.astype("<u2").tobytes())
    bits = np.zeros(1 << CHUNK_BITS, np.uint8)
    bits[low] = 1
    return b"b" + zstandard.ZstdCompressor(level=1).compress(np.packbits(bits, bitorder="little").tobytes())


def unpack(body: bytes) -> np.ndarray:
    """The bitmap's words of 64 bits."""
    raw = zstandard.ZstdDecompressor().decompress(body[1:], max_output_size=1 << CHUNK_BITS)
    if body[:1] == b"b":
        return np.frombuffer(raw, "<u8")
    bits = np.zeros(1 << CHUNK_BITS, np.uint8)
    bits[np.frombuffer(raw, "<u2")] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def ids_of(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many ids of the bitmap are smaller than each ``low``."""
    counts = np.bitwise_count(words).astype(np.int64)
    directory = np.cumsum(counts) - counts
    below = words[low >> 6] & ((np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1))
    return directory[low >> 6] + np.bitwise_count(below)


def _bitmaps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, hi, n, ids): a partial bitmap for each chunk of each batch of (g, hi, low)."""
    for part in parts:
        if not part.num_rows:
            continue
        g = part.column("g").dictionary_encode()
        code, hi, low = g.indices.to_numpy().astype(np.int64), part.column("hi").to_numpy(), part.column("low").to_numpy()
        order = np.lexsort((hi, code))
        code, hi, low = code[order], hi[order], low[order]
        first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (hi[1:] != hi[:-1]))))
        ends = np.append(first[1:], len(hi))
        yield pa.RecordBatch.from_arrays(
            [g.dictionary.take(pa.array(code[first])), pa.array(hi[first]), pa.array(ends - first), pa.array([pack(np.unique(low[a:b])) for a, b in zip(first, ends, strict=True)], pa.binary())],
            names=["g", "hi", "n", "ids"],
        )


def _merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, hi, n, distinct, ids) of rows sorted by the first two: partial bitmaps of a chunk become one."""
    rows = (row for part in parts for row in zip(*[part.column(c).to_pylist() for c in ("g", "hi", "n", "ids")], strict=True))
    out: list[tuple] = []

    def batch():
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["g", "hi", "n", "distinct", "ids"])

    for (g, hi), same in groupby(rows, key=lambda r: r[:2]):
        n, words = 0, np.zeros((1 << CHUNK_BITS) // 64, np.uint64)
        for *_, some, body in same:
            n, words = n + some, words | unpack(body)
        low = ids_of(words)
        out.append((g, hi, n, len(low), pack(low)))
        if len(out) >= 256:
            yield batch()
            out.clear()
    if out:
        yield batch()


def running(rows: DataFrame, within: list[str], order: list[str], weight: str) -> DataFrame:
    """``rows`` with ``before``, the weights of the earlier rows of its group, written once.

    Rows are dealt to ranges of (group, order), so a group of any size is many tasks; a
    range adds what earlier ranges hold of its first group, from one row for each
    group and range.
    """
    dealt = materialise(rows.repartitionByRange(*within, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*within, "part").agg(F.sum(weight).alias("held"))
    earlier = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*within, "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    here = Window.partitionBy(*within, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumn("here", F.coalesce(F.sum(weight).over(here), F.lit(0)))
    return counted.join(base, [*within, "part"]).withColumn("before", (F.col("base") + F.col("here")).cast("long")).drop("base", "here", "part")


def _ranked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, hi, what, low, row, ids, extra) sorted by the first three: (g, hi, low, row, place within the chunk).

    The chunk's bitmap comes first; ``extra`` tells which ids have how many rows more than one.
    """
    words, more = None, None
    for part in parts:
        g, hi, what, low, row = (part.column(c) for c in ("g", "hi", "what", "low", "row"))
        what, low = what.to_numpy(), low.to_numpy().astype(np.int64)
        heads = np.flatnonzero(what == 0)
        starts = np.unique(np.append(heads, 0))
        ends = np.append(starts[1:], len(what))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if a == b:
                continue
            if what[a] == 0:
                words = unpack(part.column("ids")[a].as_py())
                extra = part.column("extra")[a].as_py()
                more = np.zeros((1 << CHUNK_BITS) + 1, np.int64) if extra else None
                if extra:
                    for x in extra:
                        more[x["low"] + 1] = x["n"]
                    more = np.cumsum(more)
                a += 1
            mine = low[a:b]
            if len(mine):
                place = rank(words, mine) + (more[mine] if more is not None else 0)
                yield pa.RecordBatch.from_arrays([g.slice(a, b - a), hi.slice(a, b - a), pa.array(mine), row.slice(a, b - a), pa.array(place, pa.int64())], names=["g", "hi", "low", "row", "place"])


def coordinates(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((row, g, place), (g, n)) of leaves (row long, g string, hi long, low long, leaf binary): the place among those of g, and how many g has."""
    partial = leaves.select("g", "hi", "low").mapInArrow(_bitmaps, "g string, hi long, n long, ids binary")
    merged = partial.repartition("g", "hi").sortWithinPartitions("g", "hi").mapInArrow(_merged, "g string, hi long, n long, distinct long, ids binary")
    index = materialise(running(merged, ["g"], ["hi"], "n"), "bitmaps")
    sizes = index.groupBy("g").agg(F.sum("n").alias("n"))

    chunk = index.select("g", "hi", "ids", "before")
    shared = index.where("n > distinct").select("g", "hi")
    repeated = None
    if shared.isEmpty():
        chunk = chunk.withColumn("extra", F.lit(None).cast("array<struct<low:long,n:long>>"))
        asked = leaves.select("g", "hi", "low", "row")
    else:
        times = leaves.join(shared, ["g", "hi"]).groupBy("g", "hi", "low").agg(F.count("*").alias("n")).where("n > 1")
        times = materialise(times, "repeated-ids")
        more = times.groupBy("g", "hi").agg(F.collect_list(F.struct("low", (F.col("n") - 1).alias("n"))).alias("extra"))  # as many as a chunk has ids at most
        chunk = chunk.join(more, ["g", "hi"], "left")
        repeated = running(leaves.join(times.select("g", "hi", "low"), ["g", "hi", "low"]).select("g", "hi", "low", "leaf", "row", F.lit(1).alias("one")), ["g", "hi", "low"], ["leaf", "row"], "one")
        single = leaves.join(times, ["g", "hi", "low"], "left_anti").select("g", "hi", "low", "row")
        asked = single.unionByName(times.select("g", "hi", "low", F.lit(None).cast("long").alias("row")))
    heads = chunk.select("g", "hi", F.lit(0).alias("what"), F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("row"), "ids", "extra")
    rows = asked.select("g", "hi", F.lit(1).alias("what"), "low", "row", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("array<struct<low:long,n:long>>").alias("extra"))
    beside = heads.unionByName(rows).repartition("g", "hi").sortWithinPartitions("g", "hi", "what")
    ranked = beside.mapInArrow(_ranked, "g string, hi long, low long, row long, place long")
    placed = ranked.join(index.select("g", "hi", "before"), ["g", "hi"]).select("g", "hi", "low", "row", (F.col("place") + F.col("before")).alias("place"))
    if repeated is None:
        return placed.select("row", "g", "place"), sizes
    placed = materialise(placed, "places")
    firsts = placed.where("row is null").drop("row")
    again = repeated.join(firsts, ["g", "hi", "low"]).select("row", "g", (F.col("place") + F.col("before")).alias("place"))
    return placed.where("row is not null").select("row", "g", "place").unionByName(again), sizes


# ---------------------------------------------------------------- the tree


class Step:
    """One level of a path: what stands left and right of the node in its run."""

    __slots__ = ("left", "right", "up")

    def __init__(self, left: bytes, right: bytes, up: Step | None):
        self.left, self.right, self.up = left, right, up


def steps_of(path: str) -> Step | None:
    """``left|right,left|right,...`` from the node upwards."""
    out = None
    for level in reversed(path.split(",")) if path else ():
        left, right = level.encode().split(b"|")
        out = Step(left, right, out)
    return out


def path_of(step: Step | None) -> str:
    levels = []
    while step is not None:
        levels.append(b"%b|%b" % (step.left, step.right))
        step = step.up
    return b",".join(levels).decode()


def fold(digest: bytes, step: Step | None) -> bytes:
    """The root that a digest and its path give."""
    while step is not None:
        digest, step = sha256(step.left + digest + step.right).hexdigest().encode(), step.up
    return digest


def levels_of(slots: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each level, the slots first."""
    out = [slots]
    for _ in range(levels):
        last = out[-1]
        out.append([node(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return out


def steps_within(levels: list[list[bytes]], top: Step | None) -> list[Step | None]:
    """The path of each slot, given that of the block's last node."""
    above: list[Step | None] = [top]
    for nodes in reversed(levels[:-1]):
        own = []
        for i in range(len(nodes)):
            run = i - i % ARITY
            own.append(Step(b"".join(nodes[run:i]), b"".join(nodes[i + 1 : run + ARITY]), above[i // ARITY]))
        above = own
    return above


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows of each (g, block) of batches sorted by these, with the digests in order of their slots."""
    held: list[pa.RecordBatch] = []

    def close():
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        rows = whole.filter(pc.is_valid(whole.column("slot")))
        order = np.empty(rows.num_rows, np.int64)
        order[rows.column("slot").to_numpy()] = np.arange(rows.num_rows)  # each slot has its row
        rows = rows.take(pa.array(order))
        return whole, rows, [d.hex().encode() for d in rows.column("digest").to_pylist()]

    key = None
    for part in parts:
        if not part.num_rows:
            continue
        g = part.column("g").dictionary_encode().indices.to_numpy()
        block = part.column("block").to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (block[1:] != block[:-1]))))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), part.num_rows], strict=True):
            mine = (part.column("g")[a].as_py(), part.column("block")[a].as_py())
            if held and mine != key:
                yield close()
                held = []
            key = mine
            held.append(part.slice(a, b - a))
    if held:
        yield close()


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _reduced(step: int):
    """(g, place, digest, levels): the node of each block; ``levels`` is what the group has above the slots."""

    def rows(parts: Iterator[pa.RecordBatch]):
        for whole, _, slots in _blocks(parts):
            g, block, levels = (whole.column(c)[0].as_py() for c in ("g", "block", "levels"))
            top = levels_of(slots, min(step, levels))[-1][0]
            yield g, block, bytes.fromhex(top.decode()), max(0, levels - step)

    return lambda parts: _batched(rows(parts), ["g", "place", "digest", "levels"], [pa.string(), pa.int64(), pa.binary(), pa.int64()])


def _in_blocks(nodes: DataFrame, step: int) -> DataFrame:
    """(g, block, slot, digest, ..., levels) of (g, place, digest, ..., levels)."""
    return nodes.withColumns({"block": F.expr(f"place div {ARITY**step}"), "slot": (F.col("place") % ARITY**step).cast("long")}).drop("place")


def tiers(nodes: DataFrame, most: int, step: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """([nodes of each tier], (g, digest) of the root of each g) for groups of ``most`` leaves at most.

    ``nodes``: (g, place, digest, levels), dense places from 0.
    """
    below, every, roots = depth(most), [nodes], None
    while True:
        dealt = _in_blocks(every[-1].select("g", "place", "digest", "levels"), step).repartition("g", "block").sortWithinPartitions("g", "block")
        above = materialise(dealt.mapInArrow(_reduced(step), "g string, place long, digest binary, levels long"), "tier")
        below = max(0, below - step)
        if not below:
            return every, above.select("g", "digest")
        every.append(above)


def _paths(step: int):
    """(g, block, path): the path of each node of a tier, to be that of a block of the tier below."""

    def rows(parts: Iterator[pa.RecordBatch]):
        for whole, own, slots in _blocks(parts):
            g, path, levels = _head(whole)
            within = steps_within(levels_of(slots, min(step, levels)), steps_of(path))
            base = own.column("block")[0].as_py() * ARITY**step
            for k, above in enumerate(within):
                yield g, base + k, path_of(above)

    return lambda parts: _batched(rows(parts), ["g", "block", "path"], [pa.string(), pa.int64(), pa.string()])


def _head(whole: pa.RecordBatch) -> tuple:
    """(g, path, levels) of a block; its path is in the row without a slot."""
    path = next(p for p, s in zip(whole.column("path").to_pylist(), whole.column("slot").to_pylist(), strict=True) if s is None)
    return whole.column("g")[0].as_py(), path, max(x for x in whole.column("levels").to_pylist() if x is not None)


def _with_paths(nodes: DataFrame, paths: DataFrame, step: int) -> DataFrame:
    """The nodes' blocks, each with its path, sorted by block."""
    both = _in_blocks(nodes, step).unionByName(paths, allowMissingColumns=True)
    return both.repartition("g", "block").sortWithinPartitions("g", "block")


def block_paths(every: list[DataFrame], tops: DataFrame, step: int = LEVELS) -> DataFrame:
    """(g, block, path) of the lowest tier's blocks; ``tops`` (g, path): the path of the root of each g."""
    paths = tops.select("g", F.lit(0).cast("long").alias("block"), "path")
    for nodes in reversed(every[1:]):
        own = nodes.where("levels > 0")  # a group that ended in the tier below has a single node here, its root
        going = own.select("g").distinct()
        here = materialise(_with_paths(own.select("g", "place", "digest", "levels"), paths.join(going, "g", "left_semi"), step).mapInArrow(_paths(step), "g string, block long, path string"), "paths")
        paths = here.unionByName(paths.join(going, "g", "left_anti"))
    return paths


def manifest(docs: DataFrame, leaf_of: Column, claimed: Column | None = None, *, id_col: str = "doc_id", group_col: str = "source", step: int = LEVELS) -> DataFrame:
    """(id_col, leaf, place, subroot, root, path, folded_root) of every row of ``docs``.

    ``leaf_of`` is a row's digest.  Leaves of a group stand in order of their ids, null
    ids first, rows of one id by digest; groups in order of their names' bytes, the null
    group first.  While there are several nodes, each run of three becomes their digest;
    the last run of a level may be shorter, down to one.  ``path`` has a ``left|right`` of
    siblings for each level up to the root; folded_root is what it gives for the digest
    ``claimed`` (null or not given: for the leaf).  Ids are whole numbers.  Rows that
    repeat are leaves of their own; an empty table has no leaves.  ``step``: levels that
    one task reduces, with 3**step leaves.
    """
    id_ = F.col(id_col).cast("long")
    plain = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g"),
        F.col(id_col).alias("id"),
        F.coalesce(F.shiftright(id_, CHUNK_BITS), F.lit(NULL_HI)).alias("hi"),
        F.coalesce(id_.bitwiseAND((1 << CHUNK_BITS) - 1), F.lit(0)).alias("low"),
        F.unhex(leaf_of).alias("leaf"),
        F.unhex(F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"),
    )
    leaves = materialise(plain, "leaves")
    places, sizes = coordinates(leaves)
    sizes = materialise(sizes, "sizes")
    most, groups = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    shape = docs.select(F.col(id_col), F.lit("").alias("leaf"), F.lit(0).cast("long").alias("place"), F.lit("").alias("subroot"), F.lit("").alias("root"), F.lit("").alias("path"), F.lit("").alias("folded_root")).schema
    if not groups:
        return docs.sparkSession.createDataFrame([], shape)
    sizes = sizes.withColumn("levels", sum((F.col("n") > ARITY**k).cast("long") for k in range(40)))  # as ``depth``
    nodes = places.join(sizes.select("g", "levels"), "g").join(leaves.select("row", "id", F.col("leaf").alias("digest"), "claimed"), "row")
    nodes = materialise(nodes.select("g", "place", "digest", "levels", "id", "claimed"), "leaves")
    every, subroots = tiers(nodes, most, step)

    ranked = running(subroots.withColumn("one", F.lit(1)), [], ["g"], "one")
    stems = ranked.select(F.lit("").alias("g"), F.col("before").alias("place"), "digest", F.lit(depth(groups)).cast("long").alias("levels"))
    trunk, top = tiers(stems, groups, step)
    root = bytes(top.first()["digest"]).hex()  # one row
    ends = block_paths(trunk, F.broadcast(top.select("g", F.lit("").alias("path"))), step)
    up = _with_paths(stems, ends, step).mapInArrow(_paths(step), "g string, block long, path string")
    tops = ranked.join(up.select(F.col("block").alias("before"), "path"), "before").select("g", F.lower(F.hex("digest")).alias("subroot"), "path")
    tops = materialise(tops, "tops")
    paths = block_paths(every, tops, step).join(tops.select("g", "subroot"), "g")
    kind = docs.schema[id_col].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, own, slots in _blocks(parts):
            _, path, levels = _head(whole)
            subroot = max(x for x in whole.column("subroot").to_pylist() if x is not None)
            within = steps_within(levels_of(slots, min(step, levels)), steps_of(path))
            told = [c.hex().encode() if c is not None else s for c, s in zip(own.column("claimed").to_pylist(), slots, strict=True)]
            n, base = own.num_rows, own.column("block")[0].as_py() * ARITY**step
            for a in range(0, n, 1024):
                b = min(n, a + 1024)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("id").slice(a, b - a),
                        pa.array([s.decode() for s in slots[a:b]]),
                        pa.array(np.arange(base + a, base + b)),
                        pa.array([subroot] * (b - a), pa.string()),
                        pa.array([path_of(s) for s in within[a:b]], pa.string()),
                        pa.array([fold(d, s).decode() for d, s in zip(told[a:b], within[a:b], strict=True)]),
                    ],
                    names=["id", "leaf", "place", "subroot", "path", "folded_root"],
                )

    done = _with_paths(nodes, paths, step).mapInArrow(run, f"id {kind.simpleString()}, leaf string, place long, subroot string, path string, folded_root string")
    return done.select(F.col("id").alias(id_col), "leaf", "place", "subroot", F.lit(root).alias("root"), "path", "folded_root")
