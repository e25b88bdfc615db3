"""Near copies by exact Jaccard similarity of word shingles.

What decides is the exact Jaccard similarity of the shingle sets; SimHash finds
what to compare, and MinHash bands find the rest:

1. equal shingle sets are one set from here on,
2. sets whose SimHash values lie ``TAU`` or fewer of 64 bits apart, found by
   generalised pigeonhole partitioning (``simhash``), are candidates,
3. the sets of a component of candidates meet in one task, in parts where it is
   large; a prefix index over the rarest shingles finds every pair that can reach the
   similarity, and a pair that reaches it is a link,
4. two texts of Jaccard 0.8 lie about ten bits apart, many of them more, and no
   partition can be probed at a distance that takes them all.  A MinHash band that
   sets of different linked groups share makes these sets candidates again, and they
   meet as in 3.

A task hands on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmerge.llm.arrow import steps, texts
from quillmerge.llm.meet import links_within
from quillmerge.llm.numbered import clashing, first_of_each, numbered_rows
from quillmerge.llm.simhash import linked, signature
from quillmerge.operators.components import connected_components
from quillmerge.sources.scratch import materialise

#: SimHash bits that candidates differ in at most: the mean distance of a pair with Jaccard 0.8.
TAU = 10
#: A pair with Jaccard 0.8 shares no band with probability (1 - 0.8 ** 4) ** 24, 3 in a million.
BANDS, BAND_ROWS = 24, 4
#: Shingles that a part of a component holds; a task holds two parts at most.
PART_SHINGLES = 2 << 20
_RNG = np.random.default_rng(20)
MULTS = _RNG.integers(1 << 31, size=BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SALTS = _RNG.integers(1 << 63, size=BANDS, dtype=np.uint64)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles (ASCII blanks split, A-Z lower-cased); a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(0, len(words) - width)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    spans = zip(starts[: k + 1].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(view[a:b], 42) for a, b in spans), np.uint64, k + 1))


def bands(own: np.ndarray) -> np.ndarray:
    """One key for each MinHash band of a set that is not empty."""
    short = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(MULTS), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(least, (short[None, i : i + 2048] * MULTS[:, None]).min(axis=1), out=least)
    key = SALTS.copy()
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _sets(rows: DataFrame, text_col: str, width: int) -> DataFrame:
    """(row, set_key binary, fp, n, keys array<long>) of each row of (row, text); ``fp``: the SimHash value of the set."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(parts, text_col):
            own = [shingle_set(t, width) for t in texts(part, text_col)]
            keys = [bands(s) if len(s) else np.zeros(0, np.int64) for s in own]
            ends = np.cumsum([0, *map(len, keys)])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()),
                    pa.array(np.array([signature(s) for s in own], np.uint64).view(np.int64)),
                    pa.array([len(s) for s in own], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys), pa.int64())),
                ],
                names=["row", "set_key", "fp", "n", "keys"],
            )

    return rows.select("row", text_col).mapInArrow(run, "row long, set_key binary, fp long, n long, keys array<long>")


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span what pairs of Jaccard ``similarity`` or more connect; the sets are distinct and not empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # tokens are numbered anew, rare ones first; sets that are alike enough share one of their first tokens
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    token = rank[token]
    owner = np.repeat(np.arange(len(sets)), sizes)
    token = token[np.lexsort((token, owner))]
    first = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    lead = np.arange(len(token)) - begin[owner] < first[owner]
    order = np.argsort(token[lead], kind="stable")
    held, docs = token[lead][order], owner[lead][order]
    mark, seen, left = np.zeros(len(df), bool), np.zeros(len(sets), bool), len(sets)
    links: list[tuple[int, int]] = []
    for start in range(len(sets)):
        if seen[start]:
            continue
        seen[start], stack, left = True, [start], left - 1
        while stack and left:
            x = stack.pop()
            mine = token[begin[x] : begin[x + 1]]
            lo, hi = np.searchsorted(held, mine[: first[x]], "left"), np.searchsorted(held, mine[: first[x]], "right")
            n = hi - lo
            pool = np.unique(docs[np.repeat(hi - np.cumsum(n), n) + np.arange(int(n.sum()))])
            pool = pool[~seen[pool]]
            pool = pool[(sizes[pool] >= similarity * sizes[x] - 1e-9) & (sizes[x] >= similarity * sizes[pool] - 1e-9)]
            if not len(pool):
                continue
            mark[mine] = True
            for i in range(0, len(pool), 256):
                some = pool[i : i + 256]
                n = sizes[some]
                at = np.repeat(begin[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                both = np.add.reduceat(mark[token[at]].astype(np.int64), np.cumsum(n) - n)
                near = some[both >= similarity * (sizes[x] + n - both) - 1e-9]
                seen[near] = True
                left -= len(near)
                links += [(x, int(y)) for y in near]
                stack += near.tolist()
            mark[mine] = False
    return links


def _met(groups: DataFrame, rows: DataFrame, sets: DataFrame, text_col: str, width: int, similarity: float, part_shingles: int) -> DataFrame:
    """(src, dst): links of ``similarity`` or more between the candidates of each group of (row, group)."""
    members = materialise(groups.join(sets.select("row", F.col("n").alias("weight")), "row"), "candidates")
    payload = rows.select("row", F.col(text_col).alias("payload"))
    links = links_within(members, payload, lambda t: shingle_set(t or b"", width), lambda held: forest(held, similarity), part_shingles)
    return materialise(links, "jaccard-links")


def simhash_links(rows: DataFrame, sets: DataFrame, text_col: str, width: int, similarity: float, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """(src, dst): links that connect all pairs of ``similarity`` or more whose SimHash values are ``TAU`` or fewer bits apart."""
    near = linked(materialise(sets.select("row", "fp"), "fingerprints"), "row", TAU)
    return _met(near.select("row", F.col("component_id").alias("group")), rows, sets, text_col, width, similarity, part_shingles)


def jaccard_links(rows: DataFrame, sets: DataFrame, text_col: str, width: int, similarity: float, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """(src, dst): links between rows of distinct ``sets`` that connect all candidate pairs of ``similarity`` or more.

    SimHash links first; a MinHash band whose sets these left in several groups makes its
    sets candidates.  The sets of a component of candidates meet in a task, in parts of
    about ``part_shingles`` shingles where they are more (``meet``).
    """
    near = simhash_links(rows, sets, text_col, width, similarity, part_shingles)
    done = connected_components(near).withColumnRenamed("node", "row")
    keyed = sets.select("row", "keys").join(done, "row", "left").select("row", F.coalesce("component", "row").alias("of"), F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("row").alias("least"), F.min("of").alias("a"), F.max("of").alias("b")).where("a < b").select("key", "least")
    stars = keyed.join(least, "key").where("row <> least").select(F.col("least").alias("src"), F.col("row").alias("dst")).distinct()
    nodes = connected_components(stars).select(F.col("node").alias("row"), F.col("component").alias("group"))
    return near.unionByName(_met(nodes, rows, sets, text_col, width, similarity, part_shingles))


def components(rows: DataFrame, *, text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, component) of every row: pairs of Jaccard ``similarity`` or more connect; texts without words are alike."""
    every = materialise(_sets(rows, text_col, width), "shingle-sets")
    alike = every.groupBy("set_key").agg(F.min("row").alias("set_row"))
    apart = every.join(alike.select(F.col("set_row").alias("row")), "row", "left_semi")
    links = jaccard_links(rows, apart.where("n > 0"), text_col, width, similarity)
    linked = connected_components(links).select(F.col("node").alias("set_row"), "component")
    whole = every.select("row", "set_key").join(alike, "set_key").join(linked, "set_row", "left")
    return whole.select("row", F.coalesce("component", "set_row").alias("component"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with exactly one row of each group of near copies, whatever ids repeat or are null.

    A null text counts as empty, and all texts without words are one group.  Equal ids
    with different texts are different rows; an empty table stays empty.
    """
    own = clashing(docs)
    rows = numbered_rows(docs.withColumnsRenamed(own), text_col)
    kept = first_of_each(rows, components(rows, text_col=text_col, width=width, similarity=similarity), id_col)
    return kept.withColumnsRenamed({new: old for old, new in own.items()})
