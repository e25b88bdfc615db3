"""MinHash near-dedup with b-bit signatures.

1. A text is its set of distinct word shingles; equal sets are one set from here on.
2. Each set has ``HASHES`` minima.  Runs of ``BAND_ROWS`` whole minima are its band
   keys, and the lowest ``BITS`` bits of every minimum are its packed signature.
3. Sets that share a band key are candidates.  A pair's signatures agree by chance in
   one field of 2**BITS, so agreement a among all fields estimates a similarity of
   (a - C) / (1 - C), C = 2**-BITS; it comes from a few bit counts.  Pairs whose
   agreement is lower than a pair of the wanted similarity would show in one case of
   10**9 are dropped.
4. What is left connects sets to small groups, in which the full sets decide.

Neither step lists the pairs of a group: both hand on spanning forests (``meet``).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmerge.llm.arrow import steps, texts
from quillmerge.llm.meet import links_within
from quillmerge.llm.numbered import numbered_rows
from quillmerge.llm.similar import forest, shingle_set
from quillmerge.operators.components import connected_components
from quillmerge.sources.scratch import materialise

#: A pair of similarity 0.85 shares no band with probability (1 - 0.85 ** 4) ** 32, 6 in 10**11.
HASHES, BAND_ROWS, BITS = 128, 4, 2
#: Signatures of a part of a bucket, and shingles of a part of a group.
PART_ROWS, PART_SHINGLES = 1 << 15, 2 << 20
#: Chance that the bit counts drop a pair of exactly the wanted similarity.
MISS = 1e-9
_RNG = np.random.default_rng(12)
MULTS = _RNG.integers(1 << 31, size=HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SALTS = _RNG.integers(1 << 63, size=HASHES // BAND_ROWS, dtype=np.uint64)
LOW = np.uint64(int("01" * (64 // BITS), 2))


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash; the set is not empty."""
    short = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(least, (short[None, i : i + 2048] * MULTS[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    key = SALTS.copy()
    for column in least.reshape(-1, BAND_ROWS).T:
        key = (key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def signature(least: np.ndarray) -> bytes:
    """The lowest two bits of each minimum, 32 of them to a word."""
    fields = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(fields << np.arange(0, 64, BITS, dtype=np.uint64), axis=1).tobytes()


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many fields of the signatures differ, along the last axis."""
    differ = a ^ b
    return np.bitwise_count((differ | (differ >> np.uint64(1))) & LOW).sum(axis=-1, dtype=np.int64)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of pairs with so many differing fields."""
    chance = 2.0**-BITS
    return (1 - np.asarray(differing) / HASHES - chance) / (1 - chance)


def most_differing(percent: int) -> int:
    """Differing fields that a pair of just this similarity exceeds with chance ``MISS`` at most."""
    differ = (1 - Fraction(percent, 100)) * (1 - Fraction(1, 2**BITS))
    tail, k = Fraction(0), HASHES + 1
    while tail <= Fraction(MISS):
        k -= 1
        tail += comb(HASHES, k) * differ**k * (1 - differ) ** (HASHES - k)
    return k


def likely(most: int):
    """A spanning forest of the pairs of signatures with ``most`` or fewer differing fields."""
    low = int.from_bytes(np.full(HASHES * BITS // 64, LOW).tobytes(), "little")

    def few(held: list[bytes]) -> list[tuple[int, int]]:
        value = [int.from_bytes(x, "little") for x in held]
        links, stack, unseen = [], [], set(range(len(value)))
        while unseen:
            x = stack.pop() if stack else min(unseen)
            unseen.discard(x)
            near = [y for y in sorted(unseen) if (((d := value[x] ^ value[y]) | d >> 1) & low).bit_count() <= most]
            unseen.difference_update(near)
            links += [(x, y) for y in near]
            stack += near
        return links

    def many(held: list[bytes]) -> list[tuple[int, int]]:
        value = np.frombuffer(b"".join(held), np.uint64).reshape(len(held), -1)
        links, stack, unseen = [], [], np.arange(len(held))
        while len(unseen):
            if not stack:
                stack, unseen = [int(unseen[0])], unseen[1:]
            x = stack.pop()
            near = unequal(value[unseen], value[x]) <= most
            links += [(x, y) for y in unseen[near].tolist()]
            stack += unseen[near].tolist()
            unseen = unseen[~near]
        return links

    return lambda held: few(held) if len(held) < 12 else many(held)


def _sets(rows: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(row, id_col, set_key binary, n, keys array<long>, payload binary) of each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(parts, text_col):
            own = [shingle_set(t, width) for t in texts(part, text_col)]
            least = [minima(s) if len(s) else None for s in own]
            keys = [np.zeros(0, np.int64) if m is None else band_keys(m) for m in least]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    part.column(id_col),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()),
                    pa.array([len(s) for s in own], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys), pa.int64())),
                    pa.array([None if m is None else signature(m) for m in least], pa.binary()),
                ],
                names=["row", id_col, "set_key", "n", "keys", "payload"],
            )

    plain = rows.select("row", id_col, text_col)
    return plain.mapInArrow(run, f"row long, `{id_col}` {plain.schema[id_col].dataType.simpleString()}, set_key binary, n long, keys array<long>, payload binary")


def likely_links(sets: DataFrame, percent: int, part_rows: int = PART_ROWS) -> DataFrame:
    """(src, dst): links of distinct sets that share a band and whose signatures may be alike enough."""
    keyed = sets.select("row", F.explode("keys").alias("group"))
    shared = keyed.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    members = materialise(keyed.join(shared, "group").select("group", "row", F.lit(1).cast("long").alias("weight")), "buckets")
    return links_within(members, sets.select("row", "payload"), bytes, likely(most_differing(percent)), part_rows).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85, part_rows: int = PART_ROWS, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``.

    Words are split at ASCII blanks, A-Z lower-cased; a text with fewer than ``width``
    words is one shingle.  Rows link where 100 x the common shingles reach ``percent`` x
    all of both; component_id is the smallest id reachable, the row's own included, and
    kept tells whether it is the row's own.  A null or empty text, or one of blanks,
    has no shingles and links with nothing, not with its like either.  Rows with one id
    are rows of their own; a null id links like any other, is a component's id only
    where the component has no other, and is then kept.  An empty table stays empty;
    other columns play no part, whatever their names.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = numbered_rows(plain)
    every = materialise(_sets(rows, "id", "text", width), "shingle-sets")
    alike = every.where("n > 0").groupBy("set_key").agg(F.min("row").alias("set_row"))
    apart = materialise(every.join(alike.select(F.col("set_row").alias("row")), "row", "left_semi").select("row", "n", "keys", "payload"), "distinct-sets")
    maybe = connected_components(likely_links(apart, percent, part_rows))
    groups = materialise(maybe.join(apart.select("row", "n"), maybe["node"] == apart["row"]).select(F.col("component").alias("group"), "row", F.col("n").alias("weight")), "candidates")
    exact = lambda held: forest(held, percent / 100)
    links = links_within(groups, rows.select("row", F.col("text").alias("payload")), lambda t: shingle_set(t or b"", width), exact, part_shingles)
    linked = connected_components(links).select(F.col("node").alias("set_row"), "component")
    whole = every.select("row", "id", "n", "set_key").join(alike, "set_key", "left").join(linked, "set_row", "left")
    whole = whole.select("id", "n", F.coalesce("component", "set_row", "row").alias("component"))
    least = whole.groupBy("component").agg(F.min("id").alias("least"))
    return whole.join(least, "component").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"))
