"""SimHash near-duplicates linked by generalised pigeonhole partitioning.

Fingerprints (one 64-bit value per text) are reduced to distinct values first,
so copies never meet each other.  The 64 bits are then grouped into partitions,
correlated bits together, and each partition gets its own threshold: with m
partitions and thresholds that sum to tau - m + 1 (-1: not probed) two values
within tau bits must agree within the threshold of at least one partition.  The
thresholds and m come from dynamic programming over estimated candidate counts,
which use the bit statistics of all fingerprints.  Every value is stored once
per probed partition and probes the values a few flipped bits away; a bucket is
verified locally and hands on a spanning forest, never all pairs; one too large
for a task meets by parts (``meet``).

Partitions are used twice.  The shuffle takes those without probes as long as the
buckets fit a task, so it moves tau + 1 rows a value however many values there are.
A task that holds a large bucket makes partitions for it, and probes them itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmerge.llm.arrow import steps, texts
from quillmerge.llm.meet import links_within
from quillmerge.llm.numbered import clashing, first_of_each, numbered_rows
from quillmerge.operators.components import connected_components
from quillmerge.sources.scratch import materialise

BITS = 64
#: Stored values of one bucket that a task takes at a time; larger buckets meet by parts.
CELL = 1 << 19
#: Values of a bucket that a task compares each with each; it probes a larger bucket's partitions.
EACH = 1 << 15
#: Comparisons that numpy makes at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of the text's word shingles (ASCII blanks split, A-Z lower-cased)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(0, len(words) - width)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    spans = zip(starts[: k + 1].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    return signature(np.fromiter((digest(view[a:b], 42) for a, b in spans), np.uint64, k + 1))


def signature(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; none: 0."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id_col, fp long) for every row; a null text counts as empty, an empty one has fingerprint 0."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(parts, text_col):
            fps = np.array([fingerprint(t, width) for t in texts(part, text_col)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(fps)], names=[id_col, "fp"])

    plain = docs.select(id_col, text_col)
    return plain.mapInArrow(run, plain.select(id_col, F.lit(0).cast("long").alias("fp")).schema)


# ---------------------------------------------------------------- partitions and thresholds


def bit_statistics(values: DataFrame) -> tuple[int, np.ndarray]:
    """(n, co) over all values: co[i, j] = how many have both bits i and j set."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, co = 0, np.zeros((BITS, BITS))
        for part in parts:
            fp = part.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            n, co = n + len(fp), co + bits.T @ bits
        if n:
            cell = np.arange(BITS * BITS + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(co.ravel(), n).astype(np.int64))], names=["cell", "n"])

    rows = values.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1)
    for r in rows:
        out[r["cell"]] = r["n"]
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def group_bits(n: int, co: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal width; each is grown by the bits most correlated with it."""
    p = np.diag(co) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(co / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    left, out = set(range(BITS)), []
    for i in range(m):
        width = len(left) // (m - i)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < width:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def within(p: np.ndarray, most: int) -> np.ndarray:
    """P(distance <= t) for t = 0..most when bit i differs with probability 2 p_i (1 - p_i)."""
    dist = np.zeros(most + 2)
    dist[0] = 1
    for d in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
        dist[-1] = 0
    return np.cumsum(dist[: most + 1])


def allocate(n: int, co: np.ndarray, tau: int, most: int | None = None) -> list[tuple[list[int], int]]:
    """The (bits, threshold) pairs of least estimated cost; the thresholds sum to tau - m + 1 and are ``most`` at most."""
    most = tau if most is None else most
    p = np.diag(co) / max(n, 1)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, tau + 3):
        groups, goal = group_bits(n, co, m), tau - m + 1
        table = {0: (0.0, [])}
        for bits in groups:
            near, grown = within(p[bits], tau), {}
            for used, (cost, chosen) in table.items():
                for t in range(-1, most + 1):
                    probes = sum(comb(len(bits), d) for d in range(t + 1)) * n
                    own = 0.0 if t < 0 else 20.0 * probes + 0.05 * near[t] * n * n / 2
                    if used + t not in grown or cost + own < grown[used + t][0]:
                        grown[used + t] = (cost + own, [*chosen, t])
            table = grown
        if goal in table and table[goal][0] < best[0]:
            best = (table[goal][0], [(b, t) for b, t in zip(groups, table[goal][1], strict=True) if t >= 0])
    return best[1]


def shuffled(n: int, co: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """The plan with the least highest threshold whose buckets fit a task: tau + 1 rows a value, without probes, up to about ``CELL`` * 2 ** (64 // (tau + 1)) values."""
    p = np.diag(co) / max(n, 1)
    for most in range(tau + 1):
        plan = allocate(n, co, tau, most)
        if all(n * within(p[bits], 0)[0] <= CELL for bits, _ in plan):
            break
    return plan


# ---------------------------------------------------------------- probing and verification


def _stored_and_probes(fp: np.ndarray, bits: list[int], t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, stored, fp): each value's stored row and its probes in one partition.

    Of two values whose partitions differ, only the one with a 0 in the lowest
    differing bit probes, so a pair meets once per partition.
    """
    mask = np.uint64(sum(1 << b for b in bits)).view(np.int64)
    out = [(fp & mask, np.ones(len(fp), bool), fp)]
    for d in range(1, t + 1):
        for flip in combinations(bits, d):
            mine = fp[(fp >> flip[0]) & 1 == 0]
            flips = np.uint64(sum(1 << b for b in flip)).view(np.int64)
            out.append(((mine ^ flips) & mask, np.zeros(len(mine), bool), mine))
    bucket, stored, value = (np.concatenate(x) for x in zip(*out, strict=True))
    return bucket, stored, value


def _bucket_rows(plan: list[tuple[list[int], int]]):
    """For each value its stored row and its probes: (part, bucket, stored, fp)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                fp = part.column("fp").slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(fp):
                    continue
                for k, (bits, t) in enumerate(plan):
                    bucket, stored, value = _stored_and_probes(fp, bits, t)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(value), k, np.int32)), pa.array(bucket), pa.array(stored), pa.array(value)], names=["part", "bucket", "stored", "fp"]
                    )

    return run


def _few_pairs(every: np.ndarray, n_s: int, tau: int) -> list[tuple[int, int]] | None:
    """The pairs, as positions, of stored x all values within tau bits; None where they are more than the values."""
    out: list[tuple[int, int]] = []
    step = max(1, BLOCK // len(every))
    for i in range(0, n_s, step):
        rest = every[i:]
        near = np.flatnonzero(np.bitwise_count(every[i : min(i + step, n_s), None] ^ rest) <= tau)
        a, b = np.divmod(near, len(rest))
        later = a < b
        if len(out) + np.count_nonzero(later) > len(every):
            return None
        out += zip((a[later] + i).tolist(), (b[later] + i).tolist(), strict=True)
    return out


def forest(every: np.ndarray, n_s: int, tau: int) -> list[tuple[int, int]]:
    """Links, as positions, that span what the first ``n_s`` values (stored) x all of them (probes follow) within tau bits connect."""
    every = every.view(np.uint64)
    if (few := _few_pairs(every, n_s, tau)) is not None:
        return few
    left = [(every[:n_s], np.arange(n_s)), (every[n_s:], np.arange(n_s, len(every)))]  # stored, probes: not yet reached
    links: list[tuple[int, int]] = []
    stack: list[int] = []
    while stack or len(left[0][0]):
        if not stack:
            stack, left[0] = [int(left[0][1][0])], (left[0][0][1:], left[0][1][1:])
        x = stack.pop()
        # a probe meets only stored values
        for i in range(2 if x < n_s else 1):
            value, at = left[i]
            near = np.bitwise_count(value ^ every[x]) <= tau
            if near.any():
                found, left[i] = at[near].tolist(), (value[~near], at[~near])
                links += [(x, y) for y in found]
                stack += found
    return links


def spanning(every: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links, as values, that span what distinct values within tau bits connect; many values probe partitions of their own."""
    if len(every) <= EACH:
        return [(int(every[i]), int(every[j])) for i, j in forest(every, len(every), tau)]
    co = np.zeros((BITS, BITS))
    for i in range(0, len(every), 1 << 14):
        part = np.ascontiguousarray(every[i : i + (1 << 14)])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        co += bits.T @ bits
    out: list[tuple[int, int]] = []
    for bits, t in allocate(len(every), co, tau, 1):
        bucket, stored, fp = _stored_and_probes(every, bits, t)
        order = np.argsort(bucket, kind="stable")
        out += _links_of(stored[order], bucket[order], fp[order], tau, deep=False)
    return out


def _links_of(stored: np.ndarray, group: np.ndarray, fp: np.ndarray, tau: int, deep: bool = True) -> list[tuple[int, int]]:
    """Links, as values, inside each run of equal ``group``; runs of over ``EACH`` rows go by ``spanning`` where ``deep``."""
    edges = np.flatnonzero(np.diff(group)) + 1
    starts, sizes = np.concatenate(([0], edges)), np.diff(np.concatenate(([0], edges, [len(group)])))
    out: list[tuple[int, int]] = []
    small = sizes <= 16
    for size in np.unique(sizes[small & (sizes > 1)]).tolist():
        first = starts[sizes == size]
        for i, j in combinations(range(size), 2):
            a, b = first + i, first + j
            ok = (stored[a] | stored[b]) & (fp[a] != fp[b])
            ok &= np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= tau
            out += zip(fp[a[ok]].tolist(), fp[b[ok]].tolist(), strict=True)
    for first, size in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        mine, own = fp[first : first + size], stored[first : first + size]
        if deep and size > EACH:
            out += spanning(np.unique(mine), tau)
            continue
        stored_here = np.unique(mine[own])
        every = np.concatenate([stored_here, np.setdiff1d(mine[~own], stored_here)])
        out += [(int(every[i]), int(every[j])) for i, j in forest(every, len(stored_here), tau)]
    return out


def _verified(tau: int):
    """Rows sorted by (part, bucket): the links inside each group."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray):
            new = np.concatenate(([True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)))
            pairs = _links_of(rows[:, 2] == 1, np.cumsum(new), np.ascontiguousarray(rows[:, 3]), tau)
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])

        for part in parts:
            if not part.num_rows:
                continue
            held.append(np.stack([part.column(i).cast(pa.int64()).to_numpy() for i in range(4)], axis=1))
            rows = np.concatenate(held)
            same = np.all(rows[:, :2] == rows[-1, :2], axis=1)
            cut = len(rows) - int(same[::-1].argmin()) if not same.all() else 0  # the last group may go on
            if cut:
                yield from flush(rows[:cut])
            held = [rows[cut:]]
        if held and len(held[0]):
            yield from flush(held[0])

    return run


def hamming_links(values: DataFrame, tau: int = 4, cell: int = CELL) -> DataFrame:
    """(src, dst): links between distinct ``fp`` values that connect all pairs within ``tau`` bits.

    A bucket with more than ``cell`` stored values meets by parts of about that many and
    their probes (``meet``), so that no task holds more than two parts, and no pair is
    left out.
    """
    n, co = bit_statistics(values)
    plan = shuffled(n, co, tau)
    if n < 2:
        return values.sparkSession.createDataFrame([], "src long, dst long")
    rows = values.mapInArrow(_bucket_rows(plan), "part int, bucket long, stored boolean, fp long")
    # a stored value and the probes that come with it, on average, weigh one
    weigh = [1 / (1 + sum(comb(len(bits), d) for d in range(1, t + 1)) / 2) for bits, t in plan]
    masks = [(k, int(np.uint64(sum(1 << b for b in bits)).view(np.int64)), weigh[k]) for k, (bits, _) in enumerate(plan)]
    hot = (
        values.join(F.broadcast(values.sparkSession.createDataFrame(masks, "part int, mask long, weight double")))  # a row per partition, at most tau + 2
        .groupBy("part", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"), "weight")
        .count()
        .where(F.col("count") > cell)
        .select("part", "bucket", "weight")
    )
    hot = materialise(hot, "hot-buckets")
    some = not hot.isEmpty()
    cold = rows.join(hot, ["part", "bucket"], "left_anti") if some else rows
    links = cold.repartition("part", "bucket").sortWithinPartitions("part", "bucket").mapInArrow(_verified(tau), "src long, dst long")
    if not some:
        return links
    # a value is in a bucket once, so it numbers its row there
    members = rows.join(hot, ["part", "bucket"]).select(F.xxhash64("part", "bucket").alias("group"), F.col("fp").alias("row"), "weight")
    payload = values.select(F.col("fp").alias("row"), F.col("fp").cast("string").alias("payload"))

    def local(held: list[int]) -> list[tuple[int, int]]:
        at = {v: i for i, v in enumerate(held)}
        return [(at[a], at[b]) for a, b in spanning(np.array(held, np.int64), tau)]

    met = links_within(materialise(members, "hot-rows"), payload, int, local, cell)
    return links.unionByName(met)


def linked(fps: DataFrame, id_col: str, tau: int) -> DataFrame:
    """(id_col, fp, component_id) for every row of (id_col, fp): the smallest id reachable over values ``tau`` or fewer bits apart."""
    values = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "fp-values")
    nodes = connected_components(hamming_links(values.select("fp"), tau)).withColumnRenamed("node", "fp")
    whole = values.join(nodes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = whole.select("fp", "component").join(least, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(id_col, "fp", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, tau: int = 4) -> DataFrame:
    """(id_col, fp long, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over fingerprints ``tau`` or fewer
    bits apart.  Repeated rows come back as often; a null id is returned and takes
    part only as a copy (its component is the smallest non-null id, null if none).
    """
    return linked(materialise(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints"), id_col, tau)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, tau: int = 4) -> DataFrame:
    """``docs`` with the first document of each near-duplicate group: smallest id, exactly one row, whatever ids repeat or are null."""
    own = clashing(docs)
    rows = numbered_rows(docs.withColumnsRenamed(own), text_col)
    found = near_duplicates(rows, id_col="row", text_col=text_col, width=width, tau=tau)
    kept = first_of_each(rows, found.select("row", F.col("component_id").alias("component")), id_col)
    return kept.withColumnsRenamed({new: old for old, new in own.items()})
