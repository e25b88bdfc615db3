"""Exact substring deduplication with suffix sorting by bucket-pointer refinement.

A string of ``length`` bytes that also starts in a document with a smaller id is
removed.  Sorting every suffix of the corpus would shuffle it many times over, so
candidates are found first: every ``length``-byte window has one *anchor*, the
``GRAM``-byte gram of least hash in it, and equal windows have equal anchors.  Only
runs of windows whose anchor is in two or more documents go on, as short segments
dealt out by anchor.  Each task sorts the suffixes of its segments: q-gram buckets
first, then every bucket that still holds several suffixes is refined by the
bucket of the suffix a few bytes on, doubling the depth with the refined bucket
pointers until ``length`` bytes are told apart.  Windows of one bucket are equal;
those beyond the smallest document of their bucket are removed.

Steps: (1) texts equal to a smaller document's are settled by hash, (2) the rest
are written in groups of bounded size, bucketed by group, so that later steps read
them without a shuffle, (3) each group lists its anchors, (4) shards of anchors tell
the shared ones, (5) each group hands on its distinct segments once, with the least
and the greatest document that holds them, (6) the segments of all groups meet by anchor:
suffix sorting, (7) each group gets the answers to its segments and removes its
ranges.  So an anchor of very many segments in one text, or of one segment in very
many texts, is a few rows.  An anchor with very many segments all the same is not
sorted in one task: its windows are grouped by themselves, with a map-side minimum.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmerge.llm.arrow import give_back, pack_counts, pack_keys, texts, unpack_counts, unpack_keys
from quillmerge.sources.scratch import materialise, scratch_path

#: Bytes of an anchor gram (between 16 and 24, and under the window's length).
GRAM = 20
#: Segments of an anchor beyond which its windows are grouped one by one.
HOT_SEGMENTS = 20_000
#: Text bytes of a group; anchors of a shard follow from it.
GROUP_BYTES = 32 << 20
#: Windows of a text that are looked at at a time.
CHUNK = 1 << 20
#: Segment bytes that a suffix sort holds at a time.
SORT_BYTES = 1 << 20


# ---------------------------------------------------------------- anchors


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every position of ``data`` (uint8)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    word = lambda at: np.ndarray((n,), "<u8", data, at, (1,))  # noqa: E731  unaligned 8-byte reads
    h = word(0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += word(8)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += word(GRAM - 8)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h


def anchor_chunks(text: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first, last): the anchor of each run of windows that share one, and their first and last start, stretch by stretch of the text."""
    for lo in range(0, len(text) - length + 1, CHUNK):
        data = np.frombuffer(text[lo : lo + CHUNK + length - 1], np.uint8)
        h = gram_hashes(data)
        # low bits give way to the position: ties fall on the leftmost gram
        low = (h & ~np.uint64(0x7FFFFF)) | np.arange(len(h), dtype=np.uint64)
        width, reach = length - GRAM + 1, 1
        while 2 * reach <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        at = (low & np.uint64(0x7FFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        yield h[at[first]], first + lo, last + lo


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a whole text."""
    found = list(anchor_chunks(text, length)) or [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchor_counts(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of a text, sorted, and how many runs each has."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(text) < CHUNK:
        for h, _, _ in anchor_chunks(text, length):
            return np.unique(h, return_counts=True)
    for h, _, _ in anchor_chunks(text, length):
        some, n = np.unique(h, return_counts=True)
        keys, at = np.unique(np.concatenate([keys, some]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    return keys, counts


def run_windows(text: bytes, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, hash) of every window of runs within one stretch; equal windows have equal hashes."""
    lo, n = int(first[0]), last - first + 1
    run = np.repeat(np.arange(len(n)), n)
    start = np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)
    grams = gram_hashes(np.frombuffer(text[lo : int(last[-1]) + length], np.uint8))
    h = grams[start - lo]
    for offset in [*range(GRAM, length - GRAM, GRAM), length - GRAM]:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + grams[start - lo + offset]
    return run, start, h


# ---------------------------------------------------------------- suffix sorting


def equal_windows(data: np.ndarray, owner_end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, bucket): every start whose ``length`` bytes end by ``owner_end``, and its bucket of equal windows.

    Bucket-pointer refinement.  ``bucket[i]`` points from a suffix to its bucket at
    the depth reached; only suffixes in buckets of several are sorted again, by the
    bucket of the suffix ``depth`` bytes later.  Windows alone in their bucket are
    left out of the result.
    """
    n = len(data)
    depth = min(8, length)
    room = owner_end - np.arange(n, dtype=np.int32)
    live = np.flatnonzero(room >= depth).astype(np.int32)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    gram = np.ndarray((n,), ">u8", padded, 0, (1,))[live].astype(np.uint64) >> np.uint64(8 * (8 - depth))
    bucket = np.full(n, -1, np.int32)
    bucket[live] = _ranked(gram)
    while depth < length:
        step = min(depth, length - depth)
        here = live[room[live] >= depth + step]
        sizes = np.bincount(bucket[here]) if len(here) else np.zeros(1, np.int64)
        shared = sizes[bucket[here]] > 1
        several, alone = here[shared], here[~shared]
        if not len(several):
            return several, several
        pair = bucket[several].astype(np.int64) << 32 | bucket[several + np.int32(step)]
        fresh = np.full(n, -1, np.int32)
        fresh[several] = _ranked(pair)
        # suffixes alone in their bucket keep a pointer of their own: others may lead to them
        fresh[alone] = fresh[several].max() + 1 + np.arange(len(alone), dtype=np.int32)
        bucket, depth, live = fresh, depth + step, here
    sizes = np.bincount(bucket[live]) if len(live) else np.zeros(1, np.int64)
    live = live[sizes[bucket[live]] > 1]
    return live, bucket[live]


def _ranked(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys."""
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(keys), np.int32)
    sorted_ = keys[order]
    rank[order] = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1], dtype=np.int32))) if len(keys) else []
    return rank


def removed_ranges(docs: np.ndarray, segments: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(segment, begin, end) of the bytes that a window of a smaller document covers."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int32, len(segments))
    ends = np.cumsum(sizes, dtype=np.int32)
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), sizes)
    starts, bucket = equal_windows(data, ends[owner], length)
    if not len(starts):
        return []
    least = np.full(bucket.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, bucket, docs[owner[starts]])
    gone = np.sort(starts[least[bucket] < docs[owner[starts]]])
    if not len(gone):
        return []
    new = (np.diff(gone, prepend=gone[0] - length - 1) > length) | (np.diff(owner[gone], prepend=-1) != 0)
    first = np.flatnonzero(new)
    seg, begin, end = owner[gone[first]], gone[first], gone[np.append(first[1:], len(gone)) - 1] + length
    base = ends[seg] - sizes[seg]
    return list(zip(seg.tolist(), (begin - base).tolist(), (end - base).tolist(), strict=True))


# ---------------------------------------------------------------- Spark steps


def _list_anchors(length: int, shards: int):
    """One group's anchors, a row for each shard: sorted hashes as differences, how many documents hold each and how often."""

    def run(group: pa.Table) -> pa.Table:
        grp = group.column("grp")[0].as_py()
        found = [anchor_counts(t, length) for b in group.to_batches() for t in texts(b, "text")]
        empty = np.empty(0, np.int64)
        keys, at = np.unique(np.concatenate([empty.view(np.uint64), *(k for k, _ in found)]), return_inverse=True)
        docs = np.bincount(at, minlength=len(keys))
        runs = np.bincount(at, np.concatenate([empty, *(n for _, n in found)]), len(keys)).astype(np.int64)
        shard = (keys >> np.uint64(40)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        keys, docs, runs, shard = keys[order], docs[order], runs[order], shard[order].astype(np.int64)
        cut = np.searchsorted(shard, np.arange(shards + 1))
        rows = [(s, grp, pack_keys(keys[a:b]), pack_counts(docs[a:b]), pack_counts(runs[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        cols = zip(*rows, strict=True) if rows else [[], [], [], [], []]
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "grp", "keys", "docs", "runs"])

    return run


def _shared_anchors(hot_segments: int):
    """One shard: for each group the anchors that another document holds too, and which of them are hot."""

    def run(shard: pa.Table) -> pa.Table:
        groups = shard.column("grp").to_pylist()
        keys = [unpack_keys(k) for k in shard.column("keys").to_pylist()]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = lambda c: np.bincount(inverse, np.concatenate([unpack_counts(x) for x in shard.column(c).to_pylist()]), len(every)).astype(np.int64)
        docs, runs = total("docs"), total("runs")
        rows = []
        for g, own in zip(groups, keys, strict=True):
            at = np.searchsorted(every, own)
            shared, hot = docs[at] > 1, runs[at] > hot_segments
            if shared.any():
                rows.append((g, own[shared & ~hot].astype("<u8").tobytes(), own[shared & hot].astype("<u8").tobytes()))
        kinds = [pa.int32(), pa.binary(), pa.binary()]
        cols = zip(*rows, strict=True) if rows else [[], [], []]
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["grp", "warm", "hot"])

    return run


def _sorted_keys(table: pa.Table, column: str) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(table.column(column).to_pylist()), "<u8")) if table.num_rows else np.empty(0, np.uint64)


def _holds(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h if len(keys) else np.zeros(len(h), bool)


def _cut_segments(length: int):
    """One group: each distinct segment of a shared anchor once, of hot anchors each distinct window, with its least and greatest document."""
    names, kinds = ["anchor", "hot", "h", "segment"], [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def table(found: list[tuple], hot: bool) -> pa.Table:
        """One table of (anchors, hashes, segments, document) of many texts."""
        anchor, h, segments, doc = zip(*found, strict=True)
        sizes = [len(x) for x in segments]
        docs = np.repeat(np.array(doc, np.int64), sizes)
        columns = [np.concatenate(anchor).view(np.int64), np.full(len(docs), hot), np.concatenate(h).view(np.int64), [x for some in segments for x in some], docs, docs]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*names, "low", "high"])

    def distinct(parts: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(parts).group_by(names).aggregate([("low", "min"), ("high", "max")])
        return out.rename_columns({"low_min": "low", "high_max": "high"}).select([*names, "low", "high"])

    def run(group: pa.Table, shared: pa.Table) -> pa.Table:
        warm, hot = _sorted_keys(shared, "warm"), _sorted_keys(shared, "hot")
        none = np.empty(0, np.uint64)
        held = [table([(none, none, [], 0)], False)]
        found: tuple[list, list] = ([], [])
        size = 0

        def settle():
            nonlocal size
            fresh = [distinct([table(some, bool(is_hot))]) for is_hot, some in enumerate(found) if some]
            held[:] = [distinct([*held, *fresh])] if sum(t.num_rows for t in fresh) > CHUNK // 8 else [*held, *fresh]
            found[0].clear()
            found[1].clear()
            size = 0

        for b in group.to_batches():
            for doc, text in zip(b.column("doc").to_pylist(), texts(b, "text"), strict=True):
                for h, first, last in anchor_chunks(text, length):
                    take = _holds(warm, h)
                    if take.any():
                        runs = [text[i : j + length] for i, j in zip(first[take].tolist(), last[take].tolist(), strict=True)]
                        found[0].append((h[take], np.zeros(len(runs), np.uint64), runs, doc))
                        size += len(runs)
                    take = _holds(hot, h)
                    if take.any():
                        own, start, window = run_windows(text, first[take], last[take], length)
                        window, at = np.unique(window, return_index=True)  # one slice for each distinct window
                        found[1].append((h[take][own[at]], window, [text[i : i + length] for i in start[at].tolist()], doc))
                        size += len(at)
                    if size > CHUNK // 4:
                        settle()
            settle()
        out = distinct(held)
        grp = np.full(out.num_rows, group.column("grp")[0].as_py() if group.num_rows else 0, np.int32)
        give_back()
        return out.append_column("grp", pa.array(grp)).select(["grp", "hot", "anchor", "h", "low", "high", "segment"])

    return run


#: h is the window's hash under a hot anchor.
SEGMENTS = "grp int, hot boolean, anchor long, h long, low long, high long, segment binary"
ANSWERS = "grp int, hot boolean, anchor long, h long, low long, begins array<int>, ends array<int>"


def _sorted_ranges(length: int):
    """Segments (grp, anchor, low, high, segment) in order of their anchor: what goes of each, for each group.

    Whole anchors are taken together, about SORT_BYTES at a time.
    """

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held)
        # a segment of several groups is sorted once
        coded = part.column("segment").combine_chunks().dictionary_encode()
        own, each = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        low, high = np.full(len(each), np.iinfo(np.int64).max), np.full(len(each), np.iinfo(np.int64).min)
        np.minimum.at(low, own, part.column("low").to_numpy())
        np.maximum.at(high, own, part.column("high").to_numpy())
        begins: dict[int, list[int]] = {}
        ends: dict[int, list[int]] = {}
        for seg, a, z in removed_ranges(low, each, length):
            begins.setdefault(seg, []).append(a)
            ends.setdefault(seg, []).append(z)
        told = high > low
        told[np.fromiter(begins, np.int64, len(begins))] = True
        rows = np.flatnonzero(told[own])
        if len(rows):
            digest, at = xxhash.xxh64_intdigest, own[rows].tolist()
            hashes = np.fromiter((digest(x) if t else 0 for x, t in zip(each, told.tolist(), strict=True)), np.uint64, len(each)).view(np.int64)
            grp, anchor = (part.column(c).to_numpy()[rows] for c in ("grp", "anchor"))
            lists = [pa.array([x.get(r, []) for r in at], pa.list_(pa.int32())) for x in (begins, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int32()), pa.array(np.zeros(len(rows), bool)), pa.array(anchor), pa.array(hashes[own[rows]]), pa.array(low[own[rows]]), *lists], names=["grp", "hot", "anchor", "h", "low", "begins", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= SORT_BYTES:
                # up to where the last anchor held ends
                final, keys = held[-1].column("anchor")[-1].as_py(), batch.column("anchor").to_numpy()
                more = int(np.searchsorted(keys != final, True))
                if more < batch.num_rows:
                    yield from emit([*held, batch.slice(0, more)] if more else held)
                    held, size, batch = [], 0, batch.slice(more)
            held.append(batch)
            size += batch.column("segment").nbytes
        if held:
            yield from emit(held)
        give_back()

    return run


def _spans(text: bytes, doc: int, length: int, warm: np.ndarray, answers: dict[int, tuple], hot: np.ndarray, windows: np.ndarray, least: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of one text that go.

    ``answers`` are keyed by anchor and hash of a segment of the anchors ``warm``;
    ``windows`` are the sorted hashes of windows of the anchors ``hot``, ``least`` their documents.
    """
    digest, out = xxhash.xxh64_intdigest, []
    for h, first, last in anchor_chunks(text, length):
        take = _holds(warm, h)
        for k, a, z in zip(h[take].tolist(), first[take].tolist(), last[take].tolist(), strict=True):
            found = answers.get(k << 64 | digest(text[a : z + length]))
            if found is not None:
                low, begins, ends = found
                if doc > low:
                    out.append((a, z + length))
                elif doc == low:
                    out += [(a + i, a + j) for i, j in zip(begins, ends, strict=True)]
        take = _holds(hot, h)
        if take.any() and len(windows):
            _, start, window = run_windows(text, first[take], last[take], length)
            at = np.minimum(np.searchsorted(windows, window), len(windows) - 1)
            gone = start[(windows[at] == window) & (least[at] < doc)]
            begin = np.flatnonzero(np.diff(gone, prepend=-length - 1) > length)
            out += zip(gone[begin].tolist(), (gone[np.append(begin[1:], len(gone)) - 1] + length).tolist(), strict=True) if len(gone) else []
    return out


def _remove(length: int):
    """One group: every text without its ranges."""

    def run(group: pa.Table, told: pa.Table) -> pa.Table:
        hot = told.column("hot").to_numpy(zero_copy_only=False).astype(bool)
        anchor, h = (np.array(told.column(c).to_numpy(), np.int64).view(np.uint64) for c in ("anchor", "h"))
        least = np.array(told.column("low").to_numpy(), np.int64)
        plain = told.filter(pa.array(~hot))
        keys = [a << 64 | x for a, x in zip(anchor[~hot].tolist(), h[~hot].tolist(), strict=True)]
        answers = dict(zip(keys, zip(*[plain.column(c).to_pylist() for c in ("low", "begins", "ends")], strict=True), strict=True))
        order = np.argsort(h[hot])
        known = (np.unique(anchor[~hot]), answers, np.unique(anchor[hot]), h[hot][order], least[hot][order])
        out: list[list] = [[] for _ in range(5)]
        for b in group.to_batches():
            for doc, copy, text in zip(b.column("doc").to_pylist(), b.column("copy").to_pylist(), texts(b, "text"), strict=True):
                spans = [(0, len(text))] if copy else [] if doc is None else _spans(text, doc, length, *known)
                kept, at, gone, n = [], 0, 0, 0
                for a, z in sorted(spans):
                    if a > at or not n:
                        n += 1
                        kept.append(text[at:a])
                    gone += max(0, z - max(a, at))
                    at = max(at, z)
                kept.append(text[at:])
                for c, v in zip(out, (doc, len(text), gone, n, b"".join(kept)), strict=True):
                    c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        give_back()
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row of ``docs``.

    Texts are UTF-8 bytes, null counts as empty, ids are whole numbers.  Rows of one
    id take nothing from each other, as neither id is smaller; a row with a null id
    keeps everything and takes nothing.  ``kept`` may end inside a character.
    """
    if not GRAM < length:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = parts * max(1, -(-size // (parts * GROUP_BYTES)))  # a shuffle partition holds whole groups
    shards = max(16, 1 << (groups - 1).bit_length())

    # 1. the smallest document of each text; others of that text are copies
    hashed = plain.where(F.octet_length("text") >= length).where("doc is not null").select("doc", F.sha2("text", 256).alias("sha"))
    least = hashed.groupBy("sha").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    copies = hashed.join(least, "sha").where("doc > least").groupBy("doc").agg(F.collect_set("sha").alias("shas"))
    marked = plain.join(copies.hint("shuffle_hash"), "doc", "left").withColumn("copy", F.array_contains("shas", F.sha2("text", 256)))

    # 2. groups of bounded size
    name = f"groups_{uuid.uuid4().hex}"
    whole = marked.select(F.pmod(F.hash("doc"), F.lit(groups)).cast("int").alias("grp"), "doc", F.coalesce("copy", F.lit(False)).alias("copy"), "text")
    whole.write.bucketBy(groups, "grp").option("path", scratch_path(spark, "groups")).saveAsTable(name)
    table = spark.table(name)
    first = table.where(~F.col("copy") & F.col("doc").isNotNull()).groupBy("grp")

    # 3. - 5. anchors, the shared ones, segments
    listed = first.applyInArrow(_list_anchors(length, shards), "shard int, grp int, keys binary, docs binary, runs binary")
    shared = materialise(listed.groupBy("shard").applyInArrow(_shared_anchors(hot_segments), "grp int, warm binary, hot binary"), "shared-anchors")
    segments = first.cogroup(shared.groupBy("grp")).applyInArrow(_cut_segments(length), SEGMENTS)
    segments = materialise(segments, "segments")

    # 6. what goes of each segment: an anchor that is not hot has a bounded number of them
    warm = segments.where(~F.col("hot")).select("grp", "anchor", "low", "high", "segment").repartition("anchor").sortWithinPartitions("anchor")
    windows, none = segments.where("hot"), F.array().cast("array<int>")
    lowest = windows.groupBy("anchor", "h", "segment").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("anchor", "h", "low")
    hot = windows.select("grp", "hot", "anchor", "h").join(lowest, ["anchor", "h"]).select("grp", "hot", "anchor", "h", "low", none.alias("begins"), none.alias("ends"))
    told = warm.mapInArrow(_sorted_ranges(length), ANSWERS).unionByName(hot)

    # 7. removal
    return table.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
