"""Language-model scoring with a log-frequency Bloom filter of bigram counts.

Counts come from all training documents.  A bigram seen c times is stored under
the keys (bigram, 1) ... (bigram, q), q = 1 + floor(log_b c): a reader probes one
level after another until one is missing and so finds the quantised count.  The
filter is made of segments, one for each range of bigram hashes; a pass broadcasts
segments of bounded total size to the workers.  A text's score is a sum over its
tokens and each token's bigram lies in one segment, so passes add up.

The probability of a token after another is Dirichlet-smoothed,
(c2 + mu p(w)) / (c1 + mu), with c2 from the filter (rounded down), c1 the exact
count of the first token and p(w) the exact smoothed unigram probability.  Counting
goes by groups of documents: a group hands on each distinct token and bigram once,
and gets the whole counts of its tokens back.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmerge.llm.arrow import STEP_BYTES, give_back, pack_counts, pack_keys, steps, texts, unpack_counts, unpack_keys
from quillmerge.sources.scratch import materialise, scratch_path

#: Base of the count levels, bits for a stored key, probes for a key.
LEVEL_BASE, KEY_BITS, PROBES = 2.0, 10, 4
#: Weight of the unigram distribution against a bigram's context.
MU = 64.0
#: Bytes of filter segments that one pass broadcasts; bytes of a segment, about.
PASS_BYTES, SEGMENT_BYTES = 128 << 20, 2 << 20
#: Text bytes of a document group.
GROUP_BYTES = 16 << 20
#: Hash of the end of a text, which is also what precedes its first word.
END = np.uint64(0x5851F42D4C957F2D)


class Tokens:
    """64-bit hashes of a text's words (ASCII blanks split, A-Z lower-cased), END last."""

    def __init__(self, most: int = 1_000_000):
        self.memo: dict[bytes, int] = {}
        self.most = most

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        memo, digest = self.memo, xxhash.xxh64_intdigest
        if len(memo) < self.most:
            for w in set(words).difference(memo):
                memo[w] = digest(w)
            out = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        else:
            out = np.fromiter((memo[w] if w in memo else digest(w) for w in words), np.uint64, len(words))
        return np.append(out, END)


def bigrams(tokens: np.ndarray) -> np.ndarray:
    """A hash for each token with the one before it (END before the first)."""
    before = np.concatenate(([END], tokens[:-1]))
    h = before * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += tokens
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(30)
    return h


# ---------------------------------------------------------------- the filter


def levels(counts: np.ndarray) -> np.ndarray:
    """Number of keys that a count is stored under."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The least count of a level, 0 for level 0."""
    return np.where(level > 0, np.round(LEVEL_BASE ** (level - 1.0)), 0.0)


def _bits(keys: np.ndarray, level: np.ndarray | int, n_bits: int) -> Iterator[np.ndarray]:
    """The bit positions of keys at a level."""
    a = keys * np.uint64(0x94D049BB133111EB) + np.asarray(level).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    a ^= a >> np.uint64(32)
    a *= np.uint64(0xD6E8FEB86659FD93)
    b = (a >> np.uint64(17)) | np.uint64(1)
    for _ in range(PROBES):
        yield ((a >> np.uint64(11)) % np.uint64(n_bits)).astype(np.int64)
        a = a + b * np.uint64(0x9E3779B97F4A7C15)


def build_segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The bit array of one segment's bigrams."""
    q = levels(counts)
    n_bits = max(64, -(-int(q.sum()) * KEY_BITS // 64) * 64)
    marks = np.zeros(n_bits, np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        for at in _bits(keys[q >= level], level, n_bits):
            marks[at] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def probe(segment: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key: probed upwards until a key is missing."""
    out, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
    level = 1
    while len(live):
        hit = np.ones(len(live), bool)
        for at in _bits(keys[live], level, len(segment) * 8):
            hit &= (segment[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        live = live[hit]
        out[live] = level
        level += 1
    return out


# ---------------------------------------------------------------- counting


def _pack(keys: np.ndarray, counts: np.ndarray, shards: int):
    """Rows (shard, keys, counts) of hashes dealt by their top bits."""
    shard = (keys >> np.uint64(40)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order].astype(np.int64)
    cut = np.searchsorted(shard, np.arange(shards + 1))
    for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if b > a:
            yield s, pack_keys(keys[a:b]), pack_counts(counts[a:b])


def _count_group(shards: int):
    """One group: its distinct tokens with their training counts, and its training bigrams, packed by shard."""

    def run(group: pa.Table) -> pa.Table:
        grp, tokens, every, train, pairs = group.column("grp")[0].as_py(), Tokens(), [], [], []
        for part in group.to_batches():
            for doc, text in zip(part.column("doc_id").to_pylist(), texts(part, "text"), strict=True):
                t = tokens(text)
                if is_held_out(doc):
                    every.append(np.unique(t))
                else:
                    train.append(t)
                    pairs.append(bigrams(t))
        empty = np.empty(0, np.uint64)
        seen, times = np.unique(np.concatenate([empty, *train]), return_counts=True)
        keys = np.union1d(seen, np.concatenate([empty, *every]))
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, seen)] = times
        rows = [(0, *row) for row in _pack(keys, counts, shards)]
        keys, counts = np.unique(np.concatenate([empty, *pairs]), return_counts=True)
        rows += [(1, *row) for row in _pack(keys, counts, shards)]
        kind, shard, k, c = zip(*rows, strict=True)
        give_back()
        return pa.table({"kind": pa.array(kind, pa.int32()), "shard": pa.array(shard, pa.int32()), "grp": pa.array([grp] * len(rows), pa.int32()), "keys": pa.array(k, pa.binary()), "counts": pa.array(c, pa.binary())})

    return run


def is_held_out(doc: int | None) -> bool:
    """A row whose crc32 of the id as text leaves 1 modulo 5 (a null id counts as empty text)."""
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 1


def _reduce_shard(table: pa.Table) -> pa.Table:
    """A shard's whole counts: to each group those of its tokens, or the filter segment of the bigrams.

    The first row of a unigram shard also carries how many distinct training tokens
    and how many training tokens the shard has.
    """
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    asked = [unpack_keys(k) for k in table.column("keys").to_pylist()]
    keys = np.concatenate(asked)
    counts = np.concatenate([unpack_counts(c) for c in table.column("counts").to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    keys, counts = keys[first], np.add.reduceat(counts, first)
    if kind:
        rows = [(kind, shard, None, build_segment(keys, counts), None, 0, 0)]
    else:
        sums = [(int((counts > 0).sum()), int(counts.sum()))] + [(0, 0)] * (len(asked) - 1)
        rows = [(kind, shard, g, pack_keys(own), pack_counts(counts[np.searchsorted(keys, own)]), *n) for g, own, n in zip(table.column("grp").to_pylist(), asked, sums, strict=True)]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "shard", "grp", "body", "counts", "n_keys", "n_events"])


COUNTS = "kind int, shard int, grp int, keys binary, counts binary"
SHARD = "kind int, shard int, grp int, body binary, counts binary, n_keys long, n_events long"


# ---------------------------------------------------------------- scoring


class Scorer:
    """Sums over the tokens whose bigram lies in the segments at hand."""

    def __init__(self, segments: dict[int, np.ndarray], missing: frozenset[int], shards: int, n_train: int, n_distinct: int):
        self.segments, self.missing, self.shards = segments, missing, shards
        self.n_train, self.total = n_train, n_train + 0.5 * (n_distinct + 1)

    def __call__(self, rows: list[np.ndarray], keys: np.ndarray, counts: np.ndarray):
        """(n_known, base, model) for each text's tokens; keys and counts are the tokens' training counts, sorted."""
        begin = np.cumsum([0, *map(len, rows)])[:-1]
        t, h = np.concatenate(rows), np.concatenate([bigrams(x) for x in rows])
        c = counts[np.searchsorted(keys, t)]
        before = np.concatenate(([0], c[:-1]))
        before[begin] = counts[np.searchsorted(keys, END)]
        shard = ((h >> np.uint64(40)) % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        level, mine = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        for s, bits in self.segments.items():
            at = order[cut[s] : cut[s + 1]]
            level[at], mine[at] = probe(bits, h[at]), True
        for s in self.missing:  # no training bigram lies there
            mine[order[cut[s] : cut[s + 1]]] = True
        p = (c + 0.5) / self.total
        model = np.where(mine, np.log10((np.minimum(count_of(level), before) + MU * p) / (before + MU)), 0.0)
        return np.add.reduceat((c > 0).astype(np.int64), begin), np.add.reduceat(np.log10(p), begin), np.add.reduceat(model, begin)


def _score_group(shared, missing: frozenset[int], shards: int, n_train: int, n_distinct: int):
    def run(group: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_keys(k) for k in known.column("keys").to_pylist()] or [np.empty(0, np.uint64)])
        counts = np.concatenate([unpack_counts(c) for c in known.column("counts").to_pylist()] or [np.empty(0, np.int64)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        scorer = Scorer({s: np.frombuffer(b, np.uint8) for s, b in shared.value.items()}, missing, shards, n_train, n_distinct)
        tokens, out = Tokens(), []
        for part in steps(group.to_batches(), "text", STEP_BYTES // 4):
            rows = [tokens(t) for t in texts(part, "text")]
            n_known, base, model = scorer(rows, keys, counts)
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array([len(r) for r in rows], pa.int64()), pa.array(n_known), pa.array(base), pa.array(model)], names=["doc_id", "row", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(out) if out else SCORED.empty_table()

    return run


SCORED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORED_DDL = "doc_id long, row long, n_tokens long, n_known long, base_score double, score double"


def _passes(sizes: dict[int, int], most: int) -> list[list[int]]:
    """The segments in runs of at most ``most`` bytes (a larger one by itself); one run at least."""
    out: list[list[int]] = [[]]
    held = 0
    for s in sorted(sizes):
        if out[-1] and held + sizes[s] > most:
            out.append([])
            held = 0
        out[-1].append(s)
        held += sizes[s]
    return out


def score_held_out(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Training counts come from all rows whose crc32(id as text) mod 5 is not 1.  A
    null text counts as empty: one token, the end.  Ids are whole numbers.  Repeated rows each count and
    come back as often.  Memory: a group of documents of about GROUP_BYTES, its
    distinct tokens, and ``pass_bytes`` of filter segments; more segments mean more
    passes over the documents.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if plain.isEmpty():
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    shards = max(16, 1 << max(0, (size // (8 * SEGMENT_BYTES)).bit_length()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = parts * max(1, -(-size // (parts * GROUP_BYTES)))
    grouped = plain.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("grp", F.pmod("row", F.lit(groups)).cast("int"))
    name = f"groups_{uuid.uuid4().hex}"  # bucketed: neither counting nor any pass shuffles the texts again
    grouped.repartition(groups, "grp").write.bucketBy(groups, "grp").option("path", scratch_path(spark, "groups")).saveAsTable(name)
    by_group = spark.table(name).groupBy("grp")

    counted = by_group.applyInArrow(_count_group(shards), COUNTS).groupBy("kind", "shard").applyInArrow(_reduce_shard, SHARD)
    counted = materialise(counted, "ngram-counts")
    totals = counted.where("kind = 0").agg(F.sum("n_events"), F.sum("n_keys")).first()
    n_train, n_distinct = totals[0] or 0, totals[1] or 0
    known = counted.where("kind = 0").select("grp", F.col("body").alias("keys"), "counts")

    sizes = {r["shard"]: r["size"] for r in counted.where("kind = 1").select("shard", F.octet_length("body").alias("size")).collect()}
    scored = None
    for i, chosen in enumerate(_passes(sizes, pass_bytes)):
        bodies = counted.where((F.col("kind") == 1) & F.col("shard").isin(chosen)).select("shard", "body").collect() if chosen else []
        shared = spark.sparkContext.broadcast({r["shard"]: bytes(r["body"]) for r in bodies})  # at most pass_bytes
        missing = frozenset(range(shards)) - sizes.keys() if i == 0 else frozenset()
        one = by_group.cogroup(known.groupBy("grp")).applyInArrow(_score_group(shared, missing, shards, n_train, n_distinct), SCORED_DDL)
        if len(_passes(sizes, pass_bytes)) > 1:  # one pass's segments at a time
            one = materialise(one, "scored-pass")
            shared.destroy()
        scored = one if scored is None else scored.unionByName(one)
    if len(_passes(sizes, pass_bytes)) > 1:
        scored = _sum_passes(scored, len(_passes(sizes, pass_bytes)))
    scored = materialise(scored, "scored")
    spark.sql(f"DROP TABLE {name}")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def _sum_passes(scored: DataFrame, passes: int) -> DataFrame:
    """One row for each document: model sums add up over the passes; equal rows come back as often as they were."""
    whole = scored.groupBy("doc_id", "row").agg((F.count("*") / passes).cast("int").alias("times"), F.first("n_tokens").alias("n_tokens"), F.first("n_known").alias("n_known"), F.first("base_score").alias("base_score"), F.sum("score").alias("total"))
    once = whole.withColumn("score", F.col("total") / F.col("times"))
    return once.select("doc_id", "n_tokens", "n_known", "base_score", "score", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")
