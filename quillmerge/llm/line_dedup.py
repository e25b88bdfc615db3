"""Line deduplication with levelled sorted runs of line hashes.

Documents arrive in batches.  Each batch reduces to a *run*: its distinct line
hashes with the number of documents that hold them, sorted by hash.  Before a
run is added it is anti-joined with the *settled* runs, which hold the hashes
already known to be in ``min_docs`` documents, so settled lines cost nothing
further.  When a level holds ``fanout`` runs they are merged into one run of
the next level, and hashes that reach ``min_docs`` there move to the settled
runs.  At the end the remaining runs are merged once; every line whose hash is
settled is dropped from every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmerge.llm.arrow import plus, steps, texts, with_columns
from quillmerge.sources.scratch import materialise, scratch_path

#: Stripped from both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped line with A-Z lower-cased; None for a line too short to count."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """The levelled runs, as tables (key binary, n_docs long) in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Add the (key, n_docs) rows of a batch of documents; keys may repeat."""
        new = batch.groupBy("key").agg(F.sum("n_docs").alias("n_docs"))
        for run in self.settled:
            new = new.join(run.select("key"), "key", "left_anti")
        self.levels[0].append(materialise(new.sortWithinPartitions("key"), "line-run"))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for run in runs[1:]:
            both = both.unionByName(run)
        return both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"))

    def _compact(self, level: int) -> None:
        merged = materialise(self._merged(self.levels[level]).sortWithinPartitions("key"), "line-run")
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.settled.append(merged.where(F.col("n_docs") >= self.min_docs))
        self.levels[level + 1].append(merged.where(F.col("n_docs") < self.min_docs))

    def frequent(self) -> DataFrame:
        """(key) of the lines in at least ``min_docs`` documents; a key may come twice."""
        open_runs = [run for level in self.levels for run in level]
        out = [run.select("key") for run in self.settled]
        if open_runs:
            out.append(self._merged(open_runs).where(F.col("n_docs") >= self.min_docs).select("key"))
        if not out:
            return self.spark.createDataFrame([], "key binary")
        both = out[0]
        for run in out[1:]:
            both = both.unionByName(run)
        return both


def _batch_keys(id_col: str, text_col: str, batches: int, min_chars: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(parts, text_col):
            found: dict[int, Counter] = {}
            for doc, text in zip(part.column(id_col).to_pylist(), texts(part, text_col), strict=True):
                keys = {line_key(x, min_chars) for x in text.split(b"\n")}
                keys.discard(None)
                found.setdefault(zlib.crc32(str(doc).encode()) % batches, Counter()).update(keys)
            rows = [(b, k, n) for b, c in found.items() for k, n in c.items()]
            if rows:
                b, k, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(n, pa.int64())], names=["batch", "key", "n_docs"])

    return run


def _text_keys(text_col: str, min_chars: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(parts, text_col):
            keys = [sorted({line_key(x, min_chars) for x in t.split(b"\n")} - {None}) for t in texts(part, text_col)]
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(keys, pa.list_(pa.binary()))], names=["h", "keys"])

    return run


def _free(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def _dropper(text_col: str, min_chars: int, hot_of, surplus: str | None = None):
    """hot_of(batch): for each row the set of keys to drop; the column ``surplus`` goes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(parts, text_col):
            kept, n_lines, n_dropped = [], [], []
            for text, hot in zip(texts(part, text_col), hot_of(part), strict=True):
                lines = text.split(b"\n")
                left = [x for x in lines if line_key(x, min_chars) not in hot] if hot else lines
                kept.append(b"\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            out = with_columns(part, {text_col: pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})
            yield out.drop_columns([surplus]) if surplus else out

    return run


def drop_frequent_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 4,
    fanout: int = 3,
    broadcast_keys: int = 100_000,
) -> DataFrame:
    """``docs`` with every line dropped whose key is in at least ``min_docs`` documents.

    A line's key is the line stripped of ASCII blanks with A-Z lower-cased; keys
    under ``min_chars`` code points never count.  Each input row is one document,
    also where ids repeat or are null.  A null or empty text is one empty line and
    comes back as an empty text.  Adds ``n_lines`` (before) and ``n_dropped``; all
    other columns pass through.  ``docs`` is read twice, so it should be a table.

    The frequent keys are counted first.  Up to ``broadcast_keys`` of them (16
    bytes each) go to the tasks and no text is shuffled; beyond that they are
    joined to the distinct texts by key, and these to the documents.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout)
    path = scratch_path(spark, "line-keys")
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    plain.mapInArrow(_batch_keys("id", "body", batches, min_chars), "batch int, key binary, n_docs long").write.partitionBy("batch").parquet(path)
    keyed = spark.read.schema("key binary, n_docs long, batch int").parquet(path)
    for b in range(batches):
        runs.add(keyed.where(F.col("batch") == b).select("key", "n_docs"))
    frequent = materialise(runs.frequent(), "frequent-lines")

    clean = docs.drop("n_lines", "n_dropped")
    schema = plus(clean, "n_lines long, n_dropped long")
    if frequent.count() <= broadcast_keys:
        hot = spark.sparkContext.broadcast(frozenset(bytes(r["key"]) for r in frequent.toLocalIterator()))
        return clean.mapInArrow(_dropper(text_col, min_chars, lambda part: [hot.value] * part.num_rows), schema)
    # texts are told apart by hash: whichever text a key comes from, it is frequent
    hash_col, hot_col = _free("text_hash", clean.columns), _free("hot_keys", clean.columns)
    texts_ = plain.select(F.xxhash64(F.coalesce("body", F.lit(""))).alias("h"), "body")
    pairs = texts_.mapInArrow(_text_keys("body", min_chars), "h long, keys array<binary>").groupBy("h").agg(F.first("keys").alias("keys"))
    hot_of = (
        pairs.select("h", F.explode("keys").alias("key"))
        .join(frequent.distinct(), "key", "left_semi")
        .groupBy(F.col("h").alias(hash_col))
        .agg(F.collect_set("key").alias(hot_col))
    )
    joined = clean.withColumn(hash_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(hot_of, hash_col, "left").drop(hash_col)
    return joined.mapInArrow(_dropper(text_col, min_chars, lambda part: [frozenset(x or ()) for x in part.column(hot_col).to_pylist()], hot_col), schema)
