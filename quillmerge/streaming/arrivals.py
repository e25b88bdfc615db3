"""Arriving CSV files to verdicts, skipped rows, an alert and a log, each once.

The stream only tells which files are new; a batch's files are then read as numbered
CSV records, in parallel.  A batch writes its sinks into folders named after its files,
and last its line in the ledger, which is created once or not at all.  Readers see
what the ledger names.  A batch that died between two sinks overwrites its own folders
when it is run again; a file that the ledger names is not taken up again, even if the
stream has lost its checkpoint and deals the files to other batches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmerge.operators import serving
from quillmerge.sources.csv_records import read_records
from quillmerge.sources.scratch import materialise
from quillmerge.sources.store import Files

SINKS = ("verdicts", "skipped", "alerts", "log")
#: Files of one batch.
FILES_A_BATCH = 1000


def _first_given(pairs: Column, names: tuple[str, ...]) -> Column:
    """The first value under one of these heads that is not blank, else an empty text."""
    given = F.filter(pairs, lambda p: p["heads"].isin(*names) & (p["values"] != ""))
    return F.coalesce(F.get(given, 0)["values"], F.lit(""))


def arrived_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(row_id, path, row_number, fault, in_name, in_email, in_phone, in_city, skip_reason) of CSV files, each with a header of its own."""
    records = materialise(read_records(spark, paths), "arrived")
    heads = records.where("row_number = 1").select("path", F.col("cells").alias("header"))
    rows = records.where("row_number > 1").join(F.broadcast(heads), "path")  # a row for each file of a batch
    n = F.size("header")
    wide = F.slice(F.concat("cells", F.array_repeat(F.lit(""), n)), F.lit(1), n)
    plain = lambda a: F.transform(a, lambda v: F.lower(F.trim(v)))
    known = rows.select("path", "row_number", "fault", plain("header").alias("heads"), F.transform(wide, lambda v: F.trim(v)).alias("values"))
    pairs = F.arrays_zip("heads", "values")
    fields = {}
    for field, names in serving.ALIASES.items():
        fields[f"in_{field}"] = _first_given(pairs, names)
    empty = (fields["in_name"] == "") & (fields["in_email"] == "") & (fields["in_phone"] == "")
    reason = F.when(F.forall("values", lambda v: v == ""), "blank_row").when(plain("values") == F.col("heads"), "repeated_header").when(empty, "no_identity")
    return known.select(F.concat_ws("#", "path", "row_number").alias("row_id"), "path", "row_number", "fault", *[v.alias(k) for k, v in fields.items()], reason.alias("skip_reason"))


class Arrivals:
    """The sinks of one stream under ``out``."""

    def __init__(self, spark: SparkSession, out: str, people: Callable[[], DataFrame]):
        self.spark, self.out, self.people, self.files = spark, out.rstrip("/"), people, Files(spark)

    def _ledger(self) -> DataFrame | None:
        """(key, path) of all batches that are done."""
        folder = f"{self.out}/ledger"
        if not self.files.exists(folder):
            return None
        return self.spark.read.schema("key string, paths array<string>").json(folder).select("key", F.explode("paths").alias("path"))

    def take(self, batch: DataFrame, number: int = 0) -> None:
        """One batch of (path): its new files through all sinks."""
        new = batch.select("path").distinct()
        done = self._ledger()
        new = new if done is None else new.join(done, "path", "left_anti")
        paths = sorted(r.path for r in new.limit(100 * FILES_A_BATCH).collect())  # FILES_A_BATCH at most come in one batch
        if not paths:
            return
        key = hashlib.sha256("\n".join(paths).encode()).hexdigest()[:32]
        rows = materialise(arrived_rows(self.spark, paths), "arrived")
        checked = materialise(serving.classify_incoming(rows.where("skip_reason is null").select("row_id", "in_name", "in_email", "in_phone", "in_city"), self.people()), "verdicts")
        skipped = rows.where("skip_reason is not null or fault is not null").select("row_id", F.coalesce("skip_reason", "fault").alias("reason"))
        counts = serving.check_summary(checked)
        log = counts.withColumns({"batch": F.lit(key), "files": F.lit(len(paths)), "skipped": F.lit(skipped.count())})
        for name, df in zip(SINKS, (checked, skipped, serving.digest(checked), log), strict=True):
            self.write(name, key, df)
        self.files.claim(f"{self.out}/ledger/{key}.json", json.dumps({"key": key, "paths": paths}))

    def write(self, name: str, key: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.out}/{name}/{key}")

    def read(self, name: str) -> DataFrame:
        """A sink's rows of all batches that are done."""
        done = self._ledger()
        keys = [r.key for r in done.select("key").distinct().collect()] if done is not None else []  # a row for each batch
        if not keys:
            raise LookupError("no batch is done yet")
        return self.spark.read.parquet(*[f"{self.out}/{name}/{k}" for k in sorted(keys)])

    def start(self, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Check every CSV file that arrives in ``folder``."""
        seen = self.spark.readStream.option("maxFilesPerTrigger", FILES_A_BATCH).text(folder).select(F.col("_metadata.file_path").alias("path"))
        return seen.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
