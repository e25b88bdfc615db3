"""Tags that arrive late, out of order, twice or edited: the last one written wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmerge.operators import serving

ORDER = ("ts", "event_id")


class Tags:
    """The current tag of each ``key``, kept up to date by a stream of (key, ts, event_id, ...).

    The stream keeps one row a key as its state, the greatest by ts and event_id, and
    combines rows before they are shuffled, so that a key with very many rows is a row
    of each task.  What a batch changed goes to a folder of its own number, which a
    repeated batch writes again; since the greatest row wins wherever it stands, a
    reader takes the greatest of all folders, and a batch that comes twice, or a stream
    that starts over without its checkpoint, changes nothing.  Rows without key or ts
    are left out.  Large states want the state store on RocksDB, which is the session's
    setting.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str):
        self.spark, self.folder, self.key, self.schema = spark, folder, key, schema

    def latest(self, arriving: DataFrame) -> DataFrame:
        """The greatest row of each key, batch or stream."""
        whole = arriving.where(F.col(self.key).isNotNull() & F.col("ts").isNotNull())
        return serving.upserted(whole, self.key, *ORDER)

    def start(self, arriving: DataFrame, checkpoint: str, run: str = "0", **trigger) -> StreamingQuery:
        """Takes in what arrives; ``run`` names a stream that starts over, ``trigger`` defaults to all there is."""

        def write(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{self.folder}/run={run}/batch={batch}")

        stream = self.latest(arriving).writeStream.outputMode("update").foreachBatch(write)
        return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def read(self, keep: str | None = None) -> DataFrame:
        """The current tags; with ``keep`` (an interval, as "30 days") those no older than that before the newest."""
        held = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.folder)
        now = self.latest(held)
        if keep is None:
            return now
        newest = held.agg(F.max("ts").alias("newest"))
        return now.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {keep}")).drop("newest")  # one row
