"""The duplicate check as a stream: files that arrive are checked against resolved people, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillmerge.operators.serving import classify_incoming


def start_checks(arrivals: DataFrame, people: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Check every arriving row; verdicts are appended to ``out`` as Parquet.

    ``arrivals`` is a streaming DataFrame (row_id, in_name, in_email, in_phone,
    in_city).  People are read anew for each batch.  A batch that is run again after a
    failure overwrites its own folder, so every row has one verdict.
    """

    def check(batch: DataFrame, number: int) -> None:
        classify_incoming(batch, people).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
