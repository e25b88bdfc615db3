"""A queue that several workers empty: leases with an expiry, one call for each item, failures apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmerge.sources.store import Store

CLAIM = "item string, worker string, until double"
OUTCOME = "item string, result string, error string, attempt int"


def call_each(items: DataFrame, call: Callable[[dict], str]) -> DataFrame:
    """(item, result, error) of ``items`` (item, ...): ``call`` gets one row at a time; what it raises is that row's error alone."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            results: list[str | None] = []
            errors: list[str | None] = []
            for row in part.to_pylist():
                try:
                    results.append(call(row))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one item's failure is its own
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            if results:
                yield pa.RecordBatch.from_arrays([part.column("item"), pa.array(results, pa.string()), pa.array(errors, pa.string())], names=["item", "result", "error"])

    return items.mapInArrow(run, "item string, result string, error string")


class Queue:
    """Items (item string, ...) and a store with two tables: claims, and outcomes of every attempt.

    Both change together, as versions of the store: a worker that loses a version looks
    again, so no item is leased twice at a time.  A lease that ran out is void, so a dead
    worker's items come back.
    """

    def __init__(self, store: Store, items: DataFrame, order: str = "item", most_attempts: int = 3):
        self.store, self.items, self.order, self.most = store, items, order, most_attempts

    def _now(self) -> tuple[DataFrame, DataFrame]:
        if not self.store.versions():
            return tuple(self.store.spark.createDataFrame([], s) for s in (CLAIM, OUTCOME))
        return self.store.read("claims"), self.store.read("outcomes")

    def _open(self, claims: DataFrame, outcomes: DataFrame, now: float) -> DataFrame:
        """Items without a result, with attempts left and no running lease."""
        tried = outcomes.groupBy("item").agg(F.count("*").alias("attempts"), F.count("result").alias("done"))
        over = tried.where((F.col("done") > 0) | (F.col("attempts") >= self.most)).select("item")
        return self.items.join(over, "item", "left_anti").join(claims.where(F.col("until") > now).select("item"), "item", "left_anti")

    def lease(self, worker: str, n: int, now: float, seconds: float) -> DataFrame:
        """Up to ``n`` open items in order, leased to the worker until ``now + seconds``."""

        def make():
            claims, outcomes = self._now()
            mine = self._open(claims, outcomes, now).orderBy(self.order).limit(n).select("item", F.lit(worker).alias("worker"), F.lit(now + seconds).alias("until"))
            return {"claims": claims.where(F.col("until") > now).unionByName(mine), "outcomes": outcomes}

        self.store.rebuild(make)
        held = self.store.read("claims").where((F.col("worker") == worker) & (F.col("until") == now + seconds)).select("item")
        return self.items.join(held, "item", "left_semi")

    def settle(self, worker: str, told: DataFrame) -> None:
        """Record (item, result, error) of the worker's leased items; leases that another took over meanwhile are left alone."""

        def make():
            claims, outcomes = self._now()
            own = claims.where(F.col("worker") == worker).select("item")
            before = outcomes.groupBy("item").agg(F.count("*").alias("n"))
            fresh = told.join(own, "item", "left_semi").join(before, "item", "left").select("item", "result", "error", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("attempt"))
            ended = claims.join(told.select("item"), "item", "left_semi").where(F.col("worker") == worker)
            return {"claims": claims.join(ended, ["item", "worker"], "left_anti"), "outcomes": outcomes.unionByName(fresh)}

        self.store.rebuild(make)

    def remaining(self, now: float) -> int:
        claims, outcomes = self._now()
        return self._open(claims, outcomes, now).count()
