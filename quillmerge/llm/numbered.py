"""Rows under numbers of their own, whatever ids they carry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmerge.sources.scratch import scratch_path

#: Text bytes of a bucket of rows.
BUCKET_BYTES = 64 << 20


def numbered_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``row``, a number that no other row has; written once, so that it stays.

    Bucketed by it: the joins that fetch candidates and pick the kept rows shuffle row
    numbers, and the texts no more.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = least * max(1, -(-size // (least * BUCKET_BYTES)))
    name = f"rows_{uuid.uuid4().hex}"
    dealt = docs.withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row")
    dealt.write.bucketBy(buckets, "row").option("path", scratch_path(spark, "rows")).saveAsTable(name)
    return spark.table(name)


def clashing(docs: DataFrame) -> dict[str, str]:
    """Columns of the caller named like the row number, and what they are called meanwhile."""
    return {c: f"{c}_of_docs" for c in docs.columns if c.lower() == "row"}


def first_of_each(rows: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """The first row of each group of (row, component): smallest id, null ids last; equal ids by their content."""
    content = F.xxhash64(*[c for c in rows.columns if c != "row"])
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), content.alias("content"), F.col("row").alias("row"))
    own = rows.select("row", order.alias("order")).join(groups.select("row", "component"), "row")
    best = own.groupBy("component").agg(F.min("order").alias("best")).select(F.col("best.row").alias("row"))
    return rows.join(best, "row", "left_semi").drop("row")
