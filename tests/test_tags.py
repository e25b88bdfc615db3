"""A stream of tags in any order ends where the table of all of them would."""

import random

from pyspark.sql import functions as F

from quillmerge.operators import serving
from quillmerge.streaming.tags import Tags

SCHEMA = "user_id long, ts timestamp, event_id long, category string"


def test_any_order_repeats_and_lost_checkpoints_end_alike(spark, tmp_path):
    dice = random.Random(5)
    rows = [(dice.choice([1, 1, 1, *range(2, 9)]), dice.randrange(40), e, dice.choice("abc")) for e in range(300)]
    rows += [(3, None, 900, "x"), (None, 50, 901, "x"), (4, 99, 902, None)]
    rows += rows[:50]
    dice.shuffle(rows)
    all_rows = spark.createDataFrame([(u, t, e, c) for u, t, e, c in rows], "user_id long, s int, event_id long, category string").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id", "category")
    source = str(tmp_path / "in")
    all_rows.repartition(3).write.parquet(source)
    tags = Tags(spark, str(tmp_path / "out"), "user_id", SCHEMA)
    arriving = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    tags.start(arriving(), str(tmp_path / "one")).awaitTermination()
    want = sorted(serving.upserted(all_rows.where("user_id is not null and ts is not null"), "user_id", "ts", "event_id").collect())
    assert sorted(tags.read().collect()) == want and len(want) == 8
    spark.createDataFrame([(1, 5, 1, "late"), (2, 60, 2, "edited")], "user_id long, s int, event_id long, category string").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id", "category").write.mode("append").parquet(source)
    tags.start(arriving(), str(tmp_path / "one")).awaitTermination()
    got = {r.user_id: r.category for r in tags.read().collect()}
    assert got[2] == "edited" and got[1] == dict((r.user_id, r.category) for r in want)[1] and got[4] is None
    before = sorted(tags.read().collect())
    tags.start(arriving(), str(tmp_path / "two"), run="1").awaitTermination()
    assert sorted(tags.read().collect()) == before
    assert sorted(r.user_id for r in tags.read(keep="45 seconds").collect()) == [2, 4]
