"""Arriving CSV files, killed batches, leases and calls that fail."""

import pytest

from quillmerge.sources.store import Store
from quillmerge.streaming.arrivals import Arrivals, arrived_rows
from quillmerge.streaming.queue import Queue, call_each

PEOPLE = "root string, full_name string, email string, phone string, city string"


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("r1", "Asha Rao", "asha@x.test", "9000000001", "Pune"), ("r2", "Bina Das", None, None, "Delhi")], PEOPLE)


def drop(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


ONE = 'Name,E-mail,Mobile,Town\n"Asha\nRao",asha@x.test,,\n,,,\nname,e-mail,mobile,town\n,,,Pune\nNew One,new@x.test,,Noida\n'
TWO = "full_name,city\nBina Das,Delhi\nOther Das,Delhi,extra\n"


def sinks(arrivals):
    name = lambda row_id: (row_id.rsplit("/", 1)[1])
    verdicts = sorted((name(r.row_id), r.verdict, r.method) for r in arrivals.read("verdicts").collect())
    skipped = sorted((name(r.row_id), r.reason) for r in arrivals.read("skipped").collect())
    return verdicts, skipped, arrivals.read("log").agg({"checked": "sum", "skipped": "sum", "files": "sum"}).first(), arrivals.read("alerts").count()


WANT = (
    [("a.csv#2", "duplicate", "email"), ("a.csv#6", "new", "none"), ("b.csv#2", "needs_review", "name_city"), ("b.csv#3", "needs_review", "no_key")],
    [("a.csv#3", "blank_row"), ("a.csv#4", "repeated_header"), ("a.csv#5", "no_identity")],
)


def test_each_row_is_once_in_each_sink(spark, tmp_path, people):
    """The first batch dies between its sinks, is run again, and the stream then loses its checkpoint."""
    folder = tmp_path / "in"
    drop(folder, "a.csv", ONE)
    arrivals = Arrivals(spark, str(tmp_path / "out"), lambda: people)
    write, calls = arrivals.write, []

    def dies(name, key, df):
        calls.append(name)
        if len(calls) == 3:
            raise RuntimeError("killed")
        write(name, key, df)

    arrivals.write = dies
    with pytest.raises(Exception, match="killed"):
        arrivals.start(str(folder), str(tmp_path / "mark")).awaitTermination()
    with pytest.raises(LookupError):
        arrivals.read("verdicts")
    arrivals.start(str(folder), str(tmp_path / "mark")).awaitTermination()
    drop(folder, "b.csv", TWO)
    arrivals.start(str(folder), str(tmp_path / "mark")).awaitTermination()
    arrivals.start(str(folder), str(tmp_path / "lost")).awaitTermination()
    verdicts, skipped, log, alerts = sinks(arrivals)
    assert (verdicts, skipped) == WANT
    assert (log["sum(checked)"], log["sum(skipped)"], log["sum(files)"], alerts) == (4, 3, 2, 2)


def test_rows_of_files_with_other_headers(spark, tmp_path):
    drop(tmp_path / "in", "a.csv", ONE)
    drop(tmp_path / "in", "b.csv", TWO)
    drop(tmp_path / "in", "c.csv", "")
    drop(tmp_path / "in", "d.csv", "nothing,known\n1,2\n")
    rows = arrived_rows(spark, [str(p) for p in sorted((tmp_path / "in").iterdir())]).collect()
    got = {r.row_id.rsplit("/", 1)[1]: (r.in_name, r.in_email, r.in_city, r.skip_reason) for r in rows}
    assert got["a.csv#2"] == ("Asha\nRao", "asha@x.test", "", None) and got["b.csv#3"] == ("Other Das", "", "Delhi", None)
    assert got["d.csv#2"] == ("", "", "", "no_identity") and len(got) == 8


@pytest.fixture
def failing():
    def call(row):  # a local function: workers can't import a test
        if int(row["item"]) % 7 == 3:
            raise ValueError(f"no verdict for {row['item']}")
        return f"tag-{row['item']}"

    return call


def test_a_failing_call_costs_its_item_only(spark, failing):
    items = spark.createDataFrame([(str(k),) for k in range(20)], "item string")
    got = {r.item: (r.result, r.error) for r in call_each(items, failing).collect()}
    assert {k for k, (r, e) in got.items() if e} == {"3", "10", "17"} and got["10"] == (None, "ValueError: no verdict for 10") and got["4"] == ("tag-4", None)


def test_two_workers_empty_one_queue(spark, tmp_path, failing):
    """Each item once; a dead worker's lease runs out; failures are tried again by themselves, up to the limit."""
    items = spark.createDataFrame([(f"{k:02d}",) for k in range(9)], "item string")
    queue = Queue(Store(spark, str(tmp_path)), items, most_attempts=2)
    names = lambda df: sorted(r.item for r in df.collect())
    a = queue.lease("a", 4, now=0, seconds=10)
    b = queue.lease("b", 4, now=1, seconds=10)
    assert names(a) == ["00", "01", "02", "03"] and names(b) == ["04", "05", "06", "07"]
    queue.settle("b", call_each(b, failing))
    assert queue.remaining(now=5) == 1  # 08; the rest is leased or done
    again = queue.lease("b", 9, now=11, seconds=10)  # a is dead
    assert names(again) == ["00", "01", "02", "03", "08"]
    queue.settle("a", call_each(items.where("item < '04'"), failing))  # comes too late
    queue.settle("b", call_each(again, failing))
    last = queue.lease("a", 9, now=12, seconds=10)
    assert names(last) == ["03"]
    queue.settle("a", call_each(last, failing))
    out = queue.store.read("outcomes")
    assert queue.remaining(now=100) == 0 and out.where("result is not null").count() == 8
    assert [(r.item, r.attempt) for r in out.where("error is not null").orderBy("attempt").collect()] == [("03", 1), ("03", 2)]
