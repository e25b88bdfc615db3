"""Versions that are claimed, rules that refuse, old folders that go."""

import os
import threading
import time

import pytest

from quillmerge.operators import load
from quillmerge.sources.constraints import Allowed, Refers, Refused, Required, Unique
from quillmerge.sources.records import all_records
from quillmerge.sources.store import Conflict, Store

PEOPLE = "person_id long, full_name string, email string, gig_status string, match_confidence double"
RULES = [
    Required("people", ("person_id", "full_name")),
    Allowed("people", "gig_status IN ('active', 'inactive', 'paused')"),
    Allowed("people", "match_confidence > 0 AND match_confidence <= 1"),
    Unique("people", ("email",)),
    Refers("skills", "person_id", "people", "person_id"),
]


def tables(spark, people, skills=((1, "SQL"),)):
    return {"people": spark.createDataFrame(list(people), PEOPLE), "skills": spark.createDataFrame(list(skills), "person_id long, skill string")}


FINE = [(1, "Asha", "a@x.test", None, 1.0), (2, "Bina", None, "active", 0.6), (3, "Tara", None, "paused", 1.0)]


def test_each_broken_rule_refuses_and_names_its_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.rebuild(tables(spark, FINE), RULES) == 1
    for change, skills, rule, row in (
        ((2, None, None, "active", 0.6), [(1, "SQL")], RULES[0], {"person_id": 2}),
        ((2, "Bina", None, "gone", 0.6), [(1, "SQL")], RULES[1], {"person_id": 2}),
        ((2, "Bina", None, None, 1.5), [(1, "SQL")], RULES[2], {"person_id": 2}),
        ((2, "Bina", "a@x.test", None, 1.0), [(1, "SQL")], RULES[3], {"email": "a@x.test", "rows": 2}),
        (FINE[1], [(1, "SQL"), (9, "SQL"), (None, "SQL")], RULES[4], {"person_id": 9}),
    ):
        with pytest.raises(Refused) as told:
            store.rebuild(tables(spark, [FINE[0], change, FINE[2]], skills), RULES)
        ((broken, n, rows),) = told.value.broken
        assert broken == rule and n == 1 and row.items() <= rows[0].items()
    assert [n for n, _ in store.versions()] == [1] and store.read("people").count() == 3
    assert len([x for x in os.listdir(tmp_path) if x.startswith("v-")]) == 1


def test_two_rebuilds_at_once_follow_each_other(spark, tmp_path):
    """Both read the version before and add a row; the loser starts over and sees the winner's."""
    store = Store(spark, str(tmp_path))
    store.rebuild({"t": spark.createDataFrame([(0,)], "k long")})
    gate, asked = threading.Barrier(2), []

    def add(k):
        def make():
            asked.append(k)
            now = store.read("t")
            if len(asked) <= 2:
                gate.wait(60)
            return {"t": now.unionByName(spark.createDataFrame([(k,)], "k long"))}

        store.rebuild(make)

    both = [threading.Thread(target=add, args=(k,)) for k in (1, 2)]
    [x.start() for x in both]
    [x.join() for x in both]
    assert [n for n, _ in store.versions()] == [1, 2, 3] and sorted(asked) in ([1, 1, 2], [1, 2, 2])
    assert sorted(r.k for r in store.read("t").collect()) == [0, 1, 2]
    assert len({r.k for r in store.read("t", 2).collect()}) == 2


def test_dead_writers_and_old_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = {"t": spark.createDataFrame([(1,)], "k long")}
    store.rebuild(one)
    (tmp_path / "versions" / f"{2:012d}").write_text("")  # claimed by a writer that died
    assert store.read("t").count() == 1 and store.rebuild(one) == 3
    store.spark.createDataFrame([(7,)], "k long").write.parquet(str(tmp_path / "v-orphan/t"))
    assert not store.sweep(3600)
    time.sleep(1.1)
    swept = store.sweep(1)
    assert len(swept) == 2 and "v-orphan" in swept and [n for n, _ in store.versions()] == [3] and store.read("t").count() == 1
    with pytest.raises(Conflict):
        store.files.claim = lambda *_: False
        store.rebuild(one, tries=2)


def test_a_changed_schema_is_no_missing_table(spark, tmp_path):
    """A durable table that can't be read is an error, not an empty table that gets everything anew."""
    store = Store(spark, str(tmp_path))
    (tmp_path / "durable/log").mkdir(parents=True)
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        store.append_new("log", spark.createDataFrame([(1, "a")], "k int, v string"), "k")


def test_all_derived_tables_keep_the_rules(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.rebuild(load.derived_tables(all_records(spark, "/root/testdata/sf0.001")), load.RULES)
    run = store.read("load_runs").first()
    assert run.source_rows_read == store.read("source_records").count() > run.source_rows_used > run.people_created == store.read("people").count()
    assert store.read("source_records").where("not was_used and person_id is not null").count() == 0
    assert run.issues_logged == store.read("data_issues").count() > 0
    assert store.read("person_skills").count() > 0 and store.read("field_conflicts").count() > 0 and "merge_review" in os.listdir(tmp_path / store.versions()[0][1])
