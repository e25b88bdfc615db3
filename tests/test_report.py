"""Issues in words, entities, the files of a run and its appendix."""

import pytest

from pyspark.sql import functions as F

from quillmerge.operators import golden, identity, issues, load, report
from quillmerge.sources.records import all_records
from quillmerge.sources.store import Store

FOUND = "source string, row_number long, category string, severity string, field string, raw_value string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A whole run at the smallest scale, with two rows that were skipped on the way."""
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    skipped = spark.createDataFrame([("gig", 900, "blank_row", "warn", "", None), ("gig", 901, "repeated_header", "warn", "", "a|b\nc")], FOUND)
    made = load.derived_tables(all_records(spark, "/root/testdata/sf0.001"), skipped)
    store.rebuild(made, load.RULES)
    return {n: store.read(n) for n in made}


def test_words_fill_in_what_the_issue_holds(spark):
    rows = [
        ("naukri", 2, "invalid_format", "error", "phone", "12 {field}"),
        ("naukri", 2, "unmapped_value", "warn", "skills", "Cobol, sql,zig , Ada,zig,a,b,c,d"),
        ("naukri", 2, "inconsistent_casing", "info", "skills", "Cobol, sql, REST APIs, js"),
        (None, None, "match_key_coverage", "warn", None, None),
        (None, None, "of_no_words", "info", "x", "y"),
    ]
    told = {r["category"] + (r["field"] or ""): r for r in report.worded(spark.createDataFrame(rows, FOUND)).collect()}
    assert told["invalid_formatphone"]["description"] == "phone can't be read: 12 {field}"
    assert told["unmapped_valueskills"]["description"].endswith(": Ada, Cobol, a, b, c, d")  # six of seven, in order
    assert told["inconsistent_casingskills"]["description"].endswith(": js, sql")
    assert told["match_key_coverage"]["description"].endswith(": ")
    assert told["of_no_wordsx"]["description"] == "of_no_words" and told["of_no_wordsx"]["action_taken"] == ""


def test_every_category_has_words_and_a_section(tables):
    raised = {r["category"] for r in tables["data_issues"].select("category").distinct().collect()}
    assert raised <= set(report.WORDS)
    assert {c for cs in issues.SECTIONS.values() for c in cs} <= set(report.WORDS)


def test_entities_are_names_of_records_and_people(spark):
    found = spark.createDataFrame([("gig", 1, "alias_email", "warn", "email", "x"), ("gig", 7, "blank_row", "warn", "", None), (None, None, "three_way_match", "info", "", "gig:1"),
                                   (None, None, "cross_source_disagreement", "info", "skills", "a:9"), (None, None, "homonym", "info", "full_name", "gig:1")], FOUND)
    records = spark.createDataFrame([("gig:1", "Asha"), ("gig:2", "Bina")], "uid string, full_name string")
    people = spark.createDataFrame([("gig:1", "a:9", "Asha Rao"), ("gig:2", "gig:2", "Bina")], "ref string, root string, full_name string")
    told = {r["category"]: r["entity"] for r in report.with_entity(found, records, people).collect()}
    assert told == {"alias_email": "Asha", "blank_row": None, "three_way_match": "Asha Rao", "cross_source_disagreement": "Asha Rao", "homonym": None}


def test_appendix_holds_every_error_and_warning_in_order(tables):
    lines = [r["line"] for r in report.appendix(tables).orderBy("line_no").collect()]
    assert lines[0] == "# Data issues"
    titles = [x for x in lines if x.startswith("## ")]
    assert titles == ["## Every class of issues", "## Issues of each source", "## Every error", "## Every warning", "## Conflicts of fields", "## Merges that were not made", "## Rows of each source"]
    part = lambda title: lines[lines.index(title) + 4 : next(i for i in range(lines.index(title) + 3, len(lines)) if lines[i] == "")]
    counts = {r["severity"]: r["n"] for r in tables["data_issues"].groupBy("severity").agg(F.count("*").alias("n")).collect()}
    assert len(part("## Every error")) == counts["error"] and len(part("## Every warning")) == counts["warn"]
    assert len(part("## Conflicts of fields")) == tables["field_conflicts"].count()
    assert any("gig row 901 | - | `a\\|b c` | the header comes again" in x for x in part("## Every warning"))


def test_appendix_of_nothing(tables):
    empty = {n: t.limit(0) if n != "load_runs" else t for n, t in tables.items()}
    lines = [r["line"] for r in report.appendix(empty).orderBy("line_no").collect()]
    assert lines.count("None.") == 7 and not any(x.startswith("| ") for x in lines)


def test_files_come_back_whole_and_in_order(spark, tables, tmp_path):
    written = report.write_exports(tables, str(tmp_path))
    assert written == ["data_issues_csv", "people_csv", "field_conflicts_csv", "merge_review_csv", "source_records_csv", "data_issues_json", "appendix_md"]
    rows = report.exports(tables)
    for file in report.EXPORTS:
        back = spark.read.csv(str(tmp_path / f"{file}_csv"), header=True, escape='"', multiLine=True)
        assert back.columns == list(report.EXPORTS[file][1]) and back.count() == rows[file].count()
    text = "".join(open(p).read() for p in sorted((tmp_path / "appendix_md").glob("part-*")))
    assert text.splitlines() == [r["line"] for r in report.appendix(tables).orderBy("line_no").collect()]


def test_repaired_rows_and_flags_are_stored(spark):
    records = all_records(spark, "/root/testdata/sf0.001").where("source = 'gig'").limit(5)
    turned = F.when(F.col("row_number") == records.agg(F.min("row_number")).first()[0], F.array(F.struct(F.lit("scrambled_columns").alias("category"), F.lit("error").alias("severity"), F.lit("").alias("field"), F.lit("a | b").alias("raw_value")))).otherwise(F.col("problems"))
    made = load.derived_tables(records.withColumn("problems", turned))
    assert sorted(r["repairs"] or "" for r in made["source_records"].collect()) == ["", "", "", "", "rotated_columns"]
    assert any(r["line"].startswith("| `gig` | 5 | 5 | 0 | 1 |") for r in report.appendix(made).collect())
    for row in made["people"].select(*golden.FLAGS).collect():
        assert all(v is not None for v in row)


def test_review_details_name_few_of_many_keys(spark):
    records = [(f"a:{i}", "asha rao", "Pune", f"{i}@x.test", "9000000001") for i in range(9)] + [("b:1", "asha rao", "Pune", "z@x.test", None)]
    records = spark.createDataFrame([(*r, "naukri", i, 0, True) for i, r in enumerate(records)], "uid string, name_key string, city string, email string, phone string, source string, row_number int, source_rank int, usable boolean")
    clusters = identity.strong_clusters(records)
    reviews = identity.merge_reviews(records, clusters, identity.weak_decisions(records, clusters))
    (told,) = identity.with_details(reviews, records, clusters).collect()
    assert told["detail"] == "same name and city, other e-mails: 0@x.test, 1@x.test, 2@x.test; z@x.test"
    assert told["score"] == 0.0 and told["resolved"] is False and told["size"] == 10
