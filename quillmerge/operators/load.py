"""All derived tables of a run, and the rules they keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmerge.functions.text import sorted_json
from quillmerge.operators import findings, golden, identity, issues, report
from quillmerge.sources.constraints import Allowed, Refers, Required, Rule, Unique
from quillmerge.sources.scratch import materialise

RULES: list[Rule] = [
    Required("people", ("person_id", "full_name", *golden.FLAGS, "sources", "source_count", "record_count", "match_methods", "match_confidence")),
    Allowed("people", "gig_status IN ('active', 'inactive', 'paused')"),
    Allowed("people", "match_confidence > 0 AND match_confidence <= 1"),
    Unique("people", ("person_id",)),
    Unique("people", ("email",)),
    Unique("people", ("phone",)),
    Required("source_records", ("source_name", "source_row_number", "was_used", "raw_json")),
    Unique("source_records", ("source_name", "source_row_number")),
    Refers("source_records", "person_id", "people", "person_id"),
    Required("skills", ("skill_id", "skill_name")),
    Unique("skills", ("skill_id",)),
    Unique("skills", ("skill_name",)),
    Required("person_skills", ("person_id", "skill_id", "sources")),
    Unique("person_skills", ("person_id", "skill_id")),
    Refers("person_skills", "person_id", "people", "person_id"),
    Refers("person_skills", "skill_id", "skills", "skill_id"),
    Required("field_conflicts", ("field", "chosen_value", "rejected_value", "rule")),
    Refers("field_conflicts", "person_id", "people", "person_id"),
    Required("merge_review", ("reason", "name_key", "city", "score", "detail", "resolved")),
    Required("data_issues", ("severity", "category", "description", "action_taken")),
    Allowed("data_issues", "severity IN ('error', 'warn', 'info')"),
]


def with_person(rows: DataFrame, members: DataFrame, numbered: DataFrame) -> DataFrame:
    """``rows`` (uid, ...) with the person_id of the record's person, null where it is nobody's."""
    of = members.select("uid", "root").join(numbered.select("root", "person_id"), "root").select("uid", "person_id")
    return rows.join(of, "uid", "left")


def skill_ids(named: DataFrame) -> DataFrame:
    """(skill_id, skill_name): the distinct names of (skill), numbered from 1 in their order."""
    return golden.dense(named.select(F.col("skill").alias("skill_name")).distinct(), ["skill_name"], "skill_id")


def derived_tables(records: DataFrame, skipped: DataFrame | None = None) -> dict[str, DataFrame]:
    """people, source_records, skills, person_skills, field_conflicts, merge_review, data_issues, load_runs of one run.

    ``records`` are all records, usable or not; ``skipped`` the issue rows of file rows
    that never became records.
    """
    records = materialise(records, "records")
    members = identity.resolve(records)
    clusters = members.select("uid", F.col("strong_root").alias("root"))
    found = materialise(golden.people(members, identity.match_methods(members)), "people")
    numbered = materialise(golden.numbered(found), "people")
    by_root = numbered.select("root", "person_id")
    named = materialise(golden.person_skills(members), "skills")
    skills = materialise(skill_ids(named), "skill-ids")
    logged = issues.issues(records).unionByName(findings.identity_issues(records, clusters, members)).unionByName(findings.audit_issues(found, members))
    logged = logged if skipped is None else logged.unionByName(skipped)
    logged = materialise(report.with_entity(report.worded(logged), records, found), "issues")
    decided = identity.weak_decisions(records, clusters)
    people = numbered.withColumnsRenamed({"methods": "match_methods", "confidence": "match_confidence", "first_seen": "first_seen_source", "region": "city_region", "region_guess": "city_is_region_guess"}).drop("root", "ref")
    people = golden.with_flags(people)
    repairs = F.when(F.exists("problems", lambda p: p["category"] == "scrambled_columns"), "rotated_columns")
    used = records.select("uid", F.col("source").alias("source_name"), F.col("row_number").alias("source_row_number"), F.col("usable").alias("was_used"), repairs.alias("repairs"), sorted_json(F.col("raw")).alias("raw_json"))
    conflicts = golden.all_conflicts(members).join(by_root, "root").select("person_id", "field", F.col("chosen").alias("chosen_value"), F.col("chosen_sources").alias("chosen_source"), F.col("rejected").alias("rejected_value"), F.col("rejected_sources").alias("rejected_source"), "rule")
    run = records.agg(F.count("*").alias("source_rows_read"), F.count_if("usable").alias("source_rows_used"))
    counts = numbered.agg(F.count("*").alias("people_created")).crossJoin(logged.agg(F.count("*").alias("issues_logged")))  # single rows
    return {
        "people": people,
        "source_records": with_person(used, members, numbered).drop("uid"),
        "skills": skills,
        "person_skills": named.join(by_root, "root").join(skills.withColumnRenamed("skill_name", "skill"), "skill").select("person_id", "skill_id", "sources"),
        "field_conflicts": conflicts,
        "merge_review": identity.with_details(identity.merge_reviews(records, clusters, decided), records, clusters).withColumnsRenamed({"root": "cluster_root", "size": "cluster_size"}),
        "data_issues": logged,
        "load_runs": run.crossJoin(counts),
    }
