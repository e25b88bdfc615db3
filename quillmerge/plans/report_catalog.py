"""Registered queries of a run's report: issues in words, flags, every conflict, reviews in detail, the appendix."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmerge import config
from quillmerge.operators import golden, identity, load, report
from quillmerge.plans import oracles as O
from quillmerge.plans.catalog import LOST, LOST_ROWS, members, query
from quillmerge.plans.chain_catalog import AUDIT_ROWS, AUDITED, OWN
from quillmerge.sources.records import all_records
from quillmerge.sources.scratch import materialise, scratch_path

# ---------------------------------------------------------------- the run in SQL

CTC_NUMBER = f"TRY_CAST({O.sq('ctc')} AS DOUBLE)"
EXCLUSIVE = {
    "applicants": {
        "experience_years": "CAST(experience AS DOUBLE)",
        "ctc_annual_inr": O.ctc_value("ctc"),
        "ctc_unit_detected": f"CASE WHEN {CTC_NUMBER} < 1000 THEN 'lakh_per_annum' WHEN {CTC_NUMBER} IS NOT NULL THEN 'absolute_inr' END",
        "ctc_out_of_range": f"coalesce({O.ctc_value('ctc')} NOT BETWEEN 50000 AND 100000000, false)",
        "applied_date": O.DATE,
        "applied_date_ambiguous": f"coalesce(row_number % 4 = 2 AND day({O.DATE}) <> month({O.DATE}), false)",
        "applied_date_is_future": f"coalesce({O.DATE} > DATE '{config.INGEST_DATE}', false)",
    },
    "workers": {
        "rate_hourly_inr": O.hourly("rate"),
        "rate_monthly_inr": O.monthly("rate"),
        "rate_basis": O.rate_parts("rate")[0],
        "rate_out_of_range": f"coalesce({O.monthly('rate')} NOT BETWEEN 8000 AND 400000, false)",
        "gig_status": O.status_value("status"),
    },
    "contacts": {"is_verified": O.bool_value("verified"), "projects_completed": "CAST(projects AS INT)"},
}
HELD = " UNION ALL ".join(f"SELECT source || ':' || row_number AS uid, '{c}' AS field, CAST({sql} AS VARCHAR) AS value FROM {t}" for t, cols in EXCLUSIVE.items() for c, sql in cols.items())
CHOSEN = f"""own AS (SELECT root, source, field, value, source_rank * 100000000 + row_number AS seat FROM ({HELD}) JOIN members USING (uid) WHERE value IS NOT NULL),
chosen AS (SELECT root, field, arg_min(value, seat) AS value FROM own GROUP BY ALL)"""
CONFLICTS = f"""{LOST}, {CHOSEN},
conflicts AS ({LOST_ROWS} UNION ALL SELECT o.root, o.field, c.value, o.source || ' (first row)', o.value, o.source || ' (later row)', '{golden.EXCLUSIVE_RULE}' FROM own o JOIN chosen c USING (root, field) WHERE o.value <> c.value)"""

FIRST = "array_to_string(list_slice(list_sort(list(DISTINCT {0})), 1, 3), ', ')"
REVIEWS = f"""keys AS (SELECT root, {FIRST.format('email')} AS emails, {FIRST.format('phone')} AS phones FROM strong JOIN recs USING (uid) GROUP BY root),
reviews AS (
  SELECT verdict AS reason, d.name_key, d.city, e.root AS cluster_root, f.size AS cluster_size, 'one of several clusters of ' || d.name_key || ' in ' || d.city AS detail
  FROM decided d JOIN elig e ON d.name_key = e.name_key AND d.city = e.city JOIN facts f ON e.root = f.root WHERE verdict = 'ambiguous_name_city'
  UNION ALL SELECT verdict, name_key, city, lo || ' | ' || hi, size, 'same name and city, other ' || CASE WHEN a.emails <> '' AND b.emails <> '' THEN 'e-mails: ' || a.emails || '; ' || b.emails ELSE 'phones: ' || a.phones || '; ' || b.phones END
  FROM decided JOIN keys a ON a.root = lo JOIN keys b ON b.root = hi WHERE verdict = 'same_name_conflicting_strong_key')"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PARTS = "list_filter(list_transform(string_split(raw_value, ','), lambda p: trim(p)), lambda p: p <> '')"
KNOWN = O.mapped(config.SKILL_CANON, "lower(p)")
SKILLS = "array_to_string(list_slice(list_sort(list_distinct(list_filter({0}, lambda p: {1}))), 1, 6), ', ')"
SHOWN = f"CASE WHEN field = 'skills' AND category = 'unmapped_value' THEN {SKILLS.format(PARTS, f'{KNOWN} IS NULL')} WHEN field = 'skills' AND category = 'inconsistent_casing' THEN {SKILLS.format(PARTS, f'{KNOWN} <> p')} ELSE coalesce(raw_value, '') END"
WORDS = ", ".join(f"({quoted(c)}, {quoted(d)}, {quoted(a)})" for c, (d, a) in report.WORDS.items())
PERSONAL = ", ".join(map(quoted, report.BY_PERSON))
#: All issues of a run, in words.
TOLD = f"""{AUDITED}, {O.LINKS}{O.ISSUES[len(O.HEAD):]}, words AS (SELECT * FROM (VALUES {WORDS}) AS t(category, description, action_taken)),
logged AS (SELECT source, CAST(row_number AS BIGINT) AS row_number, category, severity, field, raw_value FROM issues UNION ALL SELECT source, CAST(row_number AS BIGINT), category, severity, field, raw_value FROM ({OWN}) UNION ALL SELECT NULL, NULL, category, severity, field, raw_value FROM ({AUDIT_ROWS})),
told AS (SELECT l.*, CASE WHEN l.row_number IS NOT NULL THEN e.full_name ELSE p.full_name END AS entity, replace(replace(w.description, '{{field}}', coalesce(l.field, '')), '{{raw}}', {SHOWN.replace('field', 'l.field').replace('category', 'l.category').replace('raw_value', 'l.raw_value')}) AS description, w.action_taken
  FROM logged l LEFT JOIN words w ON w.category = l.category LEFT JOIN every e ON e.source = l.source AND e.row_number = l.row_number
  LEFT JOIN people p ON l.row_number IS NULL AND l.category IN ({PERSONAL}) AND (p.ref = l.raw_value OR p.root = l.raw_value))"""

# ---------------------------------------------------------------- the appendix in SQL


def code(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') <> '' THEN '`' || replace({x}, '|', '\\|') || '`' ELSE '-' END"


def plain(x: str) -> str:
    return f"replace(coalesce({x}, ''), '|', '\\|')"


def thousands(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def section(place: int, part: int, title: str, columns: str, name: str) -> str:
    """The lines about a section's rows, and these rows from the table ``name`` (number, words, line)."""
    names = columns.split(",")
    head = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    line = lambda p, n, text, where="": f"SELECT {place} AS section, {p} AS part, {n} AS number, CAST([] AS VARCHAR[]) AS words, {quoted(text)} AS line {where}"
    some = f"WHERE EXISTS (SELECT 1 FROM {name})"
    out = [line(part, 0, f"## {title}"), line(part, 1, ""), line(part + 1, 0, head[0], some), line(part + 1, 1, head[1], some), line(part + 1, 0, "None.", some.replace("EXISTS", "NOT EXISTS"))]
    return " UNION ALL ".join([*out, f"SELECT {place}, {part + 2}, number, words, line FROM {name}", line(part + 3, 0, "")])


def row(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(cells) + " || ' |'"


RANK = "CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END"
WHOLE = "coalesce(source, '(whole dataset)')"
WHERE = f"CASE WHEN row_number IS NOT NULL THEN {WHOLE} || ' row ' || row_number ELSE {WHOLE} END"
FULLY = row(plain(WHERE), code("field"), code("raw_value"), plain("description"), plain("action_taken"))
SOURCE_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("error", "warn", "info"))
APPENDIX = f"""{TOLD}, {CONFLICTS}, {REVIEWS},
total AS (SELECT {SOURCE_COUNTS}, count(*) AS n FROM told),
s1 AS (SELECT {RANK} AS number, [lpad(CAST(1000000000000000000 - n AS VARCHAR), 19, '0'), category, field] AS words, {row('severity', code('category'), code('field'), thousands('n'), 'CAST(files AS VARCHAR)')} AS line FROM (SELECT severity, category, coalesce(field, '') AS field, count(*) AS n, count(DISTINCT source) AS files FROM told GROUP BY ALL)),
s2 AS (SELECT -n AS number, [src] AS words, {row(code('src'), thousands('error'), thousands('warn'), thousands('info'), thousands('n'))} AS line FROM (SELECT {WHOLE} AS src, {SOURCE_COUNTS}, count(*) AS n FROM told GROUP BY 1)),
s3 AS (SELECT 0 AS number, [category, coalesce(source, ''), lpad(CAST(coalesce(row_number, 0) AS VARCHAR), 19, '0')] AS words, {FULLY} AS line, severity FROM told),
s3a AS (SELECT * FROM s3 WHERE severity = 'error'), s3b AS (SELECT * FROM s3 WHERE severity = 'warn'),
s4 AS (SELECT person_id AS number, [field] AS words, {row(plain('full_name'), code('field'), code('chosen'), code('rejected'), plain('rule'))} AS line FROM conflicts JOIN numbered USING (root)),
s5 AS (SELECT 0 AS number, [reason, name_key, city, cluster_root] AS words, {row(code('reason'), plain('name_key'), plain('city'), code('cluster_root'), 'CAST(cluster_size AS VARCHAR)', plain('detail'))} AS line FROM reviews),
s6 AS (SELECT 0 AS number, [source] AS words, {row(code('source'), thousands('n'), thousands('used'), thousands('n - used'), "'0'")} AS line FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE uid IN (SELECT uid FROM recs)) AS used FROM every GROUP BY source)),
lines AS (
  SELECT 0 AS section, 0 AS part, 0 AS number, CAST([] AS VARCHAR[]) AS words, '# Data issues' AS line
  UNION ALL SELECT 0, 1, 0, CAST([] AS VARCHAR[]), {thousands('(SELECT count(*) FROM every)')} || ' rows read, ' || {thousands('(SELECT count(*) FROM people)')} || ' people, ' || {thousands('n')} || ' issues (' || {thousands('error')} || ' error, ' || {thousands('warn')} || ' warn, ' || {thousands('info')} || ' info)' FROM total
  UNION ALL SELECT 0, 2, 0, CAST([] AS VARCHAR[]), ''
  UNION ALL {section(1, 0, 'Every class of issues', 'Severity,Category,Field,Count,Sources', 's1')}
  UNION ALL {section(2, 0, 'Issues of each source', 'Source,error,warn,info,total', 's2')}
  UNION ALL {section(3, 0, 'Every error', 'Where,Field,Raw value,Problem,What was done', 's3a')}
  UNION ALL {section(3, 4, 'Every warning', 'Where,Field,Raw value,Problem,What was done', 's3b')}
  UNION ALL {section(4, 0, 'Conflicts of fields', 'Person,Field,Kept,Lost,Rule', 's4')}
  UNION ALL {section(5, 0, 'Merges that were not made', 'Reason,Name,City,Cluster,Rows,Why', 's5')}
  UNION ALL {section(6, 0, 'Rows of each source', 'Source,Rows,Used,Skipped,Repaired', 's6')}
)"""

# ---------------------------------------------------------------- the queries


@query(f"{APPENDIX} SELECT row_number() OVER (ORDER BY section, part, number, words, line) AS line_no, section, line FROM lines")
def report_appendix(spark, sf_dir):
    """The appendix of a whole run, line by line."""
    tables = {n: materialise(t, n) for n, t in load.derived_tables(all_records(spark, sf_dir)).items()}
    return report.appendix(tables)


@query(f"{TOLD} SELECT severity, category, source, CAST(row_number AS VARCHAR) AS row_number, field, raw_value, entity, description, action_taken FROM told")
def report_issues(spark, sf_dir):
    """The issues' file, written in order and read back."""
    folder = scratch_path(spark, "exports")
    tables = {n: materialise(t, n) for n, t in load.derived_tables(all_records(spark, sf_dir)).items()}
    report.write_exports(tables, folder)
    texts = ", ".join(f"{c} string" for c in report.EXPORTS["data_issues"][1])
    return spark.read.schema(texts).json(f"{folder}/data_issues_json")


@query(f"{O.FULL}, {CONFLICTS} SELECT person_id, full_name, field, chosen AS chosen_value, chosen_sources AS chosen_source, rejected AS rejected_value, rejected_sources AS rejected_source, rule FROM conflicts JOIN numbered USING (root)")
def report_conflicts(spark, sf_dir):
    """Every value that lost, of shared and exclusive fields, with its person."""
    return report.exports(load.derived_tables(all_records(spark, sf_dir)))["field_conflicts"]


@query(f"{O.RESOLVED}, {REVIEWS} SELECT reason, name_key, city, cluster_root, cluster_size, CAST(0 AS DOUBLE) AS score, detail, false AS resolved FROM reviews")
def merge_review_details(spark, sf_dir):
    """The reviews of merges not made, each with the keys that stand against it."""
    r = materialise(all_records(spark, sf_dir), "records")
    clusters = materialise(identity.strong_clusters(r), "clusters")
    told = identity.with_details(identity.merge_reviews(r, clusters, identity.weak_decisions(r, clusters)), r, clusters)
    return told.withColumnsRenamed({"root": "cluster_root", "size": "cluster_size"})


FLAG_VALUES = ", ".join(f"coalesce(bool_or(value = 'true') FILTER (WHERE field = '{c}'), false) AS {c}" for c in golden.FLAGS if c != "city_is_region_guess")


@query(
    f"""{O.RESOLVED}, {O.CITIES}, {CHOSEN}, flags AS (SELECT root, max(value) FILTER (WHERE field = 'ctc_unit_detected') AS ctc_unit_detected, {FLAG_VALUES} FROM (SELECT DISTINCT root FROM members) LEFT JOIN chosen USING (root) GROUP BY root)
    SELECT flags.*, coalesce(guess, false) AS city_is_region_guess FROM flags LEFT JOIN cities USING (root)"""
)
def golden_flags(spark, sf_dir):
    """The unit of the salary and all flags of a person; a flag nobody raised is false."""
    rows = members(spark, sf_dir)
    folk = golden.with_flags(golden.people(rows, identity.match_methods(rows)).withColumnRenamed("region_guess", "city_is_region_guess"))
    return folk.select("root", "ctc_unit_detected", *golden.FLAGS)
