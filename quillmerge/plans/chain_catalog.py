"""Registered queries from files to people, of durable contacts, findings, swapped tables, requests and clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmerge.operators import findings, golden, identity, issues, load, serving, signal
from quillmerge.plans import oracles as O
from quillmerge.plans.catalog import found, members, people, query, raw, table
from quillmerge.sources import wav
from quillmerge.sources.csv_records import write_lines
from quillmerge.sources.files import FILES, app_contacts, read_all
from quillmerge.sources.records import all_records
from quillmerge.sources.scratch import materialise, scratch_path
from quillmerge.sources.store import Store

# ---------------------------------------------------------------- files with damaged rows


def damaged_cells(spark, sf_dir, name):
    """(k, cells) of one source: some rows blank, a repeated header, short or long, and of workers some rotated."""
    df = raw(spark, sf_dir, name).withColumn("city", F.trim("city"))
    if name == "workers":
        df = df.withColumns({"rate": F.lit("15k/month"), "status": F.lit("Active"), "skills": F.lit("n8n, Python")})
    header, own = list(FILES[name].columns), F.array(*FILES[name].columns.values())
    k, n = F.col("row_number"), len(header)
    cells = (
        F.when(k % 37 == 3, F.array(*[F.lit(" ")] * n))
        .when(k % 41 == 4, F.array(*[F.lit(h.upper()) for h in header]))
        .when(k % 43 == 5, F.slice(own, 1, n - 2))
        .when(k % 47 == 6, F.concat(own, F.array(F.lit("x"))))
    )
    if name == "workers":
        cells = cells.when(k % 13 == 7, F.concat(F.slice(own, n, 1), F.slice(own, 1, n - 1)))
    return df.select(k.alias("k"), cells.otherwise(own).alias("cells"))


def read_back(spark, sf_dir):
    paths = {}
    for name, spec in FILES.items():
        paths[name] = scratch_path(spark, f"{name}-csv")
        write_lines(damaged_cells(spark, sf_dir, name), paths[name], list(spec.columns), "k")
    return read_all(spark, paths)


OUTCOME = "CASE WHEN k % 37 = 3 THEN 'blank_row' WHEN k % 41 = 4 THEN 'repeated_header' WHEN k % 43 = 5 OR k % 47 = 6 THEN 'column_count_mismatch' ELSE 'ok' END"
PLACED = f"""{O.CTES}, placed AS (
  SELECT 'naukri' AS source, row_number AS k, row_number() OVER (ORDER BY row_number) + 1 AS n, full_name, email, phone, city FROM applicants
  UNION ALL SELECT 'gig', row_number, row_number() OVER (ORDER BY row_number) + 1, full_name, email, NULL, city FROM workers
  UNION ALL SELECT 'cbnexus', row_number, row_number() OVER (ORDER BY row_number) + 1, full_name, NULL, phone, city FROM contacts
), judged AS (SELECT *, {OUTCOME} AS outcome, source = 'gig' AND k % 13 = 7 AND {OUTCOME} = 'ok' AS turned FROM placed)"""


@query(f"{PLACED} SELECT source, n AS row_number, {O.name_value('full_name')} AS full_name, {O.email_value('email')} AS email, {O.phone_value('phone')} AS phone, {O.city_value('city')} AS city FROM judged WHERE outcome IN ('ok', 'column_count_mismatch')")
def records_from_files(spark, sf_dir):
    """Three CSV sources with damaged rows, read, repaired and normalised."""
    records, _ = read_back(spark, sf_dir)
    return records.select("source", "row_number", "full_name", "email", "phone", "city")


@query(
    f"""{PLACED} SELECT source, n AS row_number, outcome AS category, CASE WHEN outcome = 'repeated_header' AND source = 'cbnexus' THEN 'error' ELSE 'warn' END AS severity FROM judged WHERE outcome <> 'ok'
    UNION ALL SELECT source, n, 'scrambled_columns', 'error' FROM judged WHERE turned"""
)
def issues_from_files(spark, sf_dir):
    """What structural repair had to do, row by row."""
    records, skipped = read_back(spark, sf_dir)
    structure = issues.issues(records).where(F.col("category").isin("column_count_mismatch", "scrambled_columns"))
    return structure.select("source", "row_number", "category", "severity").unionByName(skipped.select("source", "row_number", "category", "severity"))


# ---------------------------------------------------------------- durable contacts

ASKED = """asked AS (SELECT s_suppkey AS row_id, 'Vera  vendor' AS in_name,
  CASE s_suppkey % 4 WHEN 0 THEN '9' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') WHEN 1 THEN '12' ELSE '+91 8' || lpad(CAST(CAST(floor(s_suppkey / 8) AS BIGINT) AS VARCHAR), 9, '0') END AS in_phone,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'blr' END AS in_city FROM supplier)"""


def asked(spark, sf_dir):
    k = F.col("s_suppkey")
    number = lambda lead, n: F.concat(F.lit(lead), F.lpad(n.cast("long").cast("string"), 9, "0"))
    phone = F.when(k % 4 == 0, number("9", k)).when(k % 4 == 1, "12").otherwise(number("+91 8", F.floor(k / 8)))
    return table(spark, sf_dir, "supplier").select(k.alias("row_id"), F.lit("Vera  vendor").alias("in_name"), phone.alias("in_phone"), F.when(k % 3 == 0, "").otherwise("blr").alias("in_city"))


@query(
    f"""{O.FULL}, {ASKED}, known AS (SELECT DISTINCT phone FROM people WHERE phone IS NOT NULL),
    fresh AS (SELECT {O.phone_value('in_phone')} AS phone, min(row_id) AS id FROM asked WHERE {O.phone_value('in_phone')} IS NOT NULL AND {O.phone_value('in_phone')} NOT IN (SELECT phone FROM known) GROUP BY 1)
    SELECT 'audio_app:' || id AS uid, 'Vera Vendor' AS full_name, phone, CASE WHEN in_city <> '' THEN 'Bengaluru' END AS city, 'inconsistent_casing' AS dropped FROM fresh JOIN asked ON row_id = id""".replace(", 'inconsistent_casing' AS dropped", "")
)
def durable_contacts(spark, sf_dir):
    """Unmatched submissions become contacts, once for each phone, and come in again as a source."""
    folk = people(spark, sf_dir).select("root", "phone")
    store = Store(spark, scratch_path(spark, "store"))
    made = materialise(serving.new_contacts(asked(spark, sf_dir), folk), "new-contacts")
    store.append_new("contacts", made, "phone")
    store.append_new("contacts", made, "phone")  # the same request again changes nothing
    return app_contacts(spark, f"{store.root}/durable/contacts").select("uid", "full_name", "phone", "city")


@query(
    f"""WITH {ASKED.replace('asked AS', 'asked AS')} SELECT CAST(count(*) AS BIGINT) AS asked, count(*) FILTER (WHERE in_phone = '12') AS unreadable FROM asked"""
)
def incoming_warnings(spark, sf_dir):
    rows = asked(spark, sf_dir).withColumn("in_email", F.lit(None).cast("string"))
    told = serving.warnings(rows).where("warning = 'unreadable_phone'").agg(F.count("*").alias("unreadable")).withColumn("one", F.lit(1))
    return rows.agg(F.count("*").alias("asked")).withColumn("one", F.lit(1)).join(told, "one").select("asked", "unreadable")


# ---------------------------------------------------------------- findings

OWN = f"""SELECT source, row_number, 'cross_source_match' AS category, 'info' AS severity, field, value AS raw_value FROM crossing
UNION ALL SELECT source, row_number, 'duplicate_within_source', 'warn', 'email', email FROM (SELECT *, min(row_number) OVER (PARTITION BY source, email) AS first FROM recs WHERE email IS NOT NULL) WHERE row_number > first
UNION ALL SELECT source, row_number, 'duplicate_within_source', 'warn', 'phone', phone FROM (SELECT *, min(row_number) OVER (PARTITION BY source, phone) AS first FROM recs WHERE phone IS NOT NULL) WHERE row_number > first
UNION ALL SELECT source, row_number, 'exact_duplicate_row', 'warn', '', NULL FROM (SELECT *, min(row_number) OVER (PARTITION BY full_name, email, phone, city, experience, ctc, applied, skills) AS first FROM applicants WHERE source || ':' || row_number IN (SELECT uid FROM recs)) WHERE row_number > first
UNION ALL SELECT NULL, NULL, 'ambiguous_identity', 'warn', 'full_name', name_key FROM decided WHERE verdict = 'ambiguous_name_city'
UNION ALL SELECT NULL, NULL, 'homonym_kept_separate', 'info', 'full_name', name_key FROM decided WHERE verdict = 'same_name_conflicting_strong_key'
UNION ALL SELECT source, row_number, 'weak_match_applied', 'warn', 'full_name', d.name_key FROM decided d JOIN (SELECT root, arg_min(source, place) AS source, arg_min(row_number, place) AS row_number FROM strong JOIN recs USING (uid) JOIN (SELECT uid, place FROM placed) USING (uid) WHERE name_key IS NOT NULL AND city IS NOT NULL GROUP BY root) r ON r.root = hi WHERE verdict = 'merge'
UNION ALL SELECT NULL, NULL, 'homonym', 'info', 'full_name', name_key FROM members WHERE name_key IS NOT NULL AND city IS NOT NULL GROUP BY name_key HAVING count(DISTINCT root) > 1
UNION ALL SELECT NULL, NULL, 'three_way_match', 'info', '', ref FROM people WHERE source_count = 3"""


@query(f"{O.FULL}, {O.LINKS} SELECT source, CAST(row_number AS BIGINT) AS row_number, category, severity, field, raw_value FROM ({OWN})")
def issues_identity(spark, sf_dir):
    rows = members(spark, sf_dir)
    strong = rows.select("uid", F.col("strong_root").alias("root"))
    return findings.identity_issues(rows.drop("strong_root", "root"), strong, rows)


AUDITED = f"""{O.FULL}, {O.elected('monthly', O.ORDER, 'em')}, {O.elected('basis', O.ORDER, 'eb')}, {O.elected('ctc', O.ORDER, 'ec')}, {O.elected('experience', O.ORDER, 'ee')}, {O.elected('is_verified', O.ORDER, 'ev')}, {O.elected('projects', O.ORDER, 'ep')},
whole AS (SELECT p.*, monthly, basis, ctc, experience, is_verified, projects FROM people p LEFT JOIN em USING (root) LEFT JOIN eb USING (root) LEFT JOIN ec USING (root) LEFT JOIN ee USING (root) LEFT JOIN ev USING (root) LEFT JOIN ep USING (root)),
rated AS (SELECT * FROM whole WHERE monthly > 0 AND basis IS NOT NULL), mb AS (SELECT basis, median(monthly) AS m FROM rated GROUP BY basis), mall AS (SELECT median(monthly) AS m, count(*) AS n FROM rated),
paid AS (SELECT *, ctc / greatest(experience, 0.5) AS ratio FROM whole WHERE ctc > 0 AND experience IS NOT NULL), mr AS (SELECT median(ratio) AS m FROM paid),
u AS (SELECT root, source, list_sort(list_distinct(flatten(list(skills)))) AS s FROM members WHERE len(skills) > 0 GROUP BY root, source),
differ AS (SELECT a.root FROM u a JOIN u g ON a.root = g.root WHERE a.source = 'naukri' AND g.source = 'gig' AND a.s <> g.s)"""
RESERVED = "regexp_matches(email, '([@.]example\\.(com|org|net|in)|\\.(example|test|invalid|localhost))$')"


AUDIT_ROWS = f"""SELECT 'undeliverable_domain' AS category, 'info' AS severity, 'email' AS field, count(*) FILTER (WHERE {RESERVED}) || '/' || count(email) AS raw_value FROM people HAVING count(*) FILTER (WHERE {RESERVED}) > 0
    UNION ALL SELECT 'unit_correlates_with_magnitude', 'warn', 'rate', printf('%.1f', h.m / g.m) FROM mb h, mb g, mall WHERE h.basis = 'hourly' AND g.basis = 'monthly' AND n >= 6
    UNION ALL SELECT 'statistical_outlier', 'info', 'rate', ref FROM rated, mall WHERE n >= 6 AND (monthly > 3 * m OR monthly < m / 3)
    UNION ALL SELECT 'statistical_outlier', 'info', 'ctc_annual_inr', ref FROM paid, mr WHERE ratio > 3 * m OR ratio < m / 3
    UNION ALL SELECT 'business_rule_violation', 'warn', 'is_verified', CAST(count(*) AS VARCHAR) FROM whole WHERE projects >= 10 AND NOT is_verified HAVING count(*) > 0
    UNION ALL SELECT 'match_key_coverage', 'warn', '', count(*) FILTER (WHERE email IS NULL) || ',' || count(*) FILTER (WHERE phone IS NULL) || ',' || count(*) FILTER (WHERE email IS NULL AND phone IS NULL) || '/' || count(*) FROM people
    UNION ALL SELECT 'cross_source_disagreement', 'info', 'skills', root FROM differ
    UNION ALL SELECT 'cross_source_agreement', 'info', 'skills', NULL FROM differ HAVING count(*) = 0"""


@query(f"{AUDITED} {AUDIT_ROWS}")
def issues_audit(spark, sf_dir):
    rows = members(spark, sf_dir)
    folk = materialise(golden.people(rows, identity.match_methods(rows)), "people")
    return findings.audit_issues(folk, rows).select("category", "severity", "field", "raw_value")


SECTIONED = ", ".join(f"('{c}', {i}, '{s}')" for i, (s, cs) in enumerate(issues.SECTIONS.items(), 1) for c in cs)


@query(
    f"""{O.ISSUES}, sec AS (SELECT * FROM (VALUES {SECTIONED}) AS t(category, place, section)), c AS (SELECT category, severity, count(*) AS n FROM issues GROUP BY ALL)
    SELECT coalesce(place, 7) AS place, coalesce(section, 'Other') AS section, c.category, severity, n, '| ' || c.category || ' | ' || severity || ' | ' || format('{{:,}}', n) || ' |' AS line FROM c LEFT JOIN sec ON sec.category = c.category"""
)
def report_sections(spark, sf_dir):
    return issues.sections(found(spark, sf_dir))


@query(f"{O.ISSUES} SELECT source, CAST(row_number AS VARCHAR) AS row_number, category, severity, field, coalesce(raw_value, '') AS raw_value FROM issues")
def report_export(spark, sf_dir):
    """The issues written as CSV in order, and read back."""
    path = scratch_path(spark, "issues-csv")
    issues.export_csv(found(spark, sf_dir), path, "category", "source", "row_number")
    return spark.read.csv(path, header=True, escape='"', multiLine=True, emptyValue="", nullValue="\u0001", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).select("source", "row_number", "category", "severity", "field", "raw_value")


# ---------------------------------------------------------------- tables that are swapped, requests, tags


@query(
    """SELECT 'people' AS name, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'orders', count(*) FROM orders
    UNION ALL SELECT 'log', 2 * count(*) FROM events UNION ALL SELECT 'tags', count(DISTINCT user_id) FROM events"""
)
def rebuild_swap(spark, sf_dir):
    """Derived tables built twice, durable ones only added to: what a reader sees in the end."""
    store = Store(spark, scratch_path(spark, "store"))
    customer, orders, events = (table(spark, sf_dir, t) for t in ("customer", "orders", "events"))
    store.rebuild({"people": customer, "orders": orders})
    store.append("log", events.select("event_id", "ts"))
    store.append_new("tags", events.select("user_id", "event_id"), "user_id")
    store.rebuild({"people": store.read("people").where("c_custkey % 2 = 0"), "orders": orders})
    store.append("log", events.select("event_id", "ts"))
    store.append_new("tags", events.select("user_id", "event_id"), "user_id")
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    log = store.durable("log", "event_id long, ts timestamp")
    return one("people", store.read("people")).unionByName(one("orders", store.read("orders"))).unionByName(one("log", log)).unionByName(one("tags", store.durable("tags", "user_id long, event_id long")))


def loaded(spark, sf_dir):
    """All derived tables of a run, written by one job under their rules."""
    store = Store(spark, scratch_path(spark, "store"))
    store.rebuild(load.derived_tables(all_records(spark, sf_dir)), load.RULES)
    return store


@query(f"{O.FULL}, named AS (SELECT DISTINCT root, unnest(skills) AS skill FROM members) SELECT count(*) AS source_rows_read, (SELECT count(*) FROM recs) AS source_rows_used, (SELECT count(*) FROM people) AS people_created, (SELECT count(*) FROM named) AS person_skills FROM every")
def load_run(spark, sf_dir):
    store = loaded(spark, sf_dir)
    skills = store.read("person_skills").agg(F.count("*").alias("person_skills"))
    return store.read("load_runs").select("source_rows_read", "source_rows_used", "people_created").crossJoin(skills)  # single rows


@query(
    f"""{O.FULL}, named AS (SELECT root, skill, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources FROM (SELECT root, source, unnest(skills) AS skill FROM members) GROUP BY root, skill),
    ids AS (SELECT skill, row_number() OVER (ORDER BY skill) AS skill_id FROM (SELECT DISTINCT skill FROM named))
    SELECT person_id, skill_id, named.sources FROM named JOIN ids USING (skill) JOIN numbered USING (root)"""
)
def person_skill_ids(spark, sf_dir):
    return loaded(spark, sf_dir).read("person_skills")


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'not_a_list' END AS error, CASE WHEN turn % 3 = 2 THEN NULL ELSE CASE turn % 3 WHEN 0 THEN 2 ELSE 1 END END AS n,
    CASE WHEN turn % 3 = 0 THEN role END AS first_role FROM conversations"""
)
def request_rows(spark, sf_dir):
    row = F.to_json(F.struct("role", "text"))
    body = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("["), row, F.lit(", 7]"))).when(F.col("turn") % 3 == 1, "[null]").otherwise(row)
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", serving.request_rows(body).alias("r"))
    n = F.when(F.col("r.error").isNull(), F.size("r.rows"))
    return r.select("conv_id", "turn", "r.error", n.alias("n"), F.try_element_at(F.get("r.rows", 0), F.lit("role")).alias("first_role"))


@query(
    f"""{O.FULL}, q AS (SELECT row_number AS id, CASE WHEN row_number % 5 = 0 THEN 'nobody' ELSE root END AS root FROM members WHERE source = 'gig')
    SELECT id, q.root, CASE WHEN p.root IS NULL THEN 'unknown_person' WHEN coalesce(email, phone) IS NULL THEN 'no_key' END AS person_error FROM q LEFT JOIN people p ON p.root = q.root"""
)
def tag_person_errors(spark, sf_dir):
    rows = members(spark, sf_dir)
    folk = golden.people(rows, identity.match_methods(rows))
    wanted = rows.where("source = 'gig'").select(F.col("row_number").alias("id"), F.when(F.col("row_number") % 5 == 0, "nobody").otherwise(F.col("root")).alias("root"))
    return serving.person_error(wanted, folk).select("id", "root", "person_error")


@query(
    f"""{O.FULL}, tags AS (SELECT coalesce(email, phone) AS person_key FROM people WHERE length(coalesce(email, phone)) % 3 = 0)
    SELECT count(*) AS remaining FROM people WHERE coalesce(email, phone) IS NOT NULL AND root IN (SELECT root FROM members WHERE len(skills) > 0) AND coalesce(email, phone) NOT IN (SELECT person_key FROM tags)"""
)
def queue_remaining(spark, sf_dir):
    rows = members(spark, sf_dir)
    folk = golden.people(rows, identity.match_methods(rows))
    key = F.coalesce("email", "phone")
    return serving.waiting(folk, golden.person_skills(rows), folk.where(F.length(key) % 3 == 0).select(key.alias("person_key")))


@query("SELECT doc_id, text[1:500] AS reason, text[1:300] AS summary FROM documents")
def stored_remarks(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", serving.cut(text).alias("reason"), serving.cut(text, serving.SUMMARY_CHARS).alias("summary"))


# ---------------------------------------------------------------- clips


def clips(spark, sf_dir):
    """Each embedding as a WAV file's bytes, some files damaged."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", wav.encoded(F.col("embedding"), 16_000).alias("content"))
    return e.withColumn("content", F.when(F.col("vec_id") % 10 == 7, F.lit(b"ID3 no wave")).otherwise(F.col("content")))


@query(
    """SELECT vec_id, CASE WHEN vec_id % 10 = 7 THEN 'not_wav' END AS error, CASE WHEN vec_id % 10 <> 7 THEN 16000 END AS rate, CASE WHEN vec_id % 10 <> 7 THEN 16 END AS bits,
    CASE WHEN vec_id % 10 <> 7 THEN list_transform(embedding, lambda v: CAST(CAST(greatest(-32768, least(32767, floor(CAST(v AS DOUBLE) * 32768 + 0.5))) AS BIGINT) AS VARCHAR)) END AS whole FROM embeddings""".replace("list_transform(embedding", "array_to_string(list_transform(embedding").replace("AS VARCHAR)) END AS whole", "AS VARCHAR)), ' ') END AS whole")
)
def wav_round_trip(spark, sf_dir):
    back = wav.decoded(clips(spark, sf_dir))
    whole = F.array_join(F.transform("samples", lambda v: (v.cast("double") * 32768).cast("long").cast("string")), " ")
    return back.select("vec_id", "error", "rate", "bits", whole.alias("whole"))


@query(
    """SELECT vec_id, vec_id % 10 <> 7 AS analysis_ok, CASE WHEN vec_id % 10 = 7 THEN 'not_wav' END AS analysis_note, CASE WHEN vec_id % 10 <> 7 THEN round((44 + 2 * len(embedding)) * 8.0 / round(len(embedding) / 16000.0, 3) / 1000.0, 1) END AS bitrate_kbps,
    CASE WHEN vec_id % 10 <> 7 THEN 256.0 END AS pcm_bitrate_kbps FROM embeddings"""
)
def clip_bit_rates(spark, sf_dir):
    """Bit rates and outcome of each clip, damaged ones among them."""
    files = clips(spark, sf_dir).withColumn("length", F.length("content"))
    return signal.analysed(wav.decoded(files), "vec_id").select("vec_id", "analysis_ok", "analysis_note", "bitrate_kbps", "pcm_bitrate_kbps")


@query()
def clip_analysis(spark, sf_dir):
    """All measurements of each clip; one that can't be read keeps its row and its error."""
    return signal.analysed(wav.decoded(clips(spark, sf_dir)), "vec_id").select("vec_id", "error", "peak_dbfs", "rms_dbfs", "seconds", "integrated_lufs", "score", "label")
