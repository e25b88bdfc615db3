"""The registered queries over the given tables, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmerge.functions import normalize as N
from quillmerge.functions.text import is_blank, sorted_json, squash
from quillmerge.operators import audit, golden, identity, issues, load, serving, structural
from quillmerge.plans import oracles as O
from quillmerge.sources import messy
from quillmerge.sources.records import SPECS, all_records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark, sf_dir, name):
    return messy.source(spark, sf_dir, name)


def members(spark, sf_dir):
    return identity.resolve(all_records(spark, sf_dir))


def people(spark, sf_dir):
    rows = members(spark, sf_dir)
    return golden.people(rows, identity.match_methods(rows))


def with_squashed(df, column):
    """The column's squashed text as ``s``, computed once."""
    return df.withColumn("s", squash(F.col(column)))


# ---------------------------------------------------------------- normalisers


@query(f"{O.CTES} SELECT row_number AS id, {O.sq('full_name')} AS squashed, {O.sq('full_name')} = '' AS blank FROM applicants")
def norm_squash(spark, sf_dir):
    return raw(spark, sf_dir, "applicants").select(F.col("row_number").alias("id"), squash(F.col("full_name")).alias("squashed"), is_blank(F.col("full_name")).alias("blank"))


def _categories(problems):
    return F.array_join(F.transform(problems, lambda p: p["category"]), ",")


@query(
    f"""{O.CTES} SELECT row_number AS id, {O.name_value('full_name')} AS name, {O.name_key('full_name')} AS name_key, {O.abbreviated('full_name')} AS abbreviated,
    concat_ws(',', CASE WHEN full_name = '' THEN 'missing_value' ELSE CASE row_number % 7 WHEN 0 THEN 'inconsistent_casing' WHEN 1 THEN 'inconsistent_casing' WHEN 2 THEN 'abbreviated_name' END END) AS problems FROM applicants"""
)
def norm_name(spark, sf_dir):
    return with_squashed(raw(spark, sf_dir, "applicants"), "full_name").withColumn("n", N.name(F.col("full_name"), s=F.col("s"))).select(F.col("row_number").alias("id"), F.col("n.value").alias("name"), F.col("n.key").alias("name_key"), F.col("n.abbreviated"), _categories(F.col("n.problems")).alias("problems"))


@query(f"{O.CTES} SELECT w.row_number AS id, coalesce({O.name_key('a.full_name')} IS NOT NULL AND {O.name_key('w.full_name')} IS NOT NULL AND (a.row_number % 7 = 2 OR {O.name_key('a.full_name')} = {O.name_key('w.full_name')}), false) AS compatible FROM applicants a JOIN workers w ON a.row_number = w.row_number")
def names_compatible(spark, sf_dir):
    a = raw(spark, sf_dir, "applicants").select("row_number", N.name(F.col("full_name"))["tokens"].alias("a"))
    b = raw(spark, sf_dir, "workers").select("row_number", N.name(F.col("full_name"))["tokens"].alias("b"))
    return a.join(b, "row_number").select(F.col("row_number").alias("id"), N.names_compatible(F.col("a"), F.col("b")).alias("compatible"))


@query(
    f"""{O.CTES} SELECT row_number AS id, {O.phone_value('phone')} AS phone, {O.phone_value('phone')} IS NULL AS invalid,
    coalesce({O.phone_value('phone')} <> {O.sq('phone')}, false) AS reformatted FROM contacts"""
)
def norm_phone(spark, sf_dir):
    p = with_squashed(raw(spark, sf_dir, "contacts"), "phone").withColumn("p", N.phone(F.col("phone"), s=F.col("s")))
    has = lambda c: F.exists("p.problems", lambda x: x["category"] == c)
    return p.select(F.col("row_number").alias("id"), F.col("p.value").alias("phone"), has("invalid_format").alias("invalid"), has("inconsistent_format").alias("reformatted"))


@query(f"{O.CTES} SELECT row_number AS id, {O.email_value('email')} AS email, {O.email_alias('email')} AS alias_of, split_part({O.email_value('email')}, '@', 2) AS domain FROM applicants")
def norm_email(spark, sf_dir):
    return with_squashed(raw(spark, sf_dir, "applicants"), "email").withColumn("e", N.email(F.col("email"), s=F.col("s"))).select(F.col("row_number").alias("id"), F.col("e.value").alias("email"), F.col("e.alias_of"), F.col("e.domain"))


@query(
    f"""{O.CTES} SELECT row_number AS id, {O.city_value('city')} AS city, {O.mapped(O.config.CITY_REGION, O.city_value('city'))} AS region, {O.region_guess('city')} AS region_guess,
    suffix(city, ' ') AS trailing FROM workers"""
)
def norm_city(spark, sf_dir):
    c = with_squashed(raw(spark, sf_dir, "workers"), "city").withColumn("c", N.city(F.col("city"), s=F.col("s")))
    return c.select(F.col("row_number").alias("id"), F.col("c.value").alias("city"), F.col("c.region"), F.col("c.region_guess"), F.exists("c.problems", lambda p: p["category"] == "trailing_whitespace").alias("trailing"))


@query(
    """SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 40 IN (0, 17, 18) THEN NULL ELSE o_orderdate END AS DATE) AS value,
    CASE WHEN o_orderkey % 40 NOT IN (0, 17, 18) AND o_orderkey % 4 IN (1, 2) AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN true ELSE false END AS ambiguous FROM orders"""
)
def norm_date(spark, sf_dir):
    o, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    spelt = F.when(F.col("o_orderkey") % 40 == 0, "2026-02-31").when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "dd-MM-yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "MM/dd/yyyy")).when(F.col("o_orderkey") % 8 == 3, F.date_format(d, "d MMMM yyyy")).otherwise(F.date_format(d, "d MMM yyyy"))
    cut = F.col("o_orderkey") % 40  # neither mixed separators nor a cut month name is a date
    spelt = F.when(cut == 17, F.date_format(d, "dd-MM/yyyy")).when(cut == 18, F.concat(F.date_format(d, "d "), F.lit("Februa 2026"))).otherwise(spelt)
    return o.select(F.col("o_orderkey").alias("id"), N.date(spelt).alias("n")).select("id", "n.value", "n.ambiguous")


@query(f"{O.CTES} SELECT row_number AS id, {O.ctc_value('ctc')} AS value, CASE WHEN CAST(ctc AS DOUBLE) < 1000 THEN 'lakh_per_annum' ELSE 'absolute_inr' END AS unit FROM applicants")
def norm_unit_mix(spark, sf_dir):
    return raw(spark, sf_dir, "applicants").withColumn("c", N.ctc(F.col("ctc"))).select(F.col("row_number").alias("id"), "c.value", "c.unit")


@query(f"{O.CTES} SELECT row_number AS id, {O.hourly('rate')} AS hourly, {O.monthly('rate')} AS monthly, {O.rate_parts('rate')[0]} AS basis FROM workers")
def norm_rate(spark, sf_dir):
    return with_squashed(raw(spark, sf_dir, "workers"), "rate").withColumn("r", N.rate(F.col("rate"), s=F.col("s"))).select(F.col("row_number").alias("id"), "r.hourly", "r.monthly", "r.basis")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS price, l_linenumber <> 7 AND l_extendedprice > 50000 AS out_of_range FROM lineitem")
def norm_float(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 7, "nan").otherwise(F.col("l_extendedprice").cast("string"))
    known = with_squashed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t")), "t")
    n = known.select("l_orderkey", "l_linenumber", N.floating(F.col("t"), "price", 0, 50_000, s=F.col("s")).alias("n"))
    return n.select("l_orderkey", "l_linenumber", F.col("n.value").alias("price"), F.exists("n.problems", lambda p: p["category"] == "out_of_range").alias("out_of_range"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS quantity, CAST(CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN l_quantity ELSE l_quantity + 1 END AS INT) AS half FROM lineitem")
def norm_int(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.whole(q.cast("string"), "q")["value"].alias("quantity"), N.whole((q + 0.5).cast("string"), "q")["value"].alias("half"))


@query(f"{O.CTES} SELECT row_number AS id, {O.bool_value('verified')} AS verified, verified = 'maybe' AS unmapped FROM contacts")
def norm_bool(spark, sf_dir):
    b = raw(spark, sf_dir, "contacts").withColumn("b", N.boolean(F.col("verified")))
    return b.select(F.col("row_number").alias("id"), F.col("b.value").alias("verified"), F.exists("b.problems", lambda p: p["category"] == "unmapped_value").alias("unmapped"))


@query(f"{O.CTES} SELECT row_number AS id, {O.status_value('status')} AS status FROM workers")
def norm_status(spark, sf_dir):
    return raw(spark, sf_dir, "workers").select(F.col("row_number").alias("id"), N.status(F.col("status"))["value"].alias("status"))


@query(f"{O.CTES} SELECT row_number AS id, array_to_string({O.skill_list('skills')}, ';') AS skills FROM applicants")
def norm_skills(spark, sf_dir):
    return raw(spark, sf_dir, "applicants").select(F.col("row_number").alias("id"), F.array_join(N.skills(F.col("skills"))["values"], ";").alias("skills"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---------------------------------------------------------------- structure

HEADER = ["email_id", "worker_name", "rate", "location", "status", "skill_tags"]


def damaged(spark, sf_dir):
    """Worker rows as cells, some blank, some a repeated header, some short or long, some rotated."""
    w = raw(spark, sf_dir, "workers").withColumn("city", F.trim("city")).withColumn("skills", F.lit("n8n, Python"))
    cells = F.array("email", "full_name", F.lit("15k/month"), "city", F.lit("Active"), "skills")
    k = F.col("row_number")
    values = (
        F.when(k % 37 == 3, F.array(*[F.lit(" ") for _ in HEADER]))
        .when(k % 41 == 4, F.array(*[F.lit(h.upper()) for h in HEADER]))
        .when(k % 43 == 5, F.slice(cells, 1, 4))
        .when(k % 47 == 6, F.concat(cells, F.array(F.lit("x"))))
        .when(k % 13 == 7, F.concat(F.slice(cells, 6, 1), F.slice(cells, 1, 5)))
        .when(k % 17 == 8, F.concat(F.slice(cells, 3, 4), F.slice(cells, 1, 2)))
        .otherwise(cells)
    )
    return w.select("row_number", values.alias("values"))


OUTCOME = "CASE WHEN k % 37 = 3 THEN 'blank_row' WHEN k % 41 = 4 THEN 'repeated_header' WHEN k % 43 = 5 OR k % 47 = 6 THEN 'column_count_mismatch' ELSE 'ok' END"


@query(f"{O.CTES} SELECT k AS row_number, outcome, CASE WHEN outcome IN ('ok', 'column_count_mismatch') THEN 6 END AS width FROM (SELECT CAST(row_number AS INT) AS k, {OUTCOME.replace('k %', 'row_number %')} AS outcome FROM workers)")
def structural_filter(spark, sf_dir):
    d = damaged(spark, sf_dir).withColumn("outcome", structural.row_outcome(F.col("values"), HEADER))
    return d.select("row_number", "outcome", F.when(F.col("outcome").isin("ok", "column_count_mismatch"), F.size(structural.to_width(F.col("values"), 6))).alias("width"))


@query(
    f"""{O.CTES} SELECT k AS row_number, CASE WHEN k % 13 = 7 THEN 1 WHEN k % 17 = 8 THEN 4 ELSE 0 END AS shift, email AS first_cell
    FROM (SELECT CAST(row_number AS INT) AS k, email FROM workers) WHERE {OUTCOME} = 'ok'"""
)
def rotation_repair(spark, sf_dir):
    ok = damaged(spark, sf_dir).where(structural.row_outcome(F.col("values"), HEADER) == "ok")
    fixed = structural.with_rotation(ok, "values")
    return fixed.select("row_number", "shift", F.get("repaired", 0).alias("first_cell"))


@query(f"{O.HEAD} SELECT uid, source, full_name, email, phone, city, gig_status, is_verified, monthly AS rate_monthly_inr FROM every")
def records_union(spark, sf_dir):
    return all_records(spark, sf_dir).select("uid", "source", "full_name", "email", "phone", "city", "gig_status", "is_verified", "rate_monthly_inr")


@query(f"{O.HEAD} SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE uid IN (SELECT uid FROM recs)) AS usable, count(*) FILTER (WHERE uid NOT IN (SELECT uid FROM recs)) AS rejected FROM every GROUP BY source")
def row_outcomes(spark, sf_dir):
    return issues.row_outcomes(all_records(spark, sf_dir))


@query(f"{O.HEAD} SELECT uid FROM recs")
def usable_rows(spark, sf_dir):
    return all_records(spark, sf_dir).where("usable").select("uid")


@query(f"""{O.CTES} SELECT source || ':' || row_number AS uid, CAST(json_object('city', city, 'email', email, 'full_name', full_name || ' "' || row_number || '"', 'rate', rate, 'skills', skills, 'status', status) AS VARCHAR) AS raw FROM workers""")
def source_records(spark, sf_dir):
    w = raw(spark, sf_dir, "workers").withColumn("full_name", F.concat("full_name", F.lit(' "'), F.col("row_number").cast("string"), F.lit('"')))
    return SPECS["workers"].records(w).select("uid", sorted_json(F.col("raw")).alias("raw"))


@query(f"{O.FULL} SELECT r.uid, p.person_id FROM members r JOIN numbered p ON r.root = p.root")
def record_person(spark, sf_dir):
    """Every source record with the number of its person."""
    rows = members(spark, sf_dir)
    folk = golden.numbered(golden.people(rows, identity.match_methods(rows)))
    return load.with_person(rows.select("uid"), rows, folk).select("uid", "person_id")


@query(
    """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'extension' WHEN page_id % 13 = 0 THEN 'empty' WHEN length(html) > 4000 THEN 'too_large' WHEN page_id % 7 = 0 THEN 'unsafe_name' END AS error FROM pages"""
)
def upload_validation(spark, sf_dir):
    k = F.col("page_id")
    name = F.concat(F.lit("clip"), F.when(k % 7 == 0, " ").otherwise("_"), k.cast("string"), F.when(k % 11 == 0, ".exe").when(k % 3 == 0, ".WAV").otherwise(".mp3"))
    size = F.when(k % 13 == 0, 0).otherwise(F.length("html"))
    return table(spark, sf_dir, "pages").select("page_id", serving.upload_error(name, size, most=4000).alias("error"))


# ---------------------------------------------------------------- identity


@query(f"{O.MATCHED} SELECT uid, root FROM strong")
def match_strong(spark, sf_dir):
    return identity.strong_clusters(all_records(spark, sf_dir))


@query(f"{O.RESOLVED} SELECT uid, strong_root, root FROM members")
def connected_components(spark, sf_dir):
    return members(spark, sf_dir).select("uid", "strong_root", "root")


@query(f"{O.RESOLVED}, {O.METHODS} SELECT root, methods, confidence FROM methods")
def match_methods(spark, sf_dir):
    return identity.match_methods(members(spark, sf_dir))


@query(f"{O.RESOLVED} SELECT name_key, city, lo AS src, hi AS dst FROM decided WHERE verdict = 'merge'")
def weak_matches(spark, sf_dir):
    r = all_records(spark, sf_dir)
    return identity.weak_merges(identity.weak_decisions(r, identity.strong_clusters(r)))


@query(
    f"""{O.RESOLVED} SELECT verdict AS reason, d.name_key, d.city, e.root, f.size FROM decided d JOIN elig e ON d.name_key = e.name_key AND d.city = e.city JOIN facts f ON e.root = f.root WHERE verdict = 'ambiguous_name_city'
    UNION ALL SELECT verdict, name_key, city, lo || ' | ' || hi, size FROM decided WHERE verdict = 'same_name_conflicting_strong_key'"""
)
def weak_match_reviews(spark, sf_dir):
    r = all_records(spark, sf_dir)
    clusters = identity.strong_clusters(r)
    return identity.merge_reviews(r, clusters, identity.weak_decisions(r, clusters))


@query(
    f"""{O.RESOLVED}, bearers AS (SELECT DISTINCT name_key, root FROM members WHERE name_key IS NOT NULL AND city IS NOT NULL), shared AS (SELECT name_key, count(*) AS people FROM bearers GROUP BY name_key HAVING count(*) > 1)
    SELECT name_key, people, array_to_string(list_sort(list(DISTINCT city)), ', ') AS cities FROM shared JOIN bearers USING (name_key) JOIN members m USING (root) WHERE city IS NOT NULL GROUP BY shared.name_key, people""".replace("JOIN members m USING (root)", "JOIN (SELECT root, city FROM members) m USING (root)")
)
def homonyms(spark, sf_dir):
    return identity.homonyms(members(spark, sf_dir))


@query(
    """SELECT event_type AS source, 'user_id' AS field, CAST(user_id AS VARCHAR) AS value, CAST(event_id AS INT) AS row_number, CAST(min(event_id) OVER (PARTITION BY event_type, user_id) AS INT) AS first_row FROM events
    QUALIFY event_id > min(event_id) OVER (PARTITION BY event_type, user_id)"""
)
def intra_source_dups(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").cast("int").alias("row_number"), F.col("user_id").cast("string").alias("user_id"))
    return identity.duplicates_within_source(e, ("user_id",))


# ---------------------------------------------------------------- golden records


@query(f"{O.FULL} SELECT root, ref, split_part(ref, ':', 1) AS first_seen, record_count, source_count, sources, methods, confidence, full_name, email, phone, city, {O.mapped(O.config.CITY_REGION, 'city')} AS region FROM people")
def golden_people(spark, sf_dir):
    return people(spark, sf_dir).select("root", "ref", "first_seen", "record_count", "source_count", "sources", "methods", "confidence", "full_name", "email", "phone", "city", "region")


@query(f"{O.RESOLVED}, {O.NAMES} SELECT root, full_name FROM names")
def golden_name(spark, sf_dir):
    return golden.elect_names(members(spark, sf_dir)).where("full_name is not null")


@query(f"{O.RESOLVED}, {O.EMAILS} SELECT root, email FROM emails")
def golden_email(spark, sf_dir):
    return golden.elect_emails(members(spark, sf_dir)).where("email is not null")


@query(f"{O.RESOLVED}, {O.PHONES} SELECT root, phone FROM phones")
def golden_phone(spark, sf_dir):
    return golden.elect_phones(members(spark, sf_dir)).where("phone is not null")


@query(f"{O.RESOLVED}, {O.CITIES} SELECT root, city, guess AS region_guess FROM cities")
def golden_city(spark, sf_dir):
    return golden.elect_cities(members(spark, sf_dir))


@query(f"{O.RESOLVED}, {O.elected('gig_status', O.ORDER, 's')}, {O.elected('is_verified', O.ORDER, 'v')}, {O.elected('projects', O.ORDER, 'p')} SELECT DISTINCT m.root, gig_status, is_verified, projects AS projects_completed FROM (SELECT DISTINCT root FROM members) m LEFT JOIN s USING (root) LEFT JOIN v USING (root) LEFT JOIN p USING (root)")
def golden_exclusive(spark, sf_dir):
    return golden.elect_exclusive(members(spark, sf_dir)).select("root", "gig_status", "is_verified", "projects_completed")


SHARED = ("full_name", "email", "phone", "city")
LOST = f"""held AS ({' UNION ALL '.join(f"SELECT root, source, '{c}' AS field, {c} AS value FROM members WHERE {c} IS NOT NULL" for c in SHARED)}),
win AS ({' UNION ALL '.join(f"SELECT root, '{c}' AS field, {c} AS chosen FROM {t}" for c, t in zip(SHARED, ('names', 'emails', 'phones', 'cities'), strict=True))}),
bv AS (SELECT root, field, chosen, value, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS n FROM held JOIN win USING (root, field) GROUP BY ALL),
tot AS (SELECT root, field, sum(n) AS total, max(n) FILTER (WHERE value <> chosen) AS next FROM bv GROUP BY ALL)"""


LOST_ROWS = f"""SELECT l.root, l.field, l.chosen, w.sources AS chosen_sources, l.value AS rejected, l.sources AS rejected_sources,
    CASE WHEN l.field = 'city' AND w.n > next THEN 'majority vote across sources (' || w.n || '/' || total || ')' ELSE {O.mapped(golden.RULES, 'l.field')} END AS rule
    FROM bv l JOIN bv w ON l.root = w.root AND l.field = w.field AND w.value = w.chosen JOIN tot t ON t.root = l.root AND t.field = l.field WHERE l.value <> l.chosen"""


@query(f"{O.RESOLVED}, {O.NAMES}, {O.EMAILS}, {O.PHONES}, {O.CITIES}, {LOST} {LOST_ROWS}")
def field_conflicts(spark, sf_dir):
    return golden.all_conflicts(members(spark, sf_dir)).where(F.col("field").isin(*SHARED))


@query(
    f"""{O.RESOLVED}, {O.elected('experience', O.ORDER, 'x')} SELECT m.root, 'experience_years' AS field, CAST(x.experience AS VARCHAR) AS chosen, CAST(m.experience AS VARCHAR) AS rejected, m.source || ' (later row)' AS rejected_sources
    FROM members m JOIN x USING (root) WHERE m.experience <> x.experience"""
)
def exclusive_conflicts(spark, sf_dir):
    return golden.all_conflicts(members(spark, sf_dir)).where("field = 'experience_years'").select("root", "field", "chosen", "rejected", "rejected_sources")


@query(f"{O.FULL} SELECT person_id, ref FROM numbered")
def person_ids(spark, sf_dir):
    return golden.numbered(people(spark, sf_dir)).select("person_id", "ref")


@query(f"{O.RESOLVED} SELECT root, skill, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources FROM (SELECT root, source, unnest(skills) AS skill FROM members) GROUP BY root, skill")
def person_skills_norm(spark, sf_dir):
    return golden.person_skills(members(spark, sf_dir))


@query(f"{O.HEAD} SELECT DISTINCT unnest(skills) AS skill_name FROM every")
def skills_dim(spark, sf_dir):
    return all_records(spark, sf_dir).select(F.explode("skills").alias("skill_name")).distinct()


@query(f"{O.FULL} SELECT root, sources FROM people WHERE source_count = 3")
def three_way(spark, sf_dir):
    return people(spark, sf_dir).where("source_count = 3").select("root", "sources")


# ---------------------------------------------------------------- audit


@query(f"{O.RESOLVED}, {O.EMAILS} SELECT split_part(email, '@', 2) AS domain, count(*) AS n FROM emails GROUP BY 1")
def domain_counts(spark, sf_dir):
    return audit.domain_counts(golden.elect_emails(members(spark, sf_dir)))


@query(f"{O.RESOLVED}, {O.EMAILS} SELECT count(*) FILTER (WHERE regexp_matches(email, '([@.]example\\.(com|org|net|in)|\\.(example|test|invalid|localhost))$')) AS reserved, count(*) AS total FROM emails")
def reserved_domains(spark, sf_dir):
    return audit.reserved_domains(golden.elect_emails(members(spark, sf_dir)))


@query("SELECT o_orderpriority AS basis, median(o_totalprice) AS median, count(*) AS n FROM orders GROUP BY 1")
def median_by_basis(spark, sf_dir):
    return audit.median_by(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query("WITH m AS (SELECT event_type, median(value) AS median FROM events GROUP BY 1) SELECT event_type, event_id, value, median FROM events JOIN m USING (event_type) WHERE value > 3 * median OR value < median / 3")
def outliers_median3x(spark, sf_dir):
    return audit.outliers(table(spark, sf_dir, "events"), "event_type", "value", "event_id")


@query(
    """WITH r AS (SELECT c_mktsegment, c_custkey, abs(c_acctbal) / greatest(c_custkey % 9, 0.5) AS ratio FROM customer), m AS (SELECT c_mktsegment, median(ratio) AS median FROM r GROUP BY 1)
    SELECT c_mktsegment, c_custkey, ratio, median FROM r JOIN m USING (c_mktsegment) WHERE ratio > 3 * median OR ratio < median / 3"""
)
def outliers_ratio(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("ratio", F.abs("c_acctbal") / F.greatest((F.col("c_custkey") % 9).cast("double"), F.lit(0.5)))
    return audit.outliers(c, "c_mktsegment", "ratio", "c_custkey")


@query(f"{O.RESOLVED}, {O.elected('is_verified', O.ORDER, 'v')}, {O.elected('projects', O.ORDER, 'p')} SELECT root, projects AS projects_completed FROM v JOIN p USING (root) WHERE projects >= 10 AND NOT is_verified")
def trust_violations(spark, sf_dir):
    return audit.trust_violations(golden.elect_exclusive(members(spark, sf_dir))).select("root", "projects_completed")


@query(f"{O.FULL} SELECT count(*) AS people, count(*) FILTER (WHERE email IS NULL) AS no_email, count(*) FILTER (WHERE phone IS NULL) AS no_phone, count(*) FILTER (WHERE email IS NULL AND phone IS NULL) AS neither FROM people")
def key_coverage(spark, sf_dir):
    return audit.key_coverage(people(spark, sf_dir))


@query(
    f"""{O.RESOLVED}, u AS (SELECT root, source, list_sort(list_distinct(flatten(list(skills)))) AS s FROM members WHERE len(skills) > 0 GROUP BY root, source),
    b AS (SELECT a.root, a.s AS x, g.s AS y FROM u a JOIN u g ON a.root = g.root WHERE a.source = 'naukri' AND g.source = 'gig'),
    d AS (SELECT root, array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), ', ') AS only_a, array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), ', ') AS only_b FROM b)
    SELECT * FROM d WHERE only_a <> '' OR only_b <> ''"""
)
def skill_agreement(spark, sf_dir):
    return audit.skill_agreement(members(spark, sf_dir))


@query("SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def uniqueness_violations(spark, sf_dir):
    return audit.repeated(table(spark, sf_dir, "orders"), "o_custkey").withColumn("value", F.col("value").cast("string"))


# ---------------------------------------------------------------- issues


def found(spark, sf_dir):
    return issues.issues(all_records(spark, sf_dir))


@query(f"{O.ISSUES} SELECT * FROM issues")
def issues_exploded(spark, sf_dir):
    return found(spark, sf_dir)


@query(f"{O.ISSUES} SELECT severity, category, field, count(*) AS n, count(DISTINCT source) AS sources FROM issues GROUP BY ALL")
def issue_classes(spark, sf_dir):
    return issues.classes(found(spark, sf_dir))


@query(f"{O.ISSUES} SELECT source, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total FROM issues GROUP BY source")
def issues_per_source(spark, sf_dir):
    return issues.per_source(found(spark, sf_dir))


@query(f"{O.ISSUES} SELECT category, count(*) AS n FROM issues GROUP BY category ORDER BY n DESC, category LIMIT 10")
def top_categories(spark, sf_dir):
    return issues.top_categories(found(spark, sf_dir))


@query(
    f"""{O.ISSUES} SELECT category, severity, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
    array_to_string(list_slice(list(source || ':' || row_number ORDER BY source, row_number, field), 1, 4), ', ') AS examples FROM issues GROUP BY category, severity"""
)
def issue_buckets(spark, sf_dir):
    return issues.buckets(found(spark, sf_dir))


@query(f"{O.ISSUES} SELECT * FROM issues")
def issues_sorted(spark, sf_dir):
    return issues.in_order(found(spark, sf_dir))
