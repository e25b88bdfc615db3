"""Registered queries of the serving, signal and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmerge.operators import issues, serving, signal
from quillmerge.plans import oracles as O
from quillmerge.plans.catalog import found, members, people, query, raw, table
from quillmerge.operators import golden
from quillmerge.sources.scratch import materialise, scratch_path

# ---------------------------------------------------------------- incoming rows


def incoming(spark, sf_dir):
    """Contact rows as they might arrive: some known by phone, some by e-mail of another spelling, some new."""
    c = raw(spark, sf_dir, "contacts")
    k = F.col("row_number")
    return c.select(
        k.alias("row_id"),
        F.when(k % 5 == 1, F.lit("")).otherwise(F.col("full_name")).alias("Full Name"),
        F.when(k % 5 == 2, F.concat(F.lower(F.replace("full_name", F.lit(" "), F.lit("."))), k.cast("string"), F.lit("@mail.test"))).otherwise("").alias("E-Mail"),
        F.when(k % 5 == 3, F.col("phone")).when(k % 5 == 4, F.lit("12")).otherwise("").alias("Mobile"),
        F.col("city").alias("Location"),
    )


def arrived(spark, sf_dir):
    mapped = serving.mapped_columns(incoming(spark, sf_dir), keep=("row_id",))
    return mapped.where("skip_reason is null").select("row_id", "in_name", "in_email", "in_phone", "in_city")


ARRIVED = f"""arrived AS (SELECT row_number AS row_id, CASE WHEN row_number % 5 = 1 THEN '' ELSE full_name END AS in_name,
  CASE WHEN row_number % 5 = 2 THEN lower(replace(full_name, ' ', '.')) || row_number || '@mail.test' ELSE '' END AS in_email,
  CASE row_number % 5 WHEN 3 THEN phone WHEN 4 THEN '12' ELSE '' END AS in_phone, city AS in_city FROM contacts)"""
KEPT = "kept AS (SELECT * FROM arrived WHERE in_name <> '' OR in_email <> '' OR in_phone <> '')"
VERDICTS = f"""{O.FULL}, {ARRIVED}, {KEPT},
checked AS (
  SELECT row_id, e.root AS e_root, p.root AS p_root, n.n, n.root AS n_root, {O.email_value('in_email')} AS em, {O.phone_value('in_phone')} AS ph FROM kept
  LEFT JOIN (SELECT email, min(root) AS root FROM people WHERE email IS NOT NULL GROUP BY email) e ON e.email = {O.email_value('in_email')}
  LEFT JOIN (SELECT phone, min(root) AS root FROM people WHERE phone IS NOT NULL GROUP BY phone) p ON p.phone = {O.phone_value('in_phone')}
  LEFT JOIN (SELECT lower(full_name) AS l, city, count(*) AS n, min(root) AS root FROM people WHERE full_name IS NOT NULL AND city IS NOT NULL GROUP BY 1, 2) n
    ON n.l = lower({O.name_value('in_name')}) AND n.city = {O.city_value('in_city')}
), methods2 AS (
  SELECT *, CASE WHEN e_root IS NOT NULL THEN 'email' WHEN p_root IS NOT NULL THEN 'phone' WHEN n = 1 THEN 'name_city' WHEN n > 1 THEN 'name_city_ambiguous' WHEN em IS NULL AND ph IS NULL THEN 'no_key' ELSE 'none' END AS method FROM checked
), verdicts AS (
  SELECT row_id, method, CASE WHEN method IN ('email', 'phone') THEN 'duplicate' WHEN method = 'none' THEN 'new' ELSE 'needs_review' END AS verdict,
         coalesce(e_root, p_root, CASE WHEN n = 1 THEN n_root END) AS person FROM methods2
)"""


@query(
    f"{O.CTES}, {ARRIVED} SELECT row_id, in_name, in_email, in_phone, trim(in_city) AS in_city, CASE WHEN in_name = '' AND in_email = '' AND in_phone = '' THEN 'no_identity' END AS skip_reason FROM arrived"
)
def incoming_map_columns(spark, sf_dir):
    mapped = serving.mapped_columns(incoming(spark, sf_dir), keep=("row_id",))
    return mapped.select("row_id", "in_name", "in_email", "in_phone", "in_city", "skip_reason")


def verdicts(spark, sf_dir):
    return serving.classify_incoming(arrived(spark, sf_dir), people(spark, sf_dir))


@query(f"{VERDICTS} SELECT row_id, verdict, method, person FROM verdicts")
def dup_check(spark, sf_dir):
    return verdicts(spark, sf_dir)


@query(
    f"""{VERDICTS} SELECT count(*) AS checked, count(*) FILTER (WHERE verdict = 'duplicate') AS duplicate, count(*) FILTER (WHERE verdict = 'needs_review') AS needs_review,
    count(*) FILTER (WHERE verdict = 'new') AS "new", count(*) FILTER (WHERE verdict IN ('duplicate', 'needs_review')) > 0 AS needs_attention FROM verdicts"""
)
def dup_check_summary(spark, sf_dir):
    return serving.check_summary(verdicts(spark, sf_dir))


@query(
    f"""{VERDICTS}, mailed AS (SELECT row_id, email AS in_email FROM kept JOIN workers ON workers.row_number = row_id),
    c AS (SELECT count(*) AS checked, count(*) FILTER (WHERE verdict = 'duplicate') AS duplicate, count(*) FILTER (WHERE verdict = 'needs_review') AS needs_review, count(*) FILTER (WHERE verdict = 'new') AS "new" FROM verdicts)
    SELECT checked, duplicate, needs_review, "new", duplicate + needs_review > 0 AS needs_attention, duplicate > 0 AS has_duplicates,
    (SELECT count(*) FILTER (WHERE split_part({O.email_value('in_email')}, '@', 2) LIKE 'example.%') FROM mailed) AS undeliverable,
    checked || ' row(s): ' || duplicate || ' duplicate, ' || "new" || ' new, ' || needs_review || ' need review' AS summary FROM c"""
)
def batch_totals(spark, sf_dir):
    """A batch's totals, its rows with the addresses of the workers of the same number."""
    mails = raw(spark, sf_dir, "workers").select(F.col("row_number").alias("row_id"), "email")
    rows = arrived(spark, sf_dir).join(mails, "row_id").withColumn("in_email", F.col("email"))
    return serving.batch_totals(verdicts(spark, sf_dir), rows)


@query(
    f"""{VERDICTS}, r AS (SELECT verdict, row_id, row_number() OVER (PARTITION BY verdict ORDER BY row_id) AS rn FROM verdicts WHERE verdict <> 'new')
    SELECT verdict, string_agg(CAST(row_id AS VARCHAR), ', ' ORDER BY row_id) FILTER (WHERE rn <= 5) || CASE WHEN count(*) > 5 THEN ', +' || (count(*) - 5) || ' more' ELSE '' END AS line FROM r GROUP BY verdict"""
)
def alert_digest(spark, sf_dir):
    return serving.digest(verdicts(spark, sf_dir))


@query(f"{VERDICTS} SELECT row_id, verdict, method, person FROM verdicts")
def stream_incoming_check(spark, sf_dir):
    """The same check by a file stream that runs until all files are read."""
    from quillmerge.streaming.incoming import start_checks

    source, out, mark = (scratch_path(spark, x) for x in ("arrivals", "verdicts", "stream"))
    rows = arrived(spark, sf_dir)
    rows.write.parquet(source)
    known = materialise(people(spark, sf_dir), "people")
    start_checks(spark.readStream.schema(rows.schema).parquet(source), known, out, mark).awaitTermination()
    return spark.read.schema("row_id int, verdict string, method string, person string").parquet(out).select("row_id", "verdict", "method", "person")


@query(f"{VERDICTS} SELECT verdict, method, count(*) AS n FROM verdicts GROUP BY verdict, method")
def csv_arrivals(spark, sf_dir):
    """The check of CSV files as they arrive, with its ledger: verdicts by method, each row once though the stream runs twice."""
    from quillmerge.streaming.arrivals import Arrivals

    source, out = scratch_path(spark, "arrivals-csv"), scratch_path(spark, "arrival-sinks")
    rows = arrived(spark, sf_dir)
    rows.select(F.col("in_name").alias("Full Name"), F.col("in_email").alias("E-mail"), F.col("in_phone").alias("Mobile"), F.col("in_city").alias("Town")).write.csv(source, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    known = materialise(people(spark, sf_dir), "people")
    arrivals = Arrivals(spark, out, lambda: known)
    for mark in ("first", "second"):  # the second run has lost its checkpoint
        arrivals.start(source, scratch_path(spark, mark)).awaitTermination()
    return arrivals.read("verdicts").groupBy("verdict", "method").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- tags

TAGGED = "tags AS (SELECT coalesce(email, phone) AS person_key FROM people WHERE coalesce(email, phone) IS NOT NULL AND length(coalesce(email, phone)) % 3 = 0)"


def tags_of(folk):
    key = F.coalesce("email", "phone")
    return folk.where(key.isNotNull() & (F.length(key) % 3 == 0)).select(key.alias("person_key"))


@query(
    f"""{O.FULL}, {TAGGED} SELECT coalesce(email, phone) AS person_key, full_name FROM people WHERE coalesce(email, phone) IS NOT NULL AND root IN (SELECT root FROM members WHERE len(skills) > 0)
    AND coalesce(email, phone) NOT IN (SELECT person_key FROM tags) ORDER BY 1 LIMIT 20"""
)
def untagged_queue(spark, sf_dir):
    rows = members(spark, sf_dir)
    from quillmerge.operators.identity import match_methods

    folk = golden.people(rows, match_methods(rows))
    return serving.untagged(folk, golden.person_skills(rows), tags_of(folk))


TAG_TEXT = "CASE event_id % 4 WHEN 0 THEN ' DATA ' WHEN 1 THEN 'web-dev' WHEN 2 THEN 'chef' ELSE 'Generalist' END"
CONF_TEXT = "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '0.9' WHEN 2 THEN '1.5' WHEN 3 THEN 'high' ELSE '0.45' END"
CHECKED = f"""WITH t AS (SELECT event_id, user_id, ts, lower(trim({TAG_TEXT})) AS c, {CONF_TEXT} AS x FROM events),
v AS (SELECT event_id, user_id, ts, c, TRY_CAST(nullif(x, '') AS DOUBLE) AS conf,
  CASE WHEN c = 'chef' THEN 'unknown_category' WHEN x IN ('1.5', 'high') THEN 'bad_confidence' END AS error FROM t)"""


def checked_tags(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"cat": F.expr(TAG_TEXT), "conf": F.expr(CONF_TEXT)})
    return e.select("event_id", "user_id", "ts", serving.checked_tag(F.col("cat"), F.col("conf")).alias("t")).select("event_id", "user_id", "ts", "t.*")


@query(f"{CHECKED} SELECT event_id, CASE WHEN error IS NULL THEN c END AS category, CASE WHEN error IS NULL THEN conf END AS confidence, error FROM v")
def tag_validation(spark, sf_dir):
    return checked_tags(spark, sf_dir).drop("user_id", "ts")


LAST = f"{CHECKED}, last AS (SELECT user_id, c AS category, conf AS confidence FROM v WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"


def current_tags(spark, sf_dir):
    good = checked_tags(spark, sf_dir).where("error is null")
    return serving.upserted(good.select("user_id", "ts", "event_id", "category", "confidence"), "user_id", "ts", "event_id").select("user_id", "category", "confidence")


@query(f"{LAST} SELECT * FROM last")
def tag_upsert(spark, sf_dir):
    return current_tags(spark, sf_dir)


@query(f"{LAST} SELECT * FROM last")
def stream_tags(spark, sf_dir):
    """The same from a stream of four files that hold the tags in no order."""
    from quillmerge.streaming.tags import Tags

    source, out, mark = (scratch_path(spark, x) for x in ("tags", "tag-batches", "stream"))
    good = checked_tags(spark, sf_dir).where("error is null").select("user_id", "ts", "event_id", "category", "confidence")
    good.repartition(4, F.xxhash64("event_id")).write.parquet(source)
    tags = Tags(spark, out, "user_id", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in good.schema))
    tags.start(spark.readStream.schema(good.schema).option("maxFilesPerTrigger", 1).parquet(source), mark).awaitTermination()
    return tags.read().select("user_id", "category", "confidence")


@query(
    f"""{LAST}, s AS (SELECT category, count(*) AS n, count(confidence) AS k, CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS BIGINT) AS total FROM last GROUP BY category)
    SELECT category, n, CASE WHEN k > 0 THEN ((2 * total + 10 * k) // (20 * k)) / 1000.0 END AS mean_confidence FROM s"""
)
def category_summary(spark, sf_dir):
    return serving.category_summary(current_tags(spark, sf_dir))


@query(f"{LAST} SELECT user_id, confidence FROM last WHERE confidence < 0.6")
def low_confidence(spark, sf_dir):
    return current_tags(spark, sf_dir).where("confidence < 0.6").select("user_id", "confidence")


@query(
    f"""{O.RESOLVED}, s AS (SELECT DISTINCT root, unnest(skills) AS skill FROM members),
    w AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{k}', {v})" for c, ws in O.config.STUB_WEIGHTS.items() for k, v in ws.items())}) AS t(category, skill, weight)),
    sc AS (SELECT root, category, CAST(sum(weight) AS INT) AS score FROM s JOIN w USING (skill) GROUP BY root, category),
    b AS (SELECT root, arg_max(category, score * 100) AS category, list_reverse_sort(list(score)) AS l FROM sc GROUP BY root)
    SELECT r.root, CASE WHEN l IS NULL OR l[1] = coalesce(l[2], 0) THEN 'generalist' ELSE category END AS category,
      CASE WHEN l IS NULL THEN 0.4 WHEN l[1] = coalesce(l[2], 0) THEN 0.45 ELSE round(least(0.95, 0.55 + 0.1 * (l[1] - coalesce(l[2], 0))), 2) END AS confidence
    FROM (SELECT DISTINCT root FROM s) r LEFT JOIN b ON r.root = b.root"""
)
def stub_classify(spark, sf_dir):
    return serving.stub_tags(golden.person_skills(members(spark, sf_dir)).select("root", "skill"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'data' END AS category, CASE WHEN event_id % 3 = 2 OR event_id % 10 > 5 THEN NULL ELSE (event_id % 10) / 5.0 END AS confidence FROM events"""
)
def verdict_parse(spark, sf_dir):
    body = F.format_string('{"category": " Data", "confidence": %s}', (F.col("event_id") % 10 / 5.0).cast("string"))
    reply = F.when(F.col("event_id") % 3 == 0, body).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise("sorry, no")
    return table(spark, sf_dir, "events").select("event_id", serving.parsed_reply(reply).alias("r")).select("event_id", "r.category", "r.confidence")


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def events_tail(spark, sf_dir):
    e = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return e.select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


# ---------------------------------------------------------------- durable tables and views

DURABLE = f"durable AS (SELECT row_number AS id, coalesce({O.email_value('email')}, {O.phone_value('phone')}) AS person_key FROM applicants)"


@query(
    f"""{O.FULL}, {DURABLE} SELECT id, person_key, coalesce(e.root, p.root) AS person FROM durable
    LEFT JOIN (SELECT email, min(root) AS root FROM people GROUP BY email) e ON e.email = person_key LEFT JOIN (SELECT phone, min(root) AS root FROM people GROUP BY phone) p ON p.phone = person_key"""
)
def relink_tags(spark, sf_dir):
    from quillmerge.functions import normalize as N

    a = raw(spark, sf_dir, "applicants").select(F.col("row_number").alias("id"), F.coalesce(N.email(F.col("email"))["value"], N.phone(F.col("phone"))["value"]).alias("person_key"))
    return serving.relinked(a, people(spark, sf_dir)).select("id", "person_key", "person")


@query(
    f"""{O.FULL}, {ARRIVED}, known AS (SELECT DISTINCT phone FROM people WHERE phone IS NOT NULL)
    SELECT row_id, CASE WHEN phone IS NOT NULL THEN 'matched_existing' WHEN {O.phone_value('in_phone')} IS NOT NULL THEN 'created_contact' ELSE 'unlinked' END AS outcome
    FROM arrived LEFT JOIN known ON phone = {O.phone_value('in_phone')}"""
)
def resolve_person(spark, sf_dir):
    rows = incoming(spark, sf_dir).select("row_id", F.col("Mobile").alias("in_phone"))
    return serving.resolution(rows, people(spark, sf_dir))


@query(
    f"""{O.FULL}, l AS (SELECT root, array_to_string(list_sort(list(DISTINCT skill)), ', ') AS skills FROM (SELECT root, unnest(skills) AS skill FROM members) GROUP BY root)
    SELECT people.root, full_name, skills FROM people LEFT JOIN l USING (root)"""
)
def people_full(spark, sf_dir):
    rows = members(spark, sf_dir)
    return serving.with_skill_list(golden.elect_names(rows), golden.person_skills(rows))


@query(f"{O.FULL}, {TAGGED} SELECT root, coalesce(email, phone) AS person_key, person_key IS NOT NULL AS tagged FROM people LEFT JOIN tags ON person_key = coalesce(email, phone)".replace("SELECT root, coalesce(email, phone) AS person_key, person_key IS NOT NULL AS tagged", "SELECT root, coalesce(email, phone) AS person_key, tags.person_key IS NOT NULL AS tagged"))
def people_categorised(spark, sf_dir):
    folk = people(spark, sf_dir)
    return serving.tagged_people(folk, tags_of(folk))


@query(
    f"""{O.FULL}, phones2 AS (SELECT phone, min(root) AS root FROM people WHERE phone IS NOT NULL GROUP BY phone)
    SELECT row_number AS id, {O.phone_value('contacts.phone')} AS phone, root AS person FROM contacts LEFT JOIN phones2 ON phones2.phone = {O.phone_value('contacts.phone')}"""
)
def submissions_view(spark, sf_dir):
    c = raw(spark, sf_dir, "contacts").select(F.col("row_number").alias("id"), "phone")
    return serving.by_phone(c, people(spark, sf_dir)).select("id", "phone", "person")


@query(
    """SELECT count(*) AS submissions, count(DISTINCT source) AS sources, count(*) FILTER (WHERE n_chars < 100) AS short, round(avg(n_chars), 2) AS mean_chars, CAST(max(n_chars) AS BIGINT) AS longest, round(sum(n_chars) / 1048576.0, 4) AS mega, count(*) FILTER (WHERE lang = 'en') AS english FROM documents"""
)
def submission_stats(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("submissions"), F.countDistinct("source").alias("sources"), F.count_if(n < 100).alias("short"), F.round(F.avg(n), 2).alias("mean_chars"), F.max(n).alias("longest"), F.round(F.sum(n) / 1048576.0, 4).alias("mega"), F.count_if(F.col("lang") == "en").alias("english"))


@query(
    """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents), f AS (SELECT sha, min(doc_id) AS first FROM h GROUP BY sha)
    SELECT doc_id, sha, CASE WHEN doc_id <> first THEN first END AS duplicate_of FROM h JOIN f USING (sha)"""
)
def sha_duplicates(spark, sf_dir):
    return serving.earliest_copy(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM events) AS events")
def health_counts(spark, sf_dir):
    one = lambda t, name: table(spark, sf_dir, t).agg(F.count("*").alias(name))
    return one("customer", "customers").crossJoin(one("orders", "orders")).crossJoin(one("events", "events"))  # one row each


@query(
    f"""{O.ISSUES}, c AS (SELECT category, count(*) AS n FROM issues GROUP BY category)
    SELECT CAST(sum(n) AS BIGINT) AS total, '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}' AS by_category FROM c"""
)
def report_totals(spark, sf_dir):
    return issues.totals(found(spark, sf_dir))


# ---------------------------------------------------------------- signal

RATE = 160  # samples a second that the 64-sample arrays are read as


@query(
    """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
    s AS (SELECT vec_id, len(e) AS n, list_max(list_transform(e, lambda v: abs(v))) AS peak, sqrt(list_sum(list_transform(e, lambda v: v * v)) / len(e)) AS rms, list_sum(e) / len(e) AS dc, len(list_filter(e, lambda v: abs(v) >= 0.98)) AS clipped FROM x)
    SELECT vec_id, round(20 * log10(peak), 2) AS peak_dbfs, round(20 * log10(rms), 2) AS rms_dbfs, round(dc, 5) AS dc_offset, round(100.0 * clipped / n, 4) AS clipping_pct FROM s"""
)
def signal_levels(spark, sf_dir):
    return signal.with_levels(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "peak_dbfs", "rms_dbfs", "dc_offset", "clipping_pct")


FRAMES = """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
f AS (SELECT vec_id, 20 * log10(greatest(sqrt(list_sum(list_transform(e[i * 8 + 1 : i * 8 + 8], lambda v: v * v)) / 8), 1e-12)) AS db FROM x, range(8) AS t(i)),
b AS (SELECT vec_id, count(*) AS frame_count, quantile_cont(db, 0.1) AS floor, quantile_cont(db, 0.95) AS top, 100.0 * avg(CASE WHEN db < -50 THEN 1.0 ELSE 0.0 END) AS silence FROM f GROUP BY vec_id),
g AS (SELECT f.vec_id, avg(power(10, db / 10)) FILTER (WHERE db > floor + least(greatest(3.0, (top - floor) * 0.5), 15.0)) AS speech, avg(power(10, db / 10)) FILTER (WHERE db <= floor + least(greatest(3.0, (top - floor) * 0.5), 15.0)) AS noise FROM f JOIN b USING (vec_id) GROUP BY f.vec_id)"""


@query(f"{FRAMES} SELECT vec_id, frame_count, round(floor, 2) AS noise_floor_dbfs, round(top - floor, 2) AS frame_dynamic_range_db, round(silence, 2) AS silence_pct FROM b")
def frame_stats(spark, sf_dir):
    return signal.frame_stats(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8).select("vec_id", "frame_count", "noise_floor_dbfs", "frame_dynamic_range_db", "silence_pct")


@query(f"{FRAMES} SELECT b.vec_id, CASE WHEN top - floor >= 6 AND speech IS NOT NULL AND noise IS NOT NULL THEN round(10 * log10(speech / noise), 2) END AS estimated_snr_db FROM b JOIN g USING (vec_id)")
def snr_abstain(spark, sf_dir):
    return signal.frame_stats(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8).select("vec_id", "estimated_snr_db")


@query(
    f"""{FRAMES} SELECT b.vec_id, CASE WHEN top - floor < 6 THEN 'frames differ by ' || printf('%.1f', top - floor) || ' dB only, speech and background can''t be told apart'
    WHEN speech IS NULL OR noise IS NULL THEN 'all frames fall on one side of the split' END AS snr_note, CASE WHEN top - floor >= 6 AND speech IS NOT NULL AND noise IS NOT NULL THEN round(100.0 * share, 2) END AS speech_ratio_pct
    FROM b JOIN g USING (vec_id) JOIN (SELECT f.vec_id, avg(CASE WHEN db > floor + least(greatest(3.0, (top - floor) * 0.5), 15.0) THEN 1.0 ELSE 0.0 END) AS share FROM f JOIN b USING (vec_id) GROUP BY f.vec_id) s USING (vec_id)"""
)
def snr_notes(spark, sf_dir):
    """Why a clip has no signal-to-noise figure, and the share of speech where it has one."""
    return signal.frame_stats(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8).select("vec_id", "snr_note", "speech_ratio_pct")


@query()
def block_loudness(spark, sf_dir):
    return signal.with_loudness(table(spark, sf_dir, "embeddings"), "embedding", RATE).select("vec_id", "integrated_lufs", "loudness_range_lu")


@query()
def biquad_filter(spark, sf_dir):
    w = signal.with_filtered(table(spark, sf_dir, "embeddings"), "embedding", RATE)
    return w.select("vec_id", F.transform("weighted", lambda v: F.round(v, 6)).alias("weighted"))


@query(
    """WITH p AS (SELECT doc_id, CASE WHEN n_chars % 40 < 10 THEN 30 WHEN n_chars % 40 < 20 THEN 15 ELSE 0 END + CASE WHEN n_chars % 7 > 5 THEN 25 WHEN n_chars % 7 > 4 THEN 10 ELSE 0 END
      + CASE WHEN n_chars % 60 > 40 THEN 20 ELSE 0 END + CASE WHEN n_chars < 1000 THEN 20 ELSE 0 END + CASE WHEN n_chars % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN n_chars % 100 > 60 THEN 15 ELSE 0 END AS lost FROM documents)
    SELECT doc_id, CAST(greatest(0, 100 - lost) AS INT) AS score, CASE WHEN 100 - lost >= 85 THEN 'excellent' WHEN 100 - lost >= 70 THEN 'good' WHEN 100 - lost >= 50 THEN 'fair' ELSE 'poor' END AS label FROM p"""
)
def quality_score(spark, sf_dir):
    n = F.col("n_chars")
    clip = F.when(n % 7 > 5, 1.5).when(n % 7 > 4, 0.5).otherwise(0.0)
    q = signal.quality(n % 40, clip, -(n % 60), n / 1000, F.when(n % 3 == 0, 8000).otherwise(16000), n % 100, F.lit(0.0))
    return table(spark, sf_dir, "documents").select("doc_id", q.alias("q")).select("doc_id", F.col("q.score").cast("int").alias("score"), "q.label")


# ---------------------------------------------------------------- files and reports


@query(
    f"""{O.CTES}, r AS (SELECT full_name, phone, city, row_number() OVER (ORDER BY row_number) + 1 AS n FROM contacts)
    SELECT CAST(n AS BIGINT) AS row_number, full_name, phone, city FROM r"""
)
def scan_with_row_number(spark, sf_dir):
    """Contacts written as CSV part files and read back by record number."""
    from quillmerge.sources.csv_records import by_header, read_records, write_lines

    path, header = scratch_path(spark, "contacts-csv"), ["full_name", "phone", "city"]
    write_lines(raw(spark, sf_dir, "contacts").select("row_number", F.array(*header).alias("cells")), path, header, "row_number")
    rows = read_records(spark, path, across=True).where("row_number > 1")
    return rows.select("row_number", by_header(header, F.col("cells")).alias("m")).select("row_number", "m.full_name", "m.phone", "m.city")


@query(f"{O.HEAD}, {O.LINKS} SELECT src, dst, field, value, source, row_number FROM crossing")
def cross_source_links(spark, sf_dir):
    """Links between sources that joined two clusters when taken in order."""
    from quillmerge.operators import identity
    from quillmerge.sources.records import all_records

    return identity.cross_source_links(all_records(spark, sf_dir))
