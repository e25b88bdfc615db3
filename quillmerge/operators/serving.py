"""What is served from resolved people: duplicate checks, tagging queues, relinking, submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmerge import config
from quillmerge.functions import normalize as N
from quillmerge.functions.text import squash
from quillmerge.operators import audit

#: Column names that an incoming file may use for each field.
ALIASES = {
    "name": ("full name", "name", "worker_name", "full_name", "candidate name"),
    "email": ("email", "email_id", "e-mail", "email address"),
    "phone": ("phone", "phone number", "mobile", "contact"),
    "city": ("city", "location", "town"),
}


def mapped_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with name, email, phone and city taken from the first non-blank column of an alias, and skip_reason.

    ``keep`` names columns that are no cells of the file.  A row is skipped if it is blank, repeats the header, or has no name, e-mail or phone.
    """
    cells = [c for c in df.columns if c not in keep]
    out = {}
    for field, names in ALIASES.items():
        mine = [c for c in cells if c.strip().lower() in names]
        out[field] = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in mine], F.lit("")) if mine else F.lit("")
    blank = F.lit(True)
    header = F.lit(True)
    for c in cells:
        v = F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
        blank, header = blank & (v == ""), header & (F.lower(v) == c.strip().lower())
    empty = (out["name"] == "") & (out["email"] == "") & (out["phone"] == "")
    reason = F.when(blank, "blank_row").when(header, "repeated_header").when(empty, "no_identity")
    return df.select("*", *[v.alias(f"in_{k}") for k, v in out.items()], reason.alias("skip_reason"))


def classify_incoming(rows: DataFrame, people: DataFrame) -> DataFrame:
    """``rows`` (row_id, in_name, in_email, in_phone, in_city) with verdict, method and person.

    An equal e-mail decides first, then an equal phone, then name and city: one person
    is a possible duplicate to review, several are ambiguous.  Without a readable
    e-mail or phone a new row needs review too.
    """
    known = rows.withColumns({"email": N.email(F.col("in_email"))["value"], "phone": N.phone(F.col("in_phone"))["value"], "name_l": F.lower(N.name(F.col("in_name"))["value"]), "city": N.city(F.col("in_city"))["value"]})
    by_email = people.where("email is not null").groupBy("email").agg(F.min("root").alias("e_root"))
    by_phone = people.where("phone is not null").groupBy("phone").agg(F.min("root").alias("p_root"))
    by_name = people.where("full_name is not null and city is not null").groupBy(F.lower("full_name").alias("name_l"), "city").agg(F.count("*").alias("n"), F.min("root").alias("n_root"))
    found = known.join(by_email, "email", "left").join(by_phone, "phone", "left").join(by_name, ["name_l", "city"], "left")
    method = F.when(F.col("e_root").isNotNull(), "email").when(F.col("p_root").isNotNull(), "phone").when(F.col("n") == 1, "name_city").when(F.col("n") > 1, "name_city_ambiguous").when(F.col("email").isNull() & F.col("phone").isNull(), "no_key").otherwise("none")
    verdict = F.when(method.isin("email", "phone"), "duplicate").when(method == "none", "new").otherwise("needs_review")
    return found.select("row_id", verdict.alias("verdict"), method.alias("method"), F.coalesce("e_root", "p_root", F.when(F.col("n") == 1, F.col("n_root"))).alias("person"))


def check_summary(verdicts: DataFrame) -> DataFrame:
    v = F.col("verdict")
    counts = verdicts.agg(F.count("*").alias("checked"), *[F.count_if(v == k).alias(k) for k in ("duplicate", "needs_review", "new")])
    return counts.withColumn("needs_attention", (F.col("duplicate") > 0) | (F.col("needs_review") > 0))


def batch_totals(verdicts: DataFrame, rows: DataFrame) -> DataFrame:
    """The counts of a batch of ``rows`` and its ``verdicts``: has_duplicates, undeliverable, and a summary in words.

    An address is undeliverable here where its domain starts with "example.".
    """
    mails = rows.select("in_email", squash(F.col("in_email")).alias("s")).select(N.email(F.col("in_email"), s=F.col("s"))["domain"].alias("domain"))
    counts = check_summary(verdicts).withColumn("has_duplicates", F.col("duplicate") > 0)
    out = counts.crossJoin(mails.agg(F.count_if(F.col("domain").startswith("example.")).alias("undeliverable")))  # single rows
    return out.withColumn("summary", F.format_string("%d row(s): %d duplicate, %d new, %d need review", "checked", "duplicate", "new", "needs_review"))


def digest(verdicts: DataFrame, most: int = 5) -> DataFrame:
    """The alert's text for each verdict but ``new``: the first ids, and how many more."""
    told = verdicts.where("verdict <> 'new'")
    counts = told.groupBy("verdict").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("verdict").orderBy("row_id"))
    first = told.select("verdict", "row_id", rn.alias("rn")).where(F.col("rn") <= most)  # each task hands on its own first few
    told = counts.join(first.groupBy("verdict").agg(F.array_sort(F.collect_list("row_id")).alias("first")), "verdict")
    more = F.when(F.col("n") > most, F.format_string(", +%d more", F.col("n") - most)).otherwise("")
    return told.select("verdict", F.concat(F.array_join("first", ", "), more).alias("line"))


#: Rows that one request may bring.
MOST_ROWS = 1000


def request_rows(body: Column) -> Column:
    """struct(rows array<map<string, string>>, error) of a request's JSON text.

    It must be a list of at most MOST_ROWS rows; a row that is no object is an empty
    one, so that every row has its verdict.
    """
    rows = F.from_json(body, "array<string>")
    is_list = F.trim(body).startswith("[") & rows.isNotNull()
    error = F.when(~F.coalesce(is_list, F.lit(False)), "not_a_list").when(F.size(rows) > MOST_ROWS, "too_many_rows")
    empty = F.create_map().cast("map<string, string>")
    each = F.transform(rows, lambda r: F.when(F.trim(r).startswith("{"), F.coalesce(F.from_json(r, "map<string, string>"), empty)).otherwise(empty))
    return F.struct(F.when(error.isNull(), each).alias("rows"), error.alias("error"))


def warnings(rows: DataFrame) -> DataFrame:
    """(row_id, warning) of incoming rows: keys that were given and can't be read, and addresses that nothing reaches."""
    email, phone = N.email(F.col("in_email")), N.phone(F.col("in_phone"))
    given = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    found = F.array(
        F.when(given("in_email") & email["value"].isNull(), "unreadable_email"),
        F.when(given("in_phone") & phone["value"].isNull(), "unreadable_phone"),
        F.when(audit.is_reserved(email["domain"]), "undeliverable_email"),
    )
    return rows.select("row_id", F.explode(F.filter(found, lambda w: w.isNotNull())).alias("warning"))


#: Longest reason and longest summary that are stored.
REASON_CHARS, SUMMARY_CHARS = 500, 300


def cut(text: Column, most: int = REASON_CHARS) -> Column:
    """At most so many characters of a stored remark."""
    return F.substring(text, 1, most)


# ---------------------------------------------------------------- tags


def untagged(people: DataFrame, skills: DataFrame, tags: DataFrame, limit: int = 20) -> DataFrame:
    """The queue's head: people with a key and a skill and no tag, by key.  Reading it twice changes nothing."""
    key = F.coalesce("email", "phone")
    keyed = people.withColumn("person_key", key).where("person_key is not null")
    waiting = keyed.join(skills.select("root").distinct(), "root", "left_semi").join(tags, "person_key", "left_anti")
    return waiting.select("person_key", "full_name").orderBy("person_key").limit(max(1, min(200, limit)))


def waiting(people: DataFrame, skills: DataFrame, tags: DataFrame) -> DataFrame:
    """(remaining): how many people wait in the queue."""
    keyed = people.withColumn("person_key", F.coalesce("email", "phone")).where("person_key is not null")
    return keyed.join(skills.select("root").distinct(), "root", "left_semi").join(tags, "person_key", "left_anti").agg(F.count("*").alias("remaining"))


def person_error(asked: DataFrame, people: DataFrame, key: str = "root") -> DataFrame:
    """``asked`` with person_key and person_error: unknown_person, or no_key for one without e-mail and phone."""
    known = people.groupBy(key).agg(F.min(F.coalesce("email", "phone")).alias("person_key"), F.lit(True).alias("_there"))
    joined = asked.drop("person_key").join(known, key, "left")
    return joined.withColumn("person_error", F.when(F.col("_there").isNull(), "unknown_person").when(F.col("person_key").isNull(), "no_key")).drop("_there")


def checked_tag(category: Column, confidence: Column) -> Column:
    """struct(category, confidence, error): trimmed and lower-cased, in the vocabulary; a confidence empty or from 0 to 1."""
    c = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    text = F.trim(F.coalesce(confidence, F.lit("")))
    x = N.number(text)
    error = F.when(~c.isin(*config.TAG_CATEGORIES), "unknown_category").when((text != "") & x.isNull(), "bad_confidence").when(~x.between(0.0, 1.0), "bad_confidence")
    return F.struct(F.when(error.isNull(), c).alias("category"), F.when(error.isNull(), x).alias("confidence"), error.alias("error"))


def upserted(tags: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    cols = [c for c in tags.columns if c != key]
    return tags.groupBy(key).agg(F.max(F.struct(*order, *[c for c in cols if c not in order])).alias("last")).select(key, *[F.col(f"last.{c}").alias(c) for c in cols])


def category_summary(tags: DataFrame) -> DataFrame:
    """(category, n, mean_confidence): the mean of the confidences, kept to four places, rounded half up to three in whole numbers."""
    whole = F.sum(F.round(F.col("confidence") * 10_000).cast("long"))
    counts = tags.groupBy("category").agg(F.count("*").alias("n"), F.count("confidence").alias("k"), whole.alias("total"))
    return counts.select("category", "n", F.when(F.col("k") > 0, F.expr("(2 * total + 10 * k) div (20 * k)") / 1000.0).alias("mean_confidence"))


def stub_tags(skills: DataFrame) -> DataFrame:
    """(root, category, confidence) from weights of (root, skill): a tie and no weight at all are generalists."""
    rows = [(c, s, w) for c, ws in config.STUB_WEIGHTS.items() for s, w in ws.items()]
    weights = skills.sparkSession.createDataFrame(rows, "category string, skill string, weight int")
    scored = skills.join(F.broadcast(weights), "skill").groupBy("root", "category").agg(F.sum("weight").alias("score"))
    best = scored.groupBy("root").agg(F.max(F.struct("score", "category")).alias("top"), F.array_sort(F.collect_list("score")).alias("scores"))
    second = F.when(F.size("scores") > 1, F.element_at("scores", -2)).otherwise(0)
    picked = best.select("root", F.when(F.col("top.score") == second, "generalist").otherwise(F.col("top.category")).alias("category"), F.when(F.col("top.score") == second, 0.45).otherwise(F.round(F.least(F.lit(0.95), 0.55 + 0.1 * (F.col("top.score") - second)), 2)).alias("confidence"))
    return skills.select("root").distinct().join(picked, "root", "left").select("root", F.coalesce("category", F.lit("generalist")).alias("category"), F.coalesce("confidence", F.lit(0.4)).alias("confidence"))


def parsed_reply(reply: Column) -> Column:
    """struct(category, confidence) of a model's reply: code fences stripped, JSON read, a confidence out of range null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    body = F.from_json(bare, "category string, confidence double")
    conf = body["confidence"]
    return F.struct(F.lower(F.trim(body["category"])).alias("category"), F.when(conf.between(0.0, 1.0), conf).alias("confidence"))


# ---------------------------------------------------------------- durable tables


def relinked(durable: DataFrame, people: DataFrame, key: str = "person_key") -> DataFrame:
    """``durable`` with person, looked up by e-mail first and else by phone: two equi joins in place of an OR."""
    by_email = people.where("email is not null").groupBy(F.col("email").alias(key)).agg(F.min("root").alias("e_root"))
    by_phone = people.where("phone is not null").groupBy(F.col("phone").alias(key)).agg(F.min("root").alias("p_root"))
    return durable.join(by_email, key, "left").join(by_phone, key, "left").withColumn("person", F.coalesce("e_root", "p_root")).drop("e_root", "p_root")


def earliest_copy(df: DataFrame, body: str, key: str) -> DataFrame:
    """(key, sha, duplicate_of): the earliest row of the same content, null for itself."""
    hashed = df.select(key, F.sha2(F.coalesce(F.col(body), F.lit("")), 256).alias("sha"))
    first = hashed.groupBy("sha").agg(F.min(key).alias("first"))
    return hashed.join(first, "sha").select(key, "sha", F.when(F.col(key) != F.col("first"), F.col("first")).alias("duplicate_of"))


def resolution(rows: DataFrame, people: DataFrame) -> DataFrame:
    """(row_id, outcome): matched_existing by phone, created_contact for a readable new phone, unlinked else."""
    keyed = rows.select("row_id", N.phone(F.col("in_phone"))["value"].alias("phone"))
    known = people.where("phone is not null").select("phone").distinct().withColumn("there", F.lit(True))
    joined = keyed.join(known, "phone", "left")
    return joined.select("row_id", F.when(F.col("there"), "matched_existing").when(F.col("phone").isNotNull(), "created_contact").otherwise("unlinked").alias("outcome"))


def new_contacts(rows: DataFrame, people: DataFrame) -> DataFrame:
    """(contact_id, full_name, phone, phone_raw, city) of the rows (row_id, in_name, in_phone, in_city) whose readable phone nobody has.

    Of several rows with one phone the first counts.
    """
    made = rows.join(resolution(rows, people).where("outcome = 'created_contact'").select("row_id"), "row_id", "left_semi")
    keyed = made.withColumn("phone", N.phone(F.col("in_phone"))["value"])
    first = keyed.groupBy("phone").agg(F.min(F.struct("row_id", "in_name", "in_phone", "in_city")).alias("r"))
    return first.select(F.col("r.row_id").alias("contact_id"), F.col("r.in_name").alias("full_name"), "phone", F.col("r.in_phone").alias("phone_raw"), F.col("r.in_city").alias("city"))


def tagged_people(people: DataFrame, tags: DataFrame) -> DataFrame:
    """(root, person_key, tagged): people by their e-mail, else their phone, with whether a tag has that key."""
    folk = people.select("root", F.coalesce("email", "phone").alias("person_key"))
    there = tags.select("person_key").distinct().withColumn("_t", F.lit(True))
    return folk.join(there, "person_key", "left").select("root", "person_key", F.coalesce("_t", F.lit(False)).alias("tagged"))


def by_phone(rows: DataFrame, people: DataFrame, raw: str = "phone") -> DataFrame:
    """``rows`` with the normalised phone and the person who has it."""
    folk = people.where("phone is not null").groupBy("phone").agg(F.min("root").alias("person"))
    return rows.withColumn("phone", N.phone(F.col(raw))["value"]).join(folk, "phone", "left")


#: Endings of file names that may be sent in, and bytes of a file.
EXTENSIONS = ("wav", "mp3", "m4a", "aac", "ogg", "oga", "opus", "webm", "flac", "mp4", "3gp")
MOST_BYTES = 25 << 20


def upload_error(name: Column, size: Column, most: int = MOST_BYTES, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Why a sent file is refused, null if it is not."""
    ending = F.lower(F.substring_index(name, ".", -1))
    return (
        F.when(~(name.contains(".") & ending.isin(*extensions)), "extension")
        .when(size == 0, "empty")
        .when(size > most, "too_large")
        .when(~name.rlike("^[A-Za-z0-9._-]+$"), "unsafe_name")
    )


def with_skill_list(people: DataFrame, skills: DataFrame) -> DataFrame:
    """People with their skills as one sorted list."""
    listed = skills.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("skill")), ", ").alias("skills"))
    return people.join(listed, "root", "left")
