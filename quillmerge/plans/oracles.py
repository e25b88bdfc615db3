"""The registered queries in DuckDB SQL, written apart from the operators."""

from __future__ import annotations

from quillmerge import config
from quillmerge.sources.messy import CTES


def sq(x: str) -> str:
    return f"trim(regexp_replace(translate(coalesce({x}, ''), '０１２３４５６７８９', '0123456789'), '\\s+', ' ', 'g'))"


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split({sq(x)}, ' '), lambda t: CASE WHEN length(t) <= 2 AND suffix(t, '.') THEN upper(t) ELSE upper(t[1:1]) || lower(t[2:]) END), ' ')"


def tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({sq(x)}), '[^a-z ]', ' ', 'g'), ' '), lambda t: t <> '')"


def name_value(x: str) -> str:
    return f"CASE WHEN {sq(x)} <> '' THEN {title(x)} END"


def name_key(x: str) -> str:
    return f"nullif(array_to_string({tokens(x)}, ' '), '')"


def abbreviated(x: str) -> str:
    return f"coalesce(len(list_filter({tokens(x)}, lambda t: length(t) = 1)) > 0, false)"


def phone_value(x: str) -> str:
    d = f"regexp_replace(regexp_replace({sq(x)}, '[^0-9]', '', 'g'), '^00', '')"
    cut = f"CASE WHEN regexp_matches({d}, '^0+[0-9]{{10}}$') OR regexp_matches({d}, '^0*91[0-9]{{10}}$') THEN right({d}, 10) ELSE {d} END"
    return f"CASE WHEN length({cut}) = 10 THEN {cut} END"


def email_value(x: str) -> str:
    v = f"lower(replace({sq(x)}, ' ', ''))"
    return f"CASE WHEN regexp_matches({v}, '^[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{{2,}}$') THEN {v} END"


def email_alias(x: str) -> str:
    tests = " OR ".join(f"starts_with({email_value(x)}, '{p}')" for p in config.EMAIL_ALIAS_PREFIXES)
    return f"CASE WHEN {tests} THEN substring({email_value(x)}, 5) END"


def mapped(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def city_value(x: str) -> str:
    return f"CASE WHEN {sq(x)} <> '' THEN coalesce({mapped(config.CITY_CANON, f'lower({sq(x)})')}, {title(x)}) END"


def region_guess(x: str) -> str:
    return f"lower({sq(x)}) IN ('delhi ncr', 'ncr')"


def skill_list(x: str) -> str:
    parts = f"list_filter(list_transform(string_split({x}, ','), lambda p: trim(p)), lambda p: p <> '')"
    canon = f"list_transform({parts}, lambda p: coalesce({mapped(config.SKILL_CANON, 'lower(p)')}, p))"
    return f"CASE WHEN len({parts}) = 0 THEN [] ELSE list_reduce(list_transform({canon}, lambda p: [p]), lambda a, b: CASE WHEN list_contains(list_transform(a, lambda q: lower(q)), lower(b[1])) THEN a ELSE list_concat(a, b) END) END"


RATE = r"^([0-9]+(?:\.[0-9]+)?)(k|lakh|lac|l)?(?:/|per)(hr|hour|hourly|day|daily|month|monthly|mo)$"


def rate_parts(x: str) -> tuple[str, str]:
    tight = f"lower(replace({sq(x)}, ' ', ''))"
    unit = f"regexp_extract({tight}, '{RATE}', 3)"
    amount = f"TRY_CAST(regexp_extract({tight}, '{RATE}', 1) AS DOUBLE) * CASE regexp_extract({tight}, '{RATE}', 2) WHEN 'k' THEN 1000.0 WHEN '' THEN 1.0 ELSE 100000.0 END"
    basis = f"CASE WHEN {unit} IN ('hr', 'hour', 'hourly') THEN 'hourly' WHEN {unit} IN ('day', 'daily') THEN 'daily' WHEN {unit} <> '' THEN 'monthly' END"
    return basis, amount


def monthly(x: str) -> str:
    basis, amount = rate_parts(x)
    return f"round(CASE {basis} WHEN 'hourly' THEN {amount} * 160 WHEN 'daily' THEN {amount} * 20 WHEN 'monthly' THEN {amount} END, 2)"


def hourly(x: str) -> str:
    basis, amount = rate_parts(x)
    return f"round(CASE {basis} WHEN 'hourly' THEN {amount} WHEN 'daily' THEN {amount} / 8 WHEN 'monthly' THEN {amount} / 160 END, 2)"


def ctc_value(x: str) -> str:
    v = f"TRY_CAST({sq(x)} AS DOUBLE)"
    return f"round(CASE WHEN {v} < 1000 THEN {v} * 100000 ELSE {v} END, 2)"


def bool_value(x: str) -> str:
    return f"CASE WHEN lower({sq(x)}) IN ('y', 'yes', 'true', '1', 't') THEN true WHEN lower({sq(x)}) IN ('n', 'no', 'false', '0', 'f') THEN false END"


def status_value(x: str) -> str:
    return mapped(config.STATUS_CANON, f"lower({sq(x)})")


RECS = f"""
every AS (
  SELECT source || ':' || row_number AS uid, source, 0 AS source_rank, row_number,
         {name_value('full_name')} AS full_name, {name_key('full_name')} AS name_key, {abbreviated('full_name')} AS abbreviated,
         {email_value('email')} AS email, {email_alias('email')} AS alias_of, {phone_value('phone')} AS phone,
         {city_value('city')} AS city, {region_guess('city')} AS guess, NULL AS gig_status, NULL AS basis, CAST(NULL AS DOUBLE) AS monthly,
         CAST(NULL AS BOOLEAN) AS is_verified, CAST(NULL AS INT) AS projects, {ctc_value('ctc')} AS ctc, CAST(experience AS DOUBLE) AS experience, {skill_list('skills')} AS skills
  FROM applicants
  UNION ALL
  SELECT source || ':' || row_number, source, 2, row_number, {name_value('full_name')}, {name_key('full_name')}, {abbreviated('full_name')},
         {email_value('email')}, {email_alias('email')}, NULL, {city_value('city')}, {region_guess('city')}, {status_value('status')}, {rate_parts('rate')[0]}, {monthly('rate')},
         NULL, NULL, NULL, NULL, {skill_list('skills')}
  FROM workers
  UNION ALL
  SELECT source || ':' || row_number, source, 1, row_number, {name_value('full_name')}, {name_key('full_name')}, {abbreviated('full_name')},
         NULL, NULL, {phone_value('phone')}, {city_value('city')}, {region_guess('city')}, NULL, NULL, NULL, {bool_value('verified')}, CAST(projects AS INT), NULL, NULL, NULL
  FROM contacts
  UNION ALL
  SELECT source || ':' || row_number, source, 3, row_number, {name_value('full_name')}, {name_key('full_name')}, {abbreviated('full_name')},
         NULL, NULL, {phone_value('phone')}, {city_value('city')}, {region_guess('city')}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM apps
), recs AS (
  SELECT * FROM every WHERE CASE source WHEN 'audio_app' THEN full_name IS NOT NULL AND phone IS NOT NULL ELSE full_name IS NOT NULL OR email IS NOT NULL OR phone IS NOT NULL END
)"""

#: Links in the order of the list: e-mails first, keys as they come up, records as they stand; a phone link joins if nothing before it has.
LINKS = """
placed AS (SELECT uid, source, row_number, email, phone, row_number() OVER (ORDER BY CASE source WHEN 'naukri' THEN 1 WHEN 'gig' THEN 2 WHEN 'cbnexus' THEN 3 ELSE 4 END, row_number) AS place FROM recs),
elinks AS (SELECT arg_min(uid, place) OVER (PARTITION BY email) AS src, uid AS dst, 'email' AS field, email AS value, 0 AS rank FROM placed WHERE email IS NOT NULL),
plinks AS (SELECT src, uid AS dst, 'phone' AS field, phone AS value, row_number() OVER (ORDER BY bucket, place) AS rank
           FROM (SELECT *, arg_min(uid, place) OVER (PARTITION BY phone) AS src, min(place) OVER (PARTITION BY phone) AS bucket FROM placed WHERE phone IS NOT NULL) WHERE src <> uid),
both_ways AS (SELECT src, dst, rank FROM elinks UNION ALL SELECT dst, src, rank FROM elinks UNION ALL SELECT src, dst, rank FROM plinks UNION ALL SELECT dst, src, rank FROM plinks),
walk AS (SELECT rank, src AS at FROM plinks UNION SELECT w.rank, b.dst FROM walk w JOIN both_ways b ON b.src = w.at AND b.rank < w.rank),
effective AS (SELECT * FROM elinks WHERE src <> dst UNION ALL SELECT p.* FROM plinks p WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.rank = p.rank AND w.at = p.dst)),
crossing AS (SELECT e.*, b.source, b.row_number FROM effective e JOIN placed a ON a.uid = e.src JOIN placed b ON b.uid = e.dst WHERE a.source <> b.source)"""

STRONG = """
edges AS (
  SELECT a.uid AS src, b.uid AS dst FROM recs a JOIN recs b ON a.email = b.email AND a.uid <> b.uid
  UNION SELECT a.uid, b.uid FROM recs a JOIN recs b ON a.phone = b.phone AND a.uid <> b.uid
), reach AS (
  SELECT uid, uid AS r FROM recs UNION SELECT reach.uid, e.dst FROM reach JOIN edges e ON reach.r = e.src
), strong AS (SELECT uid, min(r) AS root FROM reach GROUP BY uid)"""

WEAK = """
facts AS (SELECT s.root, max(CAST(r.email IS NOT NULL AS INT)) AS e, max(CAST(r.phone IS NOT NULL AS INT)) AS p, count(*) AS size
          FROM recs r JOIN strong s ON r.uid = s.uid GROUP BY s.root),
elig AS (SELECT DISTINCT r.name_key, r.city, s.root FROM recs r JOIN strong s ON r.uid = s.uid
         WHERE r.name_key IS NOT NULL AND r.city IS NOT NULL),
decided AS (SELECT name_key, city, count(*) AS n, min(elig.root) AS lo, max(elig.root) AS hi, CAST(sum(size) AS BIGINT) AS size,
                   CASE WHEN count(*) > 2 THEN 'ambiguous_name_city' WHEN sum(e) = 2 OR sum(p) = 2 THEN 'same_name_conflicting_strong_key' ELSE 'merge' END AS verdict
            FROM elig JOIN facts ON elig.root = facts.root GROUP BY name_key, city HAVING count(*) >= 2),
wedges AS (SELECT lo AS src, hi AS dst FROM decided WHERE verdict = 'merge' UNION SELECT hi, lo FROM decided WHERE verdict = 'merge'),
wreach AS (SELECT DISTINCT root, root AS r FROM strong UNION SELECT wreach.root, w.dst FROM wreach JOIN wedges w ON wreach.r = w.src),
final AS (SELECT root AS strong_root, min(r) AS root FROM wreach GROUP BY root),
members AS (SELECT recs.*, f.strong_root, f.root FROM recs JOIN strong s ON recs.uid = s.uid JOIN final f ON s.root = f.strong_root)"""

HEAD = CTES.replace("WITH ", "WITH RECURSIVE ", 1) + f", {RECS}"
MATCHED = f"{HEAD}, {STRONG}"
RESOLVED = f"{MATCHED}, {WEAK}"
ORDER = "source_rank, row_number, uid"

METHODS = """
bystrong AS (SELECT root, strong_root, count(DISTINCT coalesce(email, 'uid:' || uid)) AS groups, count(email) > count(DISTINCT email) AS twice FROM members GROUP BY root, strong_root),
methods AS (SELECT root, CASE WHEN bool_or(twice) OR bool_or(groups > 1) OR count(*) > 1 THEN
              concat_ws(',', CASE WHEN bool_or(twice) THEN 'exact_email' END, CASE WHEN bool_or(groups > 1) THEN 'exact_phone' END, CASE WHEN count(*) > 1 THEN 'name_city_weak' END)
              ELSE 'single_source' END AS methods, CASE WHEN count(*) > 1 THEN 0.6 ELSE 1.0 END AS confidence FROM bystrong GROUP BY root)"""


def elected(field: str, order: str, name: str) -> str:
    return f"{name} AS (SELECT root, {field} FROM (SELECT root, {field}, row_number() OVER (PARTITION BY root ORDER BY {order}) AS rn FROM members WHERE {field} IS NOT NULL) WHERE rn = 1)"


NAMES = elected("full_name", f"abbreviated, -len(string_split(full_name, ' ')), -length(full_name), {ORDER}", "names")
EMAILS = elected("email", f"alias_of IS NOT NULL, {ORDER}", "emails")
PHONES = elected("phone", ORDER, "phones")
CITIES = f"""votes AS (SELECT root, city, count(*) AS n, bool_and(guess) AS guess, min(source_rank * 100000000 + row_number) AS seat FROM members WHERE city IS NOT NULL GROUP BY root, city),
cities AS (SELECT root, city, guess FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY -n, guess, seat, city) AS rn FROM votes) WHERE rn = 1)"""
GOLDEN = f"""{METHODS}, {NAMES}, {EMAILS}, {PHONES}, {CITIES},
golden AS (
  SELECT m.root, arg_min(m.uid, m.source_rank * 100000000 + m.row_number) AS ref, count(*) AS record_count, count(DISTINCT source) AS source_count,
         array_to_string(list_sort(list(DISTINCT source)), ',') AS sources
  FROM members m GROUP BY m.root
), people AS (
  SELECT g.*, methods.methods, confidence, full_name, email, phone, city FROM golden g JOIN methods USING (root)
  LEFT JOIN names USING (root) LEFT JOIN emails USING (root) LEFT JOIN phones USING (root) LEFT JOIN cities USING (root)
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY coalesce(email, '~'), coalesce(phone, '~'), coalesce(full_name, '~'), ref) AS person_id FROM people
)"""
FULL = f"{RESOLVED}, {GOLDEN}"


def issue_rows(source: str, column: str, field: str, *checks: tuple[str, str, str]) -> str:
    """The problems of one column: (condition, category, severity)."""
    found = ", ".join(f"CASE WHEN {cond} THEN '{cat}|{sev}' END" for cond, cat, sev in checks)
    return f"SELECT source, row_number, '{field}' AS field, {column} AS raw_value, unnest([{found}]) AS p FROM {source}"


def name_issues(source: str) -> str:
    s, letters = sq("full_name"), "regexp_replace(full_name, '[^A-Za-z]', '', 'g')"
    return issue_rows(
        source, "full_name", "name",
        (f"{s} = ''", "missing_value", "error"),
        (f"{s} <> '' AND NOT regexp_matches({s}, '^[A-Za-z][A-Za-z.''\\- ]*$')", "suspicious_value", "warn"),
        (f"{letters} <> '' AND {letters} = upper({letters})", "inconsistent_casing", "info"),
        (f"{letters} <> '' AND {letters} = lower({letters})", "inconsistent_casing", "info"),
        (abbreviated("full_name"), "abbreviated_name", "warn"),
    )


def email_issues(source: str) -> str:
    s, v = sq("email"), email_value("email")
    return issue_rows(
        source, "email", "email",
        (f"{s} = ''", "missing_value", "warn"),
        (f"contains({s}, ' ')", "invalid_format", "warn"),
        (f"replace({s}, ' ', '') <> lower(replace({s}, ' ', ''))", "inconsistent_casing", "info"),
        (f"{s} <> '' AND {v} IS NULL", "invalid_format", "error"),
        (f"{email_alias('email')} IS NOT NULL", "alias_email", "warn"),
    )


def phone_issues(source: str) -> str:
    s, v = sq("phone"), phone_value("phone")
    return issue_rows(
        source, "phone", "phone",
        (f"{s} = ''", "missing_value", "warn"),
        (f"{s} <> '' AND {v} IS NULL", "invalid_format", "error"),
        (f"{v} < '6'", "suspicious_value", "warn"),
        (f"{v} <> {s}", "inconsistent_format", "info"),
    )


def city_issues(source: str) -> str:
    s = sq("city")
    known = mapped(config.CITY_CANON, f"lower({s})")
    return issue_rows(
        source, "city", "city",
        (f"{s} = ''", "missing_value", "warn"),
        (f"{s} <> '' AND city <> trim(city)", "trailing_whitespace", "info"),
        (f"{s} <> '' AND {known} IS NULL", "unmapped_value", "warn"),
        (f"{known} <> {s}", "inconsistent_value", "info"),
        (region_guess("city"), "precision_loss", "warn"),
    )


def skill_issues(source: str) -> str:
    parts = "list_filter(list_transform(string_split(skills, ','), lambda p: trim(p)), lambda p: p <> '')"
    known = mapped(config.SKILL_CANON, "lower(p)")
    return issue_rows(
        source, "skills", "skills",
        (f"{sq('skills')} = ''", "missing_value", "warn"),
        (f"len(list_filter({parts}, lambda p: {known} <> p)) > 0", "inconsistent_casing", "info"),
        (f"len(list_filter({parts}, lambda p: {known} IS NULL)) > 0", "unmapped_value", "warn"),
    )


DATE = "CAST(CASE row_number % 4 WHEN 0 THEN try_strptime(applied, '%Y-%m-%d') WHEN 1 THEN try_strptime(applied, '%d-%m-%Y') WHEN 2 THEN try_strptime(applied, '%m/%d/%Y') ELSE try_strptime(applied, '%-d %b %Y') END AS DATE)"
CTC = f"({ctc_value('ctc')})"
ISSUES = ", ".join(
    [
        HEAD,
        "raised AS ("
        + " UNION ALL ".join(
            [name_issues(t) for t in ("applicants", "workers", "contacts", "apps")]
            + [email_issues(t) for t in ("applicants", "workers")]
            + [phone_issues(t) for t in ("applicants", "contacts", "apps")]
            + [city_issues(t) for t in ("applicants", "workers", "contacts", "(SELECT * FROM apps WHERE city IS NOT NULL)")]
            + [skill_issues(t) for t in ("applicants", "workers")]
            + [
                issue_rows("applicants", "experience", "experience_years", ("CAST(experience AS DOUBLE) NOT BETWEEN 0 AND 50", "out_of_range", "warn")),
                issue_rows("applicants", "ctc", "ctc_annual_inr", ("CAST(ctc AS DOUBLE) < 1000", "mixed_units", "warn"), (f"{CTC} NOT BETWEEN 50000 AND 100000000", "out_of_range", "warn")),
                issue_rows(
                    "applicants", "applied", "applied_date",
                    (f"{DATE} IS NULL", "invalid_value", "error"),
                    (f"{DATE} IS NOT NULL AND row_number % 4 <> 0", "inconsistent_format", "info"),
                    (f"row_number % 4 = 2 AND day({DATE}) <> month({DATE})", "ambiguous_date", "warn"),
                    (f"{DATE} > DATE '{config.INGEST_DATE}'", "future_date", "warn"),
                ),
                issue_rows("workers", "rate", "rate", (f"{rate_parts('rate')[0]} IS NOT NULL", "mixed_units", "info"), (f"{monthly('rate')} NOT BETWEEN 8000 AND 400000", "out_of_range", "warn")),
                issue_rows("workers", "status", "gig_status", (f"{status_value('status')} IS NULL", "unmapped_value", "error"), (f"{status_value('status')} <> {sq('status')}", "inconsistent_casing", "info")),
                issue_rows("contacts", "verified", "verified", (f"{sq('verified')} = ''", "missing_value", "warn"), (f"{sq('verified')} <> '' AND {bool_value('verified')} IS NULL", "unmapped_value", "error"), (f"{bool_value('verified')} IS NOT NULL AND verified NOT IN ('Y', 'N')", "inconsistent_value", "info")),
            ]
        )
        + "), issues AS (SELECT source, row_number, split_part(p, '|', 1) AS category, split_part(p, '|', 2) AS severity, field, raw_value FROM raised WHERE p IS NOT NULL"
        " UNION ALL SELECT source, row_number, 'unidentifiable_row', 'error', '', NULL FROM every WHERE uid NOT IN (SELECT uid FROM recs))",
    ]
)
