"""Field normalisers: raw text to a struct (value, ..., problems).

Each is a pure Column expression, so normalising a table is one projection.  A
problem is struct(category, severity, field, raw_value); E, W and I stand for
error, warn and info.  No input makes a normaliser fail: what cannot be read is
null, with a problem.  ``s`` is the squashed raw text, where it has been computed in
a projection of its own; a normaliser names it many times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmerge import config
from quillmerge.functions.text import looked_up, squash, title_words

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SEVERITY = {"E": "error", "W": "warn", "I": "info"}


def problem(category: str, severity: str, field: str, raw: Column) -> Column:
    named = F.expr(f"named_struct('category', '{category}', 'severity', '{SEVERITY[severity]}', 'field', '{field}')")
    return named.withField("raw_value", raw.cast("string"))


def problems(*checks: tuple[Column, Column]) -> Column:
    """The problems whose condition holds, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), p) for c, p in checks]), lambda p: p.isNotNull())


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once, however often ``of`` names it."""
    return F.transform(F.array(value), of)[0]


def number(text: Column) -> Column:
    """Finite decimal text as double; anything else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def name(raw: Column, field: str = "name", s: Column | None = None) -> Column:
    """struct(value, key, tokens, abbreviated, problems)."""
    s = squash(raw) if s is None else s
    there = s != ""
    tokens = F.filter(F.split(F.regexp_replace(F.lower(s), "[^a-z ]", " "), " +"), lambda t: t != "")
    key = F.array_join(tokens, " ")
    letters = F.regexp_replace(s, "[^A-Za-z]", "")
    short = F.exists(tokens, lambda t: F.length(t) == 1)
    found = problems(
        (~there, problem("missing_value", "E", field, raw)),
        (there & ~s.rlike(r"^[A-Za-z][A-Za-z.'\- ]*$"), problem("suspicious_value", "W", field, raw)),
        ((letters != "") & (letters == F.upper(letters)), problem("inconsistent_casing", "I", field, raw)),
        ((letters != "") & (letters == F.lower(letters)), problem("inconsistent_casing", "I", field, raw)),
        (there & short, problem("abbreviated_name", "W", field, raw)),
    )
    return F.struct(F.when(there, title_words(s)).alias("value"), F.when(there & (key != ""), key).alias("key"), tokens.alias("tokens"), (there & short).alias("abbreviated"), found.alias("problems"))


def names_compatible(a: Column, b: Column) -> Column:
    """Token lists of one length whose pairs are equal, or one the other's initial."""
    alike = F.zip_with(a, b, lambda x, y: (x == y) | ((F.length(x) == 1) & y.startswith(x)) | ((F.length(y) == 1) & x.startswith(y)))
    return (F.size(a) > 0) & (F.size(a) == F.size(b)) & F.forall(alike, lambda v: F.coalesce(v, F.lit(False)))


def phone(raw: Column, field: str = "phone", s: Column | None = None) -> Column:
    """struct(value, problems): ten digits without country code or trunk zeros."""
    s = squash(raw) if s is None else s
    digits = F.regexp_replace(s, "[^0-9]", "")
    cut = F.regexp_replace(digits, "^00", "")
    cut = F.regexp_replace(cut, "^0+(?=[0-9]{10}$)", "")
    cut = F.regexp_replace(cut, "^0*(?=91[0-9]{10}$)", "")
    cut = F.regexp_replace(cut, "^91(?=[0-9]{10}$)", "")
    ok = F.length(cut) == 10
    found = problems(
        (s == "", problem("missing_value", "W", field, raw)),
        ((s != "") & ~ok, problem("invalid_format", "E", field, raw)),
        (ok & ~cut.rlike("^[6-9]"), problem("suspicious_value", "W", field, raw)),
        (ok & (cut != s), problem("inconsistent_format", "I", field, raw)),
    )
    return F.struct(F.when(ok, cut).alias("value"), found.alias("problems"))


def email(raw: Column, field: str = "email", s: Column | None = None) -> Column:
    """struct(value, alias_of, domain, problems)."""
    s = squash(raw) if s is None else s
    tight = F.replace(s, F.lit(" "), F.lit(""))
    value = F.lower(tight)
    ok = value.rlike(r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$")
    local = F.substring_index(value, "@", 1)
    alias = F.lit(False)
    for p in config.EMAIL_ALIAS_PREFIXES:
        alias = alias | local.startswith(p)
    found = problems(
        (s == "", problem("missing_value", "W", field, raw)),
        ((s != "") & s.contains(" "), problem("invalid_format", "W", field, raw)),
        ((s != "") & (tight != value), problem("inconsistent_casing", "I", field, raw)),
        ((s != "") & ~ok, problem("invalid_format", "E", field, raw)),
        (ok & alias, problem("alias_email", "W", field, raw)),
    )
    return F.struct(
        F.when(ok, value).alias("value"),
        F.when(ok & alias, F.substring(value, F.lit(5), F.length(value))).alias("alias_of"),
        F.when(ok, F.substring_index(value, "@", -1)).alias("domain"),
        found.alias("problems"),
    )


def city(raw: Column, field: str = "city", s: Column | None = None) -> Column:
    """struct(value, region, region_guess, problems)."""
    s = squash(raw) if s is None else s
    key = F.lower(s)
    known = looked_up(config.CITY_CANON, key)
    guess = key.isin(*config.CITY_REGION_ONLY)
    value = F.when(s != "", F.coalesce(known, title_words(s)))
    found = problems(
        (s == "", problem("missing_value", "W", field, raw)),
        ((s != "") & raw.rlike(r"^\s|\s$"), problem("trailing_whitespace", "I", field, raw)),
        ((s != "") & known.isNull(), problem("unmapped_value", "W", field, raw)),
        (known.isNotNull() & (known != s), problem("inconsistent_value", "I", field, raw)),
        (guess, problem("precision_loss", "W", field, raw)),
    )
    return F.struct(value.alias("value"), looked_up(config.CITY_REGION, value).alias("region"), F.coalesce(guess, F.lit(False)).alias("region_guess"), found.alias("problems"))


def date(raw: Column, field: str = "applied_date", ingest: str = config.INGEST_DATE, s: Column | None = None) -> Column:
    """struct(value date, ambiguous, future, problems); dashes put the day first, slashes the month."""
    iso = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    two = r"^([0-9]{1,2})([-/])([0-9]{1,2})\2([0-9]{4})$"
    word = r"^([0-9]{1,2})[ -]([A-Za-z]+)[ -]([0-9]{4})$"

    def read(s: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(s, pattern, i).try_cast("int")
        a, b = part(two, 1), part(two, 3)
        day_first = (a > 12) | ((b <= 12) & (F.regexp_extract(s, two, 2) == "-"))
        month = looked_up({k: str(v) for k, v in config.MONTHS.items()}, F.lower(F.regexp_extract(s, word, 2))).cast("int")
        ymd = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
        shape = F.when(s.rlike(iso), "iso").when(s.rlike(two), "two").when(s.rlike(word) & month.isNotNull(), "word")
        value = (
            F.when(shape == "iso", ymd(part(iso, 1), part(iso, 2), part(iso, 3)))
            .when(shape == "two", ymd(part(two, 4), F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b)))
            .when(shape == "word", ymd(part(word, 3), month, part(word, 1)))
        )
        unclear = (shape == "two") & (a <= 12) & (b <= 12) & (a != b)
        return F.struct(s.alias("s"), shape.isNotNull().alias("shape"), value.alias("value"), F.coalesce(unclear, F.lit(False)).alias("unclear"))

    def judged(r: Column) -> Column:
        s, value, there = r["s"], r["value"], r["value"].isNotNull()
        future = F.coalesce(value > F.lit(ingest).cast("date"), F.lit(False))
        found = problems(
            (s == "", problem("missing_value", "W", field, raw)),
            ((s != "") & ~r["shape"], problem("invalid_format", "E", field, raw)),
            (r["shape"] & ~there, problem("invalid_value", "E", field, raw)),
            (there & ~s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), problem("inconsistent_format", "I", field, raw)),
            (there & r["unclear"], problem("ambiguous_date", "W", field, raw)),
            (future, problem("future_date", "W", field, raw)),
        )
        return F.struct(value.alias("value"), (there & r["unclear"]).alias("ambiguous"), future.alias("future"), found.alias("problems"))

    return once(once(squash(raw) if s is None else s, read), judged)


def ctc(raw: Column, field: str = "ctc_annual_inr", s: Column | None = None) -> Column:
    """struct(value, unit, out_of_range, problems): figures under a thousand are lakhs."""
    s = squash(raw) if s is None else s
    x = number(F.regexp_replace(s, r"[,₹ ]|INR", ""))
    lakh = x < config.CTC_LAKH_THRESHOLD
    value = F.round(F.when(lakh, x * 100_000).otherwise(x), 2)
    out = F.coalesce(~value.between(*config.CTC_PLAUSIBLE), F.lit(False))
    found = problems(
        (s == "", problem("missing_value", "W", field, raw)),
        ((s != "") & x.isNull(), problem("invalid_format", "E", field, raw)),
        (lakh, problem("mixed_units", "W", field, raw)),
        (out, problem("out_of_range", "W", field, raw)),
    )
    unit = F.when(lakh, "lakh_per_annum").when(x.isNotNull(), "absolute_inr")
    return F.struct(value.alias("value"), unit.alias("unit"), out.alias("out_of_range"), found.alias("problems"))


RATE = r"(?i)^([0-9]+(?:\.[0-9]+)?)(k|lakh|lac|l)?(?:/|per)(hr|hour|hourly|day|daily|month|monthly|mo)$"


def rate(raw: Column, field: str = "rate", s: Column | None = None) -> Column:
    """struct(hourly, monthly, basis, out_of_range, problems)."""
    s = squash(raw) if s is None else s
    tight = F.replace(s, F.lit(" "), F.lit(""))
    unit = F.lower(F.regexp_extract(tight, RATE, 3))
    times = F.lower(F.regexp_extract(tight, RATE, 2))
    amount = F.when(tight.rlike(RATE), F.regexp_extract(tight, RATE, 1).try_cast("double")) * F.when(times == "k", 1000.0).when(times.isin("l", "lac", "lakh"), 100_000.0).otherwise(1.0)
    basis = F.when(unit.isin("hr", "hour", "hourly"), "hourly").when(unit.isin("day", "daily"), "daily").when(unit.isin("month", "monthly", "mo"), "monthly")
    hours = float(config.BILLABLE_HOURS_PER_MONTH)
    hourly = F.round(F.when(basis == "hourly", amount).when(basis == "daily", amount / 8.0).when(basis == "monthly", amount / hours), 2)
    monthly = F.round(F.when(basis == "hourly", amount * hours).when(basis == "daily", amount * 20.0).when(basis == "monthly", amount), 2)
    out = F.coalesce(~monthly.between(*config.RATE_PLAUSIBLE_MONTHLY), F.lit(False))
    found = problems(
        (s == "", problem("missing_value", "W", field, raw)),
        ((s != "") & basis.isNull(), problem("invalid_format", "E", field, raw)),
        (basis.isNotNull(), problem("mixed_units", "I", field, raw)),
        (out, problem("out_of_range", "W", field, raw)),
    )
    return F.struct(hourly.alias("hourly"), monthly.alias("monthly"), basis.alias("basis"), out.alias("out_of_range"), found.alias("problems"))


def floating(raw: Column, field: str, lo: float | None = None, hi: float | None = None, s: Column | None = None) -> Column:
    """struct(value double, problems): commas are dropped, values out of range kept."""
    s = squash(raw) if s is None else s
    x = number(F.replace(s, F.lit(","), F.lit("")))
    out = F.lit(False)
    if lo is not None:
        out = out | (x < lo)
    if hi is not None:
        out = out | (x > hi)
    found = problems(
        (s == "", problem("missing_value", "W", field, raw)),
        ((s != "") & x.isNull(), problem("invalid_format", "E", field, raw)),
        (out, problem("out_of_range", "W", field, raw)),
    )
    return F.struct(x.alias("value"), found.alias("problems"))


def whole(raw: Column, field: str, lo: float | None = None, hi: float | None = None, s: Column | None = None) -> Column:
    """As ``floating``, rounded half to even."""
    x = floating(raw, field, lo, hi, s)
    return F.struct(F.bround(x["value"], 0).try_cast("int").alias("value"), x["problems"].alias("problems"))


def boolean(raw: Column, field: str = "verified", s: Column | None = None) -> Column:
    """struct(value boolean or null, problems): an unknown word is null, not false."""
    s = squash(raw) if s is None else s
    key = F.lower(s)
    value = F.when(key.isin(*config.TRUTHY), True).when(key.isin(*config.FALSY), False)
    found = problems(
        (s == "", problem("missing_value", "W", field, raw)),
        ((s != "") & value.isNull(), problem("unmapped_value", "E", field, raw)),
        (value.isNotNull() & ~s.isin("Y", "N"), problem("inconsistent_value", "I", field, raw)),
    )
    return F.struct(value.alias("value"), found.alias("problems"))


def status(raw: Column, field: str = "gig_status", s: Column | None = None) -> Column:
    """struct(value, problems)."""
    s = squash(raw) if s is None else s
    value = looked_up(config.STATUS_CANON, F.lower(s))
    found = problems(
        (s == "", problem("missing_value", "W", field, raw)),
        ((s != "") & value.isNull(), problem("unmapped_value", "E", field, raw)),
        (value.isNotNull() & (value != s), problem("inconsistent_casing", "I", field, raw)),
    )
    return F.struct(value.alias("value"), found.alias("problems"))


def skills(raw: Column, field: str = "skills", s: Column | None = None) -> Column:
    """struct(values, problems): canonical names in order, once each without regard to case."""
    s = squash(raw) if s is None else s
    parts = F.filter(F.transform(F.split(s, ","), lambda p: F.trim(p)), lambda p: p != "")
    canon = F.transform(parts, lambda p: F.coalesce(looked_up(config.SKILL_CANON, F.lower(p)), p))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(canon, empty, lambda a, p: F.when(F.exists(a, lambda q: F.lower(q) == F.lower(p)), a).otherwise(F.array_append(a, p)))
    unknown = F.exists(parts, lambda p: looked_up(config.SKILL_CANON, F.lower(p)).isNull())
    recased = F.exists(parts, lambda p: looked_up(config.SKILL_CANON, F.lower(p)) != p)
    found = problems(
        (s == "", problem("missing_value", "W", field, raw)),
        (recased, problem("inconsistent_casing", "I", field, raw)),
        (unknown, problem("unmapped_value", "W", field, raw)),
    )
    return F.struct(kept.alias("values"), found.alias("problems"))
