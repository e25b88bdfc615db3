"""Pseudonymisation: personal data replaced by keyed surrogates, in DataFrame expressions only.

Entities are found by patterns, brought to a canonical value, and every distinct
value gets one surrogate: a keyed hash of the value fills the value's own shape.
Digits stay digits, letters stay letters of their script and case, separators
stay; a checksum that held for the value holds for its surrogate and one that did
not does not; reserved ranges keep surrogates unusable.  A name is replaced word by
word, so that a family name is the same with and without a given name, and each word
is made up in its own script (Latin, Cyrillic or Greek), a given name with an ending
of the gender that its title tells.  A full name that stood behind a title is also
replaced where the same document has it without one; a family name alone is only
found behind a title.  Equal values get equal surrogates in all
documents (coreference), whatever their spelling; different values get different
ones: candidates that meet each other, or meet a value that occurs, are drawn
again until none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmerge.sources.scratch import materialise

#: Kinds and their patterns, the first that matches at a place wins.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d])\d{4}(?:[ -]?\d{4}){3}(?!\d)",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "name": r"\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every text with an entity holds; texts without it are not searched further.
HINT = r"[0-9@]|[a-fA-F]{32}|(?:Mr|Ms|Miss|Herr|Frau|Mons|Mad|Se\u00f1or)"
FEMALE_TITLES = r"^(?:Mrs|Ms|Miss|Frau|Madame|Señora)\b"
#: Syllables of made-up names by script, and the endings of given names by gender.
SYLLABLES = {
    "latin": ["ba", "den", "fel", "gor", "han", "jor", "kel", "lam", "mar", "nor", "pel", "ran", "sel", "tor", "ven", "wal"],
    "cyrillic": ["ба", "ден", "фел", "гор", "хан", "йор", "кел", "лам", "мар", "нор", "пел", "ран", "сел", "тор", "вен", "вал"],
    "greek": ["βα", "δεν", "φελ", "γορ", "χαν", "ιορ", "κελ", "λαμ", "μαρ", "νορ", "πελ", "ραν", "σελ", "τορ", "βεν", "βαλ"],
}
ENDINGS = {
    "latin": {"f": ["a", "ina", "ia", "ella"], "m": ["o", "us", "an", "el"]},
    "cyrillic": {"f": ["а", "ина", "ия", "елла"], "m": ["о", "ус", "ан", "ел"]},
    "greek": {"f": ["α", "ινα", "ια", "ελλα"], "m": ["ος", "ων", "αν", "ελ"]},
}


def kind_of(raw: Column) -> Column:
    """The first kind whose pattern matches the whole entity."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(raw.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def parts(raw: Column, kind: Column) -> Column:
    """The values of a mention as array<struct<kind, value>>: spellings of one value brought together.

    Case of e-mails and keys, separators of numbers.  A name gives its given name (led
    by f or m) and its family name, or the latter alone.
    """
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    plain = F.when(kind.isin("email", "secret"), F.lower(raw)).when(kind.isin("phone", "ssn", "card"), digits).when(kind == "iban", F.regexp_replace(raw, " ", "")).otherwise(raw)
    words = F.split(raw, " ")
    gender = F.when(raw.rlike(FEMALE_TITLES), "f").otherwise("m")
    one = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    family = one(F.lit("family"), F.initcap(F.element_at(words, -1)))
    given = one(F.lit("given"), F.concat_ws(" ", gender, F.initcap(F.get(words, 1))))
    return F.when((kind == "name") & (F.size(words) > 2), F.array(given, family)).when(kind == "name", F.array(family)).otherwise(F.array(one(kind, plain)))


def _stream(value: Column, kind: Column, attempt: Column, key: str) -> Column:
    """64 keyed hex digits for a value and an attempt (a nested hash keyed on either side)."""
    inner = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string")), 256)
    return F.sha2(F.concat_ws("\u0001", F.lit(key), inner), 256)


def _digit(stream: Column, at: Column) -> Column:
    """The decimal digit that the stream's bytes at a place name."""
    return (F.conv(F.substring(stream, (at * 2) % 62 + 1, F.lit(3)), 16, 10).cast("int") + at) % 10


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when((n - i) % 2 == 1, _folded(F.substring(digits, i, F.lit(1)).try_cast("int") * 2)).otherwise(F.substring(digits, i, F.lit(1)).try_cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _folded(x: Column) -> Column:
    return F.when(x > 9, x - 9).otherwise(x)


def _random_digits(value: Column, stream: Column) -> Column:
    """The value with every digit drawn anew."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: F.when(F.substring(value, i, F.lit(1)).rlike("[0-9]"), _digit(stream, i).cast("string")).otherwise(F.substring(value, i, F.lit(1)))), "")


def _mod97(text: Column) -> Column:
    """The remainder of an account number's letters and digits, letters counting from 10."""
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)))
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _made_up(value: Column, stream: Column, attempt: Column, ending: dict | None) -> Column:
    """A name in the value's script; every attempt draws from sixteen times as many."""

    def of(script: str) -> Column:
        pick = lambda names, a: F.get(F.array(*[F.lit(n) for n in names]), F.conv(F.substring(stream, a, 2), 16, 10).cast("int") % len(names))
        base = [pick(SYLLABLES[script], 3), pick(SYLLABLES[script], 5), *([] if ending else [pick(SYLLABLES[script], 7)])]
        more = [F.when(attempt >= i, pick(SYLLABLES[script], 7 + 2 * i)).otherwise("") for i in range(1, 9)]
        last = [] if ending is None else [F.when(F.substring(value, 1, 1) == "f", pick(ENDINGS[script]["f"], 29)).otherwise(pick(ENDINGS[script]["m"], 29))]
        return F.initcap(F.concat(*base, *more, *last))

    return F.when(value.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(value.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def candidate(value: Column, kind: Column, attempt: Column, key: str) -> Column:
    """A surrogate of a canonical value, in canonical form."""
    s = _stream(value, kind, attempt, key)
    octet = lambda a: (F.conv(F.substring(s, a, 4), 16, 10).cast("int") % 256).cast("string")
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    word = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(local), F.lit(1))), lambda i: _like(F.substring(local, i, F.lit(1)), s, i)), "")
    label = F.substring(F.sha2(F.concat_ws("\u0001", F.lit(key), host), 256), 1, 8)
    tail = F.when(attempt > 0, F.substring(s, F.lit(33), F.least(attempt * 2, F.lit(16)))).otherwise("")  # short addresses run out
    email = F.concat(word, tail, F.lit("@h"), label, F.lit(".example"))  # same host, same host
    card_body = F.concat(F.substring(value, 1, 1), F.substring(_random_digits(value, s), F.lit(2), F.greatest(F.length(value) - 2, F.lit(0))))
    check = (F.lit(10) - _luhn_sum(F.concat(card_body, F.lit("0"))) % 10) % 10
    off = (check + 1 + F.conv(F.substring(s, 1, 2), 16, 10).cast("int") % 9) % 10
    card = F.concat(card_body, F.when(_luhn(value), check).otherwise(off).cast("string"))
    country, held = F.substring(value, 1, 2), _mod97(F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))) == 1
    account = F.array_join(F.transform(F.sequence(F.lit(5), F.greatest(F.length(value), F.lit(5))), lambda i: _like(F.substring(value, i, F.lit(1)), s, i)), "")
    right = 98 - _mod97(F.concat(account, country, F.lit("00")))
    wrong = (right + 1 + F.conv(F.substring(s, 1, 2), 16, 10).cast("int") % 90) % 97 + F.when(right < 2, 2).otherwise(0)
    iban = F.concat(country, F.lpad(F.when(held, right).otherwise(wrong).cast("string"), 2, "0"), account)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat_ws(".", (F.conv(F.substring(s, 13, 4), 16, 10).cast("int") % 15 + 240).cast("string"), octet(1), octet(5), octet(9)))  # reserved, never routed
        .when(kind == "phone", F.concat(F.substring(value, F.lit(1), F.greatest(F.length(value) - 9, F.lit(0))), F.substring(_random_digits(value, s), F.greatest(F.length(value) - 8, F.lit(1)), F.lit(9))))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_random_digits(value, s), F.lit(2), F.lit(8))))  # never issued
        .when(kind == "card", card)
        .when(kind == "secret", F.substring(F.concat(s, F.sha2(s, 256)), F.lit(1), F.length(value)))
        .when(kind == "iban", iban)
        .when(kind == "given", F.concat_ws(" ", F.substring(value, 1, 1), _made_up(value, s, attempt, ENDINGS)))
        .otherwise(_made_up(value, s, attempt, None))
    )


def _like(char: Column, stream: Column, at: Column) -> Column:
    """A letter for a letter of its case, a digit for a digit, anything else itself."""
    letter = (F.conv(F.substring(stream, (at * 2) % 61 + 1, F.lit(3)), 16, 10).cast("int") + at) % 26
    return (
        F.when(char.rlike("[a-z]"), F.char(letter + 97))
        .when(char.rlike("[A-Z]"), F.char(letter + 65))
        .when(char.rlike("[0-9]"), _digit(stream, at).cast("string"))
        .otherwise(char)
    )


def rendered(raw: Column, kind: Column, surrogates: Column) -> Column:
    """The canonical surrogates in the spelling of one mention: its separators, its case, its title."""
    surrogate = F.get(surrogates, 0)
    before = lambda i: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), r"[^0-9]", ""))
    spaced = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1))), lambda i: F.when(F.substring(raw, i, F.lit(1)).rlike("[0-9]"), F.substring(surrogate, before(i), F.lit(1))).otherwise(F.substring(raw, i, F.lit(1)))), "")
    upper = raw.rlike("[A-Z]") & ~raw.rlike("[a-z]")
    grouped = F.when(raw.contains(" "), F.trim(F.regexp_replace(surrogate, "(.{4})", "$1 "))).otherwise(surrogate)
    words = F.split(raw, " ")
    bare = F.transform(surrogates, lambda n: F.regexp_replace(n, "^[fm] ", ""))
    cased = F.transform(bare, lambda n, i: F.when((F.length(F.get(words, i + 1)) > 1) & (F.get(words, i + 1) == F.upper(F.get(words, i + 1))), F.upper(n)).otherwise(n))
    return (
        F.when(kind.isin("phone", "ssn", "card"), spaced)
        .when(kind.isin("email", "secret"), F.when(upper, F.upper(surrogate)).otherwise(surrogate))
        .when(kind == "ip", surrogate)
        .when(kind == "iban", grouped)
        .otherwise(F.concat_ws(" ", F.get(words, 0), F.array_join(cased, " ")))
    )


def assign(values: DataFrame, key: str, max_rounds: int = 50) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): distinct, and none a value that occurs.

    Every round draws a candidate for the values still open, keeps the smallest
    value of each candidate unless it is taken or occurs, and goes on with the rest.
    """
    spark = values.sparkSession
    values = materialise(values.distinct(), "pii-values")
    taken, left, attempt = None, values, 0
    while True:
        drawn = left.withColumn("surrogate", candidate(F.col("value"), F.col("kind"), F.lit(attempt), key))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        free = first.join(values.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        free = materialise(free.select("kind", "value", "surrogate"), "surrogates")
        taken = free if taken is None else taken.unionByName(free)
        left = materialise(left.join(free, ["kind", "value"], "left_anti").select("kind", "value"), "pii-open")
        attempt += 1
        if left.isEmpty():
            return taken
        if attempt == max_rounds:
            raise RuntimeError(f"{left.count()} values found no free surrogate in {max_rounds} rounds")


def mentions(text: Column) -> Column:
    """The entities of a text in order, as they are spelt."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def pseudonymise(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, n_entities, kinds) for every row: the text with all entities replaced.

    A null text comes back null with no entities.  Rows are told apart by id and
    text, so repeated ids (and nulls) are fine; equal rows have equal results.  Only
    documents with an entity take part in the joins.
    """
    plain = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("row"))
    some = plain.where(F.col("text").rlike(HINT))
    # an outer generator: its input is evaluated once, and no filter repeats it below
    each = some.select(F.col(id_col).alias("id"), "row", F.posexplode_outer(mentions(F.col("text"))).alias("pos", "raw"))
    found = materialise(each.where("raw is not null").distinct(), "pii-mentions")

    # dealt by number: the distinct mentions are few bytes and much work
    parts_of = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raws = found.select("raw").repartition(parts_of, "raw").distinct().withColumn("kind", kind_of(F.col("raw"))).where("kind is not null")
    each = raws.select("raw", F.col("kind").alias("of"), F.posexplode(parts(F.col("raw"), F.col("kind"))).alias("at", "p"))
    known = materialise(each.select("raw", "of", "at", "p.*"), "pii-known")
    drawn = known.join(assign(known.select("kind", "value"), key), ["kind", "value"])
    whole = drawn.groupBy("raw", "of").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("s"))
    table = whole.select("raw", F.col("of").alias("kind"), rendered(F.col("raw"), F.col("of"), F.col("s")).alias("new"))

    put = found.join(table, "raw", "left").select("id", "row", F.struct("pos", F.coalesce("new", "raw").alias("new"), "kind", "raw").alias("m"))
    swaps = put.groupBy("id", "row").agg(F.array_sort(F.collect_list("m")).alias("put"))
    joined = plain.join(swaps, plain[id_col].eqNullSafe(swaps["id"]) & (plain["row"] == swaps["row"]), "left")
    bare = lambda c: F.regexp_replace(c, r"^\S+ ", "")
    full = F.filter("put", lambda m: (m["kind"] == "name") & bare(m["raw"]).contains(" "))
    named = F.array_distinct(F.transform(full, lambda m: F.struct(bare(m["raw"]).alias("old"), bare(m["new"]).alias("new"))))
    again = lambda gap: F.aggregate(named, gap, lambda t, n: F.when(t.contains(n["old"]), F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{L})"), n["old"], F.lit(r"(?!\p{L})")), n["new"])).otherwise(t))
    gaps = F.transform(F.split(F.col("text"), PATTERN, -1), again)
    news = F.concat(F.transform("put", lambda m: m["new"]), F.array(F.lit("")))
    woven = F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), news.alias("put")), lambda p: F.array(p["gap"], p["put"]))), "")
    there = F.col("put").isNotNull()
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform("put", lambda m: m["kind"]), lambda k: k.isNotNull())))
    return joined.select(
        plain[id_col],
        F.when(there, woven).otherwise(F.col("text")).alias("text"),
        F.when(there, F.size("put")).otherwise(0).cast("long").alias("n_entities"),
        F.when(there, kinds).otherwise(F.array().cast("array<string>")).alias("kinds"),
    )
