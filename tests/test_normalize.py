import datetime

import pytest
from pyspark.sql import functions as F

from quillmerge.functions import normalize as N
from quillmerge.functions.text import squash, title_case


@pytest.fixture
def run(spark):
    def one(f, raw, *path):
        row = spark.createDataFrame([(raw,)], "x string").select(f(F.col("x")).alias("n")).first()["n"]
        return row

    return one


def categories(row):
    return [p.category for p in row.problems]


@pytest.mark.parametrize(
    ("raw", "value", "found"),
    [
        ("09000000103", "9000000103", ["inconsistent_format"]),
        ("+91-9000000103", "9000000103", ["inconsistent_format"]),
        ("00919000000103", "9000000103", ["inconsistent_format"]),
        ("9000000103", "9000000103", []),
        ("12345", None, ["invalid_format"]),
        ("abc", None, ["invalid_format"]),
        ("1234567890", "1234567890", ["suspicious_value"]),
        ("", None, ["missing_value"]),
        (None, None, ["missing_value"]),
        ("   ", None, ["missing_value"]),
    ],
)
def test_phone(run, raw, value, found):
    row = run(N.phone, raw)
    assert (row.value, categories(row)) == (value, found)


def test_email(run):
    row = run(N.email, "alt.Ravi@Mail.test")
    assert row.value == "alt.ravi@mail.test" and row.alias_of == "ravi@mail.test" and row.domain == "mail.test"
    assert categories(row) == ["inconsistent_casing", "alias_email"]
    assert run(N.email, "not an address").value is None
    assert categories(run(N.email, "a b@mail.test")) == ["invalid_format"] and run(N.email, "a b@mail.test").value == "ab@mail.test"


@pytest.mark.parametrize(
    ("raw", "value", "key", "found"),
    [
        ("RAVI KUMAR", "Ravi Kumar", "ravi kumar", ["inconsistent_casing"]),
        ("ravi  kumar", "Ravi Kumar", "ravi kumar", ["inconsistent_casing"]),
        ("R. Kumar", "R. Kumar", "r kumar", ["abbreviated_name"]),
        ("Shaun O'brien-smith", "Shaun O'Brien-Smith", "shaun o brien smith", ["abbreviated_name"]),
        ("Ravi 2", "Ravi 2", "ravi", ["suspicious_value"]),
        ("", None, None, ["missing_value"]),
    ],
)
def test_name(run, raw, value, key, found):
    row = run(N.name, raw)
    assert (row.value, row.key, categories(row)) == (value, key, found)


@pytest.mark.parametrize(
    ("raw", "value", "ambiguous"),
    [
        ("24-07-2026", (2026, 7, 24), False),
        ("07/13/2026", (2026, 7, 13), False),
        ("7 Jul 2026", (2026, 7, 7), False),
        ("7-july-2026", (2026, 7, 7), False),
        ("2026-07-09", (2026, 7, 9), False),
        ("07/03/2026", (2026, 7, 3), True),
        ("03-07-2026", (2026, 7, 3), True),
        ("32-01-2026", None, False),
        ("2026-02-30", None, False),
        ("13/13/2026", None, False),
        ("7 Foo 2026", None, False),
        ("soon", None, False),
        (None, None, False),
    ],
)
def test_date(run, raw, value, ambiguous):
    row = run(N.date, raw)
    assert row.value == (value and datetime.date(*value)) and row.ambiguous is ambiguous


def test_future_date_is_kept(run):
    row = run(N.date, "2027-01-01")
    assert row.future and row.value == datetime.date(2027, 1, 1) and categories(row) == ["future_date"]


def test_amounts(run):
    assert run(N.ctc, "4.2").value == 420000 and run(N.ctc, "417964").unit == "absolute_inr"
    for bad in ("nan", "inf", "1_000", "4.2d", "x"):
        row = run(N.ctc, bad)
        assert row.value is None and categories(row) == ["invalid_format"]
    assert run(N.ctc, "1200").out_of_range
    hourly = run(N.rate, "1415/hr")
    assert (hourly.hourly, hourly.monthly, hourly.basis) == (1415, 226400, "hourly")
    assert run(N.rate, "15k / month").monthly == 15000 and run(N.rate, "800 per day").monthly == 16000
    assert run(N.rate, "cheap").basis is None and categories(run(N.rate, "cheap")) == ["invalid_format"]


def test_small_vocabularies(run):
    assert run(N.boolean, "Yes").value is True and run(N.boolean, "maybe").value is None
    assert categories(run(N.boolean, "maybe")) == ["unmapped_value"] and categories(run(N.boolean, "Y")) == []
    assert run(N.status, "On Hold").value == "paused" and run(N.status, "gone").value is None
    city = run(N.city, "Delhi NCR ")
    assert city.value == "Delhi" and city.region_guess and "precision_loss" in categories(city) and "trailing_whitespace" in categories(city)
    assert run(N.city, "springfield").value == "Springfield" and "unmapped_value" in categories(run(N.city, "springfield"))
    row = run(N.skills, "python, Python,js,React,Cobol,, ")
    assert row["values"] == ["Python", "JavaScript", "React", "Cobol"]
    assert categories(row) == ["inconsistent_casing", "unmapped_value"]


def test_numbers(run):
    assert run(lambda c: N.floating(c, "x", 0, 10), "1,2").value == 12 and categories(run(lambda c: N.floating(c, "x", 0, 10), "1,2")) == ["out_of_range"]
    assert run(lambda c: N.whole(c, "x"), "2.5").value == 2 and run(lambda c: N.whole(c, "x"), "3.5").value == 4


def test_text(run):
    assert run(squash, " a ​  b\n") == "a b" and run(squash, None) == ""
    assert run(title_case, "mc o'neil j.") == "Mc O'Neil J."


def test_names_compatible(spark):
    rows = [(["ravi", "kumar"], ["r", "kumar"], True), (["ravi"], ["ravi", "kumar"], False), (["ravi"], ["mohan"], False), ([], [], False)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, ok boolean")
    assert all(r.got == r.ok for r in df.select(N.names_compatible(F.col("a"), F.col("b")).alias("got"), "ok").collect())


def test_dates_of_one_shape_only(spark):
    rows = [("3 Februa 2026", None), ("3 February 2026", "2026-02-03"), ("3-FEB-2026", "2026-02-03"), ("1-2/2026", None), ("1/2-2026", None), ("1-2-2026", "2026-02-01"), ("1/2/2026", "2026-01-02"), ("30 Feb 2026", None)]
    for r in spark.createDataFrame(rows, "t string, want string").select(N.date(F.col("t")).alias("d"), "want").collect():
        assert (str(r.d.value) if r.d.value else None) == r.want
        assert bool(r.want) or r.d.problems[0].category in ("invalid_format", "invalid_value")


def test_compatibility_forms_are_read(spark):
    row = spark.createDataFrame([("９８７６５ ４３２１０", "ＡＳＨＡ\u3000Ｒａｏ", "ａ@ｘ．test")], "p string, n string, e string").select(N.phone(F.col("p"))["value"], N.name(F.col("n"))["value"], N.email(F.col("e"))["value"]).first()
    assert tuple(row) == ("9876543210", "Asha Rao", "a@x.test")


def test_squash_over_all_characters_is_full_nfkc(spark):
    """Every assigned character, between letters and with a mark behind it, as Python's own tables have it."""
    import unicodedata

    def squashed(text):
        return " ".join(unicodedata.normalize("NFKC", text).replace("​", "").replace("﻿", "").split())

    # characters that only one of the two Unicode versions knows are left out
    old = unicodedata.ucd_3_2_0
    known = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) != "Cn" or old.category(chr(c)) != "Cn")]
    plain = [c for c in known if not c.isspace() or c == " "]
    texts = ["".join(f"a{c}b{c}́ " for c in plain[i : i + 64]) for i in range(0, len(plain), 64)] + ["\U0001d7d7\U0001d7d6", "Soﬁa", "Å"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", squash(F.col("t")).alias("s")).collect()
    wrong = [(r.t, r.s) for r in rows if r.s != squashed(r.t)]
    assert not wrong, wrong[:2]
    assert {r.t: r.s for r in rows}["Soﬁa"] == "Sofia"
