import re

import pytest
from pyspark.sql import functions as F

from quillmerge.llm import surrogates


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


@pytest.fixture
def run(docs_of):
    def one(*texts, key="k"):
        rows = list(enumerate(texts))
        return {r.doc_id: r for r in surrogates.pseudonymise(docs_of(rows), key=key).collect()}

    return one


def test_each_kind_keeps_its_form(run):
    got = run("mail Bob.7@mail3.example.com now", "call +1 (377) 555-0271!", "card 4111 1111 1111 1111 and 1234567812345678", "ip 10.20.30.40.", "id 123-45-6789", 'token = "44e15e09fd311c3cf3163b66d5a9875b883d8ce1"', "Frau Anna Blum met Mr. Karl Blum", "DE44 5001 0517 5407 3249 31")
    assert [got[k].kinds for k in range(8)] == [["email"], ["phone"], ["card"], ["ip"], ["ssn"], ["secret"], ["name"], ["iban"]]
    assert re.fullmatch(r"mail [a-z]{3}\.\d@h[0-9a-f]{8}\.example now", got[0].text)
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}!", got[1].text) and "377) 555-0271" not in got[1].text
    a, b = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})", got[2].text).groups()
    assert luhn(a.replace(" ", "")) and a[0] == "4" and not luhn(b)
    assert re.fullmatch(r"ip 2[45]\d(\.\d{1,3}){3}\.", got[3].text)
    assert re.fullmatch(r"id 9\d\d-\d\d-\d{4}", got[4].text)
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[5].text) and "44e15e09" not in got[5].text
    frau, one, mr, two = re.fullmatch(r"Frau (\w+) (\w+) met Mr\. (\w+) (\w+)", got[6].text).groups()
    ends = surrogates.ENDINGS["latin"]
    assert frau.endswith(tuple(ends["f"])) and mr.endswith(tuple(ends["m"])) and one == two
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d{2}", got[7].text) and iban_holds(got[7].text)


def iban_holds(text):
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def test_ibans_keep_what_their_check_says(run):
    got = run("DE44500105175407324931", "DE45500105175407324931", "GB29 NWBK 6016 1331 9268 19")
    assert [iban_holds(got[k].text) for k in range(3)] == [True, False, True]
    assert re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", got[2].text)


def test_a_person_keeps_one_name(run):
    got = run("Herr Blum, Herr Karl Blum and Frau BLUM; later Karl Blum, Karl Blumen", "Mr Иван Петров", "Mr Νίκος Βλάχος", "Karl Blum")
    single, given, family, loud, again, other = re.fullmatch(r"Herr (\w+), Herr (\w+) (\w+) and Frau (\w+); later (\w+ \w+), (\w+ \w+)", got[0].text).groups()
    assert single == family and loud == family.upper() and again == f"{given} {family}" and other == "Karl Blumen" and family != "Blum"
    assert re.fullmatch(r"Mr [А-Яа-я]+ [А-Яа-я]+", got[1].text) and "Иван" not in got[1].text
    assert re.fullmatch(r"Mr [Α-ωά-ώ]+ [Α-ωά-ώ]+", got[2].text) and "Βλάχος" not in got[2].text
    assert got[3].text == "Karl Blum"  # nothing tells that this is a name


def test_coreference_and_keys(run):
    texts = ("a@x.test and A@X.TEST and a@x.test", "a@x.test", "b@x.test", "+1 377 555 0271", "+1 (377) 555-0271")
    got = run(*texts)
    first = got[1].text
    assert got[0].text.split(" and ") == [first, first.upper(), first] and got[0].n_entities == 3
    assert got[2].text != first and got[2].text.split("@")[1] == first.split("@")[1]
    assert re.sub(r"\D", "", got[3].text) == re.sub(r"\D", "", got[4].text)
    assert run(*texts)[1].text == first and run(*texts, key="other")[1].text != first


def test_many_values_stay_distinct(run):
    # few shapes: many candidates meet, and some meet values that occur
    texts = [f"card {4000 + k:04d} 0000 0000 {k:04d}" for k in range(300)] + [f"ip 240.0.0.{k}" for k in range(200)]
    got = run(*texts)
    assert len({r.text for r in got.values()}) == 500
    assert not {r.text for r in got.values()} & set(texts)


def test_collisions_are_drawn_again(spark, monkeypatch):
    real = surrogates.candidate
    # at first only ten candidates, two of which are values that occur
    monkeypatch.setattr(surrogates, "candidate", lambda v, k, n, key: F.when(n < 3, F.concat(F.lit("v"), F.substring(real(v, k, n, key), -1, 1))).otherwise(real(v, k, n, key)))
    values = spark.createDataFrame([("ssn", f"9000000{n:02d}") for n in range(40)] + [("ssn", "v1"), ("ssn", "v2")], "kind string, value string")
    got = surrogates.assign(values, "k").collect()
    assert len(got) == 42 and len({r.surrogate for r in got}) == 42
    assert not {r.surrogate for r in got} & {r.value for r in got}


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (3, "nothing here 12.5 and v1.2"), (4, "x@y.test"), (4, "x@y.test"), (4, "z@y.test"), (None, "x@y.test"), (5, "w " * 30_000 + "x@y.test")]
    docs = docs_of(rows).selectExpr("*", "1 AS row", "'x' AS found", "'y' AS swap")
    got = surrogates.pseudonymise(docs, key="k").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text is None and by[2][0].text == "" and by[3][0].text == rows[2][1] and by[3][0].n_entities == 0
    same = {r.text for r in by[4]}
    assert len(same) == 2 and by[None][0].text in same and by[5][0].text.endswith(by[None][0].text)
    assert surrogates.pseudonymise(docs_of([]), key="k").count() == 0
