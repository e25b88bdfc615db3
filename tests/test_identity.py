import random

import pytest

from quillmerge.operators import golden, identity
from quillmerge.operators.components import connected_components

SCHEMA = """uid string, source string, row_number int, source_rank int, full_name string, name_key string, name_abbreviated boolean,
email string, email_alias_of string, phone string, city string, region_guess boolean, usable boolean, skills array<string>"""


def record(source, row, name, email=None, phone=None, city=None, skills=None):
    rank = {"naukri": 0, "cbnexus": 1, "gig": 2}[source]
    short = any(len(t.strip(".")) == 1 for t in (name or "").split())
    return (f"{source}:{row}", source, row, rank, name, name and name.lower().replace(".", ""), short, email, None, phone, city, False, True, skills)


@pytest.fixture
def resolved(spark):
    def make(*rows):
        return identity.resolve(spark.createDataFrame(list(rows), SCHEMA))

    return make


def clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.root, set()).add(r.uid)
    return sorted(map(sorted, out.values()))


def test_hub_joins_by_email_and_phone(resolved):
    df = resolved(record("naukri", 1, "Asha Rao", "a@x.test", "9000000001"), record("gig", 1, "Asha Rao", "a@x.test"), record("cbnexus", 1, "Asha Rao", None, "9000000001"))
    assert len(clusters(df)) == 1
    m = identity.match_methods(df).first()
    assert (m.methods, m.confidence) == ("exact_email,exact_phone", 1.0)


def test_weak_merge_by_name_and_city(resolved):
    df = resolved(record("gig", 1, "Asha Rao", "a@x.test", None, "Pune"), record("cbnexus", 1, "Asha Rao", None, "9000000001", "Pune"))
    m = identity.match_methods(df).first()
    assert len(clusters(df)) == 1 and (m.methods, m.confidence) == ("name_city_weak", 0.6)


def test_three_of_one_name_stay_apart(spark):
    rows = [record("gig", k, "Asha Rao", f"a{k}@x.test", None, "Pune") for k in range(2)] + [record("cbnexus", 1, "Asha Rao", None, "9000000001", "Pune")]
    df = spark.createDataFrame(rows, SCHEMA)
    strong = identity.strong_clusters(df)
    decided = identity.weak_decisions(df, strong)
    reviews = identity.merge_reviews(df, strong, decided).collect()
    assert len(reviews) == 3 and {r.reason for r in reviews} == {"ambiguous_name_city"}
    assert len(clusters(identity.resolve(df))) == 3


def test_contradicting_keys_stay_apart(spark):
    df = spark.createDataFrame([record("cbnexus", 1, "Asha Rao", None, "9000000001", "Pune"), record("cbnexus", 2, "Asha Rao", None, "9000000002", "Pune")], SCHEMA)
    strong = identity.strong_clusters(df)
    reviews = identity.merge_reviews(df, strong, identity.weak_decisions(df, strong)).collect()
    assert [(r.reason, r.root, r["size"]) for r in reviews] == [("same_name_conflicting_strong_key", "cbnexus:1 | cbnexus:2", 2)]


def test_elections(resolved):
    df = resolved(
        record("naukri", 1, "A. Rao", "a@x.test", None, "Pune"),
        record("gig", 1, "Asha Rao", "a@x.test", None, "Noida", ["SQL"]),
        record("gig", 2, "Asha Rao", "a@x.test", None, "Noida", ["SQL", "React"]),
    )
    assert golden.elect_names(df).first().full_name == "Asha Rao"
    assert golden.elect_cities(df).first().city == "Noida"
    assert {(r.field, r.rejected) for r in golden.conflicts(df, golden.elect_cities(df), "city").collect()} == {("city", "Pune")}
    assert {(r.skill, r.sources) for r in golden.person_skills(df).collect()} == {("SQL", "gig"), ("React", "gig")}


def test_random_graphs(spark):
    r = random.Random(3)
    nodes = [f"n{k:03d}" for k in range(150)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(90)] + [(nodes[k], nodes[k + 1]) for k in range(100, 140)] + [("n000", None)]
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_numbering_is_dense_and_independent_of_order(spark):
    rows = [(f"r{k}", f"p{k * 7 % 50:02d}@x.test" if k % 5 else None, None, "n", f"ref{k}") for k in range(50)]
    ids = []
    for n in (1, 7):
        df = spark.createDataFrame(rows, "root string, email string, phone string, full_name string, ref string").repartition(n)
        ids.append({r.root: r.person_id for r in golden.numbered(df).collect()})
    assert ids[0] == ids[1] and sorted(ids[0].values()) == list(range(1, 51))


def test_hubs_and_chains_fall_together(spark):
    """A hub with most edges, a chain and a pair: one component each, by the smallest node."""
    edges = [(5_000, k) for k in range(5_001, 6_500)] + [(k, 5_000) for k in range(4_000, 4_900)] + [(k, k + 1) for k in range(100, 300)] + [(1, 2), (2, 2), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {k: 4_000 for k in [*range(4_000, 4_900), 5_000, *range(5_001, 6_500)]} | {k: 100 for k in range(100, 301)} | {1: 1, 2: 1}
    assert got == want
