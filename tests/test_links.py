"""Effective links, representatives and reports of identity resolution against a sequential union-find."""

import random

from quillmerge import config
from quillmerge.operators import audit, findings, forest, identity

SCHEMA = """uid string, source string, row_number int, source_rank int, full_name string, name_key string, name_abbreviated boolean, email string, email_alias_of string,
phone string, city string, region_guess boolean, usable boolean, skills array<string>, raw map<string,string>"""


def drawn(seed, n):
    r = random.Random(seed)
    rows = []
    for source in config.SOURCE_ORDER:
        for k in range(1, n + 1):
            if r.random() < 0.7:
                name = r.choice(["asha rao", "ravi kumar", "tara das", "mohan lal", None])
                email = f"e{r.randrange(n)}@x.test" if r.random() < 0.5 else None
                phone = f"9{r.randrange(n // 2):09d}" if r.random() < 0.5 else None
                city = r.choice(["Pune", "Delhi", "Noida", None])
                usable = r.random() < 0.85
                rows.append((f"{source}:{k}", source, k, config.SOURCE_PRIORITY.index(source), name, name, False, email, None, phone, city, False, usable, r.choice([None, [], ["SQL"], ["React", "SQL"]]), {"k": str(k)}))
    return rows


def one_by_one(rows):
    """Records in the order of the list, one union after another."""
    place = {s: i for i, s in enumerate(config.SOURCE_ORDER)}
    rows = [r for r in sorted(rows, key=lambda r: (place[r[1]], r[2])) if r[12]]
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
        return a != b

    links = []
    for field, at in (("email", 7), ("phone", 9)):
        keys = {}
        for r in rows:
            if r[at]:
                keys.setdefault(r[at], []).append(r)
        for value, (first, *others) in keys.items():
            links += [(first[0], o[0], field, value) for o in others if union(first[0], o[0])]
    strong = {x: find(x) for x in parent}
    named, first_named = {}, {}
    for r in rows:
        if r[5] and r[10]:
            named.setdefault((r[5], r[10]), set()).add(strong[r[0]])
            first_named.setdefault(strong[r[0]], r)
    issues = []
    held = lambda root, at: {r[at] for r in rows if strong[r[0]] == root and r[at]}
    merges = []
    for (name, _), roots in sorted(named.items()):
        if len(roots) > 2:
            issues.append(("ambiguous_identity", None, None, name))
        elif len(roots) == 2:
            a, b = sorted(roots)
            if any(held(a, k) and held(b, k) and not held(a, k) & held(b, k) for k in (7, 9)):
                issues.append(("homonym_kept_separate", None, None, name))
            else:
                merges.append((first_named[a], first_named[b], name))
    for a, b, name in merges:
        union(a[0], b[0])
        issues.append(("weak_match_applied", b[1], b[2], name))
    bearers = {}
    for r in rows:
        if r[5] and r[10]:
            bearers.setdefault(r[5], set()).add(find(r[0]))
    cities = {name: ", ".join(sorted({r[10] for r in rows if find(r[0]) in roots and r[10]})) for name, roots in bearers.items() if len(roots) > 1}
    issues += [("homonym", None, None, name) for name in cities]
    source = {r[0]: (r[1], r[2]) for r in rows}
    issues += [("cross_source_match", *source[b], value) for a, b, _, value in links if source[a][0] != source[b][0]]
    people = {}
    for r in rows:
        people.setdefault(find(r[0]), []).append(r)
    issues += [("three_way_match", None, None, min((r[3], r[2], r[0]) for r in mine)[2]) for mine in people.values() if len({r[1] for r in mine}) == 3]
    return links, strong, {x: find(x) for x in parent}, issues, cities


def test_random_records_against_one_union_after_another(spark):
    for seed, n in ((1, 14), (2, 40)):
        rows = drawn(seed, n)
        links, strong, final, issues, cities = one_by_one(rows)
        records = spark.createDataFrame(rows, SCHEMA)
        for small in (5, 1000) if n < 20 else (1000,):
            got = [tuple(r) for r in identity.effective_links(records, small).select("src", "dst", "field", "value").collect()]
            assert sorted(got) == sorted(links)
        resolved = identity.resolve(records)
        assert {r.uid: (r.strong_root, r.root) for r in resolved.collect()} == {u: (strong[u], final[u]) for u in final}
        assert identity.match_methods(resolved).count() == len(set(final.values()))
        clusters = resolved.select("uid", "strong_root").withColumnRenamed("strong_root", "root")
        found = findings.identity_issues(records, clusters, resolved).where("category not in ('duplicate_within_source', 'exact_duplicate_row')")
        key = lambda x: tuple(str(v) for v in x)
        assert sorted(((r.category, r.source, r.row_number, r.raw_value) for r in found.collect()), key=key) == sorted(issues, key=key)
        assert {r.name_key: r.cities for r in identity.homonyms(resolved).collect()} == cities


def test_unusable_records_are_nobody(spark):
    nobody = ("gig:1", "gig", 1, 2, None, None, False, None, None, None, None, False, False, None, {})
    half = ("audio_app:1", "audio_app", 1, 3, None, None, False, None, None, "9000000001", "Pune", False, False, None, {})
    some = ("cbnexus:1", "cbnexus", 1, 1, "Asha Rao", "asha rao", False, None, None, "9000000001", "Pune", False, True, None, {})
    resolved = identity.resolve(spark.createDataFrame([nobody, half, some], SCHEMA))
    assert [(r.uid, r.root) for r in resolved.collect()] == [("cbnexus:1", "cbnexus:1")]


def test_forest_in_rounds_is_the_forest_in_order(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60), k) for k in range(150)]
    r.shuffle(edges)
    parent, want = list(range(60)), set()

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b, k in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.add(k)
    links = spark.createDataFrame(edges, "a long, b long, rank long")
    for small in (0, 1000):
        assert {x["rank"] for x in forest.minimum_forest(links, "rank", small).collect()} == want
    assert not forest.minimum_forest(links.where("a = b"), "rank", 0).collect()


def test_skills_agree_where_one_list_is_empty(spark):
    member = "root string, source string, skills array<string>"
    rows = [("p", "naukri", []), ("p", "gig", ["SQL"]), ("q", "naukri", ["SQL"]), ("q", "gig", None), ("r", "naukri", ["SQL"]), ("r", "gig", ["React"])]
    assert [(x.root, x.only_a, x.only_b) for x in audit.skill_agreement(spark.createDataFrame(rows, member)).collect()] == [("r", "SQL", "React")]


def test_relinked_category(spark):
    rows = spark.createDataFrame([("a", "p"), ("b", None)], "person_key string, person string")
    assert [(r.category, r.raw_value) for r in findings.relink_issue(rows).collect()] == [("person_references_relinked", "1/2")]
