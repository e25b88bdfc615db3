"""b-bit MinHash near-dedup against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from quillmerge.llm import minhash
from quillmerge.llm.meet import links_within


def shingles(text, width=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent=85):
    """[(id, n, component_id)] in order of ``rows``."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), k in zip(rows, label, strict=True):
        least[k] = min((x for x in (least.get(k), doc) if x is not None), default=None)
    return sorted(((d, len(s), least[k], d == least[k]) for (d, _), s, k in zip(rows, sets, label, strict=True)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def changed(text, n, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def near_rows(prose):
    rows, n = [], 0
    for k in range(30):
        base = prose(k, 60 + 3 * k)
        rows.append((n, base))
        for j in range(1, 6):  # from alike to too far away, in a chain of changes
            n += 1
            base = changed(base, j % 3 + 1, 100 * k + j)
            rows.append((n, base))
        n += 1
    return rows


def test_links_are_those_of_all_pairs(spark, docs_of, prose):
    rows = near_rows(prose)
    assert found(minhash.near_duplicates(docs_of(rows))) == brute(rows)


def test_split_buckets_and_groups_lose_nothing(spark, docs_of, prose):
    base = prose(7, 120)
    rows = near_rows(prose)[:60] + [(1000 + k, changed(base, 1 + k % 5, k)) for k in range(60)]
    want = brute(rows)
    assert len({c for *_, c, _ in want}) < len(rows)
    assert found(minhash.near_duplicates(docs_of(rows), part_rows=7, part_shingles=700)) == want


def test_just_at_the_similarity(spark, docs_of):
    """85 common shingles of 100 link, 84 of 99 do not (0.848)."""
    words = lambda lead, n: [f"{lead}{i}" for i in range(n)]
    common = words("c", 87)  # 85 shingles of three
    rows = [(1, " ".join(common)), (2, " ".join(common + words("x", 15))), (3, " ".join(words("d", 86))), (4, " ".join(words("d", 86) + words("y", 15)))]
    assert [(r[0], r[2]) for r in found(minhash.near_duplicates(docs_of(rows)))] == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert found(minhash.near_duplicates(docs_of(rows))) == brute(rows)


def test_edges(spark, docs_of):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, "one two"), (11, "one\ttwo "), (12, "É a b"), (13, "é a b"), (None, "one two"), (3, "a b c d"), (3, "a b c d"), (3, "x y z"), (None, "only null"), (None, "only null")]
    assert found(minhash.near_duplicates(docs_of(rows))) == brute(rows)
    assert not found(minhash.near_duplicates(docs_of([])))
    clash = docs_of([(1, "a b c"), (2, "a b c")]).selectExpr("doc_id", "text", "1 AS row", "2 AS component", "3 AS n", "'x' AS kept")
    assert found(minhash.near_duplicates(clash)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_very_long_text(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " tail"), (3, "x" * 3_000_000)]
    assert [(r[1], r[2]) for r in found(minhash.near_duplicates(docs_of(rows)))] == [(299_998, 1), (299_999, 1), (1, 3)]


def test_estimates_are_collision_corrected():
    r = np.random.default_rng(1)
    for similarity in (0.0, 0.3, 0.85):
        told = []
        for _ in range(200):
            both, n = r.integers(1 << 63, size=int(similarity * 400), dtype=np.uint64), 400 - int(similarity * 400)
            a, b = (np.concatenate([both, r.integers(1 << 63, size=n // 2, dtype=np.uint64)]) * np.uint64(2) for _ in range(2))
            x, y = (np.frombuffer(minhash.signature(minhash.minima(s)), np.uint64) for s in (a, b))
            told.append(minhash.estimate(minhash.unequal(x, y)))
        assert abs(np.mean(told) - similarity) < 0.02


def test_bits_of_a_wanted_pair_are_hardly_ever_too_far():
    differ, most = 0.15 * 0.75, minhash.most_differing(85)
    r = np.random.default_rng(2)
    assert r.binomial(minhash.HASHES, differ, 1_000_000).max() <= most < minhash.HASHES * 0.75 * 0.6


@pytest.mark.parametrize("part_weight", [1, 2, 3, 5, 100])
def test_groups_of_any_split_connect_alike(spark, part_weight):
    """Numbers link where they differ by 3 or less; groups overlap."""
    r = random.Random(part_weight)
    groups = {g: sorted(r.sample(range(60), r.randint(1, 25))) for g in range(12)}

    def local(held):
        label, out = list(range(len(held))), []
        for i, j in combinations(range(len(held)), 2):
            if abs(held[i] - held[j]) <= 3 and label[i] != label[j]:
                out.append((i, j))
                old = label[j]
                label = [label[i] if x == old else x for x in label]
        return out

    members = spark.createDataFrame([(g, x, 1) for g, xs in groups.items() for x in xs], "group long, row long, weight long")
    payload = spark.createDataFrame([(x, str(x)) for x in range(60)], "row long, payload string")
    got = [(x.src, x.dst) for x in links_within(members, payload, lambda b: int(b), local, part_weight).collect()]
    assert all(abs(a - b) <= 3 for a, b in got)
    for xs in groups.values():
        for a, b in zip(xs, xs[1:], strict=False):
            if b - a <= 3:
                reach, stack = {a}, [a]
                while stack:
                    x = stack.pop()
                    for p in got:
                        for y in p if x in p else ():
                            if y not in reach:
                                reach.add(y)
                                stack.append(y)
                assert b in reach
