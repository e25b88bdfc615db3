import random

import numpy as np
import pytest

import corpus_pipeline
from quillmerge.llm import similar, simhash


def grams(text, width=5):
    words = (text or "").split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows):
    """Groups of row positions over all pairs of exact Jaccard 0.8 or more."""
    own = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def edited(words, r, n):
    words = list(words)
    for at in r.sample(range(len(words)), n):
        words[at] = f"new{r.randint(0, 10**6)}"
    return " ".join(words)


def corpus(prose):
    """Texts with copies on both sides of Jaccard 0.8, and chains of them."""
    r, texts = random.Random(7), []
    for k in range(40):
        words = prose(k, r.randint(60, 260)).lower().split(" ")
        texts.append(" ".join(words))
        texts += [edited(words, r, max(1, len(words) * share // 1000)) for share in (10, 17, 22, 24, 26, 30)]
        texts.append(edited(texts[-1].split(" "), r, max(1, len(words) // 50)))
    return [*texts, None, "", "one two", "one  two"]


def test_stage_keeps_one_of_each_brute_force_group(spark, docs_of, prose):
    rows = list(enumerate(corpus(prose)))
    random.Random(1).shuffle(rows)
    got = corpus_pipeline.drop_copies(spark, docs_of(rows), "")
    groups = brute(rows)
    assert 60 < len(groups) < len(rows) - 60
    assert sorted(r.doc_id for r in got.collect()) == sorted(min(rows[i][0] for i in g) for g in groups)
    assert got.columns == docs_of([]).columns


def test_parts_of_a_large_component_find_the_same(docs_of, prose):
    rows = similar.numbered_rows(docs_of(list(enumerate(corpus(prose)))))
    sets = similar._sets(rows, "text", 5).where("n > 2").dropDuplicates(["set_key"])
    found = []
    for size in (similar.PART_SHINGLES, 100):
        links = similar.jaccard_links(rows, sets, "text", 5, 0.8, size)
        found.append({(r.node, r.component) for r in similar.connected_components(links).collect()})
    assert found[0] == found[1] and found[0]


def test_recall_at_the_threshold():
    """Pairs of Jaccard 0.8 exactly share a band."""
    r = np.random.default_rng(3)
    missed = 0
    for _ in range(2000):
        every = r.integers(1 << 63, size=100, dtype=np.uint64)
        missed += not (similar.bands(np.sort(every[:90])) == similar.bands(np.sort(every[10:]))).any()
    assert missed == 0


@pytest.mark.parametrize("keep", [similar.keep_one, simhash.keep_one])
def test_null_and_repeated_ids_keep_their_texts(docs_of, prose, keep):
    a, b, c, d, e = (prose(k, 60) for k in range(5))
    rows = [(None, a), (None, b), (None, c), (7, d), (7, e), (7, e), (7, d), (9, a), (3, e), (None, None)]
    got = keep(docs_of(rows)).collect()
    assert sorted((r.text or "") for r in got) == sorted([a, b, c, d, e, ""])
    assert {(r.doc_id, r.text) for r in got} == {(9, a), (None, b), (None, c), (7, d), (3, e), (None, None)}
    assert keep(docs_of([])).count() == 0


def test_columns_with_clashing_names_stay(docs_of, prose):
    docs = docs_of([(1, prose(1, 30)), (2, prose(1, 30)), (3, prose(2, 30)), (None, None), (4, "")]).selectExpr("*", "'r' AS row", "7 AS component", "8 AS key", "9 AS n")
    for keep in (similar.keep_one, simhash.keep_one):
        got = keep(docs).collect()
        assert sorted((str(r.doc_id), r.row, r.component, r.key, r.n) for r in got) == [(i, "r", 7, 8, 9) for i in ("1", "3", "4")]
        assert keep(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [similar.PART_SHINGLES, 100])
def test_simhash_links_are_exact_and_join_all_pairs_in_reach(docs_of, prose, size):
    rows = similar.numbered_rows(docs_of(list(enumerate(corpus(prose)))))
    sets = similar._sets(rows, "text", 5).where("n > 2").dropDuplicates(["set_key"]).cache()
    own = {r.row: similar.shingle_set((r.text or "").encode(), 5) for r in rows.collect()}
    fps = {r.row: r.fp for r in sets.collect()}
    assert all(f % 2**64 == simhash.signature(own[row]) for row, f in fps.items())
    links = similar.simhash_links(rows, sets, "text", 5, 0.8, size)
    of = {r.node: r.component for r in similar.connected_components(links).collect()}

    def alike(a, b):
        both = len(np.intersect1d(own[a], own[b]))
        return 5 * both >= 4 * (len(own[a]) + len(own[b]) - both)

    assert all(alike(r.src, r.dst) for r in links.collect())
    pairs = [(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) % 2**64).bit_count() <= similar.TAU and alike(a, b)]
    assert sum(((fps[a] ^ fps[b]) % 2**64).bit_count() > 4 for a, b in pairs) > 20
    assert all(of[a] == of[b] for a, b in pairs)
    sets.unpersist()


@pytest.mark.parametrize("seed", [13827, 201701, 515258])
def test_stage_links_by_simhash_what_shares_no_band(spark, docs_of, seed):
    """Texts of Jaccard 0.8 without a common MinHash band, seven bits apart at most."""
    words = [f"w{seed}x{i}" for i in range(14)]
    a, b = " ".join(words[:12]), " ".join(words)
    x, y = (similar.shingle_set(t.encode(), 5) for t in (a, b))
    assert len(np.intersect1d(x, y)) == 8 and len(np.union1d(x, y)) == 10
    assert not (similar.bands(x) == similar.bands(y)).any()
    got = corpus_pipeline.drop_copies(spark, docs_of([(1, a), (2, b), (3, "some other text")]), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]
