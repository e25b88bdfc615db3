import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillmerge.llm import simhash


def brute_fp(text, width):
    words = "".join(c.lower() if c.isascii() else c for c in text)
    words = [w for w in words.replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, width, tau):
    fps = [(i, brute_fp(t or "", width)) for i, t in rows]
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(root)
    for n, a in enumerate(values):
        for b in values[:n]:
            if (a ^ b).bit_count() <= tau:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted(((i, f, least.get(find(f))) for i, f in fps), key=repr)


def test_matches_brute_force(docs_of, prose):
    rows = []
    for k in range(30):
        text = prose(k, 80)
        rows.append((100 - k, text))
        words = text.split(" ")
        words[40] = "changed"
        if k % 3 == 0:
            rows.append((200 + k, " ".join(words)))
            rows.append((300 + k, text.upper() if text.isascii() else text))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (100, rows[0][1]), (None, rows[0][1])]
    got = simhash.near_duplicates(docs_of(rows), width=4, tau=4).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == brute_components(rows, 4, 4)


@pytest.mark.parametrize("cell", [simhash.CELL, 8])
def test_links_find_every_pair(spark, cell):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    values = set(base)
    for b in base[:12]:  # dense groups, and skewed bits
        for _ in range(25):
            v = b
            for bit in r.sample(range(64), r.randint(1, 5)):
                v ^= 1 << bit
            values.add(v)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    links = simhash.hamming_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, cell=cell).collect()
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in links:
        assert ((e.src ^ e.dst) % 2**64).bit_count() <= 4
        root[find(e.src)] = find(e.dst)
    for n, a in enumerate(signed):
        for b in signed[:n]:
            if ((a ^ b) % 2**64).bit_count() <= 4:
                assert find(a) == find(b)


def test_thresholds_sum_as_the_pigeonhole_needs():
    co = np.full((64, 64), 250.0)
    np.fill_diagonal(co, 500.0)
    for n in (1000, 10**7):
        plan = simhash.allocate(n, co * n / 1000, 4)
        m = {1: 1}.get(len(plan), None)
        widths = [len(b) for b, _ in plan]
        assert m or sum(widths) <= 64
        # parts left out count -1: with m parts in all the thresholds sum to tau - m + 1
        total = round(64 / max(widths))
        assert sum(t for _, t in plan) - (total - len(plan)) >= 4 - total + 1 - 1


def test_keep_one_and_empty(docs_of):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "quite another text with words"), (1, "a b c d e f")]
    assert sorted(r.doc_id for r in simhash.keep_one(docs_of(rows)).collect()) == [1, 2]
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_a_large_table_shuffles_no_more_rows_a_value(spark, monkeypatch):
    r = np.random.default_rng(4)
    fp = r.integers(1 << 63, size=400, dtype=np.int64)
    values = spark.createDataFrame([(v,) for v in fp.tolist()], "fp long")
    n, co = simhash.bit_statistics(values)
    plans, rows_of = [], simhash._bucket_rows
    monkeypatch.setattr(simhash, "_bucket_rows", lambda plan: plans.append(plan) or rows_of(plan))
    for times in (1, 100, 500, 5000):
        monkeypatch.setattr(simhash, "bit_statistics", lambda _, k=times: (n * k, co * k))
        simhash.hamming_links(values, 10)
    batch = pa.RecordBatch.from_arrays([pa.array(fp)], names=["fp"])
    assert [sum(b.num_rows for b in rows_of(plan)(iter([batch]))) for plan in plans] == [11 * len(fp)] * 4


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)], len({find(x) for x in range(n)})


def bucket(r, groups, size):
    """Distinct values that agree in six bits: lone ones, and groups with up to eight bits changed."""
    lone = r.integers(1 << 64, size=2000, dtype=np.uint64)
    near = np.repeat(lone[:groups], size)
    for _ in range(8):
        near ^= np.uint64(1) << r.integers(64, size=len(near), dtype=np.uint64)
    return r.permutation(np.unique(np.concatenate([lone, near]) & ~np.uint64(63)))


def same(n, one, other):
    (a, k), (b, m) = components(n, one), components(n, other)
    return k == m == len(set(zip(a, b, strict=True)))


@pytest.mark.parametrize(("groups", "size"), [(60, 6), (2, 900)])
def test_partitions_made_in_a_task_find_every_pair(monkeypatch, groups, size):
    every = bucket(np.random.default_rng(6), groups, size)
    i, j = np.nonzero(np.triu(np.bitwise_count(every[:, None] ^ every) <= 10, 1))
    brute = list(zip(i.tolist(), j.tolist(), strict=True))
    assert len(brute) > 100
    monkeypatch.setattr(simhash, "EACH", 100)
    signed = every.view(np.int64)
    at = {v: k for k, v in enumerate(signed.tolist())}
    links = [(at[a], at[b]) for a, b in simhash.spanning(signed, 10)]
    assert all((int(every[a]) ^ int(every[b])).bit_count() <= 10 for a, b in links)
    assert same(len(every), links, brute) and len(links) < 12 * len(every)
    whole = simhash._links_of(np.ones(len(every), bool), np.zeros(len(every)), signed, 10)
    assert same(len(every), [(at[a], at[b]) for a, b in whole], brute)


@pytest.mark.parametrize(("groups", "size"), [(60, 6), (2, 900)])
def test_stored_values_meet_probes_and_probes_do_not_meet(groups, size):
    every = bucket(np.random.default_rng(8), groups, size)
    n_s = len(every) // 2
    i, j = np.nonzero(np.triu(np.bitwise_count(every[:, None] ^ every) <= 10, 1))
    brute = [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < n_s]
    links = simhash.forest(every.view(np.int64), n_s, 10)
    assert all(min(a, b) < n_s for a, b in links) and len(links) <= len(every)
    assert same(len(every), links, brute)
