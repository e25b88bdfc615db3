import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillmerge.llm import lm


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def brute(rows):
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    pairs = Counter(x for i, t in rows if not held(i) for x in zip([None, *words(t)], words(t)))
    out = []
    for i, t in rows:
        ws = words(t)
        quantised = [2 ** math.floor(math.log2(pairs[x])) if pairs[x] else 0 for x in zip([None, *ws], ws)]
        model = sum(math.log10((min(q, c[u]) + lm.MU * p(w)) / (c[u] + lm.MU)) for q, u, w in zip(quantised, [None, *ws], ws))
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(p(w)) for w in ws), model))
    return out


@pytest.mark.parametrize("pass_bytes", [lm.PASS_BYTES, 200])
def test_matches_exact_counts(docs_of, prose, pass_bytes):
    rows = [(k, prose(k % 25, 60)) for k in range(60)] + [(100, None), (101, ""), (102, "A a\ta"), (3, prose(3, 60)), (None, "x y"), (103, "z" * 5000)]
    got = lm.score_held_out(docs_of(rows), pass_bytes=pass_bytes).collect()
    want = sorted(brute(rows), key=lambda r: (r[0] is None, r[0] or 0))
    got = sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert np.allclose([r.base_score for r in got], [w[5] for w in want])
    # false positives of the filter raise a few counts
    model, exact = np.array([r.score for r in got]), np.array([w[6] for w in want])
    assert (model >= exact - 1e-6).all() and np.median(model - exact) < 0.02 * abs(np.median(exact))


def test_filter_finds_levels():
    r = np.random.default_rng(1)
    keys, counts = np.unique(r.integers(1, 2**63, 5000).astype(np.uint64)), None
    counts = r.integers(1, 300, len(keys))
    bits = np.frombuffer(lm.build_segment(keys, counts), np.uint8)
    found = lm.probe(bits, keys)
    assert (found >= lm.levels(counts)).all() and (found > lm.levels(counts)).mean() < 0.05
    assert (lm.probe(bits, r.integers(1, 2**63, 5000).astype(np.uint64)) > 0).mean() < 0.05
    assert (lm.count_of(lm.levels(counts)) <= counts).all()


def test_empty_table(docs_of):
    assert lm.score_held_out(docs_of([])).count() == 0
