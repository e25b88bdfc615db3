import random

import numpy as np
import pytest

from quillmerge.llm import toxicity

SMALL = toxicity.Settings(sample_docs=200, epochs=3, few=1500)


def rows_of(prose, n, seed=0):
    r, out = random.Random(seed), []
    for k in range(n):
        words = prose(seed + k, 90).split(" ")
        if k % 4 == 0:
            for _ in range(6):
                words[r.randrange(len(words))] = r.choice(["vilething", "badword", "vilestuff"])
        out.append((k, " ".join(words), int(k % 4 == 0)))
    return out


@pytest.fixture(scope="module")
def model(prose):
    return toxicity.train([(t.encode(), y) for _, t, y in rows_of(prose, 240)], SMALL)


def test_held_out_accuracy(model, prose):
    test = rows_of(prose, 120, seed=5000)
    p = toxicity.Scorer(model)([t.encode() for _, t, _ in test])
    y = np.array([y for *_, y in test])
    assert ((p >= 0.5) == y).mean() > 0.9


def test_both_forward_passes_agree(model, prose):
    scorer = toxicity.Scorer(model)
    rows = scorer._rows([prose(1, 500).encode()])[0]
    at = np.arange(8)[None, :] * 28 + np.arange(SMALL.window)[:, None]
    k, gates = 3 * SMALL.hidden, scorer.gate[rows[at]]
    slow = model.logits({"f": gates[..., :k], "b": gates[..., k:]}, np.ones(at.shape, np.float32))
    assert np.allclose(slow, scorer._whole(rows[at]), atol=1e-4)


def test_gradients_match_differences(prose):
    s = toxicity.Settings(dim=3, hidden=2, attention=2, window=5)
    m = toxicity.Model.fresh(s, {b"a": 1})
    words = [b"", b"a", b"bb", b"ccc"]
    ids, tri, head = toxicity.features(words, m.known, s)
    told, r = m.told(head), np.random.default_rng(0)
    at, mask, y = r.integers(0, 4, (5, 3)), np.ones((5, 3), np.float32), np.array([1.0, 0, 1], np.float32)
    mask[3:, 1] = 0
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}

    def loss():
        vec = m.inputs(ids, tri, told)[at].astype(np.float64)
        z = m.logits({d: vec @ m.p[f"W{d}"] + m.p[f"c{d}"] for d in "fb"}, mask)
        return np.mean(np.logaddexp(0, z) - y * z)

    g = m.gradients(at, ids, tri, told, mask, y, 1.0)
    for name in ("Wf", "Ub", "cb", "A", "v", "o", "o0"):
        flat = m.p[name].reshape(-1)
        i = int(r.integers(len(flat)))
        keep, step = flat[i], 1e-3
        flat[i] = keep + step
        up = loss()
        flat[i] = keep - step
        down = loss()
        flat[i] = keep
        assert abs((up - down) / (2 * step) - g[name].reshape(-1)[i]) < 2e-3, name


def test_every_window_counts_and_edges(model):
    scorer = toxicity.Scorer(model, most_words=5)
    clean = b"the quiet words of a plain text go on " * 40
    last = clean + b"badword vilething badword vilestuff badword"
    p = scorer([b"", clean, last, b"badword", b"x" * 10_000])
    assert ((p >= 0) & (p <= 1)).all() and p[2] > p[1] and p[3] > p[0]
    starts = toxicity.window_starts(1000, SMALL)
    assert starts[0] == 0 and starts[-1] == 1000 - SMALL.window and np.diff(starts).max() <= SMALL.stride < SMALL.window


def test_frames(spark, docs_of, prose):
    rows = rows_of(prose, 60)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(999, 1), (3, None)], "doc_id long, toxic int")
    docs = docs_of([(k, t) for k, t, _ in rows] + [(None, "no id"), (70, None), (71, ""), (5, "again")]).withColumnRenamed("source", "score")
    model = toxicity.fit(docs, labels, SMALL)
    got = toxicity.score(docs.selectExpr("doc_id", "text", "lang AS label"), model).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 for r in got)
    untrained = toxicity.fit(docs, labels.where("toxic = 0"), SMALL)
    assert {r.score < 0.5 for r in toxicity.score(docs.select("doc_id", "text"), untrained).collect()} == {True}
    assert toxicity.score(docs_of([]).select("doc_id", "text"), model).count() == 0


def test_long_words_are_seen_whole():
    """Words that share 24 bytes differ, a text without blanks is scored to its end, other marks part words too."""
    a, b = (toxicity.words_of(("x" * 24 + tail).encode()) for tail in ("kind", "vile"))
    assert a != b and all(len(w) <= toxicity.PART for w in a + b)
    long = "".join(f"{k:05d}" for k in range(200))
    parts = toxicity.words_of(long.encode())
    assert long.encode() == b"".join(w[: toxicity.HOP] for w in parts[:-1]) + parts[-1]
    assert toxicity.words_of("One\u2014two\u3000three\u2026four\u00a0\u00bfcinco?".encode()) == [b"one", b"two", b"three", b"four", b"cinco"]
    assert toxicity.words_of("na\u00efve e\u0301t\u00e9".encode()) == ["na\u00efve".encode(), "e\u0301t\u00e9".encode()]


def test_any_run_of_half_a_window_lies_in_one():
    s = toxicity.Settings()
    for n in (40, 41, 59, 60, 61, 333):
        starts = toxicity.window_starts(n, s)
        assert all(any(i <= k and k + s.window // 2 <= i + s.window for i in starts.tolist()) for k in range(n - s.window // 2 + 1))


def plain_logit(model, words):
    """One window, word by word, gate by gate."""
    s, p = model.s, model.p
    ids, tri, head = toxicity.features(words or [b""], model.known, s)
    x = []
    for i, t, h in zip(ids, tri, head, strict=True):
        held = [p["char"][b].astype(float) for b in t if b >= 0]
        v = p["word"][i].astype(float) + (np.mean(held, axis=0) if held else 0)
        v[0] += 0.4 * max([0.0 if b < 0 else float(model.telling[b]) for b in h])
        x.append(v)
    k, sides = s.hidden, {}
    for d in "fb":
        h, out = np.zeros(k), []
        for v in x if d == "f" else x[::-1]:
            g, u = v @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
            z, r = (1 / (1 + np.exp(-(g[a : a + k] + u[a : a + k]))) for a in (0, k))
            h = (1 - z) * np.tanh(g[2 * k :] + r * u[2 * k :]) + z * h
            out.append(h)
        sides[d] = out if d == "f" else out[::-1]
    states = np.concatenate([sides["f"], sides["b"]], axis=1)
    e = np.tanh(states @ p["A"]) @ p["v"]
    w = np.exp(e - e.max())
    return (states * (w / w.sum())[:, None]).sum(axis=0) @ p["o"] + p["o0"][0]


def test_scores_are_the_highest_of_all_windows_word_by_word(prose):
    r = random.Random(5)
    rows = [((prose(k, r.randint(1, 120)) + (" vile rotten" if k % 3 == 0 else "")).encode(), int(k % 3 == 0)) for k in range(60)]
    model = toxicity.train(rows, SMALL)
    texts = [t for t, _ in rows[:12]] + [b"", ("x" * 90).encode(), "naïve — café".encode()]
    got = toxicity.Scorer(model).logits(texts)
    for text, x in zip(texts, got.tolist(), strict=True):
        words = toxicity.words_of(text)
        want = max(plain_logit(model, words[i : i + SMALL.window]) for i in toxicity.window_starts(len(words), SMALL).tolist())
        assert abs(x - want) < 1e-3
