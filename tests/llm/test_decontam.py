import numpy as np
import pytest

from quillmerge.llm import decontam


def brute(rows, items, width, overlap):
    """Every passage of every text against every item, without an index; an item's passages follow its own length."""
    own = {i: decontam.as_item(i, (t or "").encode(), None, width) for i, t in items}
    own = {i: x for i, x in own.items() if x.words}
    out = set()
    for doc, text in rows:
        words = decontam.words_of((text or "").encode())
        for i, x in own.items():
            size = 1
            while size < len(x.words):
                size *= 2
            for a in range(0, max(1, len(words) - size), size):
                passage = words[a : a + 2 * size]
                share = []
                for part in (x.question, x.answer):
                    runs = {k: set(decontam.shingles(passage, k)) for k in {len(s) for s in part}}
                    share.append(sum(s in runs[len(s)] for s in part) / len(part) if part else 1.0)
                if words and min(share) >= overlap:
                    out.add((doc, i))
    return out


def test_finds_what_brute_force_finds(spark, docs_of, prose):
    items = [(k, prose(900 + k, 15 + 2 * k)) for k in range(25)] + [(30, "short one"), (31, ""), (32, None), (30, "short one")]
    rows = [(k, prose(k, 150)) for k in range(40)]
    for k in range(0, 20, 2):
        words = items[k][1].split(" ")
        if k % 4 == 0:
            words[len(words) // 2] = "swapped"
        rows[k] = (k, prose(k, 70) + " " + " ".join(words).upper() + "!! " + prose(k + 1, 33))
    rows += [(50, None), (51, ""), (52, "a short one here"), (None, items[3][1]), (3, items[5][1]), (53, " ".join(items[7][1].split(" ")[: len(items[7][1].split(" ")) // 2]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(docs_of(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(rows, items, 5, 0.8)
    # one swapped word breaks 5 of the 43 shingles of item 16, and 5 of the 11 of item 0
    assert {(16, 16), (2, 2), (52, 30), (None, 3)} <= {(r.doc_id, r.item_id) for r in got} and (0, 0) not in {(r.doc_id, r.item_id) for r in got}
    left = {r.doc_id for r in decontam.drop_leaks(docs_of(rows), bench).collect()}
    assert 2 not in left and 1 in left and 50 in left


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_shards_and_other_items_change_nothing(spark, docs_of, prose, monkeypatch, shards):
    """Items of 10, 30 and 500 words; one of 14 in two pieces 60 words apart, which no passage of its own holds."""
    monkeypatch.setattr(decontam, "_shards", lambda items: list(range(shards)))
    items = [(k, prose(900 + k, (10, 30, 500)[k % 3])) for k in range(9)] + [(20, prose(950, 14))]
    rows = [(k, prose(k, 40) + " " + items[k][1]) for k in range(9)] + [(9, "clean"), (None, None), (None, "clean too"), (None, items[1][1])]
    apart = items[9][1].split(" ")
    rows += [(30, " ".join(apart[:9]) + " " + prose(3, 60) + " " + " ".join(apart[5:])), (30, items[9][1])]
    docs, bench = docs_of(rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(docs, bench)
    want = brute(rows, items, 5, 0.8)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want == {(k, k) for k in range(9)} | {(None, 1), (30, 20)}
    kept = decontam.drop_leaks(docs.selectExpr("*", "1 AS row"), bench)
    assert kept.columns == [*docs.columns, "row"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(9, "clean"), (None, None), (None, "clean too"), (30, rows[13][1])], key=str)


def test_very_long_text(spark, docs_of, prose):
    items = [(1, prose(901, 30)), (2, prose(902, 300))]
    many = " ".join(prose(k, 1000) for k in range(300))
    rows = [(1, many + " " + items[1][1] + " " + many), (2, many), (3, "x" * 3_000_000)]
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()} == {(1, 2)}


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs_of([(1, "a b c")]), none).count() == 0
    assert decontam.find_leaks(docs_of([]), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).count() == 0


def test_an_edited_item_is_judged_whole(spark, docs_of, prose):
    """One changed word anywhere leaves 0.8 of a long item's shingles: also in what was cut off as its answer."""
    items = [(k, prose(900 + k, 36)) for k in range(4)]
    rows, share = [], {}
    for k, text in items:
        for at in range(36):
            words = text.split(" ")
            words[at] = "swapped"
            own = [set(decontam.shingles(decontam.words_of(t.encode()), 5)) for t in (text, " ".join(words))]
            share[100 * k + at, k] = len(own[0] & own[1]) / len(own[0])
            rows.append((100 * k + at, prose(at, 50) + " " + " ".join(words) + " " + prose(at + 50, 50)))
    got = decontam.find_leaks(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {x for x, v in share.items() if v >= 0.8} and len(got) > 130
    assert all(abs(r.question_overlap - share[r.doc_id, r.item_id]) < 1e-9 for r in got)


def test_answers_of_their_own_are_asked_for(spark, docs_of, prose):
    items = [(1, prose(901, 30), prose(902, 8))]
    rows = [(1, items[0][1]), (2, items[0][1] + " " + items[0][2]), (3, items[0][2])]
    got = decontam.find_leaks(docs_of(rows), spark.createDataFrame(items, "item_id long, text string, answer string"), answer_col="answer")
    assert [r.doc_id for r in got.collect()] == [2]


def test_closed_blocks_are_not_scored(prose):
    """A passage of one item opens few of a large index's blocks, and scores what a full search scores."""
    from collections import Counter

    items = [decontam.as_item(k, prose(900 + k, 30).encode(), None, 5) for k in range(400)]
    df = Counter(w for x in items for w in set(x.words))
    index = decontam.Index(items, df, len(items), 30.0, 0.8)
    (shelf,) = index.shelves
    docs = [decontam.words_of(f"{prose(k, 40)} {prose(900 + k, 30)} {prose(k + 1, 40)}".encode()) for k in range(20)]
    found = index.leaks(docs, 5)
    assert [{index.items[j].item_id for j in x} for x in found] == [{k} for k in range(20)]
    passages = sum(max(1, -(-(len(d) - 32) // 32)) for d in docs)
    assert 20 <= shelf.scored < passages * len(items) / 100
    assert shelf.pivots < passages * len(items) / 10
    # against plain BM25 over every item
    weight = [{w: float(v) for w, v in _impacts(x, df, len(items)).items()} for x in items]
    ids = np.array([index.term.get(w, -1) for w in docs[3]], np.int64)
    hits = {(int(w), index.items[j].item_id): s for w, j, s in shelf.search(ids, np.array([0]), np.array([len(ids)]))}
    scores = {x.item_id: sum(v for w, v in weight[x.item_id].items() if w in set(docs[3])) for x in items}
    limit = {x.item_id: index.threshold[j] for j, x in enumerate(index.items)}
    assert {i for _, i in hits} == {i for i, s in scores.items() if s >= limit[i]}
    assert all(abs(s - scores[i]) < 1e-9 for (_, i), s in hits.items())


def test_every_item_over_its_threshold_is_retrieved():
    """Random passages of few words, so that pivots, shut blocks and scored items all occur: the same as scoring everything."""
    import random
    from collections import Counter

    r = random.Random(5)
    words = [f"w{i}".encode() for i in range(60)]
    draw = lambda n: b" ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    items = [decontam.as_item(k, draw(r.choice([3, 6, 12, 25])), None, 5) for k in range(150)]
    df = Counter(w for x in items for w in set(x.words))
    index = decontam.Index(items, df, len(items), 12.0, 0.5)
    index.threshold *= 0.6
    for shelf in index.shelves:
        shelf.__init__(shelf.items, index.term, [_impacts(x, df, len(items), 12.0) for _, x in shelf.items], np.array([index.threshold[j] for j, _ in shelf.items]), 4)
        text = draw(2000).split()
        ids = np.array([index.term.get(w, -1) for w in text], np.int64)
        first = np.arange(0, 1990, 10)
        got = {(w, j): s for w, j, s in shelf.search(ids, first, first + 10)}
        want = {}
        for w, a in enumerate(first.tolist()):
            for j, (k, x) in enumerate(shelf.items):
                score = sum(v for t, v in _impacts(x, df, len(items), 12.0).items() if t in set(text[a : a + 10]))
                if score and score >= index.threshold[k]:
                    want[w, j] = score
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
        assert want and shelf.skips and shelf.scored


def _impacts(item, df, n, mean=30.0):
    from collections import Counter

    norm = decontam.K1 * (1 - decontam.B + decontam.B * len(item.words) / mean)
    return {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (decontam.K1 + 1) / (f + norm) for w, f in Counter(item.words).items()}


def test_ids_of_any_type_and_other_columns(spark, docs_of, prose):
    items = spark.createDataFrame([("q-1", prose(901, 30), 1), (None, prose(902, 30), 2)], "item_id string, text string, doc_id int")
    docs = docs_of([(1, prose(901, 30)), (1, prose(902, 30)), (1, "clean")]).selectExpr("*", "'x' AS item_id", "1 AS score", "2 AS leaked")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()} == {(1, "q-1"), (1, None)}
    kept = decontam.drop_leaks(docs, items)
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == ["clean"]
