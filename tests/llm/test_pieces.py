import random

import numpy as np
import pyarrow as pa
import pytest

from quillmerge.llm import pieces


@pytest.fixture(scope="module")
def table():
    from quillmerge.llm.queries import PIECES, vocabulary

    return pieces.Pieces.load(vocabulary(PIECES))


def brute(table, word):
    """Plain Viterbi, one word at a time."""
    known = {s: (table.scores[i], int(table.ids[i])) for i, s in enumerate(table.points)}
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        found = []
        for start in range(max(0, end - table.longest), end):
            s = word[start:end]
            if s in known:
                found.append((best[start][0] + known[s][0], -start, [known[s][1]]))
            elif end - start == 1:
                found.append((best[start][0] + table.unknown, -start, [int(b) for b in table.byte_ids[list(s.encode())]]))
        top = max(found, key=lambda x: (x[0], x[1]))
        best.append((top[0], best[-top[1]][1] + top[2]))
    return best[-1][1]


def test_batched_search_is_viterbi(table, prose):
    words = prose(1, 300).split(" ") + ["▁" + w for w in prose(2, 200).split(" ")] + ["日本語", "a\nb", "▁▁▁", "\U0001f600x", "ß", "a" * 64]
    got = table.encode_words(words)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [brute(table, w) for w in words]


TEXTS = ["", "plain words", "  two  blanks ", "a▁b", "▁", "tab\tand\nline\r\n", "日本語 \U0001f600 é", "x" * 5000, " ", "a ▁ b", "\x00\x7f", "no end. ", "▁▁ ▁", "    if x:\n        return  [1,  2]"]


def decoded(table, ids, sizes):
    body, n = table.decode_all(ids, sizes)
    ends = np.cumsum(n)
    return [body[b - k : b].tobytes().decode() for b, k in zip(ends.tolist(), n.tolist(), strict=True)]


@pytest.mark.parametrize("bound", [500_000, 1])
def test_round_trip_is_exact(table, bound):
    coder = pieces.Encoder(table, most_words=bound)
    for batch in (TEXTS, random.Random(2).sample(TEXTS, 8)):
        ids, sizes = coder(pa.array(batch))
        assert decoded(table, ids, sizes) == batch
    assert decoded(table, *coder(pa.array([], pa.string()))) == []


def test_whole_texts_are_viterbi(table, prose):
    """Runs of blanks, lines, leading and trailing blanks: cutting into words loses nothing."""
    texts = [prose(k, 60) for k in range(5)] + ["  " + prose(9, 20).replace(" ", "  ") + "   ", prose(10, 30).replace(" ", "\n"), "a  b   c", "x = [1,  2,\n     3]", *(t for t in TEXTS if "▁" not in t)]
    ids, sizes = pieces.Encoder(table)(pa.array(texts))
    ends = np.cumsum(sizes)
    assert [ids[b - n : b].tolist() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)] == [brute(table, "▁" + t.replace(" ", "▁")) if t else [] for t in texts]


def test_frame(docs_of, table):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(99, None), (0, "again"), (None, "no id")]
    docs = docs_of(rows).selectExpr("*", "'x' AS ids", "1 AS decoded")
    got = pieces.round_trip(docs, table).collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    assert {r.n_pieces for r in got if r.doc_id == 99} == {0}
    assert pieces.round_trip(docs_of([]), table).count() == 0
    two = pieces.decode(pieces.encode(docs, table), table).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in two) == sorted((str(i), t or "") for i, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in two) == sorted((str(r.doc_id), r.ids) for r in got)


@pytest.mark.parametrize("block", [pieces.BLOCK, 37])
def test_long_words_are_searched_whole(table, prose, monkeypatch, block):
    """No piece border every 64 characters: lines, lists, links and texts without blanks."""
    monkeypatch.setattr(pieces, "BLOCK", block)
    words = ["x" * 65, "a\nb\t" * 400, prose(3, 300).replace(" ", "\n"), "https://example.org/" + prose(4, 60).replace(" ", "/"), "日本語😀x" * 50, "▁" * 200]
    assert [np.frombuffer(x, "<i4").tolist() for x in table.encode_words(words)] == [brute(table, w) for w in words]
