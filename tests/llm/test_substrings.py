import hashlib

import pytest

from quillmerge.llm import substrings


def brute(rows, length):
    """By the definition: every window against all windows of smaller ids."""
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in data:
        gone = [False] * len(b)
        if i is not None:
            for k in range(len(b) - length + 1):
                if least[b[k : k + length]] < i:
                    gone[k : k + length] = [True] * length
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, kept))
    return sorted(out, key=repr)


def rows_of(prose):
    passage, other = prose(1, 30), prose(2, 25)
    rows = [(k, prose(10 + k, 60)) for k in range(12)]
    rows[3] = (3, prose(50, 10) + " " + passage + " " + prose(51, 10))
    rows[5] = (5, passage + prose(52, 5) + other)
    rows[7] = (7, other + " x " + passage + other)  # twice in one text
    rows[8] = (8, rows[2][1])  # a copy
    rows[9] = (9, rows[2][1])
    rows += [(2, rows[2][1]), (2, passage), (None, passage), (20, None), (21, ""), (22, "a" * 200), (23, "b" + "a" * 120), (24, "short")]
    return rows


@pytest.mark.parametrize("hot", [substrings.HOT_SEGMENTS, 1])
def test_removes_what_the_definition_says(docs_of, prose, hot):
    rows = rows_of(prose)
    got = substrings.remove_repeats(docs_of(rows), length=50, hot_segments=hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == brute(rows, 50)


def test_empty_table(docs_of):
    assert substrings.remove_repeats(docs_of([])).count() == 0


def test_anchors_cover_all_windows_and_agree(prose):
    text = prose(3, 200).encode()
    h, first, last = substrings.anchors(text, 50)
    assert first[0] == 0 and last[-1] == len(text) - 50
    assert (first[1:] == last[:-1] + 1).all()
    again = substrings.anchors(b"q" * 13 + text, 50)
    assert set(h.tolist()) <= set(again[0].tolist()) | {h[0]}


def test_query(spark, tmp_path, docs_of, prose):
    from quillmerge.llm import queries

    rows = rows_of(prose)
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op7_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {(i, n, g, s, hashlib.sha256(k).hexdigest()) for i, n, g, s, k in brute(rows, 50)}


def test_one_line_very_often_in_two_documents(docs_of, prose):
    """A line a hundred thousand times in two documents is a few distinct segments."""
    line = "this very line comes again and again in the text " * 2
    rows = [(1, prose(1, 40) + line * 100_000), (2, line * 100_000 + prose(2, 40)), (3, prose(3, 40) + "z" * 30_000), (4, "z" * 20_000)]
    got = {r.doc_id: r for r in substrings.remove_repeats(docs_of(rows), hot_segments=1000).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 0
    assert got[2].n_spans == 1 and len(line) * 100_000 <= got[2].n_removed < len(line) * 100_000 + 50
    assert (got[4].n_removed, got[4].n_spans, bytes(got[4].kept)) == (20_000, 1, b"")


@pytest.mark.parametrize("unit", ["a", "abcdefg hij"])
def test_long_repetitive_texts_in_bounded_memory(unit):
    """Two texts of 16 MB of one unit, through the steps of a task: under 1 GB, and in the end nothing of the second is left."""
    import subprocess
    import sys

    code = f"""
import resource
import numpy as np
import pyarrow as pa
from quillmerge.llm import substrings as s
n = 16 << 20
unit = {unit!r}
group = pa.table({{"grp": pa.array([0, 0], pa.int32()), "doc": [1, 2], "copy": [False, False], "text": [unit * (n // len(unit)), unit * (n // len(unit) - 7)]}})
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
listed = s._list_anchors(50, 1)(group)
shared = s._shared_anchors(s.HOT_SEGMENTS)(listed)
cut = s._cut_segments(50)(group, shared)
assert cut.num_rows <= 2 * len(unit), cut.num_rows
hot = cut.filter(pa.compute.equal(cut.column("hot"), True))
told = hot.drop_columns(["high", "segment"]).append_column("begins", pa.array([[]] * hot.num_rows, pa.list_(pa.int32()))).append_column("ends", pa.array([[]] * hot.num_rows, pa.list_(pa.int32())))
out = s._remove(50)(group, told).to_pylist()
assert [(r["n_removed"], len(r["kept"])) for r in out] == [(0, len(group["text"][0].as_py())), (len(group["text"][1].as_py()), 0)], [(r["n_removed"], len(r["kept"])) for r in out]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", "import pyarrow.compute\n" + code], capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 1000
