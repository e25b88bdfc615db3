import pytest

from quillmerge.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))


def brute(rows, min_docs, min_chars):
    docs = {}
    for n, (_, t) in enumerate(rows):
        for x in set(map(key, (t or "").split("\n"))):
            docs.setdefault(x, set()).add(n)
    hot = {x for x, d in docs.items() if len(x) >= min_chars and len(d) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("broadcast", "min_chars"), [(100_000, 1), (0, 1), (100_000, 5)])
def test_drops_what_the_definition_says(docs_of, prose, broadcast, min_chars):
    rows = [(k, f"{prose(k, 3)}\n {'Licence ONE' if k % 2 else 'licence one'}\t\nÉtat\n\n{prose(k % 3, 2)}") for k in range(30)]
    rows += [(5, "again\nlicence one"), (None, "Licence one\nkeep"), (40, None), (41, ""), (42, "\n"), (43, "x" * 50_000 + "\nlicence one\nlicence one")]
    docs = docs_of(rows).selectExpr("*", "1 AS n_lines", "'k' AS keys", "'d' AS doc", "'h' AS hot_keys", "2 AS text_hash", "3 AS key")
    got = line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=min_chars, broadcast_keys=broadcast).collect()
    assert {(r.keys, r.doc, r.hot_keys, r.text_hash, r.key) for r in got} == {("k", "d", "h", 2, 3)}
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=repr) == brute(rows, 10, min_chars)


def test_empty_table(docs_of):
    assert line_dedup.drop_frequent_lines(docs_of([])).count() == 0


def test_runs_settle_and_compact(spark):
    runs = line_dedup.LineRuns(spark, min_docs=4, fanout=2)
    for _ in range(4):
        runs.add(spark.createDataFrame([(bytearray(b"a"), 1), (bytearray(b"b"), 1)], "key binary, n_docs long"))
    runs.add(spark.createDataFrame([(bytearray(b"c"), 4)], "key binary, n_docs long"))
    assert {bytes(r.key) for r in runs.frequent().collect()} == {b"a", b"b", b"c"}
    assert len(runs.levels) > 1
