"""The Merkle manifest against a tree built from sorted lists."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmerge.llm import merkle
from quillmerge.llm.queries import merkle_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """(root, for each node its siblings as (left, right) by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i - i % 3
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    placed, subroots = {}, []
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = tree([leaf(r) for r in mine])
        placed[s], subroots = (mine, paths, top), [*subroots, top]
    root, above = tree(subroots)
    out = []
    for s, up in zip(order, above, strict=True):
        mine, paths, subroot = placed[s]
        for r, path in zip(mine, paths, strict=True):
            claimed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                claimed = (r[0], r[1].replace("\n", ""), *r[2:])
            folded = leaf(claimed)
            for left, right in path + up:
                folded = h(left, folded, right)
            out.append((r[0], leaf(r), subroot, root, h(*[x for pair in path + up for x in pair]), folded, folded == root))
    return sorted(out, key=str)


def found(spark, rows, step=merkle.LEVELS):
    df = merkle_audit(spark.createDataFrame(rows, SCHEMA), step)
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=str)


def made(n, seed=0, ids=None):
    r = random.Random(seed)
    ids = ids or r.sample(range(-200_000, 200_000), n)
    return [(i, r.choice(["a\nb", "x", None, "", "ünï\n\n"]) , r.choice(["en", None]), r.choice(["s", "s", "s", "t", "", None, "ü", "z" * 50]), r.choice([None, 7])) for i in ids]


def test_whole_tree_against_brute_force(spark):
    rows = made(1500)
    assert found(spark, rows) == brute(rows)


def test_blocks_in_tiers(spark):
    """Blocks of nine leaves: four tiers for the largest group, and groups that end in each."""
    r = random.Random(4)
    rows = [(k * 7 % 5000, f"t{k}\n", "en", "big", k) for k in range(800)] + [(k, "x", "en", f"m{k % 5}", k) for k in range(50)] + [(k, "y", None, f"single{k}", None) for k in range(100)]
    r.shuffle(rows)
    assert found(spark, rows, step=2) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = made(200, 1) + made(60, 2, [5] * 60) + made(40, 3, [None] * 40) + made(30, 4, [70_000, 70_001] * 15) + made(3, 5, [2**62, -(2**62), 2**63 - 1])
    rows += [rows[0]] * 5 + [(5, "same", "en", "s", 4)] * 20
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_small_tables(spark, n):
    rows = [(k, "a\nb", "en", None, 3) for k in range(n)]
    assert found(spark, rows) == (brute(rows) if n else [])


def test_other_columns_and_long_text(spark):
    docs = spark.createDataFrame([(1, "a" * 5_000_000, "en", "s", 3), (2, None, None, "s", None)], SCHEMA)
    wide = docs.selectExpr("*", "1 AS g", "2 AS row", "3 AS levels", "'x' AS path", "4 AS place")
    got = {r.doc_id: r for r in merkle.manifest(wide, merkle.leaf(F.col("text")), id_col="doc_id", group_col="source").collect()}
    one, two = h(f"{5_000_000}:" + "a" * 5_000_000), h("-")
    assert (got[1].leaf, got[2].leaf, got[1].root) == (one, two, h(one, two))
    assert all(r.folded_root == r.root == r.subroot for r in got.values())
    assert got[1].path == f"|{two}" and got[2].path == f"{one}|"


def test_ranks_in_bitmaps():
    r = np.random.default_rng(0)
    for n in (1, 5, 255, 256, 3000, 4096):
        low = np.sort(r.choice(1 << merkle.CHUNK_BITS, n, replace=False))
        words = merkle.unpack(merkle.pack(low))
        assert (merkle.ids_of(words) == low).all()
        asked = r.integers(0, 1 << merkle.CHUNK_BITS, 1000)
        assert (merkle.rank(words, asked) == np.searchsorted(low, asked)).all()
