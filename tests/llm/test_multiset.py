import hashlib
import re

from pyspark.sql import functions as F

from quillmerge.llm import multiset


def test_contract(docs_of, prose, monkeypatch):
    monkeypatch.setattr(multiset, "PER_BUCKET", 7)
    rows = [(k * 2, "\n".join(prose(k * 9 + j, 12) + "." for j in range(6))) for k in range(40)]
    rows += [(90, None), (91, ""), (92, "é"), (93, rows[3][1]), (94, rows[3][1]), (10, rows[5][1]), (95, "x. " * 3000)]
    got = multiset.compare_with_edits(docs_of(rows)).collect()
    ordered = sorted(((i, t) for i, t in rows), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    want = {}
    for n, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(n + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        want.setdefault((i, len(t)), set()).add(hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    assert len(got) == len(rows)
    for r in got:
        assert r.edited_sha256 in want[r.doc_id, r.n_chars]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert len(r.fingerprint) == len(got[0].fingerprint)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[93].fingerprint == by[94].fingerprint == by[6].fingerprint and by[93].near_next == 1
    assert by[90].fingerprint == by[91].fingerprint and by[6].fingerprint != by[8].fingerprint
    long = [r for r in got if r.doc_id < 80]
    assert 0.3 < sum(r.near_edited for r in long) / len(long) < 0.7 and sum(r.near_next for r in long) / len(long) < 0.2
    assert multiset.compare_with_edits(docs_of([])).count() == 0


def test_sums_are_homomorphic(spark):
    a, b = "One line. Two parts\nsecond", "third! x\none more\n"
    rows = [("a", a), ("b", b), ("both", a + "\n" + b), ("turned", "\n".join(reversed((a + "\n" + b).split("\n"))))]
    fp = multiset.with_fingerprints(spark.createDataFrame(rows, "k string, t string"), {"f": "t"}).select("k", "f")
    wide = fp.groupBy().pivot("k", ["a", "b", "both", "turned"]).agg(F.first("f"))
    r = wide.select(
        multiset.as_text(multiset.combine(F.col("a"), F.col("b"))).alias("sum"),
        multiset.as_text(multiset.combine(F.col("both"), F.col("b"), -1)).alias("less"),
        *[multiset.as_text(F.col(c)).alias(c) for c in ("a", "both", "turned")],
    ).first()
    assert r["sum"] == r.both == r.turned and r.less == r.a


def test_sums_hold_beyond_a_lane(spark):
    """Long texts, sums and differences: lanes wrap by themselves, in any order of adding."""
    many = "a b. " * (1 << 20) + "c d. e f.\ng h."
    rows = spark.createDataFrame([("x. y.\nz.", many, many + "\nx. y.\nz.")], "one string, two string, both string")
    fp = multiset.with_fingerprints(rows, {"a": "one", "b": "two", "c": "both"})
    got = fp.select(multiset.combine(F.col("a"), F.col("b")).alias("sum"), multiset.combine(F.col("c"), F.col("a"), -1).alias("less"), "b", "c").first()
    assert got["sum"] == got["c"] and got["less"] == got["b"]


def test_against_plain_sums(spark, prose):
    """Dense lanes and sign lanes from Spark's own hash of each part, summed here."""
    texts = [prose(1, 40).replace(" ", ". ", 9), "one.\none.\n\ntwo! three?", "", None, "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in multiset.with_fingerprints(df, {"f": "t"}).select("i", "f").collect()}
    hashes = {}
    for i, t in enumerate(texts):
        lines, bits = (t or "").split("\n"), [s.strip(" ") for s in re.split(r"[.!?|\n]+", t or "")]
        for seed, parts in [(k, lines) for k in range(multiset.DENSE)] + [(100 + k, [b for b in bits if b]) for k in range(multiset.WORDS)]:
            rows = spark.createDataFrame([(p,) for p in parts] or [(None,)], "p string").where("p is not null").select(F.xxhash64(F.lit(seed), "p").alias("h")).collect()
            hashes[i, seed] = [r.h & (2**64 - 1) for r in rows]
    for i in got:
        dense = [x for k in range(multiset.DENSE) for x in (sum(h & 0xFFFFFFFF for h in hashes[i, k]) % 2**32, sum(h >> 32 for h in hashes[i, k]) % 2**32)]
        lanes = [[sum(h >> (s + multiset.LANE * j) & 1 for h in hashes[i, 100 + k]) % 2**20 for j in range(3)] for k in range(multiset.WORDS) for s in range(multiset.SHIFTS)]
        assert got[i].dense == dense
        assert [[v >> (multiset.LANE * j) & multiset.LANE_MASK for j in range(3)] for v in got[i].signs] == lanes
