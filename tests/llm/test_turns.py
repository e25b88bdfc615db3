"""Conversation repair against a shortest-path search over whole edit strings."""

import hashlib
import heapq
import random
import zlib

import pytest

from quillmerge.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def least(symbols):
    """Dijkstra by (cost, edits): symbols are (initial, must_go, truncated)."""
    heap, done = [(0, "", 0, "^")], set()
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if i == len(symbols) and state in "^a":
            return cost, edits
        if (i, state) in done:
            continue
        done.add((i, state))
        new = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 5, edits + "I", i, new))
        if i < len(symbols):
            initial, must_go, truncated = symbols[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state))
            if not must_go:
                if state + initial in ("^s", "^u", "su", "ua", "au"):
                    heapq.heappush(heap, (cost + 5 * truncated, edits + "K", i + 1, initial))
                heapq.heappush(heap, (cost + 1 + 5 * truncated, edits + "R", i + 1, new))


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else text.translate({ord(c): None for c in ".!?"}) if draw == 2 else text
        mine += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        seen, symbols, blank, double, cut = set(), [], 0, 0, 0
        for _, role, text in mine:
            bare, again = not text.strip(BLANK), (role, text) in seen
            seen.add((role, text))
            truncated = not bare and not again and text.strip(BLANK)[-1] not in ".!?"
            blank, double, cut = blank + bare, double + (again and not bare), cut + truncated
            symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "x", bare or again, truncated))
        cost, edits = least(symbols)
        lines, i, state = [], 0, ""
        for e in edits:
            if e == "K":
                state = mine[i][1]
                lines.append(f"{state}:{mine[i][2]}")
            elif e in "RI":
                state = "assistant" if state[:1] == "u" else "user"
                lines.append(f"{state}:{mine[i][2] if e == 'R' else ''}")
            i += e != "I"
        at = {t for t, *_ in mine if t is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))
        out[conv] = (max(at) - min(at) + 1 - len(at) if at else 0, blank, double, cut, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(spark, rows):
    own = turns.damaged(spark.createDataFrame(rows, SCHEMA))
    made, _ = turns.repair(own)
    got = turns.digests(own, made).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_search_finds_the_least_of_the_cheapest():
    r = random.Random(3)
    for _ in range(3000):
        symbols = [(r.choice("ssuuuaaax"), r.random() < 0.15, r.random() < 0.2) for _ in range(r.randint(0, 9))]
        codes = bytes(4 * (2 if gone else int(cut)) + "suax".index(c) for c, gone, cut in symbols)
        assert turns.cheapest(codes) == least(symbols)
        assert turns.cheapest(codes, block=r.randint(1, 4)) == least(symbols)


@pytest.mark.parametrize("n", [33, 200, 3000])
def test_long_conversations_block_by_block(n):
    r = random.Random(n)
    symbols = [(r.choice("ua" * 8 + "sx") if r.random() < 0.3 else "ua"[i % 2], r.random() < 0.1, r.random() < 0.1) for i in range(n)]
    codes = bytes(4 * (2 if gone else int(cut)) + "suax".index(c) for c, gone, cut in symbols)
    assert turns.cheapest(codes) == least(symbols)


def test_conversations_against_brute_force(spark):
    r = random.Random(1)
    texts = ["Yes.", "No!", "Why?", "cut", "dot . \n", "", "  ", "\t", None, "ünï", "a\nb", "long " * 20, "x. y"]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(r.randint(1, 8)):
            turn = None if r.random() < 0.05 else turn + 3 * (r.random() < 0.1)
            role = r.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "Über"]) if r.random() < 0.5 else ["user", "assistant"][(turn or 0) % 2]
            rows.append((conv, turn, role, r.choice(texts)))
    rows += [(500, k, ["user", "assistant"][k % 2], f"turn {k}" + "." * (k % 5 > 0)) for k in range(400)] + [(501, 7, "user", "again.")] * 5
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone"))
    want = brute(rows)
    got = result(spark, rows)
    assert got == want
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table_and_other_columns(spark):
    assert not result(spark, [])
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Bye.")]
    plain = spark.createDataFrame(rows, SCHEMA)
    wide = plain.selectExpr("*", "1 AS copy", "2 AS dropped", "'x' AS audit", "3 AS code", "4 AS what")
    made, fixed = turns.repair(turns.intact(wide))
    assert [(r.audit, r.cost) for r in made.collect()] == [("KKD", 2)]
    assert [(r.place, r.turn, r.role, r.text, r.edit) for r in fixed.orderBy("place").collect()] == [(0, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Hello.", "K")]


def test_very_long_text(spark):
    rows = [(1, 0, "user", "a" * 4_000_000 + "."), (1, 1, "assistant", "b" * 4_000_000)]
    assert result(spark, rows) == brute(rows)
