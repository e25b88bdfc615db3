"""Repair of conversation structure by iterative-deepening A*.

A conversation should read ``(s?(ua)+)?``: at most one system turn, then user and
assistant in turn.  Rows have faults (blank, duplicate, truncated), and edits have
costs; the cheapest sequence of edits is wanted, of equal ones the least in ASCII.

* Faults are found by Spark expressions; duplicates by a window over equal rows, so
  texts of one conversation never meet for it.
* What the search needs of a row is one byte.  The bytes of a conversation, in order,
  are searched depth first in ASCII order of the edits, under a bound that rises to
  the least cost not yet refuted.  A table keeps what a failed state has refuted, so
  it is not entered again with as little budget; the first accepting path is the answer.
* A conversation of more than ``BLOCK`` rows is searched block by block: from the last
  block to the first, the same search tells what each state costs from there on, and
  from the first to the last it finds the path.  Edits of a block end with its last
  row, so no block's path is the beginning of another and the least stays the least.
* Texts stream past their conversation's edits, one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmerge.llm.arrow import give_back
from quillmerge.sources.scratch import materialise

#: Cost of each edit; what an undeleted truncated row costs besides.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: ASCII blanks, as in ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows that one search takes on.
BLOCK = 32
#: Roles by their initials, in the order of their numbers; others are 3.
INITIALS, ROLES = "sua", {2: "user", 3: "assistant"}
FINE, CUT_OFF, GONE = range(3)
START, SYSTEM, USER, ASSISTANT = range(4)
#: Which state a row's initial leads to.
STEPS = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
#: Where the whole may end.
ENDS = {START: 0, ASSISTANT: 0}
NEVER = 1 << 60


def _edits(fault: int, initial: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, next state, rows used) of each edit before or at a row, in ASCII order."""
    other = ASSISTANT if state == USER else USER  # the only role that may follow and be made up
    out = [("D", DELETE, state, 1), ("I", INSERT, other, 0)]
    if fault != GONE:
        more = TRUNCATED * (fault == CUT_OFF)
        if (state, initial) in STEPS:
            out.append(("K", KEEP + more, STEPS[state, initial], 1))
        out.append(("R", REROLE + more, other, 1))
    return out


EDITS = {(4 * fault + initial, state): _edits(fault, initial, state) for fault in range(3) for initial in range(4) for state in range(4)}
#: Behind the last row only turns can be added.
AFTER = {state: [("I", INSERT, ASSISTANT if state == USER else USER, 0)] for state in range(4)}


@lru_cache(1 << 16)
def search(codes: bytes, start: int, ends: tuple[int, ...] | None) -> tuple[int, str, int]:
    """(cost, edits, last state) of the cheapest way through the rows.

    ``ends``: what it costs to go on from each state; None behind the last row of all.
    """
    last = ends is None
    ends = ends or tuple(ENDS.get(s, NEVER) for s in range(4))
    n, path = len(codes), []
    floor = [min(ends)] * (n + 1)
    for i in range(n - 1, -1, -1):  # a row with a fault costs a deletion at least
        floor[i] = floor[i + 1] + (DELETE if codes[i] >= 4 else 0)
    refuted: dict[tuple[int, int], int] = {}
    end = start

    def descend(i: int, state: int, left: int) -> int:
        """-1 if a way of cost ``left`` was found, else a cost under which there is none."""
        nonlocal end
        known = refuted.get((i, state), floor[i])
        if known > left:
            return known
        if i == n and ends[state] <= left:
            end = state
            return -1
        least = ends[state] if i == n else NEVER
        for letter, cost, to, used in EDITS[codes[i], state] if i < n else AFTER[state] if last else ():
            path.append(letter)
            under = descend(i + used, to, left - cost)
            if under < 0:
                return -1
            path.pop()
            least = min(least, cost + under)
        refuted[i, state] = least
        return least

    bound = floor[0]
    while (higher := descend(0, start, bound)) >= 0:
        bound = higher
    return bound, "".join(path), end


def cheapest(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """(cost, edits) for the rows of one conversation, a byte each: 4 x fault + initial."""
    parts = [codes[i : i + block] for i in range(0, len(codes), block)] or [b""]
    ahead: list[tuple[int, ...] | None] = [None]  # what each state costs behind a block, less what all of them cost
    every = 0
    for part in reversed(parts[1:]):
        costs = [search(part, state, ahead[-1])[0] for state in range(4)]
        every += min(costs)
        ahead.append(tuple(c - min(costs) for c in costs))
    state, total, edits = START, every, []
    for k, part in enumerate(parts):
        cost, found, state = search(part, state, ahead.pop())
        total += cost if k == 0 else 0  # the first block's cost has what its last state costs beyond the least
        edits.append(found)
    return total, "".join(edits)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copy, dropped): rows with the test damage that their id and turn draw.

    crc32 of ``conv_id:turn`` modulo 20: 0 drops the row (it stays, marked), 1 empties the
    text, 2 takes out ``[.!?]``, 3 repeats the row, 4 makes the role user.  A null is
    one space, but stays null as an id or a turn.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(known(conv_col), F.lit(":"), known(turn_col))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(known(text_col), ".!?", "")).otherwise(known(text_col))
    copies = F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(draw == 4, "user").otherwise(known(role_col)).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
        (draw == 0).alias("dropped"),
    )


def intact(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows as ``damaged`` gives them, without damage."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), known(role_col).alias("role"), known(text_col).alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("dropped"))


def _coded(rows: DataFrame) -> DataFrame:
    """``rows`` without texts, with digest, bare (no character but blanks) and code (4 x fault + initial)."""
    bare = F.trim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    number = F.coalesce(*[F.when(initial == c, i) for i, c in enumerate(INITIALS)], F.lit(3))
    plain = rows.select("conv_id", "dropped", "turn", "role", "copy", F.unhex(F.sha2("text", 256)).alias("digest"), (bare == "").alias("bare"), F.substring(bare, -1, 1).isin(".", "!", "?").alias("ended"), number.alias("initial"))
    seen = Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(*ORDER)
    fault = F.when(F.col("bare") | (F.row_number().over(seen) > 1), GONE).when(F.col("ended"), FINE).otherwise(CUT_OFF)
    return plain.withColumn("code", (4 * fault + F.col("initial")).cast("int"))


ORDER = ["turn", "role", "digest", "copy"]  # null turns come first
#: Columns of a plan beside the conversation.
PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _planned(parts: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, dropped, turn, code, blank) sorted by conversation and order: one plan for each conversation."""
    here, codes, blank, gap, first, before, out = None, None, 0, 0, None, None, []

    def batch():
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.string())], names=["conv_id", *[x.split()[0] for x in PLAN.split(", ")]])

    def close():
        faults = [codes.count(bytes([4 * f + i])) for f in range(3) for i in range(4)]
        illegal = sum((a % 4, b % 4) not in LEGAL for a, b in pairwise(codes))
        cost, edits = cheapest(bytes(codes))
        out.append((here[0], gap, blank, sum(faults[8:]) - blank, sum(faults[4:8]), illegal, cost, edits))

    for part in parts:
        for conv, dropped, turn, code, bare in zip(*[part.column(c).to_pylist() for c in ("conv_id", "dropped", "turn", "code", "bare")], strict=True):
            if here is None or conv != here[0]:
                if here is not None:
                    close()
                    if len(out) >= 4096:
                        yield batch()
                        out.clear()
                here, codes, blank, gap, before = (conv,), bytearray(), 0, 0, None
            if dropped:
                continue
            codes.append(code)
            blank += bare
            if turn is not None:
                gap += 0 if before is None or turn == before else turn - before - 1
                before = turn
    if here is not None:
        close()
    if out:
        yield batch()


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``damaged`` or ``intact`` rows.

    Rows count in order of turn, null turns first; rows of one turn by role, then by
    the sha256 of their text.  A row is a duplicate if its role and text were seen
    before.  A null id is a conversation of its own.  A conversation whose rows are all
    dropped has zeros and no edits; an empty table has no plans.
    """
    arranged = _coded(rows).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    kind = rows.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    return arranged.select("conv_id", "dropped", "turn", "code", "bare").mapInArrow(lambda parts: _planned(parts, arrow), f"conv_id {kind.simpleString()}, {PLAN}")


def _beside(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Rows and plans of each conversation in one partition, the plan first."""
    names = [x.split()[0] for x in PLAN.split(", ")]
    own = rows.where("not dropped").select("conv_id", F.lit(1).alias("what"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "copy", "text", *[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in PLAN.split(", "))])
    heads = made.select("conv_id", F.lit(0).alias("what"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(0).alias("copy"), F.lit("").alias("text"), *names)
    both = heads.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "what", *ORDER)
    return both.select("conv_id", "what", "turn", "role", "text", *names)


def _followed(parts: Iterator[pa.RecordBatch]):
    """("plan", values) at the head of each conversation, then ("row", role, text, turn, edit) of its repaired rows, then ("end",)."""
    audit, at, state, opened = "", 0, START, False

    def role_of(letter, role):
        nonlocal state
        if letter == "K":
            state = STEPS[state, INITIALS.index(role[0])]
            return role
        state = ASSISTANT if state == USER else USER
        return ROLES[state]

    def made_up():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield "row", role_of("I", ""), "", None, "I"

    for part in parts:
        columns = [part.column(c).to_pylist() for c in ("what", "role", "text", "turn", "audit")]
        for k, (what, role, text, turn, edits) in enumerate(zip(*columns, strict=True)):
            if what == 0:
                if opened:
                    yield from made_up()
                    yield ("end",)
                audit, at, state, opened = edits, 0, START, True
                yield "plan", part.slice(k, 1)
                continue
            yield from made_up()
            letter = audit[at]
            at += 1
            if letter != "D":
                yield "row", role_of(letter, role), text, turn, letter
    if opened:
        yield from made_up()
        yield ("end",)
    give_back()


def repaired(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the repaired conversations; an inserted row has no turn and an empty text."""
    both = _beside(rows, made)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, place, kind = None, [], 0, None

        def batch():
            c = list(zip(*held, strict=True))
            kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names=["conv_id", "place", "turn", "role", "text", "edit"])

        for what, *values in _followed(parts):
            if what == "plan":
                conv, place, kind = values[0].column("conv_id")[0].as_py(), 0, values[0].column("conv_id").type
            elif what == "row":
                role, text, turn, edit = values
                held.append((conv, place, turn, role, text, edit))
                place += 1
                if len(held) >= 1024:
                    yield batch()
                    held = []
        if held:
            yield batch()

    return both.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, turn long, role string, text string, edit string")


def digests(rows: DataFrame, made: DataFrame) -> DataFrame:
    """``made`` with repaired_sha256: of the repaired ``role:text``, joined by newlines."""
    both = _beside(rows, made)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, hashes, own, lines = [], [], None, 0

        def batch():
            plain = pa.Table.from_batches(heads).select(made_names).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*plain.columns, pa.array(hashes, pa.string())], names=[*made_names, "repaired_sha256"])

        for what, *values in _followed(parts):
            if what == "plan":
                heads.append(values[0])
                own, lines = hashlib.sha256(), 0
            elif what == "row":
                own.update((("\n" if lines else "") + values[0] + ":" + values[1]).encode())
                lines += 1
            else:
                hashes.append(own.hexdigest())
                if len(heads) >= 1024:
                    yield batch()
                    heads, hashes = [], []
        if heads:
            yield batch()

    made_names = made.columns
    return both.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields) + ", repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired rows) of ``damaged`` or ``intact`` rows; the plans are written once."""
    made = materialise(plans(rows), "plans")
    return made, repaired(rows, made)
