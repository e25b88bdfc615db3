"""Rules that derived tables must keep, tested while they are written.

Rules on single rows (``required``, ``allowed``) are counted by observed metrics of the
very pass that writes the table.  Keys and references need rows of other places and are
tested on what was written, before anyone can read it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Rows that a refusal shows of each broken rule.
SHOWN = 5


@dataclass(frozen=True)
class Required:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Allowed:
    """``condition`` in SQL holds, or is null."""

    table: str
    condition: str


@dataclass(frozen=True)
class Unique:
    """No two rows have the same columns; a row with a null in them is no one's double."""

    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Refers:
    """Values of the column that are not null are in another table's column."""

    table: str
    column: str
    other: str
    other_column: str


Rule = Required | Allowed | Unique | Refers


class Refused(Exception):
    """A rebuild broke rules: (rule, how many rows, some of them)."""

    def __init__(self, broken: list[tuple[Rule, int, list[dict]]]):
        super().__init__("; ".join(f"{rule}: {n} rows, {rows}" for rule, n, rows in broken))
        self.broken = broken


def _row_tests(rules: list[Rule], table: str) -> list[tuple[Rule, Column]]:
    """(rule, condition that a broken row fulfils) of the rules on single rows."""
    tests = []
    for rule in rules:
        if rule.table != table:
            continue
        if isinstance(rule, Required):
            none = F.lit(False)
            for c in rule.columns:
                none = none | F.col(c).isNull()
            tests.append((rule, none))
        elif isinstance(rule, Allowed):
            tests.append((rule, ~F.coalesce(F.expr(rule.condition), F.lit(True))))
    return tests


def _some(rows: DataFrame, n: int) -> list[dict]:
    return [r.asDict() for r in rows.limit(SHOWN).collect()] if n else []


def write_tested(df: DataFrame, path: str, table: str, rules: list[Rule]) -> list[tuple[Rule, int, list[dict]]]:
    """Write ``df`` as Parquet; the broken rules on its rows, counted in the same pass."""
    tests = _row_tests(rules, table)
    if not tests:
        df.write.parquet(path)
        return []
    seen = Observation()
    df.observe(seen, *[F.coalesce(F.sum(broken.cast("long")), F.lit(0)).alias(f"rule{i}") for i, (_, broken) in enumerate(tests)]).write.parquet(path)
    counts = seen.get
    told = [(rule, counts[f"rule{i}"], broken) for i, (rule, broken) in enumerate(tests) if counts[f"rule{i}"]]
    written = df.sparkSession.read.parquet(path) if told else None
    return [(rule, n, _some(written.where(broken), n)) for rule, n, broken in told]


def tested_keys(tables: dict[str, DataFrame], rules: list[Rule]) -> list[tuple[Rule, int, list[dict]]]:
    """The broken keys and references of written tables."""
    out = []
    for rule in rules:
        df = tables.get(rule.table)
        if isinstance(rule, Unique):
            whole = df.dropna(subset=list(rule.columns)).groupBy(*rule.columns).agg(F.count("*").alias("rows")).where("rows > 1")
        elif isinstance(rule, Refers):
            there = tables[rule.other].select(F.col(rule.other_column).alias(rule.column)).distinct()
            whole = df.where(F.col(rule.column).isNotNull()).join(there, rule.column, "left_anti")
        else:
            continue
        n = whole.count()
        if n:
            out.append((rule, n, _some(whole, n)))
    return out
