"""Repair of raw rows before any field is read: blank rows, repeated headers, widths, rotated cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmerge import config
from quillmerge.functions.text import compatible, squeezed


def row_outcome(values: Column, header: list[str]) -> Column:
    """blank_row, repeated_header, column_count_mismatch or ok."""
    plain = F.split(compatible(F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit(""))), "\u0001")), "\u0001")
    flat = F.when(F.size(values) == 0, F.array().cast("array<string>")).otherwise(F.transform(plain, squeezed))
    head = F.array(*[F.lit(" ".join(h.split()).lower()) for h in header])
    return (
        F.when(F.forall(flat, lambda v: v == ""), "blank_row")
        .when(F.transform(flat, lambda v: F.lower(v)) == head, "repeated_header")
        .when(F.size(values) != len(header), "column_count_mismatch")
        .otherwise("ok")
    )


def to_width(values: Column, n: int) -> Column:
    """Padded with empty cells, or cut."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(""), n)), 1, n)


def like_email(v: Column) -> Column:
    return F.when(v.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"), 1.0).otherwise(0.0)


def like_rate(v: Column) -> Column:
    return F.when(F.trim(v).rlike(r"(?i)^\d+(\.\d+)?\s*(k|l|lac|lakh)?\s*/\s*(hr|hour|hourly|month|mo|monthly|day|daily)$"), 1.0).otherwise(0.0)


def like_status(v: Column) -> Column:
    return F.when(F.lower(F.trim(v)).isin(*config.STATUS_CANON), 1.0).otherwise(0.0)


def like_city(v: Column) -> Column:
    return F.when(F.lower(F.trim(v)).isin(*config.CITY_CANON), 1.0).otherwise(0.0)


def like_name(v: Column) -> Column:
    t = F.trim(v)
    shape = t.rlike(r"^[A-Za-z][A-Za-z.'\- ]{1,60}$") & ~v.contains(",")
    return F.when(~shape, 0.0).when(F.size(F.split(t, r"\s+")) <= 4, 1.0).otherwise(0.3)


def like_skills(v: Column) -> Column:
    parts = F.filter(F.transform(F.split(v, ","), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    hits = F.size(F.filter(parts, lambda p: p.isin(*config.SKILL_CANON)))
    return F.when(F.size(parts) > 0, hits / F.size(parts)).otherwise(0.0)


WORKER_CHECKS = (like_email, like_name, like_rate, like_city, like_status, like_skills)


def with_rotation(df: DataFrame, values: str, checks=WORKER_CHECKS) -> DataFrame:
    """``df`` with repaired, shift, score_before, score_after: the best cyclic rotation of a row's cells.

    A rotation must beat the best so far by more than one point, so a tie changes nothing.
    """
    n = len(checks)

    def score(shift: int) -> Column:
        return sum((f(F.coalesce(F.get(F.col(values), (i + shift) % n), F.lit(""))) for i, f in enumerate(checks)), F.lit(0.0))

    scored = df.withColumn("_scores", F.array(*[score(s) for s in range(n)]))
    best = F.aggregate(
        F.sequence(F.lit(1), F.lit(n - 1)),
        F.struct(F.lit(0).alias("shift"), F.get("_scores", 0).alias("score")),
        lambda a, s: F.when(F.get("_scores", s) > a["score"] + 1.0, F.struct(s.alias("shift"), F.get("_scores", s).alias("score"))).otherwise(a),
    )
    chosen = scored.withColumn("_best", best)
    turned = F.concat(F.slice(values, F.col("_best.shift") + 1, n), F.slice(values, F.lit(1), F.col("_best.shift")))
    return chosen.withColumns({"repaired": turned, "shift": F.col("_best.shift"), "score_before": F.get("_scores", 0), "score_after": F.col("_best.score")}).drop("_scores", "_best")
