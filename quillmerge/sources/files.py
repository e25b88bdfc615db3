"""From files to records: numbered CSV rows, structural repair, normalisers; and the durable contacts as a further source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmerge.functions import normalize as N
from quillmerge.operators import structural
from quillmerge.sources.csv_records import read_records
from quillmerge.sources.records import APP, SPECS, with_problems
from quillmerge.sources.store import Files

#: What the CSV reader tells of a record.
FAULTS = ("undecodable_bytes", "oversized_cell", "unterminated_quote")
SKIPPED = "source string, row_number long, category string, severity string, field string, raw_value string"


@dataclass(frozen=True)
class FileSpec:
    """A source's file: its columns in order, each with the spec's field it feeds, and how it is repaired."""

    source: str  #: key of SPECS
    columns: dict[str, str]
    repeat_severity: str = "W"  #: of a header that comes again
    rotated: bool = False  #: whether rows may have their cells rotated


FILES = {
    "applicants": FileSpec("applicants", {"Full Name": "full_name", "Email": "email", "Phone": "phone", "City": "city", "Experience (Years)": "experience", "Current CTC": "ctc", "Applied Date": "applied", "Skills": "skills"}),
    "workers": FileSpec("workers", {"email_id": "email", "worker_name": "full_name", "rate": "rate", "location": "city", "status": "status", "skill_tags": "skills"}, rotated=True),
    "contacts": FileSpec("contacts", {"Name": "full_name", "Phone Number": "phone", "City": "city", "Verified": "verified", "Projects Completed": "projects"}, repeat_severity="E"),
}


def _row_problem(category: str, severity: str, raw: Column | None = None) -> Column:
    return N.problem(category, severity, "", F.lit(None) if raw is None else raw)


def repaired(rows: DataFrame, spec: FileSpec) -> tuple[DataFrame, DataFrame]:
    """(rows as the source's raw columns with ``row_problems``, skipped rows as issues) of (row_number, cells, fault).

    Blank rows and repeated headers are skipped; a row of another width is padded or
    cut; rotated cells are turned back.  Each leaves its problem.
    """
    header, name = list(spec.columns), SPECS[spec.source].name
    seen = rows.withColumn("outcome", structural.row_outcome(F.col("cells"), header))
    repeat = N.SEVERITY[spec.repeat_severity]
    out = seen.where(F.col("outcome").isin("blank_row", "repeated_header"))
    skipped = out.select(F.lit(name).alias("source"), "row_number", F.col("outcome").alias("category"), F.when(F.col("outcome") == "blank_row", "warn").otherwise(repeat).alias("severity"), F.lit("").alias("field"), F.lit(None).cast("string").alias("raw_value"))
    kept = seen.where(~F.col("outcome").isin("blank_row", "repeated_header")).withColumn("cells", structural.to_width(F.col("cells"), len(header)))
    checks = [(F.col("fault").isNotNull(), N.problems(*[(F.col("fault") == c, _row_problem(c, "E")) for c in FAULTS])[0]), (F.col("outcome") == "column_count_mismatch", _row_problem("column_count_mismatch", "W"))]
    values = F.col("cells")
    if spec.rotated:
        kept = structural.with_rotation(kept, "cells")
        checks.append((F.col("shift") > 0, _row_problem("scrambled_columns", "E", F.array_join("cells", " | "))))
        values = F.col("repaired")
    cells = [F.get(values, i).alias(field) for i, field in enumerate(spec.columns.values())]
    return kept.select(F.lit(name).alias("source"), "row_number", N.problems(*checks).alias("row_problems"), *cells), skipped


def read_source(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(records, skipped rows as issues) of one source's CSV files; the first record of the first file is its header."""
    spec = FILES[name]
    rows = read_records(spark, path, across=True).where("row_number > 1").select("row_number", "cells", "fault")
    raw, skipped = repaired(rows, spec)
    records = SPECS[spec.source].records(raw.drop("row_problems"))
    problems = raw.select("row_number", "row_problems")
    return with_problems(records, problems), skipped


def app_contacts(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of contacts that were made outside the files, from their durable table; None before the first one.

    A contact's number is its id; the phone as it was typed counts before the
    normalised one, a missing city is no problem.
    """
    return APP.records(as_raw_contacts(spark.read.parquet(path))) if Files(spark).exists(path) else None


def as_raw_contacts(table: DataFrame) -> DataFrame:
    phone = F.coalesce(F.nullif(F.col("phone_raw"), F.lit("")), F.col("phone"))
    return table.select(F.lit(APP.name).alias("source"), F.col("contact_id").cast("int").alias("row_number"), "full_name", phone.alias("phone"), F.nullif(F.col("city"), F.lit("")).alias("city"))


def read_all(spark: SparkSession, paths: dict[str, str], contacts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, skipped rows) of all sources in their order, the durable contacts last."""
    records = skipped = None
    for name, path in paths.items():
        one, gone = read_source(spark, path, name)
        records = one if records is None else records.unionByName(one)
        skipped = gone if skipped is None else skipped.unionByName(gone)
    app = app_contacts(spark, contacts) if contacts else None
    return (records if app is None else records.unionByName(app)), skipped
