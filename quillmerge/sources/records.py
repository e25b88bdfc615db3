"""Sources to one typed table of records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmerge import config
from quillmerge.functions import normalize as N
from quillmerge.functions.text import squash
from quillmerge.sources import messy

#: Column of the records table and its type; a source without it has null.
COLUMNS = {
    "full_name": "string",
    "name_key": "string",
    "name_abbreviated": "boolean",
    "email": "string",
    "email_alias_of": "string",
    "phone": "string",
    "city": "string",
    "region_guess": "boolean",
    "experience_years": "double",
    "ctc_annual_inr": "double",
    "ctc_unit_detected": "string",
    "ctc_out_of_range": "boolean",
    "applied_date": "date",
    "applied_date_ambiguous": "boolean",
    "applied_date_is_future": "boolean",
    "rate_hourly_inr": "double",
    "rate_monthly_inr": "double",
    "rate_basis": "string",
    "rate_out_of_range": "boolean",
    "gig_status": "string",
    "is_verified": "boolean",
    "projects_completed": "int",
    "skills": "array<string>",
}


@dataclass(frozen=True)
class SourceSpec:
    """How a source's raw columns become records.

    ``fields`` maps a raw column to its normaliser, ``outputs`` a record column to
    the path in a normaliser's struct, ``identity`` names the columns of which one
    at least must be there for a record to be usable.
    """

    name: str
    fields: dict[str, Callable[..., Column]]
    outputs: dict[str, str]
    identity: tuple[str, ...] = ("full_name", "email", "phone")
    needs_all: bool = False  #: all of ``identity`` must be there
    optional: tuple[str, ...] = ()  #: raw columns whose absence is no problem

    def records(self, raw: DataFrame) -> DataFrame:
        texts = [c for c in raw.columns if c not in ("source", "row_number")]
        mapped = F.map_from_arrays(F.array(*map(F.lit, texts)), F.array(*[F.col(c).cast("string") for c in texts]))
        squashed = raw.select("source", "row_number", mapped.alias("raw"), *self.fields, *[squash(F.col(c)).alias(f"s_{c}") for c in self.fields])
        # an explode of one element: the optimiser doesn't copy a normaliser into every use of its result
        each = F.struct(*[f(F.col(c), s=F.col(f"s_{c}")).alias(f"n_{c}") for c, f in self.fields.items()])
        once = squashed.select("source", "row_number", "raw", F.explode(F.array(each)).alias("n")).select("source", "row_number", "raw", "n.*")
        cols = [F.col(f"n_{self.outputs[c]}").cast(t).alias(c) if c in self.outputs else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()]
        there = [F.col(f"n_{self.outputs[c]}").isNotNull() for c in self.identity]
        usable = reduce(lambda a, b: a & b if self.needs_all else a | b, there)
        found = [F.when(F.col("raw")[c].isNotNull(), F.col(f"n_{c}.problems")).otherwise(F.array()) if c in self.optional else F.col(f"n_{c}.problems") for c in self.fields]
        found.append(F.when(usable, F.array()).otherwise(F.array(N.problem("unidentifiable_row", "E", "", F.lit(None)))))
        rank = config.SOURCE_PRIORITY.index(self.name)
        return once.select("source", "row_number", F.concat_ws(":", "source", "row_number").alias("uid"), F.lit(rank).alias("source_rank"), "raw", F.concat(*found).alias("problems"), *cols, usable.alias("usable"))


def with_problems(records: DataFrame, rows: DataFrame) -> DataFrame:
    """``records`` with the row_problems of (row_number, row_problems) before their own."""
    told = rows.where(F.size("row_problems") > 0)
    joined = records.join(told, "row_number", "left")
    return joined.withColumn("problems", F.when(F.col("row_problems").isNull(), F.col("problems")).otherwise(F.concat("row_problems", "problems"))).select(*records.columns)


NAME = {"full_name": "full_name.value", "name_key": "full_name.key", "name_abbreviated": "full_name.abbreviated"}
CITY = {"city": "city.value", "region_guess": "city.region_guess"}

SPECS = {
    "applicants": SourceSpec(
        "naukri",
        {"full_name": N.name, "email": N.email, "phone": N.phone, "city": N.city, "experience": lambda c, s: N.floating(c, "experience_years", *config.EXPERIENCE_PLAUSIBLE, s=s), "ctc": N.ctc, "applied": N.date, "skills": N.skills},
        NAME | CITY | {"email": "email.value", "email_alias_of": "email.alias_of", "phone": "phone.value", "experience_years": "experience.value", "ctc_annual_inr": "ctc.value", "ctc_unit_detected": "ctc.unit", "ctc_out_of_range": "ctc.out_of_range", "applied_date": "applied.value", "applied_date_ambiguous": "applied.ambiguous", "applied_date_is_future": "applied.future", "skills": "skills.values"},
    ),
    "workers": SourceSpec(
        "gig",
        {"full_name": N.name, "email": N.email, "rate": N.rate, "city": N.city, "status": N.status, "skills": N.skills},
        NAME | CITY | {"email": "email.value", "email_alias_of": "email.alias_of", "rate_hourly_inr": "rate.hourly", "rate_monthly_inr": "rate.monthly", "rate_basis": "rate.basis", "rate_out_of_range": "rate.out_of_range", "gig_status": "status.value", "skills": "skills.values"},
        identity=("full_name", "email"),
    ),
    "contacts": SourceSpec(
        "cbnexus",
        {"full_name": N.name, "phone": N.phone, "city": N.city, "verified": N.boolean, "projects": lambda c, s: N.whole(c, "projects_completed", s=s)},
        NAME | CITY | {"phone": "phone.value", "is_verified": "verified.value", "projects_completed": "projects.value"},
        identity=("full_name", "phone"),
    ),
}


#: Contacts that were made outside the files.
APP = SourceSpec(
    "audio_app",
    {"full_name": N.name, "phone": N.phone, "city": N.city},
    NAME | CITY | {"phone": "phone.value"},
    identity=("full_name", "phone"),
    needs_all=True,
    optional=("city",),
)


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all four sources, in one table."""
    out = None
    for name, spec in (SPECS | {"apps": APP}).items():
        one = spec.records(messy.source(spark, sf_dir, name))
        out = one if out is None else out.unionByName(one)
    return out
