"""What identity resolution and the audit have to report, as issue rows.

A row is (source, row_number, category, severity, field, raw_value); one that
concerns no single record has a null source and number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmerge import config
from quillmerge.operators import audit, identity

ISSUE = ("source", "row_number", "category", "severity", "field", "raw_value")


def _rows(df: DataFrame, category: str, severity: str, field: str | Column, raw: Column, source: Column | None = None, row: Column | None = None) -> DataFrame:
    none = F.lit(None)
    values = (none if source is None else source, none if row is None else row, F.lit(category), F.lit(severity), F.lit(field) if isinstance(field, str) else field, raw)
    kinds = ("string", "long", "string", "string", "string", "string")
    return df.select(*[v.cast(k).alias(n) for v, k, n in zip(values, kinds, ISSUE, strict=True)])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def identity_issues(records: DataFrame, strong: DataFrame, resolved: DataFrame) -> DataFrame:
    """Links across sources, repeats within one, weak merges, names left apart, people of just three sources."""
    own = (F.col("source"), F.col("row_number"))
    usable = records.where("usable")
    linked = identity.cross_source_links(usable)
    out = [_rows(linked, "cross_source_match", "info", F.col("field"), F.col("value"), *own)]
    again = identity.duplicates_within_source(usable, ("email", "phone"))
    out.append(_rows(again, "duplicate_within_source", "warn", F.col("field"), F.col("value"), *own))
    payload = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("raw"))))
    copies = identity.duplicates_within_source(usable.withColumn("payload", F.sha2(payload, 256)), ("payload",))
    out.append(_rows(copies, "exact_duplicate_row", "warn", "", F.lit(None), *own))
    decided = identity.weak_decisions(records, strong)
    for verdict, category, severity in (("ambiguous_name_city", "ambiguous_identity", "warn"), ("same_name_conflicting_strong_key", "homonym_kept_separate", "info")):
        out.append(_rows(decided.where(F.col("verdict") == verdict), category, severity, "full_name", F.col("name_key")))
    second = identity.representatives(records, strong).withColumnRenamed("root", "last")
    merged = decided.where("verdict = 'merge'").join(second, "last")
    out.append(_rows(merged, "weak_match_applied", "warn", "full_name", F.col("name_key"), *own))
    out.append(_rows(identity.homonyms(resolved), "homonym", "info", "full_name", F.col("name_key")))
    spread = resolved.groupBy("root").agg(F.countDistinct("source").alias("n"), F.min(F.struct("source_rank", "row_number", "uid"))["uid"].alias("ref"))
    out.append(_rows(spread.where("n = 3"), "three_way_match", "info", "", F.col("ref")))
    return _union(out)


def audit_issues(people: DataFrame, members: DataFrame) -> DataFrame:
    """Undeliverable addresses, units that predict magnitudes, outliers, broken rules, missing keys, differing skills."""
    out = []
    reserved = audit.reserved_domains(people).where("reserved > 0")
    out.append(_rows(reserved, "undeliverable_domain", "info", "email", F.format_string("%d/%d", "reserved", "total")))

    rated = people.where("rate_monthly_inr > 0 and rate_basis is not null").withColumn("all", F.lit("all"))
    by_basis = audit.medians(rated, "rate_basis", "rate_monthly_inr").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("rate_basis") == "hourly", F.col("median"))).alias("hourly"), F.max(F.when(F.col("rate_basis") == "monthly", F.col("median"))).alias("monthly")
    )
    apart = by_basis.where("n >= 6 and hourly > 0 and monthly > 0")
    out.append(_rows(apart, "unit_correlates_with_magnitude", "warn", "rate", F.format_string("%.1f", F.col("hourly") / F.col("monthly"))))
    enough = by_basis.where("n >= 6").select(F.lit("all").alias("all"))  # one row, or none where too few are known
    odd = audit.outliers(rated, "all", "rate_monthly_inr", "ref").join(F.broadcast(enough), "all", "left_semi")
    out.append(_rows(odd, "statistical_outlier", "info", "rate", F.col("ref")))

    paid = people.where("ctc_annual_inr > 0 and experience_years is not null")
    a_year = paid.withColumn("all", F.lit("all")).withColumn("ratio", F.col("ctc_annual_inr") / F.greatest("experience_years", F.lit(0.5)))
    out.append(_rows(audit.outliers(a_year, "all", "ratio", "ref"), "statistical_outlier", "info", "ctc_annual_inr", F.col("ref")))

    broken = people.where((F.col("projects_completed") >= config.PROJECTS_TRUST) & (F.col("is_verified") == F.lit(False))).agg(F.count("*").alias("n")).where("n > 0")
    out.append(_rows(broken, "business_rule_violation", "warn", "is_verified", F.col("n")))
    cover = audit.key_coverage(people)
    out.append(_rows(cover, "match_key_coverage", "warn", "", F.format_string("%d,%d,%d/%d", "no_email", "no_phone", "neither", "people")))

    differ = audit.skill_agreement(members)
    out.append(_rows(differ, "cross_source_disagreement", "info", "skills", F.col("root")))
    control = differ.agg(F.count("*").alias("n")).where("n = 0")
    out.append(_rows(control, "cross_source_agreement", "info", "skills", F.lit(None)))
    return _union(out)


def relink_issue(relinked: DataFrame, key: str = "person_key") -> DataFrame:
    """One row that tells how many durable rows found their person again, of how many."""
    told = relinked.agg(F.count("person").alias("found"), F.count("*").alias("n")).where("n > 0")
    return _rows(told, "person_references_relinked", "info", key, F.format_string("%d/%d", "found", "n"))


def ingest_issue(contacts: DataFrame) -> DataFrame:
    """One row that tells how many durable contacts came in again; none without any."""
    told = contacts.agg(F.count("*").alias("n")).where("n > 0")
    return _rows(told, "app_contacts_ingested", "info", "", F.col("n"), F.lit(config.SOURCE_PRIORITY[-1]))
