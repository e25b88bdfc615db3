"""Problems as rows, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def severity_rank() -> Column:
    return F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)


def issues(records: DataFrame) -> DataFrame:
    """One row for each problem of each record."""
    return records.select("source", "row_number", F.explode("problems").alias("p")).select("source", "row_number", "p.*")


def classes(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "category", F.coalesce("field", F.lit("")).alias("field")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


def per_source(found: DataFrame) -> DataFrame:
    return found.groupBy("source").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn", "info")], F.count("*").alias("total"))


def row_outcomes(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if("usable").alias("usable"), F.count_if(~F.col("usable")).alias("rejected"))


def top_categories(found: DataFrame, n: int = 10) -> DataFrame:
    """The report's head: the ``n`` most frequent categories, ties by name."""
    return found.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(n)


def buckets(found: DataFrame, examples: int = 4) -> DataFrame:
    """(category, severity, n, sources, examples): how often, where, and the first ``examples`` rows as "source:row"."""
    keys = ["category", "severity"]
    told = found.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    order = Window.partitionBy(*keys).orderBy("source", "row_number", "field")
    first = found.select(*keys, "source", "row_number", "field", F.row_number().over(order).alias("rn")).where(F.col("rn") <= examples)  # cut before the shuffle
    shown = F.concat_ws(":", F.coalesce("source", F.lit("-")), F.col("row_number").cast("string"))
    listed = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", shown.alias("at")))), lambda x: x["at"]), ", ").alias("examples"))
    return told.join(listed, keys)


def in_order(found: DataFrame) -> DataFrame:
    """Errors first, then by category, source and row."""
    return found.orderBy(severity_rank(), "category", F.coalesce("source", F.lit("")), F.coalesce("row_number", F.lit(-1)), "field")


# ---------------------------------------------------------------- exports


def csv_cell(text: Column) -> Column:
    """A cell in quotes."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def table_cell(text: Column) -> Column:
    """A cell of a Markdown table: bars escaped, line breaks as blanks."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


#: Sections of the appendix, in order, and the categories of each.
SECTIONS = {
    "Structure": ("blank_row", "repeated_header", "column_count_mismatch", "scrambled_columns", "unidentifiable_row", "undecodable_bytes", "oversized_cell", "unterminated_quote"),
    "Formats": ("missing_value", "invalid_format", "invalid_value", "inconsistent_format", "inconsistent_casing", "inconsistent_value", "trailing_whitespace"),
    "Units and dates": ("mixed_units", "ambiguous_date", "future_date", "out_of_range", "unit_correlates_with_magnitude"),
    "Vocabularies": ("unmapped_value", "precision_loss", "suspicious_value", "abbreviated_name", "alias_email"),
    "Identity": ("duplicate_within_source", "exact_duplicate_row", "cross_source_match", "ambiguous_identity", "homonym", "homonym_kept_separate", "weak_match_applied", "three_way_match", "app_contacts_ingested", "person_references_relinked"),
    "Audit": ("undeliverable_domain", "statistical_outlier", "business_rule_violation", "match_key_coverage", "cross_source_agreement", "cross_source_disagreement"),
}


def sections(found: DataFrame) -> DataFrame:
    """(place, section, category, severity, n, line): the appendix's tables, a Markdown line for each class of issues."""
    rows = [(i, s, c) for i, (s, cs) in enumerate(SECTIONS.items(), 1) for c in cs]
    of = found.sparkSession.createDataFrame(rows, "place int, section string, category string")
    counted = found.groupBy("category", "severity").agg(F.count("*").alias("n"))
    told = counted.join(F.broadcast(of), "category", "left").select(F.coalesce("place", F.lit(len(SECTIONS) + 1)).alias("place"), F.coalesce("section", F.lit("Other")).alias("section"), "category", "severity", "n")
    line = F.concat(F.lit("| "), table_cell(F.col("category")), F.lit(" | "), F.col("severity"), F.lit(" | "), thousands(F.col("n")), F.lit(" |"))
    return told.withColumn("line", line)


def totals(found: DataFrame) -> DataFrame:
    """(total, by_category): the number of issues, and those of each category as JSON with sorted keys."""
    by = found.groupBy("category").agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n"))))).alias("by_category"))


def export_csv(df: DataFrame, path: str, *order: Column | str) -> None:
    """Write a report's rows as CSV with a header, in order over its files."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
