"""The report of a run: issues in words, the files it writes, and its appendix as ordered lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmerge import config
from quillmerge.functions.text import looked_up
from quillmerge.operators import golden, issues
from quillmerge.operators.issues import table_cell, thousands

#: What each category of issue means, and what was done about it; {field} and {raw} stand for the issue's own.
WORDS: dict[str, tuple[str, str]] = {
    "blank_row": ("the row has no cell with anything in it", "skipped"),
    "repeated_header": ("the header comes again as a row", "skipped"),
    "column_count_mismatch": ("the row has another number of cells than the header", "padded with empty cells or cut"),
    "scrambled_columns": ("the cells stand under the wrong headers: {raw}", "turned back to the order that fits best"),
    "unidentifiable_row": ("nothing in the row tells whose it is", "kept as a source record, left out of matching"),
    "undecodable_bytes": ("the row holds bytes that are not UTF-8", "read with replacement characters"),
    "oversized_cell": ("a cell is larger than the reader takes", "cut"),
    "unterminated_quote": ("a quoted cell never ends", "read to the end of the file"),
    "missing_value": ("{field} is empty", "left null"),
    "invalid_format": ("{field} can't be read: {raw}", "left null, or mended where the meaning is plain"),
    "invalid_value": ("{field} names nothing that exists: {raw}", "left null"),
    "inconsistent_format": ("{field} is spelt in another form than the rest: {raw}", "rewritten in the common form"),
    "inconsistent_casing": ("{field} has other capitals than the common spelling: {raw}", "rewritten in the common spelling"),
    "inconsistent_value": ("{field} is another name of a known value: {raw}", "replaced by the known value"),
    "trailing_whitespace": ("{field} has blanks around it: {raw}", "trimmed"),
    "mixed_units": ("{field} is given in another unit than its neighbours: {raw}", "converted, the unit kept beside it"),
    "ambiguous_date": ("{field} can be read day first or month first: {raw}", "read by its separator and marked"),
    "future_date": ("{field} lies behind the day of the run: {raw}", "kept and marked"),
    "out_of_range": ("{field} lies outside what is plausible: {raw}", "kept and marked"),
    "unmapped_value": ("{field} is in no vocabulary: {raw}", "kept as it is where it is a name, else left null"),
    "precision_loss": ("{field} names a region, not a city: {raw}", "taken as the region's main city and marked as a guess"),
    "suspicious_value": ("{field} has a shape that real ones seldom have: {raw}", "kept"),
    "abbreviated_name": ("{field} has an initial for a name: {raw}", "kept; a full spelling wins where there is one"),
    "alias_email": ("{field} looks like somebody's second address: {raw}", "kept; a first address wins where there is one"),
    "duplicate_within_source": ("a row before has the same {field}: {raw}", "both kept, as one person"),
    "exact_duplicate_row": ("a row before says the very same", "both kept, as one person"),
    "cross_source_match": ("the {field} links it to a record of another source: {raw}", "joined as one person"),
    "ambiguous_identity": ("over two clusters bear the name {raw} in one city", "not merged, queued for a person to look at"),
    "homonym_kept_separate": ("two clusters bear the name {raw} in one city, with different keys", "kept as two people"),
    "weak_match_applied": ("two clusters share name and city only: {raw}", "merged, with a lower confidence"),
    "homonym": ("several people bear the name {raw}", "kept apart"),
    "three_way_match": ("the person is known to three sources", "merged into one"),
    "undeliverable_domain": ("addresses at domains that are reserved for examples: {raw}", "kept, no mail should be sent"),
    "unit_correlates_with_magnitude": ("hourly {field}s come to {raw} times the monthly ones", "kept, the unit may be wrong at its source"),
    "statistical_outlier": ("{field} is far from the median: {raw}", "kept"),
    "business_rule_violation": ("people of many projects who are not verified: {raw}", "kept, to be verified"),
    "match_key_coverage": ("people without e-mail, phone or both: {raw}", "kept; they can be matched by name and city only"),
    "cross_source_agreement": ("no person's {field} differ between sources", "nothing to do"),
    "cross_source_disagreement": ("two sources name different {field}: {raw}", "all of them kept"),
    "person_references_relinked": ("rows by {field} that found their person again: {raw}", "linked anew"),
    "app_contacts_ingested": ("contacts made outside the files: {raw}", "taken in as a source"),
}

#: Categories whose raw value names a person by the first record of its cluster, or by the cluster.
BY_PERSON = ("three_way_match", "statistical_outlier", "cross_source_disagreement")

EXAMPLES = 6


def skill_examples(raw: Column, unknown: bool, most: int = EXAMPLES) -> Column:
    """The first ``most`` distinct spellings of a list that are in no vocabulary, or are there in another spelling, in order."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda p: F.trim(p)), lambda p: p != "")
    known = lambda p: looked_up(config.SKILL_CANON, F.lower(p))
    told = F.filter(parts, (lambda p: known(p).isNull()) if unknown else (lambda p: known(p) != p))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(told)), 1, most), ", ")


def worded(found: DataFrame) -> DataFrame:
    """``found`` with description and action_taken; a category without words has its own name for one."""
    listed = lambda category, unknown: F.when((F.col("field") == "skills") & (F.col("category") == category), skill_examples(F.col("raw_value"), unknown))
    shown = F.coalesce(listed("unmapped_value", True), listed("inconsistent_casing", False), F.col("raw_value"), F.lit(""))
    text = looked_up({c: d for c, (d, _) in WORDS.items()}, F.col("category"))
    filled = F.replace(F.replace(text, F.lit("{field}"), F.coalesce("field", F.lit(""))), F.lit("{raw}"), shown)
    action = looked_up({c: a for c, (_, a) in WORDS.items()}, F.col("category"))
    return found.withColumns({"description": F.coalesce(filled, F.col("category")), "action_taken": F.coalesce(action, F.lit(""))})


def with_entity(found: DataFrame, records: DataFrame, people: DataFrame) -> DataFrame:
    """``found`` with entity: the name in the record it concerns, or of the person; null where it concerns neither.

    Rows that concern the whole dataset have no key and take no part in the join, so
    that they don't meet in one task.
    """
    row = F.when(F.col("row_number").isNotNull(), F.concat_ws(":", "source", "row_number"))
    keyed = found.withColumn("key", F.coalesce(F.concat(F.lit("r"), row), F.when(F.col("category").isin(*BY_PERSON), F.concat(F.lit("p"), F.col("raw_value")))))
    named = records.select(F.concat(F.lit("r"), "uid").alias("key"), F.col("full_name").alias("entity"))
    persons = people.select(F.explode(F.array_distinct(F.array("ref", "root"))).alias("id"), F.col("full_name").alias("entity")).select(F.concat(F.lit("p"), "id").alias("key"), "entity")
    met = keyed.where("key is not null").join(named.unionByName(persons), "key", "left")
    return met.unionByName(keyed.where("key is null").withColumn("entity", F.lit(None).cast("string"))).drop("key")


# ---------------------------------------------------------------- the files

#: Each file with its table, columns and order, as fixed values.
EXPORTS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "data_issues": ("data_issues", ("severity", "category", "source", "row_number", "field", "raw_value", "entity", "description", "action_taken"), ("severity", "category", "source", "row_number")),
    "people": (
        "people",
        ("person_id", "full_name", "email", "phone", "city", "city_region", "experience_years", "ctc_annual_inr", "ctc_unit_detected", "applied_date", "applied_date_ambiguous", "applied_date_is_future",
         "rate_hourly_inr", "rate_monthly_inr", "rate_basis", "gig_status", "is_verified", "projects_completed", "skills", "sources", "source_count", "record_count", "match_methods", "match_confidence"),
        ("person_id",),
    ),
    "field_conflicts": ("field_conflicts", ("person_id", "full_name", "field", "chosen_value", "chosen_source", "rejected_value", "rejected_source", "rule"), ("person_id",)),
    "merge_review": ("merge_review", ("reason", "name_key", "city", "cluster_root", "cluster_size", "score", "detail", "resolved"), ("reason", "name_key")),
    "source_records": ("source_records", ("source_name", "source_row_number", "person_id", "was_used", "repairs", "raw_json"), ("source_name", "source_row_number")),
}


def exports(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of each file: people with their skills, conflicts with their person's name, the rest as stored."""
    people = tables["people"]
    named = tables["person_skills"].join(tables["skills"], "skill_id").groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_list("skill_name")), ", ").alias("skills"))
    own = dict(tables)
    own["people"] = people.join(named, "person_id", "left")
    own["field_conflicts"] = tables["field_conflicts"].join(people.select("person_id", "full_name"), "person_id", "left")
    return {file: own[table].select(*columns) for file, (table, columns, _) in EXPORTS.items()}


def write_exports(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Each file as CSV in order under ``folder``, the issues also as JSON, one a line; what was written."""
    rows = exports(tables)
    for file, (_, _, order) in EXPORTS.items():
        issues.export_csv(rows[file], f"{folder}/{file}_csv", *[issues.severity_rank() if c == "severity" else F.col(c) for c in order])
    issues_in_order = rows["data_issues"].repartitionByRange(issues.severity_rank(), "category").sortWithinPartitions(issues.severity_rank(), "category", "source", "row_number")
    issues_in_order.write.option("ignoreNullFields", False).json(f"{folder}/data_issues_json")
    appendix(tables).repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.text(f"{folder}/appendix_md")
    return [*(f"{file}_csv" for file in EXPORTS), "data_issues_json", "appendix_md"]


# ---------------------------------------------------------------- the appendix

WHOLE = "(whole dataset)"


def _cells(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _code(text: Column) -> Column:
    """In code marks, a dash where there is nothing."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("`"), table_cell(text), F.lit("`"))).otherwise("-")


def _lines(df: DataFrame, section: int, part: int, line: Column, number: Column | None = None, *words: Column) -> DataFrame:
    """(section, part, number, words, line): lines of one part of a section, in order of number, then words, then line."""
    order = F.array(*[F.coalesce(w.cast("string"), F.lit("")) for w in words]).cast("array<string>")
    return df.select(F.lit(section).alias("section"), F.lit(part).alias("part"), (F.lit(0) if number is None else number).cast("long").alias("number"), order.alias("words"), line.alias("line"))


def _table(df: DataFrame, section: int, part: int, title: str, columns: str, rows: DataFrame) -> DataFrame:
    """A section's title, then its rows under a head, or "None." where there are none; ``df`` gives the session."""
    names = columns.split(",")
    head = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    one = df.sparkSession.range(1)
    top = [_lines(one, section, part, F.lit(text), F.lit(i)) for i, text in enumerate([f"## {title}", ""])] if title else []
    some = rows.limit(1).agg(F.count("*").alias("n"))
    top += [_lines(some.where("n > 0"), section, part + 1, F.lit(text), F.lit(i)) for i, text in enumerate(head)]
    none = _lines(some.where("n = 0"), section, part + 1, F.lit("None."))
    end = _lines(one, section, part + 3, F.lit(""))
    return reduce(DataFrame.unionByName, [*top, none, rows, end])


def _row_key(number: Column) -> Column:
    """A whole number as text that sorts as the number does."""
    return F.lpad(F.coalesce(number, F.lit(0)).cast("string"), 19, "0")


def appendix_parts(tables: dict[str, DataFrame]) -> DataFrame:
    """The lines of all sections with what orders them; nothing is collected, rows of any number go through."""
    found, people = tables["data_issues"], tables["people"]
    source = F.coalesce("source", F.lit(WHOLE))
    total = found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn", "info")], F.count("*").alias("n"))
    run = tables["load_runs"].select("source_rows_read", "people_created").crossJoin(total)  # single rows
    summary = F.concat(thousands(F.col("source_rows_read")), F.lit(" rows read, "), thousands(F.col("people_created")), F.lit(" people, "), thousands(F.col("n")), F.lit(" issues ("),
                       thousands(F.col("error")), F.lit(" error, "), thousands(F.col("warn")), F.lit(" warn, "), thousands(F.col("info")), F.lit(" info)"))
    out = [_lines(found.sparkSession.range(1), 0, 0, F.lit("# Data issues")), _lines(run, 0, 1, summary), _lines(found.sparkSession.range(1), 0, 2, F.lit(""))]

    classes = found.groupBy("severity", "category", F.coalesce("field", F.lit("")).alias("field")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    line = _cells(F.col("severity"), _code(F.col("category")), _code(F.col("field")), thousands(F.col("n")), F.col("sources").cast("string"))
    rows = _lines(classes, 1, 2, line, issues.severity_rank(), _row_key(F.lit(10**18) - F.col("n")), F.col("category"), F.col("field"))
    out.append(_table(found, 1, 0, "Every class of issues", "Severity,Category,Field,Count,Sources", rows))

    each = issues.per_source(found)
    line = _cells(_code(source), *[thousands(F.col(c)) for c in ("error", "warn", "info", "total")])
    out.append(_table(found, 2, 0, "Issues of each source", "Source,error,warn,info,total", _lines(each, 2, 2, line, -F.col("total"), source)))

    where = F.when(F.col("row_number").isNotNull(), F.concat(source, F.lit(" row "), F.col("row_number").cast("string"))).otherwise(source)
    line = _cells(table_cell(where), _code(F.col("field")), _code(F.col("raw_value")), table_cell(F.col("description")), table_cell(F.col("action_taken")))
    for i, (severity, title) in enumerate((("error", "Every error"), ("warn", "Every warning"))):
        of = found.where(F.col("severity") == severity)
        rows = _lines(of, 3, 4 * i + 2, line, None, F.col("category"), F.col("source"), _row_key(F.col("row_number")))
        out.append(_table(found, 3, 4 * i, title, "Where,Field,Raw value,Problem,What was done", rows))

    lost = tables["field_conflicts"].join(people.select("person_id", "full_name"), "person_id", "left")
    line = _cells(table_cell(F.col("full_name")), _code(F.col("field")), _code(F.col("chosen_value")), _code(F.col("rejected_value")), table_cell(F.col("rule")))
    out.append(_table(found, 4, 0, "Conflicts of fields", "Person,Field,Kept,Lost,Rule", _lines(lost, 4, 2, line, F.col("person_id"), F.col("field"))))

    review = tables["merge_review"]
    line = _cells(_code(F.col("reason")), table_cell(F.col("name_key")), table_cell(F.col("city")), _code(F.col("cluster_root")), F.col("cluster_size").cast("string"), table_cell(F.col("detail")))
    out.append(_table(found, 5, 0, "Merges that were not made", "Reason,Name,City,Cluster,Rows,Why", _lines(review, 5, 2, line, None, *[F.col(c) for c in ("reason", "name_key", "city", "cluster_root")])))

    outcome = tables["source_records"].groupBy("source_name").agg(F.count("*").alias("n"), F.count_if("was_used").alias("used"), F.count("repairs").alias("repaired"))
    line = _cells(_code(F.col("source_name")), *[thousands(c) for c in (F.col("n"), F.col("used"), F.col("n") - F.col("used"), F.col("repaired"))])
    out.append(_table(found, 6, 0, "Rows of each source", "Source,Rows,Used,Skipped,Repaired", _lines(outcome, 6, 2, line, None, F.col("source_name"))))
    return reduce(DataFrame.unionByName, out)


def appendix(tables: dict[str, DataFrame]) -> DataFrame:
    """(line_no, section, line): the appendix, its lines dense from 1 in order.

    ``tables`` are those of ``load.derived_tables``.  Sections: what the run came to,
    classes of issues, sources, every error and warning, conflicts, merges not made,
    rows of each source.
    """
    return golden.dense(appendix_parts(tables), ["section", "part", "number", "words", "line"], "line_no").select("line_no", "section", "line")
