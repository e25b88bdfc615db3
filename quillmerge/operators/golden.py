"""Golden records: one elected value for each field of a person, every other value kept as a conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmerge import config
from quillmerge.functions.text import looked_up
from quillmerge.sources.scratch import materialise

MEMBER_ORDER = ("source_rank", "row_number", "uid")

#: Fields that come from the first member that has them.
EXCLUSIVE = (
    "experience_years",
    "ctc_annual_inr",
    "ctc_unit_detected",
    "ctc_out_of_range",
    "applied_date",
    "applied_date_ambiguous",
    "applied_date_is_future",
    "rate_hourly_inr",
    "rate_monthly_inr",
    "rate_basis",
    "rate_out_of_range",
    "gig_status",
    "is_verified",
    "projects_completed",
)

#: Flags of a person: nothing found is no, never unknown.  ``is_verified`` is none of them: there unknown is a third state.
FLAGS = ("city_is_region_guess", "ctc_out_of_range", "applied_date_ambiguous", "applied_date_is_future", "rate_out_of_range")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _best(value: str, *order: Column | str) -> Column:
    """The value of the member that comes first in an order, of those that have one."""
    return F.min(F.when(F.col(value).isNotNull(), F.struct(*[_col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v"))))["v"]


def _name() -> Column:
    """Not abbreviated, most words, longest, then the first member's."""
    return _best("full_name", F.col("name_abbreviated"), -F.size(F.split("full_name", " ")), -F.length("full_name"), *MEMBER_ORDER)


def _email() -> Column:
    """No alias, then the first member's."""
    return _best("email", F.col("email_alias_of").isNotNull(), *MEMBER_ORDER)


def elect_names(members: DataFrame) -> DataFrame:
    return members.groupBy("root").agg(_name().alias("full_name"))


def elect_emails(members: DataFrame) -> DataFrame:
    return members.groupBy("root").agg(_email().alias("email"))


def elect_phones(members: DataFrame) -> DataFrame:
    return members.groupBy("root").agg(_best("phone", *MEMBER_ORDER).alias("phone"))


def _city_votes(members: DataFrame) -> DataFrame:
    """(root, city, votes, guessed, seat): the candidates of each person's city."""
    return members.where("city is not null").groupBy("root", "city").agg(F.count("*").alias("votes"), F.min("region_guess").alias("guessed"), F.min(F.struct(*MEMBER_ORDER)).alias("seat"))


def elect_cities(members: DataFrame) -> DataFrame:
    """(root, city, region_guess): the majority; ties to a city not only guessed, then the best source, then the first."""
    return _city_votes(members).groupBy("root").agg(F.min(F.struct((-F.col("votes")).alias("n"), "guessed", "seat", "city")).alias("w")).select("root", "w.city", F.col("w.guessed").alias("region_guess"))


def elect_exclusive(members: DataFrame) -> DataFrame:
    return members.groupBy("root").agg(*[_best(c, *MEMBER_ORDER).alias(c) for c in EXCLUSIVE])


def conflicts(members: DataFrame, elected: DataFrame, field: str) -> DataFrame:
    """(root, field, chosen, rejected): each distinct value of a field that lost its election."""
    values = members.where(F.col(field).isNotNull()).select("root", F.col(field).cast("string").alias("rejected")).distinct()
    chosen = elected.select("root", F.col(field).cast("string").alias("chosen"))
    return values.join(chosen, "root").where("rejected <> chosen").select("root", F.lit(field).alias("field"), "chosen", "rejected")


def _elected(members: DataFrame) -> DataFrame:
    """(root, ref and every elected field but the city): one pass over the members."""
    first = F.min(F.struct(*MEMBER_ORDER, "source"))
    return members.groupBy("root").agg(
        first["uid"].alias("ref"),
        first["source"].alias("first_seen"),
        F.count("*").alias("record_count"),
        F.countDistinct("source").alias("source_count"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        _name().alias("full_name"),
        _email().alias("email"),
        _best("phone", *MEMBER_ORDER).alias("phone"),
        *[_best(c, *MEMBER_ORDER).alias(c) for c in EXCLUSIVE],
    )


#: How a conflict of a field was settled: fixed values.
RULES = {
    "full_name": "prefer the fully spelled name over an initial, then the longest",
    "email": "prefer the primary (non-alias) address, then source priority",
    "phone": "source trust order " + " > ".join(config.SOURCE_PRIORITY),
    "city": "tie broken by preferring a city name over a region label, then by source trust order " + " > ".join(config.SOURCE_PRIORITY),
}
EXCLUSIVE_RULE = "two rows of the same file disagree; kept the earlier row and logged the difference"


def all_conflicts(members: DataFrame) -> DataFrame:
    """(root, field, chosen, chosen_sources, rejected, rejected_sources, rule): every value that lost an election.

    A shared field gives a row for each distinct value, an exclusive one a row for
    each later record that differs from the kept value.  All fields are melted into
    rows, so the members are read once for the values and once for the winners.
    """
    shared = ("full_name", "email", "phone", "city")
    winners = _elected(members).join(elect_cities(members).select("root", "city"), "root", "left")
    melted = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in (*shared, *EXCLUSIVE)])).alias("m")
    held = members.select("root", "source", melted).select("root", "source", "m.*").where("value is not null")
    chosen = winners.select("root", melted).select("root", "m.field", F.col("m.value").alias("chosen")).where("chosen is not null")
    met = held.join(chosen, ["root", "field"])
    exclusive = F.col("field").isin(*EXCLUSIVE)
    by_value = met.where(~exclusive).groupBy("root", "field", "chosen", "value").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n"))
    wins = by_value.where("value = chosen").select("root", "field", F.col("sources").alias("chosen_sources"), F.col("n").alias("top"))
    total = by_value.groupBy("root", "field").agg(F.sum("n").alias("total"), F.max(F.when(F.col("value") != F.col("chosen"), F.col("n"))).alias("next"))
    lost = by_value.where("value <> chosen").join(wins, ["root", "field"]).join(total, ["root", "field"])
    rule = F.when((F.col("field") == "city") & (F.col("top") > F.col("next")), F.format_string("majority vote across sources (%d/%d)", "top", "total"))
    for field, text in RULES.items():
        rule = rule.when(F.col("field") == field, text)
    one = lost.select("root", "field", "chosen", "chosen_sources", F.col("value").alias("rejected"), F.col("sources").alias("rejected_sources"), rule.alias("rule"))
    two = met.where(exclusive & (F.col("value") != F.col("chosen"))).select("root", "field", "chosen", F.concat("source", F.lit(" (first row)")).alias("chosen_sources"), F.col("value").alias("rejected"), F.concat("source", F.lit(" (later row)")).alias("rejected_sources"), F.lit(EXCLUSIVE_RULE).alias("rule"))
    return one.unionByName(two)


def people(members: DataFrame, methods: DataFrame) -> DataFrame:
    """One row for each person: elected fields, the region of the elected city, provenance and confidence."""
    region = looked_up(config.CITY_REGION, F.col("city"))
    out = _elected(members).join(methods, "root").join(elect_cities(members), "root", "left")
    return out.withColumn("region", region)


def with_flags(people_rows: DataFrame) -> DataFrame:
    """``people_rows`` with no null among its flags."""
    return people_rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in FLAGS})


def dense(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with ``name``, dense from 1 in an order that no two rows share.

    Rows are dealt to ranges of the order first; a number is a row's place in its range
    plus the sizes of the ranges before, so no task sorts all rows.
    """
    keyed = rows.withColumn("sort_key", F.struct(*[_col(o).alias(f"k{i}") for i, o in enumerate(order)]))
    dealt = materialise(keyed.repartitionByRange("sort_key").withColumn("part", F.spark_partition_id()), "numbering")
    sizes = dealt.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("sort_key"))
    return dealt.join(F.broadcast(base), "part").withColumn(name, (F.col("base") + place).cast("long")).drop("part", "base", "sort_key")


def numbered(people_rows: DataFrame) -> DataFrame:
    """``people_rows`` with person_id, dense from 1 in order of e-mail, phone, name and ref (null last)."""
    return dense(people_rows, [*[F.coalesce(F.col(c), F.lit("~")) for c in ("email", "phone", "full_name")], "ref"], "person_id")


def person_skills(members: DataFrame) -> DataFrame:
    """(root, skill, sources): the union of the members' skills, with where each was named."""
    each = members.select("root", "source", F.explode("skills").alias("skill"))
    return each.groupBy("root", "skill").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))
