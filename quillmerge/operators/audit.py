"""Checks of a whole dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmerge import config
from quillmerge.sources.scratch import materialise


def domain_counts(people: DataFrame) -> DataFrame:
    return people.where("email is not null").groupBy(F.substring_index("email", "@", -1).alias("domain")).agg(F.count("*").alias("n"))


def is_reserved(domain: Column) -> Column:
    """Whether a domain is set aside for documentation and tests."""
    test = F.lit(False)
    for d in config.RESERVED_DOMAINS:
        test = test | (domain == d) | domain.endswith(d if d.startswith(".") else "." + d)
    return test


def reserved_domains(people: DataFrame) -> DataFrame:
    """(reserved, total): addresses at domains set aside for examples, sub-domains included."""
    return people.agg(F.count_if(is_reserved(F.substring_index("email", "@", -1))).alias("reserved"), F.count("email").alias("total"))


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, n): exact, the mean of the two middle values where their number is even; null values play no part.

    Equal values are counted first.  The distinct ones are dealt to ranges of
    (group, value) and summed up range by range, so that a group of any size is never
    in one task.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    dealt = materialise(counted.repartitionByRange("g", "v").sortWithinPartitions("g", "v").withColumn("part", F.spark_partition_id()), "value-counts")
    held = dealt.groupBy("g", "part").agg(F.sum("c").alias("held"))  # a row for each group of each range
    by_part = Window.partitionBy("g").orderBy("part")
    base = held.select("g", "part", "held", F.sum("held").over(by_part).alias("top"), F.sum("held").over(Window.partitionBy("g")).alias("n"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = base.select(F.col("g").alias("of"), F.col("part").alias("at"), (F.col("top") - F.col("held")).alias("base"), "top", "n").where((F.col("base") <= high) & (F.col("top") > low))
    running = dealt.join(middle, F.col("g").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    place = Window.partitionBy("g", "part").orderBy("v")
    upto = running.withColumn("upto", F.col("base") + F.sum("c").over(place))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    return upto.groupBy(F.col("g").alias(group)).agg(((at(low) + at(high)) / 2).alias("median"), F.first("n").alias("n"))


def median_by(df: DataFrame, basis: str, value: str) -> DataFrame:
    return medians(df, basis, value).withColumnRenamed(basis, "basis").select("basis", "median", "n")


def outliers(df: DataFrame, group: str, value: str, key: str, factor: float = config.OUTLIER_FACTOR) -> DataFrame:
    """(group, key, value, median): values over ``factor`` times their group's median, or under its share."""
    there = df.select(group, key, value).join(medians(df, group, value).select(group, "median"), group)
    return there.where((F.col(value) > factor * F.col("median")) | (F.col(value) < F.col("median") / factor))


def key_coverage(people: DataFrame) -> DataFrame:
    e, p = F.col("email").isNull(), F.col("phone").isNull()
    return people.agg(F.count("*").alias("people"), F.count_if(e).alias("no_email"), F.count_if(p).alias("no_phone"), F.count_if(e & p).alias("neither"))


def trust_violations(people: DataFrame, least: int = config.PROJECTS_TRUST) -> DataFrame:
    """People of many projects who are known to be unverified, those of most projects first."""
    found = people.where((F.col("projects_completed") >= least) & (F.col("is_verified") == F.lit(False)))
    return found.orderBy(F.desc("projects_completed"), "root")


def skill_agreement(members: DataFrame) -> DataFrame:
    """(root, only_a, only_b): people whom two sources describe with different skills; a source that names none tells nothing."""
    named = members.where("size(skills) > 0").groupBy("root", "source").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("skills")))).alias("s"))
    a = named.where("source = 'naukri'").select("root", F.col("s").alias("a"))
    b = named.where("source = 'gig'").select("root", F.col("s").alias("b"))
    both = a.join(b, "root")
    return both.select("root", F.array_join(F.array_except("a", "b"), ", ").alias("only_a"), F.array_join(F.array_except("b", "a"), ", ").alias("only_b")).where("only_a <> '' or only_b <> ''")


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(value, n): values of a key that should be unique and is not."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n")).where("n > 1")
