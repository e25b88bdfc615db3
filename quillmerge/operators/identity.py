"""Identity resolution: shared e-mails and phones link, then guarded name-and-city merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmerge import config
from quillmerge.operators.components import connected_components
from quillmerge.operators.forest import SMALL, minimum_forest
from quillmerge.sources.scratch import materialise


def place() -> Column:
    """A record's place in the list of all records: sources in their order, rows as numbered."""
    rank = F.array_position(F.array(*[F.lit(s) for s in config.SOURCE_ORDER]), F.col("source"))
    return F.struct(rank.alias("source_place"), F.col("row_number").alias("row_number"), F.col("uid").alias("uid"))


def first_of_key(records: DataFrame, key: str) -> DataFrame:
    """(key, anchor): the first record of each key, by place."""
    return records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("place").alias("anchor"))


def star_edges(records: DataFrame, key: str) -> DataFrame:
    """(src, dst, value, bucket, place): every usable record with its key's first one; linear in the records, whatever a key's size.

    ``bucket`` is the place of the first record: in its order keys come up in the list.
    """
    there = records.where(F.col("usable") & F.col(key).isNotNull()).select("uid", key, place().alias("place"))
    linked = there.join(first_of_key(there, key), key).where("uid <> anchor.uid")
    return linked.select(F.col("anchor.uid").alias("src"), F.col("uid").alias("dst"), F.col(key).alias("value"), F.col("anchor").alias("bucket"), "place")


def _by_email(records: DataFrame) -> DataFrame:
    """(uid, label, phone, place) of the usable records; label: the smallest uid of the e-mail, or the record's own."""
    there = records.where("usable").select("uid", "email", "phone", place().alias("place"))
    least = there.where("email is not null").groupBy("email").agg(F.min("uid").alias("least"))
    return there.join(least, "email", "left").select("uid", F.coalesce("least", "uid").alias("label"), "phone", "place")


def strong_clusters(records: DataFrame) -> DataFrame:
    """(uid, root) of the usable records: linked by equal e-mail or phone, root the smallest uid.

    Records of one e-mail are a cluster as they stand; phones link these, and only such
    links as join two of them need components.
    """
    labelled = materialise(_by_email(records), "labels")
    phones = labelled.where("phone is not null").groupBy("phone").agg(F.min("label").alias("first"))
    edges = labelled.join(phones, "phone").where("label <> first").select(F.col("first").alias("src"), F.col("label").alias("dst"))
    linked = connected_components(edges, small=SMALL)
    return labelled.join(linked, F.col("label") == F.col("node"), "left").select("uid", F.coalesce("component", "label").alias("root"))


def effective_links(records: DataFrame, small: int = SMALL) -> DataFrame:
    """(src, dst, field, value): the links that joined two clusters when taken in order.

    E-mails come before phones, keys in order of their first record, records in order of
    their place, each with its key's first.  A record has one e-mail, so all e-mail links join;
    of the phone links those in the minimum spanning forest over the e-mails' clusters.
    """
    emails = star_edges(records, "email").select("src", "dst", F.lit("email").alias("field"), "value")
    label = materialise(_by_email(records), "labels")
    of = lambda end, name: label.select(F.col("uid").alias(end), F.col("label").alias(name))
    phones = star_edges(records, "phone").join(of("src", "a"), "src").join(of("dst", "b"), "dst")
    ranked = phones.select("a", "b", F.struct("bucket", "place").alias("rank"), "src", "dst", "value")
    joined = minimum_forest(ranked, "rank", small)
    return emails.unionByName(joined.select("src", "dst", F.lit("phone").alias("field"), "value"))


def name_city_groups(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per (name_key, city): its clusters, with whether they hold e-mails and phones."""
    keyed = records.join(clusters, "uid")  # usable records only
    facts = keyed.groupBy("root").agg(F.max(F.col("email").isNotNull()).alias("has_email"), F.max(F.col("phone").isNotNull()).alias("has_phone"), F.count("*").alias("size"))
    eligible = keyed.where("usable and name_key is not null and city is not null").select("name_key", "city", "root").distinct()
    joined = eligible.join(facts, "root")
    n = joined.groupBy("name_key", "city").agg(F.count("*").alias("clusters"), F.sum(F.col("has_email").cast("int")).alias("with_email"), F.sum(F.col("has_phone").cast("int")).alias("with_phone"), F.min("root").alias("first"), F.max("root").alias("last"), F.sum("size").alias("size"))
    return n.where("clusters >= 2")


def weak_decisions(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each (name_key, city) of several clusters with its verdict: ambiguous, conflict or merge."""
    verdict = F.when(F.col("clusters") > 2, "ambiguous_name_city").when((F.col("with_email") == 2) | (F.col("with_phone") == 2), "same_name_conflicting_strong_key").otherwise("merge")
    return name_city_groups(records, clusters).withColumn("verdict", verdict)


def weak_merges(decisions: DataFrame) -> DataFrame:
    return decisions.where("verdict = 'merge'").select("name_key", "city", F.col("first").alias("src"), F.col("last").alias("dst"))


def representatives(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """(root, source, row_number): the first usable record with name and city of each cluster."""
    named = records.where("usable and name_key is not null and city is not null").select("uid", F.struct(place().alias("place"), "source", "row_number").alias("r"))
    return named.join(clusters, "uid").groupBy("root").agg(F.min("r").alias("r")).select("root", "r.source", "r.row_number")


def merge_reviews(records: DataFrame, clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """(reason, name_key, city, root, size): one row for each cluster of an ambiguous name, one for each conflict."""
    members = records.join(clusters, "uid")
    sizes = members.groupBy("root").count()
    eligible = members.where("usable and name_key is not null and city is not null").select("name_key", "city", "root").distinct()
    ambiguous = decisions.where("verdict = 'ambiguous_name_city'").select("name_key", "city", F.col("verdict").alias("reason"))
    each = eligible.join(ambiguous, ["name_key", "city"]).join(sizes, "root").select("reason", "name_key", "city", "root", F.col("count").alias("size"))
    conflicts = decisions.where("verdict = 'same_name_conflicting_strong_key'").select(F.col("verdict").alias("reason"), "name_key", "city", F.concat_ws(" | ", "first", "last").alias("root"), "size")
    return each.unionByName(conflicts)


def with_details(reviews: DataFrame, records: DataFrame, clusters: DataFrame, shown: int = 3) -> DataFrame:
    """``reviews`` with score (0: no merge was weighed), detail and resolved (false).

    The detail of a conflict names the first ``shown`` e-mails, or phones, of either
    cluster; a cluster may hold any number of them.
    """
    apart = F.col("reason") == "same_name_conflicting_strong_key"
    ends = reviews.where(apart).select(F.explode(F.split("root", r" \| ")).alias("end")).distinct()
    held = records.join(clusters, "uid").join(ends, F.col("root") == F.col("end"), "left_semi")
    keys = held.select("root", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("email", "phone")])).alias("k")).select("root", "k.*").where("value is not null").distinct()
    first = keys.withColumn("rn", F.row_number().over(Window.partitionBy("root", "kind").orderBy("value"))).where(F.col("rn") <= shown)  # cut before the shuffle
    told = first.groupBy("root").pivot("kind", ["email", "phone"]).agg(F.array_join(F.array_sort(F.collect_list("value")), ", "))
    of = lambda side: told.select(F.col("root").alias(f"root_{side}"), F.col("email").alias(f"email_{side}"), F.col("phone").alias(f"phone_{side}"))
    two = reviews.where(apart).withColumns({"root_a": F.substring_index("root", " | ", 1), "root_b": F.substring_index("root", " | ", -1)}).join(of("a"), "root_a", "left").join(of("b"), "root_b", "left")
    differ = lambda name, kind: F.format_string(f"same name and city, other {name}: %s; %s", f"{kind}_a", f"{kind}_b")
    detail = F.when((F.col("email_a") != "") & (F.col("email_b") != ""), differ("e-mails", "email")).otherwise(differ("phones", "phone"))
    many = reviews.where(~apart).withColumn("detail", F.concat(F.lit("one of several clusters of "), "name_key", F.lit(" in "), "city"))
    out = many.unionByName(two.select(*reviews.columns, detail.alias("detail")))
    return out.withColumns({"score": F.lit(0.0), "resolved": F.lit(False)})


def resolve(records: DataFrame) -> DataFrame:
    """The usable ``records`` with strong_root and root: the cluster after the strong links, and after the weak merges.

    A record that is not usable is nobody: it links with nothing and is left out.
    Weak merges are decided on the strong clusters and applied together, so that two
    of them may chain.
    """
    records = materialise(records, "records")
    strong = materialise(strong_clusters(records), "strong")
    merges = weak_merges(weak_decisions(records, strong))
    weak = connected_components(merges, small=SMALL).withColumnRenamed("node", "strong_root")
    rooted = records.join(strong.withColumnRenamed("root", "strong_root"), "uid").join(weak, "strong_root", "left")
    return materialise(rooted.withColumn("root", F.coalesce("component", "strong_root")).drop("component"), "resolved")


def match_methods(resolved: DataFrame) -> DataFrame:
    """(root, methods, confidence): how a cluster's records came together.

    exact_email: an e-mail occurs twice; exact_phone: a strong cluster spans several
    e-mail groups (a record without e-mail is its own); name_city_weak: several
    strong clusters.
    """
    email_group = F.coalesce(F.col("email"), F.concat(F.lit("uid:"), F.col("uid")))
    # an e-mail group is a component of e-mail links alone: records of one e-mail
    by_strong = resolved.groupBy("root", "strong_root").agg(F.countDistinct(email_group).alias("groups"), (F.count("email") > F.countDistinct("email")).alias("twice"))
    by_root = by_strong.groupBy("root").agg(F.max("twice").alias("email"), F.max(F.col("groups") > 1).alias("phone"), (F.count("*") > 1).alias("weak"))
    found = F.filter(F.array(F.when(F.col("email"), "exact_email"), F.when(F.col("phone"), "exact_phone"), F.when(F.col("weak"), "name_city_weak")), lambda m: m.isNotNull())
    methods = F.when(F.size(found) == 0, F.array(F.lit("single_source"))).otherwise(found)
    return by_root.select("root", F.array_join(methods, ",").alias("methods"), F.when(F.col("weak"), 0.6).otherwise(1.0).alias("confidence"))


def homonyms(resolved: DataFrame) -> DataFrame:
    """(name_key, people, cities): names that several people bear, by records with name and city; cities of all their records."""
    named = resolved.where("usable and name_key is not null and city is not null").select("name_key", "root").distinct()
    shared = named.groupBy("name_key").agg(F.count("*").alias("people")).where("people > 1")
    lived = resolved.where("city is not null").select("root", "city").distinct()
    cities = named.join(shared, "name_key").join(lived, "root").select("name_key", "people", "city").distinct()
    return cities.groupBy("name_key", "people").agg(F.array_join(F.array_sort(F.collect_list("city")), ", ").alias("cities"))


def duplicates_within_source(records: DataFrame, keys: tuple[str, ...] = ("email", "phone"), carry: str | None = None) -> DataFrame:
    """(source, field, value, row_number, first_row): later rows of one source that repeat a key.

    With ``carry``, also that column of the row and of the first one.
    """
    out = None
    for key in keys:
        there = records.where(F.col(key).isNotNull()).select("source", F.col(key).alias("value"), "row_number", *([F.col(carry).alias("own")] if carry else []))
        first = there.groupBy("source", "value").agg(F.min(F.struct("row_number", *(["own"] if carry else []))).alias("f"), F.count("*").alias("n")).where("n > 1")
        one = there.join(first, ["source", "value"]).where("row_number > f.row_number")
        one = one.select("source", F.lit(key).alias("field"), "value", "row_number", F.col("f.row_number").alias("first_row"), *([F.col("own").alias(carry), F.col("f.own").alias(f"first_{carry}")] if carry else []))
        out = one if out is None else out.unionByName(one)
    return out


def cross_source_links(records: DataFrame, small: int = SMALL) -> DataFrame:
    """(src, dst, field, value, source, row_number): effective links between records of different sources; the row is the later record's."""
    edges = effective_links(records, small)
    a = records.select(F.col("uid").alias("src"), F.col("source").alias("src_source"))
    b = records.select(F.col("uid").alias("dst"), "source", "row_number")
    return edges.join(a, "src").join(b, "dst").where("src_source <> source").select("src", "dst", "field", "value", "source", "row_number")
