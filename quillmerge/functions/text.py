"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_WIDTH = "\u200b\ufeff"


def compatible(raw: Column) -> Column:
    """NFKC, null as empty: by the normaliser of the Unicode library that Spark itself ships, for text beyond ASCII only.

    The call counts as indeterminate, so a projection that makes it is never copied
    into later ones: what it gives is computed once.  It can't stand in a lambda.
    """
    text = F.coalesce(raw, F.lit(""))
    whole = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), whole).otherwise(text)


def squeezed(text: Column) -> Column:
    """Zero-width marks dropped, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, ZERO_WIDTH, ""), r"(?U)\s+", " "))


def squash(raw: Column) -> Column:
    """Null as empty, NFKC, zero-width marks dropped, runs of white space to one blank, trimmed."""
    return squeezed(compatible(raw))


def sorted_json(values: Column) -> Column:
    """A map as JSON, keys in order, nulls kept."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))), {"ignoreNullFields": "false"})


def is_blank(raw: Column) -> Column:
    return squash(raw) == ""


def title_token(token: Column) -> Column:
    """Capitalised, also behind ' and -; an initial of up to two characters that ends in a dot is upper-cased."""

    def caps(part: Column) -> Column:
        return F.concat(F.upper(F.substring(part, 1, 1)), F.lower(F.substring(part, F.lit(2), F.length(part))))

    def rejoined(text: Column, mark: str) -> Column:
        return F.array_join(F.transform(F.split(text, mark), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), mark)

    short = (F.length(token) <= 2) & token.endswith(".")
    return F.when(short, F.upper(token)).otherwise(rejoined(rejoined(caps(token), "'"), "-"))


def title_words(squashed: Column) -> Column:
    return F.array_join(F.transform(F.split(squashed, " "), title_token), " ")


def title_case(text: Column) -> Column:
    return title_words(squash(text))


def literal_map(values: dict[str, str]) -> Column:
    quoted = ("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for pair in values.items() for x in pair)
    return F.expr(f"map({', '.join(quoted)})")


def looked_up(values: dict[str, str], key: Column) -> Column:
    """The value of a key in a small vocabulary, null if it has none."""
    return F.try_element_at(literal_map(values), key)
