"""Document fingerprints by a homomorphic multiset hash, in DataFrame expressions only.

A text's paragraphs (lines) are a multiset.  Every paragraph hashes to a wide
vector, and the fingerprint is the sum of the vectors, lane by lane, modulo a
power of two: order plays no part, a paragraph is inserted or deleted by adding or
subtracting its vector, and equal multisets have equal sums.  The vector has two
parts:

* *dense*: lanes of fresh bits of the whole paragraph, modulo 2^32, so that
  different multisets agree with negligible chance,
* *signs*: for each sentence of the paragraph, one random bit in each of ``63 *
  WORDS`` lanes, summed modulo 2^20 (three lanes share a long, with a spare bit each).

The sign lanes of two texts, read as +1 and -1, have the cosine of the two
sentence multisets as their expected cosine, whatever the texts' lengths; that is
the likeness.  Both parts are sums over paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmerge.sources.scratch import materialise

#: 32-bit dense lanes in pairs; 64-bit words of sign bits for each sentence.
DENSE, WORDS = 8, 3
#: Bits from lane to lane, lanes in a long, and the shifts that bring 63 of a hash's bits into lanes.
LANE, PER_LONG = 21, 3
SHIFTS = LANE
#: A lane counts modulo 2^20; its spare bit takes the carry of one addition, and is cleared.
LANE_MASK = (1 << (LANE - 1)) - 1
SPREAD = sum(1 << (LANE * i) for i in range(PER_LONG))
LANES = LANE_MASK * SPREAD
#: Documents that one window partition of the ordering holds, about.
PER_BUCKET = 5000


def paragraphs(text: Column) -> Column:
    """The lines of a text; a null or empty text has one, empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def sentences(text: Column) -> Column:
    """Stretches between full stops (and the like) inside lines; none for a blank text."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?|\\n]+", -1), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, h: a + of(h))


def _hashes(parts: Column, seed: int) -> Column:
    return F.transform(parts, lambda part: F.xxhash64(F.lit(seed), part))


def _sign_lanes(hashes: Column) -> list[Column]:
    spread = F.lit(SPREAD).cast("long")
    none, held = F.lit(0).cast("long"), F.lit(LANES).cast("long")
    return [F.aggregate(hashes, none, lambda a, h: (a + F.shiftrightunsigned(h, s).bitwiseAND(spread)).bitwiseAND(held)) for s in range(SHIFTS)]  # noqa: B023


def with_fingerprints(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``rows`` with a column struct(dense array<long>, n long, signs array<long>) for each {column: text column}.

    The fingerprint is the sum of the paragraphs' vectors.  A dense lane is the sum
    of 32-bit halves of paragraph hashes, kept modulo 2^32; the halves are summed in
    64 bits, so no text of under 2^31 lines overflows.  A sign lane counts the
    sentences whose bit is set, modulo 2^20.  Each step is a projection of its own, so
    that texts are cut and hashed once.
    """
    low = F.lit(0xFFFFFFFF).cast("long")
    rows = rows.withColumns({f"_p_{c}": paragraphs(F.col(t)) for c, t in texts.items()} | {f"_s_{c}": sentences(F.col(t)) for c, t in texts.items()})
    rows = rows.withColumns({f"_d{i}_{c}": _hashes(F.col(f"_p_{c}"), i) for c in texts for i in range(DENSE)} | {f"_w{i}_{c}": _hashes(F.col(f"_s_{c}"), 100 + i) for c in texts for i in range(WORDS)})
    new = {}
    for c in texts:
        dense = [lane.bitwiseAND(low) for i in range(DENSE) for lane in (_total(F.col(f"_d{i}_{c}"), lambda h: h.bitwiseAND(low)), _total(F.col(f"_d{i}_{c}"), lambda h: F.shiftrightunsigned(h, 32)))]
        signs = [lane for i in range(WORDS) for lane in _sign_lanes(F.col(f"_w{i}_{c}"))]
        new[c] = F.struct(F.array(*dense).alias("dense"), F.size(f"_s_{c}").cast("long").alias("n"), F.array(*signs).alias("signs"))
    rows = rows.withColumns(new)
    return rows.drop(*[x for x in rows.columns if x.startswith(("_p_", "_s_", "_d", "_w"))])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together (sign 1), or of a without b (sign -1)."""
    low = F.lit(0xFFFFFFFF).cast("long")
    lanes, spare = F.lit(LANES).cast("long"), F.lit((1 << (LANE - 1)) * SPREAD).cast("long")
    dense = F.zip_with(a["dense"], b["dense"], lambda x, y: (x + sign * y).bitwiseAND(low))
    # the spare bit is lent before a subtraction, so that no lane borrows from the next
    packed = F.zip_with(a["signs"], b["signs"], lambda x, y: ((x + y) if sign > 0 else (x.bitwiseOR(spare) - y)).bitwiseAND(lanes))
    return F.struct(dense.alias("dense"), (a["n"] + sign * b["n"]).alias("n"), packed.alias("signs"))


def as_text(fp: Column) -> Column:
    """The fingerprint as text: dense lanes in hex, then the sign lanes in base 64."""
    wide = F.array_join(F.transform(fp["dense"], lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")
    lanes = F.array_join(F.transform(fp["signs"], lambda v: F.lpad(F.hex(v), 16, "0")), "")
    return F.concat_ws(":", wide, F.regexp_replace(F.base64(F.unhex(lanes)), "[\r\n]", ""))


def _signed(fp: Column) -> Column:
    """The sign lanes as sums of +1 and -1."""
    mask = F.lit(LANE_MASK).cast("long")
    return F.flatten(F.transform(fp["signs"], lambda v: F.array(*[(2 * F.shiftrightunsigned(v, LANE * i).bitwiseAND(mask) - fp["n"]).cast("double") for i in range(PER_LONG)])))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def with_likeness(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with a column for each {column: (fingerprint, fingerprint)}, 0 to 1.

    1 for equal fingerprints, else the cosine of the sign lanes (0 if a text has no sentence).
    """
    own = dict.fromkeys(c for pair in pairs.values() for c in pair)
    rows = rows.withColumns({f"_v_{c}": _signed(F.col(c)) for c in own})
    rows = rows.withColumns({f"_q_{c}": _dot(F.col(f"_v_{c}"), F.col(f"_v_{c}")) for c in own} | {f"_x_{k}": _dot(F.col(f"_v_{a}"), F.col(f"_v_{b}")) for k, (a, b) in pairs.items()})
    zero, new = F.lit(0.0), {}
    for k, (a, b) in pairs.items():
        norm = F.sqrt(F.col(f"_q_{a}") * F.col(f"_q_{b}"))
        cosine = F.when(norm > 0, F.greatest(zero, F.least(F.lit(1.0), F.col(f"_x_{k}") / norm))).otherwise(zero)
        empty = (F.col(a)["n"] == 0) | (F.col(b)["n"] == 0)
        new[k] = F.when(F.col(a)["dense"] == F.col(b)["dense"], F.lit(1.0)).when(empty, zero).otherwise(cosine)
    rows = rows.withColumns(new)
    return rows.drop(*[x for x in rows.columns if x.startswith(("_v_", "_q_", "_x_"))])


def _bucketed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``bucket``: ascending ranges of doc_id of about PER_BUCKET rows, from quantiles of all ids."""
    n = docs.count()
    buckets = min(1 << 16, max(1, n // PER_BUCKET))
    cuts: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * buckets)).alias("q")).first()["q"] or []
        cuts = sorted(set(found))
    # two steps of at most 256 comparisons
    tops, rows = cuts[255::256], [cuts[i : i + 256] for i in range(0, len(cuts), 256)] or [[]]
    below = lambda values: F.size(F.filter(values, lambda c: c <= F.col("doc_id"))) if values is not None else F.lit(0)
    typed = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<long>")
    if len(rows) == 1:
        bucket = below(typed(rows[0]))
    else:
        top = below(typed(tops))
        bucket = top * 256 + F.coalesce(below(F.get(F.array(*[typed(r) for r in rows]), top)), F.lit(0))
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(bucket))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the next, in order of doc_id (ties: of text), the last with the first's.

    The order is cut into ranges; a range is sorted by itself and its last row
    takes the first row of the next range, of which there is one for each range.
    """
    dealt = _bucketed(docs.select("doc_id", "text"))
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    first = dealt.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", F.col("text").isNotNull(), "text")).alias("head"))
    first = materialise(first.select("bucket", F.col("head.text").alias("head")), "range-heads")
    turn = Window.orderBy("bucket")  # a row per range
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = first.select("bucket", F.coalesce(F.lead("bucket").over(turn), F.first("bucket").over(whole)).alias("then"))
    heads = after.join(first.select(F.col("bucket").alias("then"), "head"), "then").select("bucket", "head")
    led = dealt.select("bucket", "doc_id", "text", F.lead("text").over(order).alias("following"), F.lead(F.lit(True)).over(order).alias("inside"))
    return led.join(heads, "bucket").select("doc_id", "text", F.when(F.col("inside"), F.col("following")).otherwise(F.col("head")).alias("next_text"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness, one row per row of ``docs``.

    The edited text ends with the beginning of the next document in place of its
    own last half.  A null text counts as empty: n_chars 0, likeness to an equal
    (empty) text 1 and to any other 0.
    """
    rows = with_next(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("next_text", F.lit("")).alias("next_text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    whole = rows.select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    hashed = with_fingerprints(whole.withColumn("edited_sha256", F.sha2("edited", 256)), {"own": "text", "changed": "edited", "after": "next_text"})
    alike = with_likeness(hashed.drop("text", "edited", "next_text"), {"near_edited": ("own", "changed"), "near_next": ("own", "after")})
    return alike.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
