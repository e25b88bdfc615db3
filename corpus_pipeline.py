"""A cleaning pipeline over ``documents``: five stages, each written as Parquet and read again.

Every stage gets what its predecessor kept.  All but the last return the columns
of ``documents`` (``n_chars`` follows the text); the last one returns the encoded
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmerge.llm import decontam, line_dedup, pieces, similar, toxicity
from quillmerge.llm.queries import PIECES, vocabulary
from quillmerge.sources.scratch import materialise

#: Toxicity learns, and line dedup finds frequent lines, in what the stage itself is given.
LINE_MIN_DOCS = 10


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names renamed, and how to name them back."""
    own = {c: f"{c}_of_docs" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(own), {new: old for old, new in own.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5, row by row; a null or empty text is scored as empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.Settings())
    plain, back = set_aside(docs, "toxicity")
    return toxicity.score(plain, model, out_col="toxicity").where("toxicity < 0.5").drop("toxicity").withColumnsRenamed(back)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; every row stays, and its n_chars, if there is one, follows the text."""
    plain, back = set_aside(docs, "n_lines", "n_dropped")
    kept = line_dedup.drop_frequent_lines(plain, min_docs=LINE_MIN_DOCS, min_chars=1).drop("n_lines", "n_dropped").withColumnsRenamed(back)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash candidates and MinHash ones for the rest, linked at Jaccard 0.8 or more of five-word shingles."""
    return similar.keep_one(docs, width=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, exact): the pieces of each text, decoded again and compared."""
    trip = pieces.round_trip(docs, pieces.Pieces.load(vocabulary(PIECES)))
    return trip.select("doc_id", "n_pieces", "ids", "exact")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: A trained model decides in the first stage, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
