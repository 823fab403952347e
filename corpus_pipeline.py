"""The corpus pipeline: language ID, line dedup, near-dedup by shingle Jaccard, best-fit packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import language_id, line_dedup, near_copies, packing
from tidewatch.llm.queries import vocabulary
from tidewatch.llm.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language scores less than this (a guess among four scores 0.25) are rejected.
LEAST_SCORE = 0.3
#: Documents less than this share of whose three-character places occur in any learned language's landmarks are rejected: other
#: scripts and noise have 0 to 0.1, documents of a learned language 0.75 and more, 0.24 at least where numbers and keys make up most of one.
LEAST_KNOWN = 0.2
#: Words a shingle.
SHINGLE = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a known language; rejects those without text or letters, of no clear language, or in a script or
    language that none of the learned ones is like."""
    found = language_id.identify(docs.select(*COLUMNS), language_id.fit(docs))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & (F.col("known") >= LEAST_KNOWN)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated multi-line chunks. A document all of whose text has gone goes too, one
    that was empty before stays."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    kept = out.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return kept.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long").alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a shingle Jaccard of 0.8 or more (SimHash candidates first, then MinHash bands for those
    beyond its reach, all verified by whole sets): that with the smallest doc_id (null ids after
    all others). Documents are told apart by id and text together, so rows that share an id are each kept or not by their
    own text."""
    return near_copies.one_of_each(docs.select(*COLUMNS), shingle=SHINGLE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row per piece of a document."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("simhash_near_dedup", dedup_near), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
