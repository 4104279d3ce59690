"""From raw documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, lines, near, packing, winnow
from tidemark.llm.common import held_out, table
from tidemark.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with all their columns; texts that are missing or without a letter go.

    The automata learn from the labelled two thirds of these documents; every document is judged by its text alone.
    """
    samples = langid.labelled_sample(docs.where(~held_out(F.col("doc_id"), 3)).select("doc_id", "text", "lang"))
    return langid.identify(docs, samples).where("lang_pred <> 'und'").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat or resemble an earlier one; what keeps no line at all goes.

    ``n_chars`` follows the text; blank and missing texts, which lose nothing, stay as they are.
    """
    cut = lines.drop_similar_lines(docs)
    kept = cut.where("n_removed = 0 or text rlike '\\\\S'")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number ``row`` of each row's own, written once, so that it stays the same in all that is derived from it."""
    return materialize(docs.withColumn("row", F.monotonically_increasing_id()), f"pipeline-{name}-rows")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row by id, then hash of the text, of each group of near-duplicates; rows are told apart by number, whatever their ids.

    Near-duplicates have a Jaccard similarity of 0.8 or more over five-word shingles. SimHash fingerprints of these find those that differ
    in 2 bits or fewer, bands those that differ in more (see ``near``).
    """
    rows = numbered(docs, "simhash")
    found = near.groups(rows)
    named = rows.select("row", "doc_id", F.xxhash64("text").alias("text")).join(found, "row")
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "text", "row"))["row"].alias("row"))
    return rows.join(first, "row", "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words, or a whole shorter text, of ``benchmark``; every row is judged by its own text."""
    rows = numbered(docs, "decontamination")
    found = winnow.decontaminate(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("row"))
    return rows.join(bad, "row", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of token sequences, one row per piece."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("packing", pack)]

#: SimHash, MinHash, suffix automata, XXH64 and the genetic packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
