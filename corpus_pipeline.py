"""A corpus pipeline: toxicity, near-duplicates, decontamination, personal data, SentencePiece segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontam, pii, sentencepiece_nbest, simhash, toxicity
from tidewell.llm.common import materialize, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the lexicon scores 0.5 or more; rows of null text stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that of the least doc_id, then of the least digest; a null doc_id comes last."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows of which test items cover a twentieth of the words or more; cuts spans of more than 13 words from the others."""
    return decontam.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in the place of each span; n_chars follows. All rows stay."""
    return pii.redact_pii(docs)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentation of each text: doc_id, text as decoded from it, piece_ids, score, and how far the next one falls behind.

    Null and empty texts have no ids and a null score.
    """
    ways = sentencepiece_nbest.segment_texts(docs)
    best, second = F.get("ways", F.lit(0)), F.get("ways", F.lit(1))
    return ways.select("doc_id", F.col("decoded").alias("text"), F.col("ids").alias("piece_ids"), best["score"].alias("score"), (best["score"] - second["score"]).alias("margin"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("sentencepiece", segmented),
]

#: SimHash, automaton, checksum and lattice stages aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
