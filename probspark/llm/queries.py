"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, katz, langid, merkle, mixing, negatives, pii, quality, sentencepiece, simhash, urls, vectorcodes
from .common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of neighbouring conversations: one prompt, two masked completions."""
    return chat.format_preferences(chat.neighbours(table(spark, sf_dir, "conversations")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a conditional random field over its words."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality score of every document."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.classify(table(spark, sf_dir, "documents"), labels)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by rule or template."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: pattern spans and what the sequence model adds."""
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and Katz log probabilities of every document."""
    return katz.score(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) within the edit distance, with the place of the match."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of its edited text."""
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: The vocabulary file of the encoder; any file of that kind will do.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with a decoding check of each."""
    return sentencepiece.encode(table(spark, sf_dir, "documents"), PIECES)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error and its label's error of every usable vector, under codebooks trained on all of them."""
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every anchor."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=moved)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document, with its source's size and target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", mixing.words("text").alias("size"), F.array("source").alias("sources"))
    out = mixing.mix(docs, "doc_id", "size", "sources")
    return out.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


def queries() -> dict:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_language_id": op2_language_id,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_url_filters": op4_url_filters,
        "op5_pii": op5_pii,
        "op6_katz_backoff": op6_katz_backoff,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_document_fingerprints": op8_document_fingerprints,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_vector_codes": op11_vector_codes,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_source_mix": op13_source_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.ORACLE, "op8_document_fingerprints": merkle.ORACLE, "op11_vector_codes": vectorcodes.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_source_mix": mixing.ORACLE}
