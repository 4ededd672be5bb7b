"""The registered queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, chosenpath, cotrain, decontaminate, langid, lzprint, mixing, permuterm, quotes, runs, secrets, suffix, tokens
from feedloom.llm.common import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES", "TOKENIZER"]

TOKENIZER = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


@query("op3_phrase_fingerprint")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.fingerprints(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op7_mix_sources")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op9_near_duplicates", chosenpath.SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op5_decontamination", decontaminate.SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_secret_scan")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query("op8_substring_dedup", suffix.SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_bytes(table(spark, sf_dir, "documents"))


@query("op2_quote_linking", quotes.SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(quotes.quoting_replies(table(spark, sf_dir, "conversations")))


@query("op10_quality")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_spelling_variants", permuterm.SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permuterm.spelling_forms(permuterm.corpus_words(table(spark, sf_dir, "documents")))


@query("op12_periodic_runs", runs.SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(table(spark, sf_dir, "documents"))


@query("op13_bpe_round_trip")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))
