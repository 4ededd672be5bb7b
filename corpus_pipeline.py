"""From raw documents to a training mix: language, near duplicates, benchmark passages, secrets, source weights.

Each stage takes what the one before kept, from a table written in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import chosenpath, decontaminate, langid, mixing, secrets
from feedloom.llm.common import small_side, stored, table, unused
from feedloom.session import configure

#: Cosine below which a text is in none of the learned languages.
LEAST_LIKENESS = 0.1
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language learned from the declared ones; all, if none is declared."""
    prototypes = langid.train(docs)
    if not prototypes:
        return docs
    found = langid.predict(docs, prototypes)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LIKENESS)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near duplicates. Rows that share an id are one document."""
    found = stored(chosenpath.near_duplicates(docs, NEAR_PERCENT))
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    ids = stored(ids.where("n > 1 or not kept"))
    left = docs.join(small_side(ids.where("not kept").select("doc_id"), 16), "doc_id", "left_anti")
    if not ids.where("kept").head(1):
        return left.select(docs.columns)
    again = stored(ids.where("kept").select("doc_id"))
    whole = F.struct(*docs.columns)
    first = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(first.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and the number of characters counted anew where known."""
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind))).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``copies``, ``taken`` words and their source's ``target``."""
    rows = stored(docs.select("doc_id", F.xxhash64("text").alias("_print"), "source", mixing.words().alias("size")))
    targets = mixing.source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    id_, hash_ = unused(docs, "_id", "_print")
    taken = mixing.mix(rows, targets).where("taken > 0").groupBy(F.col("doc_id").alias(id_), F.col("_print").alias(hash_))
    mixed = stored(taken.agg(F.max("target").alias("target"), F.max("taken").alias("taken"), F.max((F.col("taken") / F.col("size")).cast("long")).alias("copies")))
    columns = [c for c in docs.columns if c not in ("target", "taken", "copies")]
    docs = docs.select(columns)
    same = docs["doc_id"].eqNullSafe(mixed[id_]) & F.xxhash64(docs["text"]).eqNullSafe(mixed[hash_])
    return docs.join(small_side(mixed, 48), same).select(*columns, "target", "taken", "copies")


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return stored(STAGES[-1][1](spark, docs, sf_dir))


#: Profiles of random vectors are not SQL; the run is tested against a brute-force version instead.
ORACLE_SQL = None
