"""The language cascade, a trainable text detector and the backfill of unknown languages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.language import declared_language, detection_text, is_unknown, normalize_label
from feedloom.functions.text import UNKNOWN
from feedloom.operators.grams import GramCounts

# A detector adds a string column ``label`` computed from the column ``text``.
Detector = Callable[[DataFrame], DataFrame]


def assign_language(rows: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Replace ``declared`` and ``text`` by ``language``: the declared one, else the detector's, else unknown.

    Text of rows with a declared language is blanked first, so the detector has nothing to do for them.
    """
    if detector is None:
        return rows.withColumn("language", F.coalesce("declared", F.lit(UNKNOWN))).drop("declared", "text")
    asked = rows.withColumn("text", F.when(F.col("declared").isNull(), F.col("text")).otherwise(F.lit("")))
    guess = F.when(F.col("text") != "", normalize_label(F.col("label")))
    return (
        detector(asked)
        .withColumn("language", F.coalesce("declared", guess, F.lit(UNKNOWN)))
        .select(*[c for c in rows.columns if c not in ("declared", "text")], "language")
    )


def train_detector(documents: DataFrame, ngram: int = 3, features: int = 1 << 14) -> PipelineModel:
    """Fit a character n-gram model on ``text, lang``; one distributed aggregation per label."""
    labels = StringIndexer(inputCol="lang", outputCol="_label", handleInvalid="skip").fit(documents)
    grams = GramCounts(n=ngram, inputCol="text", outputCol="_features", numFeatures=features)
    bayes = NaiveBayes(
        featuresCol="_features", labelCol="_label", predictionCol="_prediction",
        rawPredictionCol="_raw", probabilityCol="_probability",
    )
    known = labels.transform(documents.where(F.col("lang").isNotNull()))
    names = IndexToString(inputCol="_prediction", outputCol="label", labels=labels.labels)
    # Training needs no texts beside their counts.
    return PipelineModel([grams, bayes.fit(grams.counted(known, ["_label"])), names])


def model_detector(model: PipelineModel) -> Detector:
    """A detector from a fitted model."""
    scratch = ["_features", "_raw", "_probability", "_prediction"]
    return lambda df: model.transform(df).drop(*scratch)


def predictor_detector(load: Callable[[], object]) -> Detector:
    """A detector from any object with ``predict(text, k) -> (labels, scores)``.

    ``load`` runs once per task and batch stream on the executors. A model that cannot be loaded, or fails on a
    text, leaves the label null, hence the language unknown.
    """

    @F.pandas_udf("string")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # noqa: BLE001
            model = None

        def best(text: str | None) -> str | None:
            if model is None or not text:
                return None
            try:
                labels, _ = model.predict(text, k=1)
            except Exception:  # noqa: BLE001
                return None
            return str(labels[0]) if len(labels) else None

        for texts in batches:
            yield texts.map(best).astype(object)

    return lambda df: df.withColumn("label", label("text"))


def backfill_language(
    articles: DataFrame,
    detector: Detector | None = None,
    start_after: str | None = None,
    limit: int | None = None,
    key: str = "article_key",
) -> DataFrame:
    """Articles with unknown languages filled in, plus ``scanned`` and ``updated`` flags per row.

    By default one pass covers the table without a shuffle. ``start_after`` and ``limit`` select a batch of
    unknown rows in key order instead.
    """
    unknown = is_unknown(F.col("language"))
    wanted = unknown if start_after is None else unknown & (F.col(key) > start_after)
    rows = articles
    if limit is not None:
        batch = rows.where(wanted).select(key).orderBy(key).limit(max(1, limit)).withColumn("_in", F.lit(True))
        rows, wanted = rows.join(batch, key, "left"), F.col("_in").isNotNull()
    rows = rows.withColumn("scanned", F.coalesce(wanted, F.lit(False)))
    urls = F.filter(F.array("canonical_url"), lambda u: u.isNotNull())
    country = F.when(F.col("country") != "", F.col("country")).otherwise(F.lit(UNKNOWN))
    asked = rows.withColumnRenamed("language", "_old").select(
        "*",
        F.when(F.col("scanned"), declared_language(country, urls)).otherwise(F.col("_old")).alias("declared"),
        F.when(F.col("scanned"), detection_text(F.col("title"), F.col("summary"))).otherwise(F.lit("")).alias("text"),
    )
    filled = assign_language(asked, detector)
    updated = F.col("scanned") & (F.col("language") != UNKNOWN)
    return filled.select(
        *[c for c in articles.columns if c != "language"],
        F.when(updated, F.col("language")).otherwise(F.col("_old")).alias("language"),
        "scanned",
        updated.alias("updated"),
    )


def backfill_metrics(backfilled: DataFrame, key: str = "article_key") -> DataFrame:
    """Rows scanned and updated, and the last key scanned, to continue after."""
    return backfilled.agg(
        F.count_if("scanned").alias("scanned_count"),
        F.count_if("updated").alias("updated_count"),
        F.max(F.when(F.col("scanned"), F.col(key))).alias("last_id"),
    )
