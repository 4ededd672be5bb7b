"""Quality classification by co-training.

Two views of a document are learned apart: its words, and its metadata (source, language, size and layout). In each round
either classifier labels the unlabelled documents it is sure of, for the other one to learn from. At the end both are
calibrated on labelled documents that neither has seen, and their log odds are averaged for every document.

Training uses bounded samples, the documented parameters of :func:`score_quality`; scoring covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored, unused

#: Hash bins of words and of metadata.
WORD_BINS, META_BINS = 1 << 13, 1 << 8
ROUNDS = 3
#: Rows of the samples: labelled documents, and documents for exchanged labels; and how sure a label must be.
LABELLED_ROWS, POOL_ROWS, SURE = 20_000, 20_000, 0.95


def _views(docs: DataFrame) -> DataFrame:
    """``docs`` with vectors ``content`` and ``meta``."""
    text = F.coalesce("text", F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")) / size

    rows = docs.select(
        "*", F.split(F.lower(text), r"\s+").alias("_words"), F.log(size).alias("_size"),
        F.log(F.lit(1) + F.size(F.split(text, "\n"))).alias("_lines"), share(r"[^\p{Lu}]+").alias("_upper"),
        share(r"[\p{L}\p{N}\s.,]+").alias("_signs"), share(r"[^0-9]+").alias("_digits"),
        F.coalesce("source", F.lit("?")).alias("_source"), F.coalesce("lang", F.lit("?")).alias("_lang"),
    )
    stages = [
        HashingTF(inputCol="_words", outputCol="content", numFeatures=WORD_BINS, binary=True),
        FeatureHasher(inputCols=["_source", "_lang"], outputCol="_names", numFeatures=META_BINS),
        VectorAssembler(inputCols=["_size", "_lines", "_upper", "_signs", "_digits", "_names"], outputCol="meta"),
    ]
    return PipelineModel(stages).transform(rows).drop("_words", "_size", "_lines", "_upper", "_signs", "_digits", "_source", "_lang", "_names")


@dataclass
class View:
    """A view's classifier and its calibration: probability = sigmoid(slope * margin + shift)."""

    model: LogisticRegressionModel
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, features: str) -> tuple[LogisticRegressionModel, str]:
        model = self.model.copy().setFeaturesCol(features).setRawPredictionCol(f"_raw_{features}")
        return model.setProbabilityCol("").setPredictionCol(""), f"_raw_{features}"


def _margin(rows: DataFrame, view: View, features: str) -> DataFrame:
    model, raw = view.log_odds(features)
    return model.transform(rows).withColumn(f"{features}_margin", vector_to_array(raw)[1]).drop(raw)


def _fit(rows: DataFrame, features: str) -> View:
    return View(LogisticRegression(featuresCol=features, labelCol="label", maxIter=25, regParam=0.01).fit(rows))


def _calibrate(view: View, rows: DataFrame, features: str) -> View:
    """Platt scaling on labelled rows that the model was not fitted on."""
    scored = VectorAssembler(inputCols=[f"{features}_margin"], outputCol="_m").transform(_margin(rows, view, features))
    fit = LogisticRegression(featuresCol="_m", labelCol="label", maxIter=25, regParam=1e-4).fit(scored)
    return View(view.model, float(fit.coefficients[0]), float(fit.intercept))


def _sample(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest hashed ids: a sample that is the same in every run."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(limit)


def cotrain(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS,
            rounds: int = ROUNDS, sure: float = SURE) -> tuple[View, View] | None:
    """Calibrated content and metadata views, or None if the labels do not show both classes.

    Of ``labels`` (``doc_id``, ``quality``) null ones are left out, and the larger of contradicting ones counts.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    ids = stored(_sample(known, labelled_rows))
    pool_ids = _sample(docs.select("doc_id").where("doc_id is not null").distinct().join(known, "doc_id", "left_anti"), pool_rows)
    ids = stored(ids.unionByName(pool_ids.withColumn("label", F.lit(None).cast("double"))))
    # At most labelled_rows + pool_rows ids of 16 bytes.
    picked = docs.join(F.broadcast(ids), "doc_id")
    once = picked.groupBy("doc_id").agg(F.min(F.xxhash64(*docs.columns)).alias("_row"))  # of rows sharing an id always the same one
    (row,) = unused(docs, "_row")
    picked = picked.withColumn(row, F.xxhash64(*docs.columns)).join(once.withColumnRenamed("_row", row), ["doc_id", row], "left_semi")
    picked = picked.dropDuplicates(["doc_id"])
    rows = stored(_views(picked).select("doc_id", "label", "content", "meta", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0).alias("held")))
    train, held = rows.where("label is not null and not held"), rows.where("label is not null and held")
    if train.select("label").distinct().count() < 2 or held.select("label").distinct().count() < 2:
        return None
    pool = rows.where("label is null")
    content, meta = _fit(train, "content"), _fit(train, "meta")
    taught: dict[str, DataFrame] = {}
    for _ in range(rounds):
        scored = pool
        for features, view in (("content", content), ("meta", meta)):
            scored = _margin(scored, view, features)
        limit = F.log(F.lit(sure / (1 - sure)))
        for teacher, pupil in (("content", "meta"), ("meta", "content")):
            margin = F.col(f"{teacher}_margin")
            said = scored.where(F.abs(margin) >= limit).select("doc_id", (margin > 0).cast("double").alias("label"), "content", "meta")
            taught[pupil] = stored(said)
        content = _fit(train.select("label", "content").unionByName(taught["content"].select("label", "content")), "content")
        meta = _fit(train.select("label", "meta").unionByName(taught["meta"].select("label", "meta")), "meta")
    return _calibrate(content, held, "content"), _calibrate(meta, held, "meta")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings: float) -> DataFrame:
    """``doc_id``, ``content_score``, ``meta_score``, ``score`` (0 to 1) and ``good`` (``score >= threshold``) of every row.

    Null texts and metadata are classes of their own. Without labels of both classes all scores are 0.5.
    """
    docs = docs.select("doc_id", "text", "lang", "source")
    views = cotrain(docs, labels, **settings)
    if views is None:
        half = [F.lit(0.5).alias(c) for c in ("content_score", "meta_score", "score")]
        return docs.select("doc_id", *half, F.lit(0.5 >= threshold).alias("good"))
    rows = _views(docs)
    odds = []
    for features, view in zip(("content", "meta"), views, strict=True):
        rows = _margin(rows, view, features)
        odds.append(F.col(f"{features}_margin") * view.slope + view.shift)

    def chance(x: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))

    score = chance((odds[0] + odds[1]) / 2)
    return rows.select("doc_id", chance(odds[0]).alias("content_score"), chance(odds[1]).alias("meta_score"), score.alias("score"), (score >= threshold).alias("good"))
