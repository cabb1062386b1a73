"""Pair classifiers: boosted trees with calibrated margins, a perceptron, cross-validation and selection."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import CORE, feature_digest
from .metrics import binary_metrics, select_rule

#: Trees' depth, step and number (the grid's axes).
GRID = ((3, 0.05), (3, 0.1), (4, 0.05), (4, 0.1))


def assembled(df: DataFrame, names=CORE) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="x", handleInvalid="error").transform(df)


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 0, key: str = "pair_id") -> DataFrame:
    """``fold`` by hash order within each label, so that folds repeat."""
    w = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("fold", (F.row_number().over(w) - 1) % k)


def fit_trees(df: DataFrame, *, depth: int = 3, step: float = 0.1, trees: int = 30, seed: int = 1) -> GBTClassifier:
    return GBTClassifier(featuresCol="x", labelCol="label_d", maxDepth=depth, stepSize=step, maxIter=trees, seed=seed).fit(assembled(df).withColumn("label_d", F.col("y").cast("double")))


def margins(model, df: DataFrame) -> DataFrame:
    return model.transform(assembled(df)).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("x", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, k: int = 5, **options) -> DataFrame:
    """Margins of each row from a model that hasn't seen its fold."""
    rows, out = stratified_folds(df, k).persist(), None
    for f in range(k):
        part = margins(fit_trees(rows.where(F.col("fold") != f), **options), rows.where(F.col("fold") == f))
        out = part if out is None else out.union(part)
    return out


def platt(df: DataFrame) -> tuple[float, float]:
    """A, B of sigma(A * margin + B) by unpenalised logistic regression; the identity if a label has fewer than two rows."""
    counts = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    if min(counts.get(True, 0), counts.get(False, 0)) < 2:
        return 1.0, 0.0
    x = VectorAssembler(inputCols=["margin"], outputCol="m").transform(df.withColumn("label_d", F.col("y").cast("double")))
    fit = LogisticRegression(featuresCol="m", labelCol="label_d", regParam=0.0).fit(x)
    return float(fit.coefficients[0]), float(fit.intercept)


def calibrated(df: DataFrame, a: float, b: float) -> DataFrame:
    return df.withColumn("p", 1 / (1 + F.exp(-(F.lit(a) * F.col("margin") + F.lit(b)))))


def train(df: DataFrame, **options) -> tuple[object, float, float]:
    a, b = platt(out_of_fold(df, **options))
    return fit_trees(df, **options), a, b


def score(df: DataFrame, model, a: float, b: float) -> DataFrame:
    """``df`` with p; a probability outside [0, 1] fails the query."""
    x = calibrated(margins(model, df), a, b)
    return x.withColumn("p", F.when(F.col("p").between(0, 1), F.col("p")).otherwise(F.raise_error(F.lit("no probability")).cast("double")))


def fit_perceptron(df: DataFrame, hidden: int = 16, seed: int = 1):
    x = assembled(df).withColumn("label_d", F.col("y").cast("double"))
    return MultilayerPerceptronClassifier(featuresCol="x", labelCol="label_d", layers=[len(CORE), hidden, 2], maxIter=100, seed=seed).fit(x)


def cross_validation(df: DataFrame, seeds: int = 3, k: int = 5, **options) -> DataFrame:
    """ba_mean, ba_std, brier_mean, brier_std over seeds (population deviation).

    A fold's probabilities are calibrated on the fold after it, by margins of a model that has seen neither.
    """
    out = None
    for s in range(seeds):
        rows = stratified_folds(df, k, s).persist()
        scored = None
        for f in range(k):
            after = (f + 1) % k
            a, b = platt(margins(fit_trees(rows.where(~F.col("fold").isin(f, after)), seed=s + 1, **options), rows.where(F.col("fold") == after)))
            part = calibrated(margins(fit_trees(rows.where(F.col("fold") != f), seed=s + 1, **options), rows.where(F.col("fold") == f)), a, b)
            scored = part if scored is None else scored.union(part)
        one = binary_metrics(scored).withColumn("seed", F.lit(s))
        out = one if out is None else out.union(one)
    return out.agg(F.avg("balanced_accuracy").alias("ba_mean"), F.stddev_pop("balanced_accuracy").alias("ba_std"), F.avg("brier").alias("brier_mean"), F.stddev_pop("brier").alias("brier_std"))


def select(runs: DataFrame) -> str:
    return select_rule(runs).first()["winner"]


def save(model, path: str, *, name: str, version: str, fingerprint: str, a: float, b: float) -> dict:
    """Writes the model and its manifest; returns the manifest."""
    spark = __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    PipelineModel(stages=[model]).write().overwrite().save(f"{path}/model")
    digest = spark.range(1).select(feature_digest()).first()[0]
    manifest = {"name": name, "version": version, "features": list(CORE), "feature_set_sha256": digest, "corpus_fingerprint": fingerprint, "platt": [a, b]}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def load(spark, path: str) -> tuple[object, dict]:
    """The model and its manifest; a manifest of other features is refused."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["features"] != list(CORE):
        raise ValueError("the model has other features")
    return PipelineModel.load(f"{path}/model").stages[0], manifest
