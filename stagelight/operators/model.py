"""Damage model on window features: median fill and gradient-boosted trees of Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_damage_model(train: DataFrame, features: list[str], label: str, *, rounds: int = 300, rate: float = 0.05, depth: int = 4, seed: int = 0) -> PipelineModel:
    """Missing features take the training median; 300 rounds at rate 0.05 with about 15 leaves (depth 4)."""
    filled = [f"_{f}" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_x"),
        GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed),
    ]).fit(train.withColumn(label, F.col(label).cast("double")))


def score_windows(model: PipelineModel, windows: DataFrame) -> DataFrame:
    """Add ``p_damaged``."""
    scored = model.transform(windows)
    return scored.select(*windows.columns, vector_to_array("probability")[1].alias("p_damaged"))
