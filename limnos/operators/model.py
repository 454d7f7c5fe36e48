"""Model training and scoring.

A fitted model is one ML ``PipelineModel`` over *raw* readings: engineered
features (where the model takes more than the sensors) -> population scaling
fitted on the training rows -> classifier.  It is saved and loaded as a whole,
so what scales a reading is always what scaled the training rows.

Classifiers: ``rf``, a class-weighted Spark ML forest (the default); ``net``,
the class-weighted softmax net of ``operators.net``; ``mlp``, Spark ML's own
multilayer perceptron (no class weights, L2 or early stop).
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ml import fit_moments
from .net import NetConfig, NetModel, train_net
from .stages import FeatureStep, ScaleStep

FEATURES = "_features"

#: The readings (tds, turbidity, ph) that a retrained or calibrated model is looked at with.
SPOT_SAMPLES = [
    (1000.0, 4.0, 7.5, "mixed readings"),
    (200.0, 1.0, 7.2, "Excellent quality"),
    (1500.0, 20.0, 5.5, "Poor quality"),
    (500.0, 3.0, 8.0, "Good quality"),
    (800.0, 8.0, 6.8, "Acceptable quality"),
]


def _forest(label: str, weight: str, seed: int, num_trees: int = 50, max_depth: int = 10):
    from pyspark.ml.classification import RandomForestClassifier
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=label, seed=seed, numTrees=num_trees, maxDepth=max_depth,
                                  probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred", weightCol=weight)


def _perceptron(label: str, n: int, seed: int):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    return MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol=label, seed=seed, layers=[n, 64, 32, 16, 4], maxIter=200,
                                          probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")


def train(df: DataFrame, features: Sequence[str], label: str = "quality", kind: str = "rf", seed: int = 42,
          validation: DataFrame | None = None, net: NetConfig | None = None):
    """M6: fit a pipeline on the raw readings of the training split.

    Balanced class weights and the scaler come from one scan of the training
    rows.  ``validation`` (raw readings too) only serves the net's rate cut and
    early stop.  Engineered features are made by the pipeline, whether or not
    ``df`` brings them."""
    from pyspark.ml import PipelineModel

    from ..functions.features import ENGINEERED_FEATURES

    features = list(features)
    steps = [FeatureStep()] if set(features) & set(ENGINEERED_FEATURES) else []

    def prepared(rows: DataFrame) -> DataFrame:
        for s in steps:
            rows = s.transform(rows)
        return rows

    base = prepared(df)
    scaler, counts = fit_moments(base, features, label)
    scale = ScaleStep(inputCols=features, outputCol=FEATURES, means=[scaler.means[c] for c in features],
                      stds=[scaler.stds[c] for c in features])
    n = sum(counts.values())
    weight = F.create_map(*[x for c, k in counts.items() for x in (F.lit(c), F.lit(n / (len(counts) * k)))])[F.col(label)]
    rows = scale.transform(base).select(FEATURES, F.col(label), weight.alias("_weight"), F.lit(False).alias("_val"))
    if kind == "net":
        if validation is not None:
            held = scale.transform(prepared(validation)).select(FEATURES, F.col(label), F.lit(1.0).alias("_weight"), F.lit(True).alias("_val"))
            rows = rows.unionByName(held)
        fitted = train_net(rows, FEATURES, label, "_weight", "_val", len(features), net or NetConfig(seed=seed))
        stage = NetModel(featuresCol=FEATURES, probabilityCol="_prob", layers=fitted.sizes, parameters=fitted.parameters.tolist())
        stage.history = fitted.history
    elif kind in ("rf", "mlp"):
        cached = rows.select(FEATURES, label, "_weight").persist()
        try:
            stage = (_forest(label, "_weight", seed) if kind == "rf" else _perceptron(label, len(features), seed)).fit(cached)
        finally:
            cached.unpersist()
    else:
        raise ValueError(f"unknown model kind {kind}")
    return PipelineModel([*steps, scale, stage])


def model_probabilities(model, out: str = "probability") -> Callable[[DataFrame], DataFrame]:
    """Adapter: a fitted pipeline as the 'model' of ``operators.score``; the
    rows keep their columns and gain ``out``."""
    from pyspark.ml.functions import vector_to_array

    def apply(df: DataFrame) -> DataFrame:
        res = model.transform(df)
        p = F.col("_prob") if res.schema["_prob"].dataType.typeName() == "array" else vector_to_array("_prob")
        return res.select(*[c for c in df.columns if c != out], p.alias(out))

    return apply


def save_model(model, path: str) -> str:
    """One artefact, the pipeline with its feature step, scaler and
    classifier (quirk Q-9)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def predicted_class(df: DataFrame, probability: str = "probability") -> DataFrame:
    from ..functions.arrays import argmax
    return df.withColumn("predicted", argmax(probability))


def spot_samples(spark, model) -> DataFrame:
    """The five spot readings through the model and the rules: case,
    sensors, class by the rules, class and probability by the model."""
    from .score import label_readings

    rows = spark.createDataFrame(SPOT_SAMPLES, "tds double, turbidity double, ph double, description string")
    out = predicted_class(model_probabilities(model)(label_readings(rows)))
    return out.select("description", "tds", "turbidity", "ph", F.col("quality").alias("rule_class"), "predicted",
                      F.array_max("probability").alias("top_probability"))
