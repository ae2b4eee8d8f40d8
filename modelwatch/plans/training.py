"""Point-in-time training sets, a forest, and batch scoring."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.scalars import hash_slot
from ..operators.asof import HOT_ROWS, pit_join
from ..operators.metrics import classification_metrics


def training_set(entities: DataFrame, view: DataFrame, by: list[str], features: list[str], probability: Column,
                 key: str, ts: str = "ts", tie: str | None = None, seed: str = "label",
                 hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Entity rows with the features known at their time, the approval probability and a label.

    The label is 1 where a repeatable uniform draw of the row's key falls below the probability.
    """
    known = pit_join(entities, view, by, ts, ts, features, tie=tie, hot_rows=hot_rows)
    return (known.withColumn("probability", probability)
            .withColumn("label", F.when(F.col("probability").isNotNull(),
                                        (hash_slot(F.col(key), seed) / 1000.0 < F.col("probability")).cast("int"))))


def split(df: DataFrame, key: str, seed: str = "42", train_per_thousand: int = 800) -> tuple[DataFrame, DataFrame]:
    """80/20 split by key hash: the same rows on every run and after every lost task."""
    slot = hash_slot(F.col(key), seed)
    return df.where(slot < train_per_thousand), df.where(slot >= train_per_thousand)


def fit(train: DataFrame, features: list[str], label: str = "label") -> PipelineModel:
    forest = RandomForestClassifier(labelCol=label, featuresCol="_x", numTrees=fv.FOREST_TREES,
                                    maxDepth=fv.FOREST_DEPTH, seed=fv.FOREST_SEED)
    vectors = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    return Pipeline(stages=[vectors, forest]).fit(train.select(*features, label).dropna())


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Prediction and probability of the positive class; both null for a row that lacks a feature."""
    keep = [c for c in df.columns if c not in ("prediction", "probability", "rawPrediction")]
    known = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in model.stages[0].getInputCols()])
    return (model.transform(df.select(*keep))
            .select(*keep, F.when(known, F.col("prediction").cast("int")).alias("prediction"),
                    F.when(known, F.get(vector_to_array("probability"), F.lit(1))).alias("probability")))


def fit_and_evaluate(df: DataFrame, features: list[str], key: str, label: str = "label", scope: str = "all",
                     model_name: str = "classifier", version: int = 1) -> tuple[PipelineModel, DataFrame]:
    """Train on 80 %, measure on the rest; the second result is a row for the model_versions table."""
    train, test = split(df.where(F.col(label).isNotNull()), key)
    model = fit(train, features, label)
    m = classification_metrics(score(model, test).where("prediction is not null"), [], label=label)
    row = m.select(
        F.lit(scope).alias("scope_id"), F.lit(model_name).alias("model_name"), F.lit(version).alias("version"),
        F.lit(f"{model_name}-{version}").alias("run_id"),
        F.create_map(F.lit("model_type"), F.lit("RandomForestClassifier"),
                     F.lit("n_estimators"), F.lit(str(fv.FOREST_TREES)),
                     F.lit("max_depth"), F.lit(str(fv.FOREST_DEPTH))).alias("params"),
        F.create_map(*[x for c in ("accuracy", "f1_score", "precision", "recall") for x in (F.lit(c), F.col(c))])
         .alias("metrics"))
    return model, row
