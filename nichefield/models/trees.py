"""Tree ensembles: random forest and two boosting presets."""

from __future__ import annotations

import math

from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.scalars import all_finite
from ..operators.common import shuffle_width
from .base import Model, training_rows

RF_DEFAULTS = {"n_estimators": 500, "max_features": "sqrt", "min_samples_leaf": 1, "max_depth": 30}
GBM_DEFAULTS = {"n_estimators": 1000, "learning_rate": 0.01, "max_depth": 3, "subsample": 0.75}
XGB_DEFAULTS = {"n_estimators": 500, "learning_rate": 0.1, "max_depth": 5, "subsample": 0.8,
                "colsample_bytree": 0.8}
ROWS_PER_PART = 1_000_000  # records that one task trains on
LOADERS = {"rf": RandomForestClassificationModel, "gbm": GBTClassificationModel, "xgb": GBTClassificationModel}


def _vector(predictors):
    """Predictors as a vector; a missing one becomes 0 and its row is masked after scoring."""
    return array_to_vector(F.array(*[F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in predictors]))


def _rows(df, predictors, label):
    """Records as vectors, in parts of a bounded size: training keeps them in memory and reads a whole part in each task."""
    rows = training_rows(df, predictors, label)
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n1"))
    n, n1, largest = parts.agg(F.sum("n"), F.sum("n1"), F.max("n")).first()
    if not n or n1 in (0, n):
        raise ValueError("fitting needs complete records of both classes")
    if largest > ROWS_PER_PART:
        rows = rows.repartition(max(shuffle_width(rows.sparkSession), math.ceil(n / ROWS_PER_PART)))
    return rows.select("label", _vector(predictors).alias("features"))


def fit_rf(df, predictors, label, seed, n_estimators, max_features, min_samples_leaf, max_depth) -> Model:
    forest = RandomForestClassifier(
        labelCol="label", numTrees=n_estimators, featureSubsetStrategy=str(max_features),
        minInstancesPerNode=min_samples_leaf, maxDepth=max_depth, seed=seed, maxMemoryInMB=512)
    params = {"n_estimators": n_estimators, "max_features": max_features,
              "min_samples_leaf": min_samples_leaf, "max_depth": max_depth}
    return Model("rf", predictors, params, stage=forest.fit(_rows(df, predictors, label)))


def _boosted(name, df, predictors, label, seed, params) -> Model:
    boost = GBTClassifier(
        labelCol="label", maxIter=params["n_estimators"], stepSize=params["learning_rate"],
        maxDepth=params["max_depth"], subsamplingRate=params["subsample"], seed=seed,
        featureSubsetStrategy=str(params.get("colsample_bytree", "all")),
        maxMemoryInMB=512, checkpointInterval=10)
    if boost.getFeatureSubsetStrategy() in ("1.0", "1"):
        boost.setFeatureSubsetStrategy("all")
    return Model(name, predictors, params, stage=boost.fit(_rows(df, predictors, label)))


def fit_gbm(df, predictors, label, seed, **params) -> Model:
    return _boosted("gbm", df, predictors, label, seed, params)


def fit_xgb(df, predictors, label, seed, **params) -> Model:
    return _boosted("xgb", df, predictors, label, seed, params)


def score(model: Model, df, out: str):
    return score_vector(model, df, out, _vector(model.predictors))


def score_vector(model: Model, df, out: str, vector):
    names = df.columns
    stage = model.stage.copy().setFeaturesCol("_features").setProbabilityCol("_probability")
    stage = stage.setRawPredictionCol("").setPredictionCol("")
    done = stage.transform(df.withColumn("_features", vector))
    p = vector_to_array(F.col("_probability"))[1]
    return done.select(*names, F.when(all_finite(model.predictors), p).alias(out))
