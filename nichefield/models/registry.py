"""Models by name: defaults, fitting with overrides, saving and loading."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..grid import DEFAULT_SEED
from . import enfa, gam, glm, maxent, mlp, svm, trees
from .base import Model

# name: (long name, defaults, fit, score, MLlib loader or None)
_MODELS = {
    "lr": ("Logistic Regression (GLM)", glm.DEFAULTS, glm.fit, glm.score, None),
    "gam": ("Generalized Additive Model", gam.DEFAULTS, gam.fit, gam.score, None),
    "rf": ("Random Forest", trees.RF_DEFAULTS, trees.fit_rf, trees.score, trees.LOADERS["rf"]),
    "gbm": ("Gradient Boosting Machine", trees.GBM_DEFAULTS, trees.fit_gbm, trees.score, trees.LOADERS["gbm"]),
    "xgb": ("XGBoost", trees.XGB_DEFAULTS, trees.fit_xgb, trees.score, trees.LOADERS["xgb"]),
    "svm": ("Support Vector Machine", svm.DEFAULTS, svm.fit, svm.score, None),
    "mlp": ("Multilayer Perceptron", mlp.DEFAULTS, mlp.fit, mlp.score, None),
    "maxent": ("MaxEnt", maxent.DEFAULTS, maxent.fit, maxent.score, None),
    "enfa": ("Ecological Niche Factor Analysis", enfa.DEFAULTS, enfa.fit, enfa.score, None),
}
ALGORITHMS = tuple(_MODELS)
LONG_NAMES = {name: m[0] for name, m in _MODELS.items()}
SEED_STRIDE = 17  # fixed value: seed step between replicates


def _entry(name: str):
    if name not in _MODELS:
        raise ValueError(f"unknown algorithm {name!r}; choose from {algorithms()}")
    return _MODELS[name]


def algorithms() -> tuple[str, ...]:
    """Names of all algorithms, those that users have registered included."""
    return tuple(_MODELS)


def register(name: str, fit, score, defaults: dict | None = None, long_name: str | None = None, load=None) -> None:
    """Add an algorithm of one's own, for ``fit``, ``cross_validate``, ``predict_wide`` and whole runs alike.

    ``fit(df, predictors, label, seed, **params)`` returns a ``Model`` of that name whose state is plain numbers and lists;
    ``score(model, df, out)`` adds a column (``base.by_formula`` and ``base.in_batches`` make one). ``load`` reads a model's
    ``stage`` back, if it has one. Registering a name again replaces it; the built-in ones stay as they are.
    """
    if name in ALGORITHMS:
        raise ValueError(f"{name!r} is built in")
    if not name.isidentifier():
        raise ValueError(f"{name!r} cannot name columns")
    _MODELS[name] = (long_name or name, dict(defaults or {}), fit, score, load)


def unregister(name: str) -> None:
    """Forget an algorithm that ``register`` has added."""
    if name in ALGORITHMS:
        raise ValueError(f"{name!r} is built in")
    _MODELS.pop(name, None)


def defaults(name: str) -> dict:
    return dict(_entry(name)[1])


def scorer(name: str):
    return _entry(name)[3]


def fit(name: str, df: DataFrame, predictors, label: str = "label", seed: int = DEFAULT_SEED, **params) -> Model:
    """Fit one algorithm on the complete rows of ``df``; unknown parameters are refused."""
    base = defaults(name)
    unknown = set(params) - set(base)
    if unknown:
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    return _entry(name)[2](df, list(predictors), label, seed, **{**base, **params})


def fitted_config(algorithms, n_presence: int | None = None, overrides=None) -> dict[str, dict]:
    """The parameters each algorithm runs with, overrides applied."""
    out = {}
    for name in algorithms:
        params = {**defaults(name), **((overrides or {}).get(name) or {})}
        if name == "maxent" and params["feature_types"] is None and n_presence is not None:
            params["feature_types"] = list(maxent.feature_classes(n_presence))
        out[name] = params
    return out


def changed_overrides(edited: dict[str, dict]) -> dict[str, dict]:
    """Only those edited parameters that exist and differ from the defaults."""
    out = {n: {k: v for k, v in p.items() if k in defaults(n) and v != defaults(n)[k]}
           for n, p in edited.items() if n in _MODELS}
    return {n: p for n, p in out.items() if p}


def save_model(model: Model, spark: SparkSession, path: str) -> None:
    """A10: coefficients as one small table, tree and network models with their own writer."""
    if model.stage is not None:
        model.stage.write().overwrite().save(f"{path}/stage")
    row = (model.name, model.predictors, json.dumps(model.params), json.dumps(model.state))
    spark.createDataFrame([row], "name string, predictors array<string>, params string, state string") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> Model:
    r = spark.read.parquet(f"{path}/model").first()
    loader = _entry(r.name)[4]
    stage = loader.load(f"{path}/stage") if loader else None
    return Model(r.name, list(r.predictors), json.loads(r.params), json.loads(r.state), stage)
