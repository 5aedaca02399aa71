"""Habitat models: fitted on Spark, scored as columns of a DataFrame."""

from .grouped import GroupedModel, fit_by
from .registry import ALGORITHMS, LONG_NAMES, algorithms, defaults, fit, fitted_config, register, unregister

__all__ = ["ALGORITHMS", "LONG_NAMES", "GroupedModel", "algorithms", "defaults", "fit", "fit_by", "fitted_config", "register", "unregister"]
