"""Cross-validated fitting of many algorithms and replicates on one labelled table."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import DEFAULT_SEED
from ..models import fit
from ..models.base import Model
from ..models.registry import SEED_STRIDE
from ..operators.common import checkpointed
from ..operators.splits import replicate_seed


@dataclass
class CrossValidation:
    """Held-out scores, the final model of each unit, and the units that failed."""

    oof: DataFrame
    models: dict[tuple[str, int], Model]
    errors: list[tuple[str, int, str]] = field(default_factory=list)

    def errors_frame(self) -> DataFrame:
        return self.oof.sparkSession.createDataFrame(self.errors, "algorithm string, replicate int, error string")


def _folds(folded: DataFrame) -> list[tuple]:
    """(train, test) conditions with both sides non-empty."""
    if "is_test" in folded.columns:
        return [(~F.col("is_test"), F.col("is_test"))]
    sizes = {r.fold: r["count"] for r in folded.groupBy("fold").count().collect()}
    total = sum(sizes.values())
    usable = [i for i in sorted(sizes) if 0 < sizes[i] < total]
    if not usable:
        raise ValueError("no usable folds: the blocks are too coarse to hold any out")
    return [(F.col("fold") != i, F.col("fold") == i) for i in usable]


def cross_validate(labelled: DataFrame, predictors, algorithms, split: Callable[[DataFrame, int], DataFrame],
                   replicates: int = 5, seed: int = DEFAULT_SEED, params: dict | None = None,
                   threads: int = 4) -> CrossValidation:
    """Fit on each training side, score the held-out side, then fit on everything.

    ``split(df, seed)`` adds ``fold`` or ``is_test``; all algorithms of a replicate share it. A unit
    that fails becomes an error row and the others go on. Units are small distributed jobs, so a
    few are submitted at a time.
    """
    if replicates < 1:
        raise ValueError("replicates must be at least 1")
    params, predictors = params or {}, list(predictors)
    keep = ["pid", "label", *predictors]
    folded = {}
    for r in range(replicates):
        rows = checkpointed(split(labelled, replicate_seed(seed, r)))
        folded[r] = rows, _folds(rows)

    def unit(algorithm: str, replicate: int):
        rows, sides = folded[replicate]
        model_seed = seed + SEED_STRIDE * replicate
        options = params.get(algorithm, {})
        held = []
        for train, test in sides:
            m = fit(algorithm, rows.where(train).select(*keep), predictors, "label", model_seed, **options)
            held.append(m.score(rows.where(test).select(*keep)).select(
                F.lit(algorithm).alias("algorithm"), F.lit(replicate).alias("replicate"), "pid", "label", "score"))
        final = fit(algorithm, rows.select(*keep), predictors, "label", model_seed, **options)
        return final, reduce(DataFrame.unionByName, held)

    def guarded(task):
        try:
            return task, unit(*task), None
        except Exception as exc:  # one failed unit must not end the run
            return task, None, f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}"

    spark = labelled.sparkSession
    tasks = [(a, r) for a in algorithms for r in range(replicates)]
    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(guarded), tasks))
    models = {task: got[0] for task, got, _ in done if got}
    errors = [(*task, error) for task, _, error in done if error]
    held = [got[1] for _, got, _ in done if got]
    if not held:
        raise ValueError(f"every fit failed, first: {errors[0]}")
    return CrossValidation(checkpointed(reduce(DataFrame.unionByName, held)), models, errors)
