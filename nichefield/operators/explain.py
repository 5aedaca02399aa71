"""Which predictors matter and how: permutation importance and partial dependence."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import HASH_BITS, hash_bytes, hash_text, sort_keys
from ..functions.scalars import complete_rows
from ..grid import DEFAULT_SEED
from .common import attach, checkpointed
from .evaluate import auc
from .quantiles import quantiles

DEFAULT_REPEATS = 3
DEFAULT_GRID = 50
CHUNK_VALUES = 2_000_000  # hashes that one task sorts when records are permuted, those of all copies together
PD_RANGE = (0.025, 0.975)  # fixed value: share of records a dependence curve spans


def permuted(df: DataFrame, ident: str, label: str, predictors, features, repeats: int,
             seed: int = DEFAULT_SEED) -> DataFrame:
    """Copies of the records with one predictor permuted, for every feature and repeat.

    Position in one seeded order receives the value at the same position of another, so the
    permutation is exact, repeatable and spread over the cluster.
    """
    copies = _copies(features, repeats)
    moved = _permuted(_hashed(df, ident, [ident, label], predictors, copies, seed), [ident, label], predictors, copies)
    return _named(moved, copies).select("feature", "repeat", ident, label, *predictors)


def _copies(features, repeats: int) -> list[tuple[str, int]]:
    return [(f, r) for f in features for r in range(repeats)]


def _named(df: DataFrame, copies) -> DataFrame:
    """``feature`` and ``repeat`` of the number in column ``copy``."""
    names = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for f, r in copies])
    return df.withColumn("_c", names[F.col("copy")]).select("*", "_c.*").drop("_c", "copy")


def _hashed(df: DataFrame, ident: str, keep, predictors, copies, seed: int) -> DataFrame:
    """The usable records with their hashes in the base order and in that of each copy, made once and read often."""
    texts = [hash_text(seed, F.col(ident)), *[hash_text(seed, r, f, F.col(ident)) for f, r in copies]]
    used = dict.fromkeys([*keep, *predictors])
    return checkpointed(complete_rows(df, predictors).select(*used, hash_bytes(texts).alias("_h")))


def _permuted(hashed: DataFrame, keep, predictors, copies) -> DataFrame:
    """``keep`` and the predictors of each record of each copy, the copy's number in ``copy``.

    The hash orders are never sorted as a whole. Counts of equal slices of the hash range tell which slices hold
    the positions of a chunk, in every order alike. Records and values travel there once, packed; those of a
    slice on the border of two chunks go to both. A task sorts its chunk of each order and pairs the positions.
    """
    orders = len(copies) + 1
    size = max(1, CHUNK_VALUES // orders)
    chunks = -(-hashed.count() // size)
    bits = (16 * chunks).bit_length()  # a chunk is more than 8 slices
    sizes = hashed.select("_h").mapInArrow(_count(orders, bits), "copy int, slice bigint, n bigint").groupBy("copy", "slice").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.partitionBy("copy").orderBy("slice")) - F.col("n")
    placed = sizes.withColumn("start", before).withColumn("chunk", F.explode(F.expr(f"sequence(start div {size}, (start + n - 1) div {size})")))
    # Per order and chunk its first and last slice and the position at which the first begins.
    edges = placed.groupBy("copy", "chunk").agg(F.min("slice"), F.max("slice"), F.min("start")).orderBy("copy", "chunk").collect()
    bounds = np.array(edges, np.int64).reshape(orders, chunks, 5)[:, :, 2:]

    used, predictors = [c for c in hashed.columns if c != "_h"], list(predictors)
    features = list(dict.fromkeys(f for f, _ in copies))
    wide = hashed.select(*used, *[F.col(f).cast("double").alias(f"_v_{f}") for f in features], "_h")
    dealt = wide.mapInArrow(_deal(used, copies, bounds, bits), "chunk int, copy int, data binary")
    kinds = dict(hashed.dtypes)
    schema = ", ".join(["copy int", *[f"`{n}` {kinds[n]}" for n in keep], *[f"`{p}` double" for p in predictors]])
    return dealt.groupBy("chunk").applyInArrow(_pair(used, keep, predictors, copies, bounds, size), schema)


def _count(orders: int, bits: int):
    """Rows (copy, slice, n) of a task: how many hashes of each order (0: the base) lie in each slice."""
    def work(batches):
        counts = np.zeros((orders, 1 << bits), np.int64)
        for batch in batches:
            if batch.num_rows:
                for mine, keys in zip(counts, sort_keys(batch.column(0), orders).T):
                    mine += np.bincount(keys >> (HASH_BITS - bits), minlength=1 << bits)
        for copy, mine in enumerate(counts):
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), copy, np.int32)), pa.array(at), pa.array(mine[at])], names=["copy", "slice", "n"])

    return work


def _deal(used, copies, bounds: np.ndarray, bits: int):
    """Packets (chunk, copy, data): records of the base order (copy 0), hashes and values of the others."""
    def flush(held):
        table = pa.Table.from_batches(held).combine_chunks()
        orders = np.ascontiguousarray(sort_keys(table.column("_h").chunk(0), len(bounds)).T)
        records, out = table.select(used).append_column("_h", pa.array(orders[0])), []
        for copy, order in enumerate(orders):
            at = order >> (HASH_BITS - bits)
            first = np.searchsorted(bounds[copy, :, 1], at, "left")
            last = np.searchsorted(bounds[copy, :, 0], at, "right") - 1
            rows, chunk, more = np.arange(len(at)), first, first + 1
            while (beyond := more <= last).any():
                rows, chunk, more = np.r_[rows, np.flatnonzero(beyond)], np.r_[chunk, more[beyond]], more + 1
            sort = np.argsort(chunk, kind="stable")
            rows, chunk = rows[sort], chunk[sort]
            cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
            if copy:
                value = table.column(f"_v_{copies[copy - 1][0]}").to_numpy()
                both = np.stack([order[rows], value[rows].view(np.int64)], 1)
            else:
                both = records.take(pa.array(rows))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                out.append((int(chunk[a]), copy, both[a:b].tobytes() if copy else _packed(both.slice(a, b - a))))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()),
                                           pa.array([x[2] for x in out], pa.binary())], names=["chunk", "copy", "data"])

    def work(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n * len(bounds) >= CHUNK_VALUES:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return work


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _pair(used, keep, predictors, copies, bounds: np.ndarray, size: int):
    """The permuted records of one chunk of positions, copy after copy."""
    def chosen(order, ties, chunk, copy):
        """Rows at the chunk's positions, in order of the hash; equal hashes by ``ties``."""
        rank = np.argsort(order, kind="stable")
        if (order[rank][1:] == order[rank][:-1]).any():
            rank = ties(rank)
        start = chunk * size - bounds[copy, chunk, 2]
        return rank[start:start + size]

    def run(key, table):
        chunk, held = key[0].as_py(), {}
        for copy, data in zip(table.column("copy").to_pylist(), table.column("data").to_pylist()):
            held.setdefault(copy, []).append(data)
        base = pa.concat_tables([pa.ipc.open_stream(d).read_all() for d in held[0]]).combine_chunks()
        by = [("_h", "ascending"), *[(n, "ascending") for n in used]]
        base = base.take(pa.array(chosen(base.column("_h").to_numpy(), lambda _: pc.sort_indices(base, by).to_numpy(), chunk, 0)))
        numbers = {p: base.column(p).cast(pa.float64()) for p in predictors}
        out = []
        for copy, (feature, _) in enumerate(copies, 1):
            both = np.frombuffer(b"".join(held[copy]), np.int64).reshape(-1, 2)
            order, value = both[:, 0], both[:, 1].view(np.float64)
            mine = value[chosen(order, lambda _: np.lexsort((value, order)), chunk, copy)]
            swapped = [pa.array(mine) if p == feature else numbers[p] for p in predictors]
            out.append(pa.table([pa.array(np.full(len(mine), copy - 1, np.int32)), *[base.column(n) for n in keep], *swapped],
                                names=["copy", *keep, *predictors]))
        return pa.concat_tables(out)

    return run


def permute_column(df: DataFrame, ident: str, column: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """One column permuted over all records: its id and the value it now carries."""
    return permuted(df.withColumn("_label", F.lit(0)), ident, "_label", [column], [column], 1, seed).select(ident, column)


def importance(score, df: DataFrame, label: str, predictors, ident: str = "pid",
               repeats: int = DEFAULT_REPEATS, seed: int = DEFAULT_SEED, per_repeat: bool = False) -> DataFrame:
    """H7: mean loss of AUC when one predictor is permuted.

    ``score`` is a fitted model, or any function adding a ``score`` column. All features and
    repeats are scored in one pass and ranked together.
    """
    run = score.score if hasattr(score, "score") else score
    copies = _copies(predictors, repeats)
    rows = _hashed(df, ident, [ident, label], predictors, copies, seed)
    whole = run(rows.drop("_h")).select(F.lit(-1).alias("copy"), label, "score")
    moved = run(_permuted(rows, [label], predictors, copies)).select("copy", label, "score")
    skill = checkpointed(auc(whole.unionByName(moved), label, "score", ["copy"]))  # read twice
    base = skill.where("copy = -1").select("auc").scalar()
    drops = _named(skill.where("copy >= 0"), copies).select("feature", "repeat", (base - F.col("auc")).alias("importance"))
    if per_repeat:
        return drops
    return drops.groupBy("feature").agg(F.avg("importance").alias("importance"))


def _by_model(models: dict, rows: DataFrame, keep, out: str = "score") -> DataFrame:
    """All models' scores of the same rows, one row per model: the rows are made and read once."""
    scored = rows
    for (a, r), m in models.items():
        scored = m.score(scored, f"_s_{a}_{r}")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("algorithm"), F.lit(r).alias("replicate"), F.col(f"_s_{a}_{r}").alias(out))
                               for a, r in models]))
    return scored.select(*keep, each.alias("_e")).select("_e.algorithm", "_e.replicate", *keep, f"_e.{out}")


def model_importances(models: dict, df: DataFrame, label: str, predictors, ident: str = "pid",
                      repeats: int = DEFAULT_REPEATS, seed: int = DEFAULT_SEED) -> DataFrame:
    """H7 for all algorithms and replicates of a run: the permuted copies are made once and shared."""
    copies, names = _copies(predictors, repeats), list(models)
    rows = _hashed(df, ident, [ident, label], predictors, copies, seed)
    whole = rows.select(F.lit(-1).alias("copy"), label, *predictors)
    both = whole.unionByName(_permuted(rows, [label], predictors, copies))
    for i, m in enumerate(models.values()):
        both = m.score(both, f"_s_{i}")
    each = both.select("copy", label, F.posexplode(F.array(*[F.col(f"_s_{i}") for i in range(len(names))])).alias("model", "score"))
    # A small table that is read twice: made once, not with all copies for each reader.
    skill = checkpointed(auc(each, label, "score", ["model", "copy"]))
    base = skill.where("copy = -1").select("model", F.col("auc").alias("_base"))
    drops = _named(attach(skill.where("copy >= 0"), base, ["model"]), copies)
    called = F.array(*[F.struct(F.lit(a).alias("algorithm"), F.lit(r).alias("replicate")) for a, r in names])[F.col("model")]
    return (drops.withColumn("_m", called).groupBy("_m.algorithm", "_m.replicate", "feature")
            .agg(F.avg(F.col("_base") - F.col("auc")).alias("importance")))


def model_curves(models: dict, df: DataFrame, predictors, n_grid: int = DEFAULT_GRID) -> DataFrame:
    """H8 for all algorithms and replicates of a run, over one common grid."""
    return _by_model(models, pd_grid(df, predictors, n_grid), ["feature", "grid_i", "grid_v"], "pred")


def ensemble_score(models: dict, weights: dict[str, float]):
    """Scoring function of the ensemble: mean over replicate models, then weighted over algorithms."""
    positive = {a: max(float(weights.get(a, 0.0)), 0.0) for a, _ in models}
    total = sum(positive.values())
    share = {a: (w / total if total > 0 else 1.0 / len(positive)) for a, w in positive.items()}

    def run(df: DataFrame) -> DataFrame:
        names, out = df.columns, df
        parts: dict[str, list[str]] = {}
        for (a, r), m in models.items():
            parts.setdefault(a, []).append(f"_s_{a}_{r}")
            out = m.score(out, f"_s_{a}_{r}")
        mean = [reduce(lambda x, y: x + y, [F.col(c) for c in cols]) / len(cols) * share[a] for a, cols in parts.items()]
        return out.select(*names, reduce(lambda x, y: x + y, mean).alias("score"))
    return run


def ensemble_importance(models: dict, weights: dict[str, float], df: DataFrame, label: str, predictors,
                        ident: str = "pid", repeats: int = DEFAULT_REPEATS, seed: int = DEFAULT_SEED) -> DataFrame:
    """Loss of ensemble AUC per feature and repeat."""
    return importance(ensemble_score(models, weights), df, label, predictors, ident, repeats, seed, per_repeat=True)


def train_auc(models: dict, weights: dict[str, float], df: DataFrame, label: str, predictors) -> DataFrame:
    """I8: ensemble AUC on its own training records."""
    rows = complete_rows(df, predictors)
    return auc(ensemble_score(models, weights)(rows.select(label, *predictors)), label, "score")


def pd_grid(df: DataFrame, predictors, n_grid: int = DEFAULT_GRID) -> DataFrame:
    """H8: rows to score for every curve: one predictor over its range, the others at their median."""
    low, high = PD_RANGE
    q = quantiles(df, predictors, [low, 0.5, high])
    points = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f)[0].alias("lo"), F.col(f)[2].alias("hi"))
                                 for f in predictors]))
    step = (F.col("c.hi") - F.col("c.lo")) / F.lit(float(max(n_grid - 1, 1)))
    value = F.when(F.col("grid_i") == n_grid - 1, F.col("c.hi")).otherwise(F.col("c.lo") + step * F.col("grid_i"))
    rows = q.select(*predictors, points.alias("c")).select(
        *predictors, "c", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("grid_i"))
    return rows.select(F.col("c.feature").alias("feature"), "grid_i", value.alias("grid_v"), *[
        F.when(F.col("c.feature") == p, value).otherwise(F.col(p)[1]).alias(p) for p in predictors])


def partial_dependence(model, df: DataFrame, predictors, n_grid: int = DEFAULT_GRID) -> DataFrame:
    """H8: response curve of every predictor."""
    return model.score(pd_grid(df, predictors, n_grid), "pred").select("feature", "grid_i", "grid_v", "pred")
