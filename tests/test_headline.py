from pyspark.sql import functions as F

from nichefield.operators.notes import TSS_OK, headline, run_notes


def test_equal_means_pick_the_same_algorithm_in_any_order(spark):
    """A sum taken in another order, or rows in another order, must not change the reported algorithm."""
    rows = [("s", "rf", (0.1 + 0.2 + 0.3) / 3), ("s", "enfa", (0.3 + 0.2 + 0.1) / 3), ("s", "lr", 0.1),
            ("n", "rf", None), ("n", "lr", None), ("e", "Ensemble", None), ("e", "lr", 0.9)]
    assert rows[0][2] != rows[1][2]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "run string, algorithm string, tss_mean double").coalesce(1)
        for c in ("auc_mean", "boyce_mean", "auc_sd", "tss_sd", "boyce_sd"):
            df = df.withColumn(c, F.lit(0.5))
        got = {r.run: r.algorithm for r in headline(df, ["run"]).collect()}
        assert got == {"s": "enfa", "n": "lr", "e": "Ensemble"}


def test_order_of_a_sum_moves_no_mean_over_a_bound(spark):
    """0.1, 0.2 and 0.9 have the mean 0.4, in whatever order they were added."""
    scores = [(0.1 + 0.2 + 0.9) / 3, (0.9 + 0.1 + 0.2) / 3]
    low = next(x for x in (*scores, 0.39999999999999997) if x < TSS_OK)
    rows = [("a", "lr", low, 0.5), ("b", "lr", 0.4000000000000001, 0.5), ("c", "lr", 0.3999, 0.5)]
    df = spark.createDataFrame(rows, "run string, algorithm string, tss_mean double, auc_mean double")
    for c in ("boyce_mean", "auc_sd", "tss_sd", "boyce_sd"):
        df = df.withColumn(c, F.lit(0.5))
    facts = {c: F.lit(None).cast("double") for c in ("disagreement_share", "suitable_share", "extrapolated_share", "train_auc", "cv_auc", "removed")}
    facts |= {c: F.lit(None).cast("int") for c in ("n_presence", "n_dropped")} | {"split_method": F.lit("kfold"), "has_maxent": F.lit(False), "presence_only": F.lit(False)}
    notes = run_notes(df, df.select("run").withColumns(facts), ["run"]).where("heading = 'Overall performance'").collect()
    assert {r.run: r.tone for r in notes} == {"a": "ok", "b": "ok", "c": "caution"}
