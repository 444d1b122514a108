"""Scores over long prediction tables ``run, task_label, method, speech_id, y_true, y_pred``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from penmark.functions.tails import mcnemar_exact

KEYS = ["run", "task_label", "method"]


def correct(true: str = "y_true", pred: str = "y_pred") -> Column:
    return F.col(true).eqNullSafe(F.col(pred)).cast("int")


def confusion(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return predictions.groupBy(*(KEYS if keys is None else keys), "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def label_scores(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``tp, fp, fn, f1`` of every label seen in truth or prediction."""
    keys = KEYS if keys is None else keys
    hit = F.col("y_true") == F.col("y_pred")
    zero = F.lit(0).cast("bigint")
    sides = F.explode(
        F.array(
            F.struct(F.col("y_true").alias("label"), F.col("n").alias("truth"), zero.alias("said"), F.when(hit, F.col("n")).otherwise(zero).alias("tp")),
            F.struct(F.col("y_pred").alias("label"), zero.alias("truth"), F.col("n").alias("said"), zero.alias("tp")),
        )
    )
    sums = confusion(predictions, keys).select(*keys, sides.alias("s")).groupBy(*keys, F.col("s.label").alias("label")).agg(
        F.sum("s.tp").alias("tp"), F.sum("s.said").alias("said"), F.sum("s.truth").alias("truth")
    )
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.col("truth") + F.col("said")), F.lit(0.0))
    return sums.select(
        *keys, "label", "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("truth") - F.col("tp")).alias("fn"), f1.alias("f1")
    )


def f1_macro_micro(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = KEYS if keys is None else keys
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return label_scores(predictions, keys).groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"), (2 * tp / (2 * tp + fp + fn)).alias("micro_f1")
    )


def f1_binary(predictions: DataFrame, keys: list[str] | None = None, positive: str = "1") -> DataFrame:
    """F1 of the positive class, from one pass of counts."""
    keys = KEYS if keys is None else keys
    true, said = F.col("y_true") == positive, F.col("y_pred") == positive
    tp, wrong = F.count_if(true & said), F.count_if(true != said)
    return predictions.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.lit(2.0) * tp, 2 * tp + wrong), F.lit(0.0)).alias("f1")
    )


def best_methods(scores: DataFrame, by: list[str], score: str = "f1") -> DataFrame:
    """All methods tied at the maximum score of each group."""
    order = Window.partitionBy(*by).orderBy(F.desc(score))
    return scores.withColumn("_r", F.rank().over(order)).where(F.col("_r") == 1).drop("_r")


def stored_scores(scores: DataFrame, names: list[str]) -> DataFrame:
    """Scores to 3 places, as result tables hold them; methods are compared, and tie, on these."""
    return scores.withColumns({name: F.bround(name, 3) for name in names})


def best_grid_point(scores: DataFrame, by: list[str]) -> DataFrame:
    """Highest score; the first point in grid order on a tie."""
    best = F.max_by(F.struct("grid_idx", "score"), F.struct("score", (-F.col("grid_idx")).alias("i")))
    return scores.groupBy(*by).agg(best.alias("b")).select(*by, "b.grid_idx", "b.score")


def mcnemar(predictions: DataFrame, pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """McNemar's test for method pairs ``run, task_label, baseline, method``.

    Only rows of paired methods are joined; the four cells are counted before
    the last shuffle.
    """
    bits = predictions.select(*KEYS, "speech_id", correct().alias("ok"))
    left = bits.withColumnRenamed("method", "baseline").withColumnRenamed("ok", "a")
    right = bits.withColumnRenamed("ok", "b")
    base = left.join(pairs, ["run", "task_label", "baseline"])
    both = base.join(right, ["run", "task_label", "method", "speech_id"])
    cells = both.groupBy("run", "task_label", "baseline", "method").agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("yy"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("yn"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("ny"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("nn"),
    )
    p = mcnemar_exact(F.col("yn"), F.col("ny"))
    return (
        cells.withColumn("statistic", F.least("yn", "ny"))
        .withColumn("p", p)
        .withColumn("significant", F.col("p") <= alpha)
    )


def compare_multiclass(scores_a: DataFrame, scores_b: DataFrame, predictions: DataFrame) -> DataFrame:
    """The methods best by macro F1 against the best of a baseline family, per run.

    ``scores_*`` hold ``run, method, macro_f1, micro_f1``; both differences are in percent of the
    baseline. McNemar's test compares the predictions row by row.
    """
    def best(scores: DataFrame, name: str, prefix: str) -> DataFrame:
        top = best_methods(scores, ["run"], "macro_f1")
        return top.select("run", F.col("method").alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in ("macro_f1", "micro_f1")])

    pairs = best(scores_a, "method", "").join(best(scores_b, "baseline", "baseline_"), "run")
    tests = predictions.select("run", "task_label").distinct().join(pairs.select("run", "baseline", "method"), "run")
    tested = mcnemar(predictions, tests.select("run", "task_label", "baseline", "method"))
    delta = lambda c: F.try_divide((F.col(c) - F.col(f"baseline_{c}")) * 100, F.col(f"baseline_{c}"))
    out = pairs.join(tested, ["run", "baseline", "method"])
    return out.withColumn("delta_macro", delta("macro_f1")).withColumn("delta_micro", delta("micro_f1"))


def compare_methods(
    scores_a: DataFrame, scores_b: DataFrame, predictions: DataFrame, score: str = "f1"
) -> DataFrame:
    """Best methods of one family against the best of a baseline family, per task label.

    ``scores_*`` hold ``run, task_label, method`` and the score; ``delta_pct`` is
    relative to the baseline.
    """
    by = ["run", "task_label"]
    best_a = best_methods(scores_a, by, score).select(*by, "method", F.col(score).alias("score"))
    best_b = best_methods(scores_b, by, score).select(
        *by, F.col("method").alias("baseline"), F.col(score).alias("baseline_score")
    )
    pairs = best_a.join(best_b, by)
    tested = mcnemar(predictions, pairs.select(*by, "baseline", "method"))
    delta = F.try_divide((F.col("score") - F.col("baseline_score")) * 100, F.col("baseline_score"))
    return pairs.join(tested, [*by, "baseline", "method"]).withColumn("delta_pct", delta)
