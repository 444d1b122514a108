"""Train/test splits, stratified folds, one-vs-rest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from penmark.operators.ranks import SEED, shuffled_rank

TRAIN_PER_SPEAKER = 50


def split_by_count(
    speeches: DataFrame, per_group: int = TRAIN_PER_SPEAKER, by: str = "speaker", seed: int = SEED
) -> DataFrame:
    """``side``: a fixed number of shuffled rows of every speaker train, the rest test.

    Rows without a speaker belong to no group and go to the test side.
    """
    ranked = shuffled_rank(speeches, [by], seed=seed)
    train = F.col(by).isNotNull() & (F.col("rn") <= per_group)
    return ranked.withColumn("side", F.when(train, "train").otherwise("test")).drop("rn", "group_size")


def split_stratified(speeches: DataFrame, test_share: float = 0.1, label: str = "y", seed: int = SEED) -> DataFrame:
    """``side``: a share of every label tests."""
    ranked = shuffled_rank(speeches, [label], seed=seed)
    test = F.col("rn") <= F.round(F.col("group_size") * test_share)
    return ranked.withColumn("side", F.when(test, "test").otherwise("train")).drop("rn", "group_size")


def folds(speeches: DataFrame, n: int = 5, label: str = "y", seed: int = SEED) -> DataFrame:
    """``fold`` 0..n-1, sizes within one of each other inside every label."""
    ranked = shuffled_rank(speeches, [label], seed=seed)
    return ranked.withColumn("fold", ((F.col("rn") - 1) % n).cast("int")).drop("rn", "group_size")


def binary_label(speeches: DataFrame, label: str) -> DataFrame:
    """Replace ``y`` by 1 for one label and 0 for every other."""
    return speeches.withColumn("y", F.col("y").eqNullSafe(label).cast("int").cast("string"))


def binary_labels(speeches: DataFrame, labels: list[str]) -> DataFrame:
    """One 0/1 row per speech and label of a given label list, without a join."""
    each = F.explode(F.lit(labels)).alias("task_label")
    return speeches.select("speech_id", "y", each).select(
        "speech_id", "task_label", F.col("y").eqNullSafe(F.col("task_label")).cast("int").alias("y_bin")
    )


def distinct_labels(speeches: DataFrame) -> list[str]:
    """Label values in alphabetic order; one model is trained for each, so they are few."""
    rows = speeches.where(F.col("y").isNotNull()).select("y").distinct().orderBy("y").collect()
    return [r["y"] for r in rows]
