"""Classification experiments: split, folds, grid search, prediction, scores, result store."""

from __future__ import annotations

import json
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from penmark.operators import corpus as c
from penmark.operators import features as x
from penmark.operators import learn
from penmark.operators import metrics as m
from penmark.operators import splits as sp
from penmark.plans.feature_sets import FULL, feature_sets, method_name, series
from penmark.session import staged, staged_together
from penmark.sources import files

RESULTS_SCHEMA = "run string, method string, label string, metric string, value double, params string, n_features int"
PREDICTIONS_SCHEMA = "run string, task_label string, method string, speech_id string, y_true string, y_pred string"

N_FOLDS = 5
TASKS = ["MC", "BC"]


class Experiment(NamedTuple):
    results: DataFrame
    predictions: DataFrame


class Best(NamedTuple):
    predictions: DataFrame  # speech_id, y_true, y_pred
    params: dict
    n_features: int


def _counts_of(counts: dict[str, DataFrame], rows: DataFrame) -> dict[str, DataFrame]:
    """The counts of some speeches, written once: folds and fits read them many times, and the others' counts not at all."""
    ids = rows.select("speech_id")
    return staged_together({block: of_block.join(ids, "speech_id", "left_semi") for block, of_block in counts.items()})


def fitted_vectors(
    counts: dict[str, DataFrame], fit_rows: DataFrame, rows: DataFrame, arrays: bool = False, fit_counts: dict[str, DataFrame] | None = None
) -> tuple[DataFrame, int]:
    """Vectors of ``rows`` (``speech_id, y, ...``) from blocks fitted on ``fit_rows`` only, or their ``indices, values``.

    ``fit_counts`` are counts that hold those of ``fit_rows``, where they are fewer than ``counts``.
    """
    fit_on = fit_rows.select("speech_id", "y")
    fitted, parts = [], []
    for block, block_counts in counts.items():
        mine = (fit_counts or counts)[block].join(fit_on.select("speech_id"), "speech_id", "left_semi")
        fit = x.fit_block(block, mine, fit_on)
        fitted.append(fit)
        parts.append(x.apply_block(fit, block_counts.join(rows.select("speech_id"), "speech_id", "left_semi")))
    features = parts[0]
    for part in parts[1:]:
        features = features.unionByName(part)
    index, size = x.feature_index(fitted, rows)
    if arrays:
        return staged(x.to_arrays(features, index, size, rows)), size
    return x.to_vectors(features, index, size, rows), size


def _spaces(counts: dict[str, DataFrame], folded: DataFrame, parallelism: int) -> tuple[DataFrame, dict[int, int]]:
    """The vectors of every fold's own features, as ``space``, and how many features each has."""
    with ThreadPool(parallelism) as pool:
        made = pool.map(lambda k: fitted_vectors(counts, folded.where(F.col("fold") != k), folded, arrays=True), range(N_FOLDS))
    parts = [rows.withColumn("space", F.lit(k)) for k, (rows, _) in enumerate(made)]
    return _union(parts), {k: size for k, (_, size) in enumerate(made)}


def _class_sizes(fit: DataFrame) -> dict[int, dict[str, int]]:
    """Rows per label of each space, labels in alphabetic order."""
    out: dict[int, dict[str, int]] = {}
    for r in fit.groupBy("space", "y").count().orderBy("space", "y").collect():
        out.setdefault(r["space"], {})[r["y"]] = r["count"]
    return out


def _linear_search(rows: DataFrame, counts: dict[str, DataFrame], learner: str, score: str, grid: list[dict], parallelism: int) -> Best:
    """All folds and grid points of a linear learner fitted together, then the best one on the whole training side."""
    train, best = rows.where("side = 'train'"), 0
    known = _counts_of(counts, train)
    if len(grid) > 1:
        folded = staged(sp.folds(train.select("speech_id", "y"), N_FOLDS))
        vectors, sizes = _spaces(known, folded, parallelism)
        fit, held = vectors.where("fold <> space"), vectors.where("fold = space")
        pooled = staged(learn.fit_predict_many(learner, grid, fit, held, sizes, _class_sizes(fit)))
        best = m.best_grid_point(pooled_scores(pooled, score), []).first()["grid_idx"]
    vectors, size = fitted_vectors(counts, train, rows, arrays=True, fit_counts=known)
    vectors = vectors.withColumn("space", F.lit(0))
    fit, held = vectors.where("side = 'train'"), vectors.where("side = 'test'")
    predicted = learn.fit_predict_many(learner, [grid[best]], fit, held, {0: size}, _class_sizes(fit))
    return Best(predicted.drop("grid_idx"), grid[best], size)


def optimise(
    rows: DataFrame,
    counts: dict[str, DataFrame],
    learner: str,
    score: str,
    grid: list[dict] | None = None,
    parallelism: int = N_FOLDS,
) -> Best:
    """Grid search on the training side, then one fit on all of it and the test predictions.

    ``rows`` holds ``speech_id, y, side``. Every fold fits its own features. A
    point's score is the F1 of its pooled out-of-fold predictions.
    """
    grid = grid or learn.full_grid(learner)
    if learner in ("lr", "svm"):
        return _linear_search(rows, counts, learner, score, grid, parallelism)
    train = rows.where("side = 'train'")
    known, best = _counts_of(counts, train), 0
    if len(grid) > 1:
        folded = staged(sp.folds(train.select("speech_id", "y"), N_FOLDS))

        def fold_predictions(k: int) -> list[DataFrame]:
            vectors, _ = fitted_vectors(known, folded.where(F.col("fold") != k), folded)
            fit, held = vectors.where(F.col("fold") != k), vectors.where(F.col("fold") == k)
            return [
                learn.fit_predict(learner, point, fit, held).withColumn("grid_idx", F.lit(i))
                for i, point in enumerate(grid)
            ]

        with ThreadPool(parallelism) as pool:
            parts = [p for fold in pool.map(fold_predictions, range(N_FOLDS)) for p in fold]
        pooled = parts[0]
        for part in parts[1:]:
            pooled = pooled.unionByName(part)
        best = m.best_grid_point(pooled_scores(pooled, score), []).first()["grid_idx"]
    vectors, size = fitted_vectors(counts, train, rows, fit_counts=known)
    predicted = learn.fit_predict(
        learner, grid[best], vectors.where("side = 'train'"), vectors.where("side = 'test'")
    )
    return Best(predicted, grid[best], size)


def pooled_scores(predictions: DataFrame, score: str) -> DataFrame:
    """``grid_idx, score``: macro F1 or F1 of class 1 over all folds' predictions."""
    if score == "binary":
        return m.f1_binary(predictions, ["grid_idx"]).withColumnRenamed("f1", "score")
    scores = m.f1_macro_micro(predictions, ["grid_idx"])
    return scores.select("grid_idx", F.col("macro_f1").alias("score"))


def split_rows(encoded: DataFrame, focus: str, train_rows: int) -> DataFrame:
    """``speech_id, y, side``; always split by speaker, whatever the label."""
    labelled = c.with_label(encoded, focus).where(F.col("y").isNotNull())
    return staged(sp.split_by_count(labelled.select("speech_id", "speaker", "y"), train_rows).drop("speaker"))


def _predictions(run: str, task_label: str, method: str, best: Best) -> DataFrame:
    return best.predictions.select(
        F.lit(run).alias("run"), F.lit(task_label).alias("task_label"), F.lit(method).alias("method"),
        F.col("speech_id").cast("string").alias("speech_id"), "y_true", "y_pred",
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _binary_results(predictions: DataFrame, params: dict[str, Best]) -> DataFrame:
    """One F1 per label, to 3 places, with the parameters chosen for it."""
    scores = m.f1_binary(predictions)
    chosen = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("task_label"), F.lit(json.dumps(b.params)).alias("params"), F.lit(b.n_features).alias("n_features"))
                for k, b in params.items()
            ]
        )
    )
    info = predictions.sparkSession.range(1).select(chosen.alias("c")).select("c.*")
    return scores.join(info, "task_label").select(
        "run", "method", F.col("task_label").alias("label"), F.lit("f1").alias("metric"),
        F.bround("f1", 3).alias("value"), "params", "n_features",
    )


def run_experiment(
    encoded: DataFrame,
    task: str,
    focus: str,
    learner: str,
    switches: list[str],
    train_rows: int = sp.TRAIN_PER_SPEAKER,
    grid: list[dict] | None = None,
    counts: dict[str, DataFrame] | None = None,
) -> Experiment:
    """One feature set: several classes at once (``MC``) or each label against the rest (``BC``)."""
    if task not in TASKS:
        raise ValueError(f"task must be one of {TASKS}")
    run, method = f"{task}_{learner}_{focus}", method_name(switches)
    counts = counts or x.staged_counts(encoded, switches)
    counts = {b: counts[b] for b in x.blocks_of(switches)}
    rows = split_rows(encoded, focus, train_rows)
    if task == "MC":
        best = optimise(rows, counts, learner, "macro", grid)
        predictions = staged(_predictions(run, "all", method, best))
        scores = m.f1_macro_micro(predictions).unpivot(["run", "method"], ["macro_f1", "micro_f1"], "metric", "value")
        results = scores.select(
            "run", "method", F.lit("all").alias("label"), "metric", F.bround("value", 3).alias("value"),
            F.lit(json.dumps(best.params)).alias("params"), F.lit(best.n_features).alias("n_features"),
        )
        return Experiment(results, predictions)
    parts, chosen = [], {}
    for label in sp.distinct_labels(rows):
        chosen[label] = optimise(sp.binary_label(rows, label), counts, learner, "binary", grid)
        parts.append(staged(_predictions(run, label, method, chosen[label])))
    predictions = _union(parts)
    return Experiment(_binary_results(predictions, chosen), predictions)


def party_status_experiment(
    encoded: DataFrame,
    learner: str,
    switches: list[str],
    author: str,
    train_rows: int = sp.TRAIN_PER_SPEAKER,
    grid: list[dict] | None = None,
    counts: dict[str, DataFrame] | None = None,
) -> Experiment:
    """Verify one author within each party status, all other speakers kept."""
    run, method = f"AV_{learner}_name_partystatus", method_name(switches)
    counts = counts or x.staged_counts(encoded, switches)
    counts = {b: counts[b] for b in x.blocks_of(switches)}
    statuses = sp.distinct_labels(c.with_label(encoded, "party_status"))
    parts, chosen = [], {}
    for status in statuses:
        rows = split_rows(c.without_other_status(encoded, author, status), "name", train_rows)
        chosen[status] = optimise(sp.binary_label(rows, author), counts, learner, "binary", grid)
        parts.append(staged(_predictions(run, status, method, chosen[status])))
    predictions = _union(parts)
    return Experiment(_binary_results(predictions, chosen), predictions)


def run_series(
    encoded: DataFrame,
    task: str,
    focus: str,
    learner: str,
    store: str,
    sets: list[list[str]] | None = None,
    author: str | None = None,
    **options,
) -> None:
    """Run every feature set that has no stored result yet and append its rows.

    Block counts are shared by the whole series. ``focus='party_status'`` with
    task ``BC`` verifies one ``author`` per status.
    """
    spark = encoded.sparkSession
    sets = sets or series()
    verify = task == "BC" and focus == "party_status"
    run = f"AV_{learner}_name_partystatus" if verify else f"{task}_{learner}_{focus}"
    results = files.read_long(spark, f"{store}/results", RESULTS_SCHEMA)
    open_methods = {r["method"] for r in files.todo_methods(feature_sets(spark), results, run).collect()}
    todo = [s for s in sets if method_name(s) in open_methods]
    if not todo:
        return
    counts = x.staged_counts(encoded, sorted({s for one in todo for s in one}))
    for switches in todo:
        if verify:
            out = party_status_experiment(encoded, learner, switches, author, counts=counts, **options)
        else:
            out = run_experiment(encoded, task, focus, learner, switches, counts=counts, **options)
        # Predictions first: a method counts as done only when its result row exists.
        files.append_predictions(out.predictions, f"{store}/predictions")
        files.append_results(out.results, f"{store}/results")


def score_predictions(predictions: DataFrame, task: str) -> DataFrame:
    """Score any model's predictions: macro and micro F1 (``MC``) or F1 per label (``BC``)."""
    if task not in TASKS:
        raise ValueError(f"task must be one of {TASKS}")
    if task == "BC":
        rows = m.f1_binary(predictions)
        return rows.select("run", "method", F.col("task_label").alias("label"), F.lit("f1").alias("metric"), F.bround("f1", 3).alias("value"))
    rows = m.f1_macro_micro(predictions).unpivot(["run", "method"], ["macro_f1", "micro_f1"], "metric", "value")
    return rows.select("run", "method", F.lit("all").alias("label"), "metric", F.bround("value", 3).alias("value"))


def lsa_by_wing(encoded: DataFrame) -> DataFrame:
    """Two latent components of every speech over the full feature set, with its wing."""
    labels = c.with_label(encoded, "name").select("speech_id", "y")
    features, _, _ = x.feature_arrays(encoded, labels, FULL)
    features = learn.stored_rows(features.withColumnRenamed("speech_id", "row"))
    components, _ = learn.block_svd(features)
    points = learn.project(features, components).withColumnRenamed("row", "speech_id")
    rows = encoded.select("speech_id", c.wing_english("wing").alias("wing")).join(points, "speech_id", "left")
    zero = F.lit(0.0)
    return rows.select("speech_id", "wing", F.coalesce("c1", zero).alias("c1"), F.coalesce("c2", zero).alias("c2"))
