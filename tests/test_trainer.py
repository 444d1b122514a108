"""The one-pass trainer against finite differences, single fits and their objective."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from penmark.operators import learn, trainer

SCHEMA = "space int, speech_id string, y string, indices array<int>, values array<double>"


def _rows(spark, n=120, d=6, classes="abc", spaces=2, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(len(classes), d))
    rows = []
    for space in range(spaces):
        for i in range(n):
            k = i % len(classes)
            x = np.where(rng.random(d) < 0.7, centres[k] + rng.normal(scale=0.8, size=d), 0.0)
            at = np.flatnonzero(x)
            rows.append((space, str(i), classes[k], at.tolist(), x[at].tolist()))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("kind, classes", [("softmax", (0, 1, 2)), ("logit", (0, 2)), ("hinge", (1, 2))])
def test_gradients_are_slopes(kind, classes):
    rng = np.random.default_rng(3)
    p = trainer.Problem(0, 4, kind, classes, tuple(rng.uniform(0.5, 2, len(classes))), 30.0, 0.1)
    z, y = rng.normal(size=(20, p.columns)), rng.integers(0, 4, 20)
    _, slope = trainer._loss(p, z, y)
    for _ in range(10):
        i, j = rng.integers(20), rng.integers(p.columns)
        up, down = z.copy(), z.copy()
        up[i, j] += 1e-6
        down[i, j] -= 1e-6
        assert (trainer._loss(p, up, y)[0] - trainer._loss(p, down, y)[0]) / 2e-6 == pytest.approx(slope[i, j], abs=1e-6)
    unused = ~np.isin(y, classes)
    assert not slope[unused].any()


def test_all_points_equal_single_fits(spark):
    learner = "lr"
    rows = _rows(spark).cache()
    grid = learn.full_grid(learner)
    fit, held = rows.where("cast(speech_id as int) < 90"), rows.where("cast(speech_id as int) >= 90")
    sizes = {r["y"]: r["count"] for r in fit.where("space = 0").groupBy("y").count().orderBy("y").collect()}
    got = learn.fit_predict_many(learner, grid, fit, held, {0: 6, 1: 6}, {0: sizes, 1: sizes}, tol=1e-9).collect()
    assert len(got) == 2 * 30 * len(grid)
    vectors = lambda side: [
        (r.speech_id, r.y, Vectors.sparse(6, r.indices, r["values"])) for r in side.where("space = 1").collect()
    ]
    train, test = [spark.createDataFrame(vectors(s), ["speech_id", "y", "features"]).coalesce(1).cache() for s in (fit, held)]
    by = {}
    for r in got:
        by.setdefault((r.grid_idx, r.speech_id), []).append(r.y_pred)
    wrong = 0
    for i in (1, 6, 7, 12):
        single = {r.speech_id: r.y_pred for r in learn.fit_predict(learner, grid[i], train, test, tol=1e-9).collect()}
        wrong += sum(v not in by[i, k] for k, v in single.items())
    assert wrong == 0


def test_the_minimum_is_met(spark):
    rows = _rows(spark, spaces=1, classes="ab")
    problems = [trainer.Problem(0, 6, kind, (0, 1), (1.0, 2.0), 180.0, reg) for kind in ("logit", "hinge") for reg in (0.5, 0.01, 1e-4)]
    coded = rows.withColumn("y", F.when(F.col("y") == "a", 0).otherwise(1))
    fitted = trainer.fit_many(coded, problems, tol=1e-9)
    best = trainer._gradients(coded, problems, fitted)
    rng = np.random.default_rng(0)
    for _ in range(5):
        moved = trainer._gradients(coded, problems, [w + rng.normal(scale=0.01, size=w.shape) for w in fitted])
        assert all(f <= g + 1e-9 for (f, _), (g, _) in zip(best, moved))


def test_blocks_and_slices(spark, monkeypatch):
    rows = _rows(spark, spaces=1).withColumn("y", F.ascii("y") - 97)
    problems = [trainer.Problem(0, 6, "softmax", (0, 1, 2), (1.0, 1.0, 1.0), 120.0, reg) for reg in (0.1, 1.0, 0.01)]
    whole = trainer.fit_many(rows, problems, tol=1e-10)
    monkeypatch.setattr(trainer, "BLOCK_VALUES", 30)
    parts = trainer.fit_many(rows, problems, tol=1e-10)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(whole, parts))


def test_empty_sides_and_one_class(spark):
    rows = _rows(spark, spaces=1)
    none = rows.limit(0)
    assert learn.fit_predict_many("lr", [{"C": 1.0, "balanced": True}], rows, none, {0: 6}, {0: {"a": 40, "b": 40, "c": 40}}).collect() == []
    only = rows.where("y = 'b'")
    said = learn.fit_predict_many("svm", [{"C": 1.0, "balanced": True}], only, rows, {0: 6}, {0: {"b": 40}})
    assert {r.y_pred for r in said.collect()} == {"b"} and said.count() == 120
