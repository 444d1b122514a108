"""Kernel maps against exact kernels, and kernel machines on data that no line tells apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.operators import kernels, learn

SCHEMA = "space int, speech_id string, y string, indices array<int>, values array<double>"


def _cells(x):
    return kernels.Cells.of([(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x])


def _exact(kernel, x, gamma):
    inner = x @ x.T
    if kernel == "rbf":
        squares = np.diag(inner)
        return np.exp(-gamma * (squares[:, None] + squares[None] - 2 * inner))
    if kernel == "poly":
        return (gamma * inner + kernels.COEF0) ** kernels.DEGREE
    return np.tanh(gamma * inner + kernels.COEF0)


def _sparse(n=60, d=40, seed=5):
    rng = np.random.default_rng(seed)
    return np.where(rng.random((n, d)) < 0.3, rng.normal(size=(n, d)), 0.0)


@pytest.mark.parametrize("kernel", ["rbf", "poly"])
def test_error_falls_with_the_width(kernel):
    x, gamma = _sparse(), 0.08
    want = _exact(kernel, x, gamma)
    errors = []
    for width in (256, 4096):
        made = kernels.kernel_map(kernel, 40, gamma, width=width)(_cells(x))
        errors.append(np.sqrt(np.mean((made @ made.T - want) ** 2)))
    # A quarter of the error at sixteen times the width.
    assert errors[1] < 0.5 * errors[0] and errors[1] < 0.03


def test_sigmoid_equals_its_large_directions_on_landmarks():
    x, gamma = _sparse(), 0.08
    want = _exact("sigmoid", x, gamma)
    made = kernels.kernel_map("sigmoid", 40, gamma, _cells(x))(_cells(x))
    values, vectors = np.linalg.eigh(want)
    large = np.where(values > kernels.CUT * values.max(), values, 0)
    assert np.allclose(made @ made.T, (vectors * large) @ vectors.T, atol=1e-8)


@pytest.mark.parametrize("n, d, dense", [(600, 5, 1.0), (900, 300, 0.1)])
def test_sigmoid_of_rows_that_are_no_landmarks(n, d, dense):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((n, d)) < dense, rng.normal(size=(n, d)) if dense == 1 else rng.random((n, d)), 0.0)
    gamma = 1 / (d * x.var())
    want = _exact("sigmoid", x, gamma)[500:, 500:]
    made = kernels.kernel_map("sigmoid", d, gamma, _cells(x[:500]))(_cells(x[500:]))
    assert np.sqrt(np.mean((made @ made.T - want) ** 2)) < 0.06


def test_panels_and_empty_rows(monkeypatch):
    x = _sparse()
    x[3] = 0.0
    whole = kernels._fourier(40, 0.1, 64, 1)(_cells(x))
    assert whole.shape == (60, 64) and np.isfinite(whole).all()
    dot = _cells(x).dot(_cells(x), 40)
    monkeypatch.setattr(kernels, "PANEL", 100)
    assert np.allclose(_cells(x).dot(_cells(x), 40), dot) and np.allclose(dot, x @ x.T)
    assert kernels.kernel_map("poly", 40, 0.1, width=64)(_cells(x[3:4])).any() == (kernels.COEF0 != 0)
    with pytest.raises(ValueError):
        kernels.kernel_map("linear", 40, 0.1)


def _rings(spark, n=160, spaces=2):
    rng = np.random.default_rng(2)
    rows = []
    for space in range(spaces):
        for i in range(n):
            far = i % 2
            angle, r = rng.uniform(0, 2 * np.pi), (2.0 if far else 0.6) + rng.normal(scale=0.1)
            rows.append((space, str(i), "far" if far else "near", [0, 2], [float(r * np.cos(angle)), float(r * np.sin(angle))]))
    return spark.createDataFrame(rows, SCHEMA)


def test_gamma_is_the_usual_one(spark):
    rows = _rings(spark, spaces=1)
    x = np.zeros((160, 3))
    for k, r in enumerate(rows.collect()):
        x[k, r.indices] = r["values"]
    assert kernels.gammas(rows, {0: 3})[0] == pytest.approx(1 / (3 * x.var()))
    assert kernels.gammas(rows.limit(0), {0: 3}) == {0: 1.0}


def test_rings_need_the_round_kernel(spark):
    rows = _rings(spark).cache()
    fit, held = rows.where("cast(speech_id as int) < 100"), rows.where("cast(speech_id as int) >= 100")
    grid = [{"C": 10.0, "balanced": False, "kernel": k} for k in kernels.KERNELS]
    sizes = {"far": 50, "near": 50}
    said = learn.fit_predict_many("svm", grid, fit, held, {0: 3, 1: 3}, {0: sizes, 1: sizes})
    got = {r.grid_idx: (r.n, r.right) for r in said.groupBy("grid_idx").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("right")).collect()}
    assert {k: n for k, (n, _) in got.items()} == {0: 120, 1: 120, 2: 120, 3: 120}
    assert got[2][1] > 0.97 and got[0][1] < 0.8


def test_a_map_does_not_depend_on_the_partitions(spark):
    rows = _rings(spark, 40)
    made = []
    for parts in (1, 5):
        out, numbers, sizes = kernels.map_rows(rows.repartition(parts), rows, {0: 3, 1: 3}, kernels.KERNELS, width=32)
        assert sizes[numbers[1, "rbf"]] == 32 and sizes[numbers[0, "linear"]] == 3 and sizes[numbers[1, "sigmoid"]] == 32
        made.append({(r.space, r.speech_id): r["values"] for r in out.collect()})
    assert made[0].keys() == made[1].keys() and len(made[0]) == 2 * 40 * 4
    assert all(np.allclose(v, made[1][k]) for k, v in made[0].items())


def test_held_rows_are_mapped_where_they_are_read(spark, monkeypatch):
    """Nothing but the fit rows is written under a kernel: 4 KB a row would be 12 GB for three million."""
    from penmark.operators import trainer

    written, whole = [], trainer.staged
    monkeypatch.setattr(learn, "staged", lambda df: pytest.fail("mapped rows written"))
    monkeypatch.setattr(trainer, "staged", lambda df: (written.append(df.count()), whole(df))[1])
    rows = _rings(spark, spaces=1).cache()
    fit, held = rows.where("cast(speech_id as int) < 40"), rows.where("cast(speech_id as int) >= 40")
    said = learn.fit_predict_many("svm", [{"C": 10.0, "balanced": False, "kernel": "rbf"}], fit, held, {0: 3}, {0: {"far": 20, "near": 20}})
    assert said.count() == 120 and written == [40]


@pytest.mark.parametrize("size, n", [(30, 5), (100_000, 300)])
def test_products_of_close_and_far_columns(size, n):
    rng = np.random.default_rng(8)
    rows = [(np.sort(rng.choice(size, k, replace=False)), rng.normal(size=k)) for k in rng.integers(0, 9, n)]
    turn = rng.normal(size=(size, 3))
    want = [v @ turn[i] for i, v in rows]
    assert np.allclose(kernels.Cells.of(rows).times(turn), want)
