import math
import json
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from penmark.operators import features as x
from penmark.operators import learn
from penmark.plans import experiments as ex


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        y = "abc"[i % 3]
        centre = {"a": (0.0, 0.0), "b": (4.0, 0.0), "c": (0.0, 4.0)}[y]
        rows.append((i, y, Vectors.sparse(2, [0, 1], list(rng.normal(centre, 0.6)))))
    df = spark.createDataFrame(rows, ["speech_id", "y", "features"]).coalesce(1).cache()
    return df.where("speech_id < 90"), df.where("speech_id >= 90")


@pytest.mark.parametrize("learner, point", [
    ("lr", {"C": 1.0, "balanced": True}),
    ("svm", {"C": 1.0, "balanced": False}),
    ("rf", {"n_trees": 10, "impurity": "entropy", "balanced": True, "max_depth": 5}),
])
def test_learners_separate_clear_classes(points, learner, point):
    train, test = points
    got = learn.fit_predict(learner, point, train, test).toPandas()
    assert len(got) == 30 and (got["y_true"] == got["y_pred"]).mean() > 0.9


def test_single_class_and_unknown_learner(points):
    train, test = points
    only = learn.fit_predict("lr", {"C": 1.0, "balanced": True}, train.where("y = 'a'"), test)
    assert {r["y_pred"] for r in only.collect()} == {"a"}
    with pytest.raises(ValueError):
        learn.fit_predict("knn", {"balanced": False}, train, test)


def test_grids_and_weights():
    assert [len(learn.full_grid(k)) for k in ("lr", "rf", "svm")] == [14, 28, 56]
    assert learn.full_grid("lr")[:2] == [{"C": 0.001, "balanced": True}, {"C": 0.001, "balanced": False}]
    assert learn.class_weights({"a": 30, "b": 10}, True) == {"a": pytest.approx(2 / 3), "b": 2.0}


def test_logistic_regression_meets_its_objective(spark):
    """The fitted plane must minimise |w|^2/2 + C * sum of weighted losses."""
    rng = np.random.default_rng(9)
    xs = rng.normal(size=(60, 2))
    ys = (xs[:, 0] + 0.5 * rng.normal(size=60) > 0.4).astype(int)
    rows = [(i, str(ys[i]), Vectors.dense(xs[i])) for i in range(60)]
    df = spark.createDataFrame(rows, ["speech_id", "y", "features"])
    c = 0.7
    sizes = learn.class_sizes(df)
    weights = learn.class_weights(sizes, True)
    prepared = learn._prepared(df, list(sizes), weights)
    model = learn.LogisticRegression(
        regParam=1 / (c * 60), standardization=False, maxIter=1000, tol=1e-10, **learn._COLUMNS
    ).fit(prepared)
    w, b = model.coefficients.toArray(), model.intercept

    def objective(w, b):
        margin = (2 * ys - 1) * (xs @ w + b)
        each = np.array([weights[str(y)] for y in ys])
        return (w @ w) / 2 + c * (each * np.log1p(np.exp(-margin))).sum()

    best = objective(w, b)
    for step in np.random.default_rng(1).normal(scale=0.02, size=(200, 3)):
        assert objective(w + step[:2], b + step[2]) >= best - 1e-9


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(2)
    dense = np.abs(rng.normal(size=(40, 6))) * [5, 1, 3, 1, 0.5, 0.2]
    rows = [(i, Vectors.dense(r)) for i, r in enumerate(dense)]
    got = learn.truncated_svd(spark.createDataFrame(rows, ["speech_id", "features"])).orderBy("idx").toPandas()
    v = np.linalg.svd(dense, full_matrices=False)[2][:2].T
    for k in range(2):
        column = v[:, k] * np.sign(v[abs(v[:, k]).argmax(), k])
        assert got[f"v{k + 1}"].to_numpy() == pytest.approx(column, abs=1e-8)


def test_block_svd_of_low_rank_and_close_values(spark):
    rng = np.random.default_rng(8)
    left, right = np.linalg.qr(rng.normal(size=(60, 12)))[0], np.linalg.qr(rng.normal(size=(30, 12)))[0]
    for values in ([5, 4.8, 4.5, 1, 1, 0.5, 0.4, 0.3, 0.2, 0.1, 0, 0], [3, 2] + [0] * 10):
        dense = left @ np.diag(values) @ right.T
        rows = [(i, j, float(dense[i, j])) for i in range(60) for j in range(30)]
        components, found = learn.block_svd(spark.createDataFrame(rows, "row long, idx int, value double"), 2)
        assert found == pytest.approx(values[:2], rel=1e-8)
        v = components.orderBy("idx").toPandas()[["v1", "v2"]].to_numpy()
        assert v.T @ v == pytest.approx(np.eye(2), abs=1e-8)
        assert np.abs(v.T @ right[:, :2]) == pytest.approx(np.eye(2), abs=1e-4)


@pytest.fixture(scope="module")
def encoded(spark):
    rng = random.Random(11)
    habit = {"Ana": ["NOUN", "NOUN", "ADJ"], "Bea": ["VERB", "PRON", "VERB"], "Ciro": ["NOUN", "VERB", "DET"]}
    rows = []
    for i in range(120):
        who = ["Ana", "Bea", "Ciro"][i % 3]
        tags = [rng.choice(habit[who] + ["ADP"]) for _ in range(25)]
        codes = [rng.choice(["EmoPos", "w"]) if who == "Ana" else rng.choice(["EmoNeg", "w"]) for _ in range(25)]
        text = " ".join(rng.choice(["de", "la", "casa", "mesa", "que"]) for _ in range(25)) + "."
        status = "Coalition" if i % 2 else "Opposition"
        rows.append((i, who, "FM"[i % 3 == 1], status, "Izquierda" if who == "Ana" else "Derecha", text, " ".join(tags), "+-" * 5, codes))
    schema = ("speech_id long, speaker string, gender string, party_status string, wing string, text string, pos_tags string,"
              " stress string, feels array<string>")
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.col("feels").alias(c) for c in ("gram", "obj", "cog", "cdi")])


GRID = [{"C": 0.001, "balanced": True}, {"C": 10.0, "balanced": True}]


def test_multiclass_experiment(encoded):
    out = ex.run_experiment(encoded, "MC", "name", "lr", ["pos_tags"], train_rows=20, grid=GRID)
    results = {r["metric"]: r for r in out.results.collect()}
    assert set(results) == {"macro_f1", "micro_f1"} and results["macro_f1"]["value"] > 0.8
    assert results["micro_f1"]["n_features"] > 10
    # Both points separate the speakers, so the first in grid order is chosen.
    assert json.loads(results["micro_f1"]["params"]) == GRID[0]
    assert out.predictions.count() == 60 and out.predictions.select("speech_id").distinct().count() == 60


def test_binary_and_party_status_experiments(encoded):
    grid = GRID[1:]
    out = ex.run_experiment(encoded, "BC", "name", "svm", ["liwc_feels", "pos_tags"], train_rows=20, grid=grid)
    got = {r["label"]: r["value"] for r in out.results.collect()}
    assert set(got) == {"Ana", "Bea", "Ciro"} and got["Bea"] > 0.8
    counts = x.staged_counts(encoded, ["pos_tags"])
    status = ex.party_status_experiment(encoded, "lr", ["pos_tags"], "Bea", train_rows=10, grid=grid, counts=counts)
    rows = {r["label"]: r for r in status.results.collect()}
    assert set(rows) == {"Coalition", "Opposition"} and rows["Coalition"]["run"] == "AV_lr_name_partystatus"
    # 40 rows of each other speaker, 20 of the author; 10 of each train.
    assert status.predictions.groupBy("task_label").count().toPandas()["count"].tolist() == [70, 70]


def test_series_skips_stored_methods(spark, encoded, tmp_path):
    store = str(tmp_path / "store")
    sets = [["pos_tags", "base_features"], ["base_features"]]
    for _ in range(2):
        ex.run_series(encoded, "MC", "gender", "lr", store, sets, train_rows=20, grid=GRID[1:])
    stored = ex.files.read_long(spark, f"{store}/results", ex.RESULTS_SCHEMA).toPandas()
    assert sorted(stored["method"]) == ["BaseFeatures"] * 2 + ["BaseFeatures + POS"] * 2
    preds = ex.files.read_long(spark, f"{store}/predictions", ex.PREDICTIONS_SCHEMA)
    scored = ex.score_predictions(preds, "MC").toPandas()
    merged = scored.merge(stored, on=["method", "metric"])
    assert len(merged) == 4 and (merged["value_x"] == merged["value_y"]).all()


def test_fold_features_see_only_their_training_part(encoded):
    counts = {"pos_tags": x.block_counts(encoded, "pos_tags")}
    rows = encoded.select("speech_id", F.col("speaker").alias("y"))
    rare = counts["pos_tags"].unionByName(counts["pos_tags"].limit(1).withColumn("gram", F.lit("zzz")).withColumn("speech_id", F.lit(119).cast("long")))
    _, with_all = ex.fitted_vectors({"pos_tags": rare}, rows, rows)
    _, without = ex.fitted_vectors({"pos_tags": rare}, rows.where("speech_id < 119"), rows)
    assert with_all > without


def test_components_for_every_speech(encoded):
    got = ex.lsa_by_wing(encoded).toPandas()
    assert len(got) == 120 and set(got["wing"]) == {"Left", "Right"} and got["c1"].abs().max() > 0


@pytest.mark.parametrize("wide", [False, True])
def test_block_svd_reads_the_rows_once_a_round(spark, monkeypatch, wide):
    """The array form meets numpy and the joined form, for dense and sparse pieces; no round joins the cells."""
    rng = np.random.default_rng(6)
    n = 4000 if wide else 25
    rows = [(i, int(j), float(rng.random() + (j < 3))) for i in range(150) for j in rng.choice(n, 9, replace=False)]
    rows += [(i, i % 4, 2.0 + i % 4) for i in range(150)]  # cells that come twice add up
    cells = spark.createDataFrame(rows, "row long, idx int, value double").repartition(3)
    monkeypatch.setattr(learn, "CELLS", 200)
    joins = []
    whole = type(cells).join
    monkeypatch.setattr(type(cells), "join", lambda self, *a, **b: (joins.append(1), whole(self, *a, **b))[1])
    got, found = learn.block_svd(cells, 2)
    assert not joins
    dense = np.zeros((150, n))
    for i, j, v in rows:
        dense[i, j] += v
    assert found == pytest.approx(np.linalg.svd(dense, compute_uv=False)[:2], rel=1e-8)
    monkeypatch.setattr(learn, "DRIVER_FEATURES", 1)
    joined, _ = learn.block_svd(cells, 2)
    one, two = [x.orderBy("idx").toPandas() for x in (got, joined)]
    assert joins and one["idx"].tolist() == two["idx"].tolist()
    for c in ("v1", "v2"):
        assert one[c].to_numpy() == pytest.approx(two[c].to_numpy(), abs=1e-6)


def test_folds_read_the_training_counts_alone(encoded, monkeypatch):
    """Folds see counts of the training side only, so their work does not grow with the test side."""
    seen, whole = [], ex._spaces
    monkeypatch.setattr(ex, "_spaces", lambda counts, *a: (seen.append(counts), whole(counts, *a))[1])
    out = ex.run_experiment(encoded, "MC", "name", "svm", ["pos_tags", "base_features"], train_rows=20, grid=[{**GRID[0], "kernel": "rbf"}, {**GRID[1], "kernel": "rbf"}])
    assert [c.select("speech_id").distinct().count() for c in seen[0].values()] == [60] * 4
    assert out.predictions.count() == 60


@pytest.mark.parametrize("wide", [False, True])
def test_stored_rows_give_components_and_points(spark, monkeypatch, wide):
    """Rows written once serve the decomposition and the projection, by arrays (also for a null id) and by joins."""
    rng = np.random.default_rng(7)
    rows = [(i or (0 if wide else None), [i % 2, 2 + i % 7], [8.0 - 4 * (i % 2), float(rng.random())]) for i in range(50)]
    dense = np.zeros((50, 9))
    for n, (_, idx, values) in enumerate(rows):
        dense[n, idx] = values
    monkeypatch.setattr(learn, "CELLS", 40)
    if wide:
        monkeypatch.setattr(learn, "DRIVER_FEATURES", 1)
    stored = learn.stored_rows(spark.createDataFrame(rows, "row long, indices array<int>, values array<double>").repartition(3))
    components, found = learn.block_svd(stored, 2)
    assert found == pytest.approx(np.linalg.svd(dense, compute_uv=False)[:2], rel=1e-8)
    basis = np.zeros((9, 2))
    for r in components.collect():
        basis[r["idx"]] = r["v1"], r["v2"]
    points = learn.project(stored, components)
    assert wide or "Exchange" not in points._jdf.queryExecution().executedPlan().toString()
    got = {r["row"]: (r["c1"], r["c2"]) for r in points.collect()}
    assert np.linalg.norm(dense @ basis, axis=0) == pytest.approx(found, rel=1e-6)
    assert len(got) == 50 and all(got[rows[i][0]] == pytest.approx(dense[i] @ basis, abs=1e-9) for i in range(50))


def test_lsa_moves_a_speech_once(spark, encoded, monkeypatch):
    """Cells are not joined with their columns one by one, neither for the matrix nor for the points."""
    joins, whole = [], type(encoded).join
    monkeypatch.setattr(type(encoded), "join", lambda self, *a, **b: (joins.append(self.columns), whole(self, *a, **b))[1])
    out = ex.lsa_by_wing(encoded.unionByName(encoded.limit(2))).collect()
    assert len(out) == 122 and all(math.isfinite(r["c1"]) and math.isfinite(r["c2"]) for r in out)
    cells = [c for c in joins if "feature" in c and "value" in c]
    assert len(cells) == 1  # function words and length curves alone
