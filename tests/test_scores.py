import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.operators import corpus as c
from penmark.operators import metrics as m
from penmark.operators import stats as st


def predictions(spark, rows, method="M", task="t"):
    data = [("r", task, method, i, a, b) for i, (a, b) in enumerate(rows)]
    return spark.createDataFrame(data, "run string, task_label string, method string, speech_id long, y_true string, y_pred string")


def test_macro_counts_labels_seen_only_in_predictions(spark):
    row = m.f1_macro_micro(predictions(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")])).first()
    assert row["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    assert row["micro_f1"] == pytest.approx(0.5)


def test_binary_f1(spark):
    assert m.f1_binary(predictions(spark, [("1", "1"), ("0", "1"), ("1", "0"), ("0", "0")])).first()["f1"] == 0.5
    assert m.f1_binary(predictions(spark, [("0", "0")])).first()["f1"] == 0.0


def test_best_methods_keep_ties_and_grid_keeps_order(spark):
    scores = spark.createDataFrame([("x", "A", 0.5), ("x", "B", 0.5), ("x", "C", 0.1)], "task_label string, method string, f1 double")
    assert sorted(r["method"] for r in m.best_methods(scores, ["task_label"]).collect()) == ["A", "B"]
    grid = spark.createDataFrame([(0, 0.1), (1, 0.7), (2, 0.7)], "grid_idx int, score double")
    assert m.best_grid_point(grid, []).first()["grid_idx"] == 1


def test_mcnemar_cells_and_symmetry(spark):
    truth = ["1"] * 6 + ["0"] * 2
    a = predictions(spark, [(t, t if i < 5 else "x") for i, t in enumerate(truth)], "A")
    b = predictions(spark, [(t, t if i == 5 else "x") for i, t in enumerate(truth)], "B")
    both = a.unionByName(b)
    pairs = spark.createDataFrame([("r", "t", "A", "B"), ("r", "t", "B", "A")], "run string, task_label string, baseline string, method string")
    got = {r["method"]: r for r in m.mcnemar(both, pairs).collect()}
    assert (got["B"]["yy"], got["B"]["yn"], got["B"]["ny"], got["B"]["nn"]) == (0, 5, 1, 2)
    assert got["A"]["p"] == got["B"]["p"] == pytest.approx(0.21875) and not got["A"]["significant"]


def test_comparison_pairs_all_ties(spark):
    preds = predictions(spark, [("1", "1"), ("0", "0")], "A").unionByName(predictions(spark, [("1", "1"), ("0", "0")], "B"))
    preds = preds.unionByName(predictions(spark, [("1", "1"), ("0", "1")], "Base"))
    scores = m.f1_binary(preds)
    out = m.compare_methods(scores.where("method <> 'Base'"), scores.where("method = 'Base'"), preds).collect()
    assert sorted(r["method"] for r in out) == ["A", "B"]
    assert all(r["delta_pct"] == pytest.approx(50.0) and r["p"] == 1.0 for r in out)


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(5)
    rows = [("M", f"s{i}", round(rng.gauss({"a": 0.2, "b": 0.25, "c": 0.7}[g], 0.05), 3), g)
            for i, g in enumerate("aaaaabbbbbbbcccc")]
    return spark.createDataFrame(rows, "method string, speaker string, f1 double, grp string"), rows


def plain_anova(by):
    values = np.concatenate(list(by.values()))
    ssb = sum(len(v) * (np.mean(v) - values.mean()) ** 2 for v in by.values())
    ssw = sum(((v - np.mean(v)) ** 2).sum() for v in by.values())
    d1, d2 = len(by) - 1, len(values) - len(by)
    return ssb / d1 / (ssw / d2), ssw / d2


def by_group(rows, f=lambda v: v):
    return {g: f(np.array([r[2] for r in rows if r[3] == g])) for g in "abc"}


def test_anova_and_levene(groups):
    df, rows = groups
    f, mse = plain_anova(by_group(rows))
    got = st.anova(df, ["method"]).first()
    assert got["f_stat"] == pytest.approx(f) and got["mse"] == pytest.approx(mse) and got["p"] < 1e-6
    shifted = st.anova(df.withColumn("f1", F.col("f1") + 3), ["method"]).first()
    assert shifted["f_stat"] == pytest.approx(f)
    dev = by_group(rows, lambda v: abs(v - np.median(v)))
    assert st.levene(df, ["method"]).first()["f_stat"] == pytest.approx(plain_anova(dev)[0])


def test_tukey_only_after_a_significant_test(groups):
    df, rows = groups
    got = {(r["group_a"], r["group_b"]): r for r in st.tukey_hsd(df, ["method"]).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert got[("a", "c")]["reject"]
    rng = np.random.default_rng(1)
    means = rng.normal(size=(400_000, 3))
    error = np.sqrt(rng.chisquare(13, 400_000) / 13)
    simulated = (means.max(axis=1) - means.min(axis=1)) / error
    for r in got.values():
        assert r["p"] == pytest.approx((simulated > r["q"]).mean(), abs=2e-3)
    same = df.withColumn("f1", F.when(F.col("f1") > 0, F.crc32("speaker") % 10 / 10.0))
    if st.anova(same, ["method"]).first()["p"] >= 0.05:
        assert st.tukey_hsd(same, ["method"]).count() == 0


def test_single_groups_drop(spark, groups):
    df, _ = groups
    labels = df.select("speaker", F.when(F.col("speaker") == "s0", "alone").otherwise(F.col("grp")).alias("label"))
    assert st.with_groups(df.drop("grp"), labels).count() == 15


def test_spearman_with_ties(spark):
    rows = [("M", 1.0, 2.0), ("M", 2.0, 1.0), ("M", 2.0, 4.0), ("M", 4.0, 4.0), ("M", 5.0, 9.0), ("M", None, 1.0)]
    df = spark.createDataFrame(rows, "method string, x double, y double")
    rx, ry = np.array([1, 2.5, 2.5, 4, 5]), np.array([2, 1, 3.5, 3.5, 5])
    got = st.spearman(df, ["method"], "x", "y").first()
    r = np.corrcoef(rx, ry)[0, 1]
    assert got["n"] == 5 and got["r"] == pytest.approx(r)
    t = r * math.sqrt(3 / (1 - r * r))
    tail = 1 - (2 / math.pi) * (math.atan(t / math.sqrt(3)) + (t / math.sqrt(3)) / (1 + t * t / 3))  # t with 3 degrees
    assert got["p"] == pytest.approx(tail, abs=1e-8)


def test_shapiro_published_example(spark):
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("M", str(i), float(v)) for i, v in enumerate(men)], "method string, speaker string, resid double")
    got = st.shapiro(df, ["method"]).first()
    assert got["w"] == pytest.approx(0.78881, abs=1e-4) and got["p"] == pytest.approx(0.006704, abs=1e-4)


def test_box_summary(spark):
    rows = [("M", "g", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)]
    row = st.box_summary(spark.createDataFrame(rows, "method string, grp string, f1 double"), ["method"]).first()
    assert (row["q1"], row["median"], row["q3"], row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (2, 3, 4, 1, 4, 1)


def test_best_fit(spark):
    rows = [("M", float(i), 2.0 * i + 1) for i in range(5)]
    row = st.best_fit(spark.createDataFrame(rows, "method string, x double, y double"), ["method"], "x", "y").first()
    assert (row["slope"], row["intercept"], row["r2"]) == (pytest.approx(2), pytest.approx(1), pytest.approx(1))


def test_label_codes_come_back(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "y string")
    table = c.label_table(train)
    assert {(r["label"], r["code"]) for r in table.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    rows = spark.createDataFrame([(1, "c"), (2, "unseen"), (3, None), (4, "a")], "id int, y string")
    coded = c.encode_labels(rows, table)
    assert {r["id"]: r["code"] for r in coded.collect()} == {1: 2, 2: None, 3: None, 4: 0}
    assert {r["id"]: r["y_pred"] for r in c.decode_labels(coded, table).collect()} == {1: "c", 2: None, 3: None, 4: "a"}


def test_multiclass_comparison_pairs_all_tied_methods(spark):
    truth = "aabbccab"
    said = {"m1": "aabbccaa", "m2": "aabbccbb", "m3": "cccccccc", "base": "aabbaaab"}
    rows = [("r", "all", k, str(i), t, p) for k, v in said.items() for i, (t, p) in enumerate(zip(truth, v))]
    preds = spark.createDataFrame(rows, "run string, task_label string, method string, speech_id string, y_true string, y_pred string")
    scores = m.stored_scores(m.f1_macro_micro(preds, ["run", "method"]), ["macro_f1", "micro_f1"])
    got = {r["method"]: r for r in m.compare_multiclass(scores.where("method <> 'base'"), scores.where("method = 'base'"), preds).collect()}
    kept = {r["method"]: r for r in scores.collect()}
    top = max(kept[k]["macro_f1"] for k in ("m1", "m2", "m3"))
    assert set(got) == {k for k in ("m1", "m2", "m3") if kept[k]["macro_f1"] == top} and "m1" in got
    row = got["m1"]
    assert (row["baseline"], row["yy"], row["yn"], row["ny"], row["nn"]) == ("base", 5, 1, 2, 0)
    assert row["micro_f1"] == 0.875 and row["baseline_micro_f1"] == 0.75 and abs(row["delta_micro"] - 100 / 6) < 1e-9
    assert abs(row["delta_macro"] - (row["macro_f1"] - row["baseline_macro_f1"]) / row["baseline_macro_f1"] * 100) < 1e-9
