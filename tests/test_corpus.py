import pytest
from pyspark.sql import functions as F

from penmark.operators import corpus as c
from penmark.operators import ranks, splits
from penmark.plans import recipes


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        (1, "Ana", "PSOE", None, "F", 1965, "Coalition", "uno dos"),
        (2, "Ana", "PSOE", "Chairperson", "F", 1965, "Coalition", "tres"),
        (3, "Bea", "PP", "Regular", "F", 1975, "Opposition", None),
        (4, "Bea", "PP", "Regular", "M", 1975, "Opposition", ""),
        (5, "Ciro", None, "Regular", "M", 1980, None, "cinco"),
        (6, "Dario", "Mixto", "Regular", "M", 1980, "Opposition", "seis"),
    ]
    schema = "speech_id long, speaker string, party string, role string, gender string, birth int, party_status string, text string"
    return spark.createDataFrame(rows, schema)


def ids(df):
    return sorted(r["speech_id"] for r in df.select("speech_id").collect())


def test_missing_role_stays(small):
    assert ids(c.drop_chair(small)) == [1, 3, 4, 5, 6]


def test_missing_party_drops_out(small):
    assert ids(c.party_min_rows(small, 1)) == [1, 2, 3, 4, 6]
    assert ids(c.party_min_rows(small, 2)) == [1, 2, 3, 4]


def test_word_limit_is_strict_and_drops_missing_text(small):
    assert ids(c.min_words(small, 1)) == [1]
    assert ids(c.min_words(small, 2)) == []


def test_empty_and_missing_texts_drop(small):
    assert ids(c.with_text(small)) == [1, 2, 5, 6]


def test_missing_wing_is_no_group_but_passes_by_name(small):
    rows = c.assign_wing(small, "four").unionByName(
        c.assign_wing(small.where("speech_id = 1").withColumn("party", F.lit("Mixto")).withColumn("speech_id", F.lit(7)), "four")
    )
    top = c.top_speakers_per_wing(rows)
    assert sorted((r["wing"], r["speaker"]) for r in top.collect()) == [("Derecha", "Bea"), ("Izquierda", "Ana")]
    assert ids(c.of_speakers(rows, top)) == [1, 2, 3, 4, 7]


def test_ties_go_to_the_earlier_name(spark):
    rows = spark.createDataFrame([("B", "w"), ("A", "w"), ("C", "w")], "speaker string, wing string")
    assert [r["speaker"] for r in c.top_speakers_per_wing(rows, 2).orderBy("rank").collect()] == ["A", "B"]


def test_schemes_differ(small):
    up = F.lit("UP")
    got = small.select(c.wing_of(up, "four"), c.wing_of(up, "six"), c.wing_of(F.lit("CDC"), "two"), c.wing_of(F.lit(None).cast("string"), "six")).first()
    assert tuple(got) == ("Izquierda", "Más izquierda", "Regionalistas", None)
    english = small.select(c.wing_english(F.lit(None).cast("string")), c.wing_english(F.lit("Centro"))).first()
    assert tuple(english) == ("Regionalist", "Centre")


def test_other_status_rows_of_one_author(small):
    assert ids(c.without_other_status(small, "Ciro", "Coalition")) == [1, 2, 3, 4, 6]
    assert ids(c.without_other_status(small, "Ana", "Coalition")) == [1, 2, 3, 4, 5, 6]


def test_modal_labels_and_categories(small):
    got = {(r["speaker"], r["kind"]): r["label"] for r in c.modal_labels(c.assign_wing(small, "four")).collect()}
    assert got[("Bea", "gender")] == "F"  # a tie takes the lower label
    assert (got[("Ana", "birth")], got[("Bea", "birth")]) == ("1960", "1980")
    assert ("Ciro", "party") not in got
    with pytest.raises(ValueError):
        c.modal_labels(small, ["name"])


def test_totals_count_missing_as_a_value(small):
    row = c.corpus_totals(c.assign_wing(small, "four")).first()
    assert (row["n_samples"], row["n_parties"], row["n_wings"]) == (6, 4, 3)


def test_focus_names():
    assert c.label_column("name") == "speaker"
    with pytest.raises(ValueError):
        c.label_column("topic")


@pytest.fixture(scope="module")
def skewed(spark):
    """One speaker holds a third of the rows; one row has no speaker."""
    base = spark.range(3000).select(
        F.col("id").alias("speech_id"),
        F.when(F.col("id") == 7, None).when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("speaker"),
    )
    return base


def test_shuffled_rank_is_the_exact_group_order(skewed):
    got = ranks.shuffled_rank(skewed, ["speaker"]).withColumn("h", ranks.shuffle_key()).toPandas()
    assert len(got) == 3000
    for _, group in got.groupby("speaker", dropna=False):
        group = group.sort_values(["h", "speech_id"])
        assert group["rn"].tolist() == list(range(1, len(group) + 1))
        assert set(group["group_size"]) == {len(group)}


def test_cuts_follow_the_counted_size(spark, skewed, monkeypatch):
    plain = {r["speech_id"]: r["rn"] for r in ranks.shuffled_rank(skewed, ["speaker"]).collect()}
    monkeypatch.setattr(ranks, "CUT_ROWS", 8)
    assert {r["speech_id"]: r["rn"] for r in ranks.shuffled_rank(skewed, ["speaker"]).collect()} == plain
    sizes = spark.createDataFrame([(n,) for n in (0, 8, 9, 128, 129, 8 * 16**7 + 1, 10**18)], "n long")
    assert [r["d"] for r in sizes.select(ranks._depth(F.col("n")).alias("d")).collect()] == [0, 0, 1, 1, 2, 8, 8]


def test_a_group_of_two_million_rows(spark):
    n = 2_000_000
    got = ranks.shuffled_rank(spark.range(n).select(F.col("id").alias("speech_id"), F.lit("one").alias("speaker")), ["speaker"])
    cut = F.substring(ranks.shuffle_key(), 1, 2)  # what its size asks for
    parts = got.groupBy(cut.alias("cut")).agg(
        F.count(F.lit(1)).alias("n"), F.min("rn").alias("low"), F.max("rn").alias("high"), F.count_distinct("rn").alias("m")
    ).orderBy("cut").collect()
    assert max(p["n"] for p in parts) < ranks.CUT_ROWS and sum(p["n"] for p in parts) == n
    assert all(p["n"] == p["m"] == p["high"] - p["low"] + 1 for p in parts)
    assert parts[0]["low"] == 1 and all(a["high"] + 1 == b["low"] for a, b in zip(parts, parts[1:]))


def test_sorted_numbers_are_the_exact_order(skewed):
    rows = skewed.where("speaker is not null")
    whole = ranks.sorted_numbers(rows, [F.desc("speech_id")]).toPandas().sort_values("rn")
    assert whole["rn"].tolist() == list(range(1, 3000)) and whole["speech_id"].is_monotonic_decreasing
    inside = ranks.sorted_numbers(rows, [F.col("speech_id")], ["speaker"]).toPandas()
    for _, group in inside.groupby("speaker"):
        assert group.sort_values("speech_id")["rn"].tolist() == list(range(1, len(group) + 1))


def test_split_is_disjoint_complete_and_sized(skewed):
    got = splits.split_by_count(skewed, 50).toPandas()
    assert sorted(got["speech_id"]) == list(range(3000))
    train = got[got["side"] == "train"].groupby("speaker").size()
    assert train["hot"] == 50 and (train <= 50).all()
    assert got[got["speech_id"] == 7]["side"].tolist() == ["test"]


def test_folds_are_stratified(skewed):
    got = splits.folds(skewed.withColumnRenamed("speaker", "y"), 5).toPandas()
    sizes = got.groupby(["y", "fold"]).size().unstack()
    assert ((sizes.max(axis=1) - sizes.min(axis=1)) <= 1).all()


def test_stratified_share(skewed):
    got = splits.split_stratified(skewed.withColumnRenamed("speaker", "y")).toPandas()
    hot = got[got["y"] == "hot"]
    assert (hot["side"] == "test").sum() == 100


def test_balanced_sample_takes_the_smallest_size(skewed):
    got = c.balanced_sample(skewed).toPandas().groupby("speaker").size()
    sizes = skewed.where("speaker is not null").toPandas().groupby("speaker").size()
    assert set(got) == {sizes.min()} and len(got) == len(sizes)


def test_recipes_keep_their_order_of_steps(spark):
    rows = []
    for i in range(60):
        party = ["PSOE", "PP"][i % 2]
        text = "palabra " * (60 if i % 4 < 2 else 10)
        rows.append((i, f"S{i % 4}", party, "Regular", "F", 1960, "Coalition", text if i != 5 else None))
    schema = "speech_id long, speaker string, party string, role string, gender string, birth int, party_status string, text string"
    df = spark.createDataFrame(rows, schema)
    four = recipes.four_wings(df, party_rows=30)  # party size counts before short texts drop
    assert {r["speaker"] for r in four.select("speaker").distinct().collect()} == {"S0", "S1"}
    two = recipes.two_wings(df, party_rows=30).toPandas().groupby("speaker").size()
    assert two["S1"] == 14 and two["S0"] == 15  # balanced first, the missing text drops later


def test_binary_labels(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "speech_id long, y string")
    got = {(r["speech_id"], r["task_label"]): r["y_bin"] for r in splits.binary_labels(rows, ["a", "b"]).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 0, (2, "a"): 0, (2, "b"): 1, (3, "a"): 0, (3, "b"): 0}
