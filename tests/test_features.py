import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from penmark.operators import features as x
from penmark.plans.feature_sets import FULL, feature_sets, method_name, series


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(24):
        y = "abc"[i % 3]
        tags = rng.choices(["NOUN", "VERB", "X", "DET", "ADJ"], [3 + (y == "a"), 1, 1, 2, 1], k=rng.randint(0, 30))
        stress = "".join(rng.choices("+-", k=rng.randint(0, 20)))
        text = " ".join("x" * rng.randint(1, 9) + ("." if rng.random() < 0.2 else "") for _ in range(rng.randint(0, 25)))
        rows.append((i, y, " ".join(tags), stress, tags, text))
    return spark.createDataFrame(rows, "speech_id long, y string, pos_tags string, stress string, gram array<string>, text string"), rows


def grams(units, low, high, glue):
    return Counter(glue.join(units[i : i + n]) for n in range(low, high + 1) for i in range(len(units) - n + 1))


def brute_tfidf(docs, fit_ids):
    """Plain sublinear, smoothed, unit-norm TF-IDF; vocabulary from ``fit_ids``."""
    df = Counter(g for i in fit_ids for g in docs[i])
    out = {}
    for i, counts in docs.items():
        w = {g: (1 + math.log(tf)) * (math.log((1 + len(fit_ids)) / (1 + df[g])) + 1) for g, tf in counts.items() if g in df}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, g): v / norm for g, v in w.items()})
    return out, df


def as_dict(df, value="value"):
    return {(r["speech_id"], r["feature"]): r[value] for r in df.collect()}


def test_short_codes_leave_the_sequence(spark):
    df = spark.createDataFrame([(1, "w Prepos w Articulo")], "speech_id long, pos_tags string")
    got = {r["gram"]: r["tf"] for r in x.block_counts(df, "pos_tags").collect()}
    assert got == {"prepos": 1, "articulo": 1, "prepos articulo": 1}


@pytest.mark.parametrize("block", ["pos_tags", "stress"])
def test_tfidf_equals_brute_force_with_train_vocabulary(corpus, block):
    df, rows = corpus
    if block == "pos_tags":
        docs = {r[0]: grams([t.lower() for t in r[2].split() if len(t) >= 2], 1, 3, " ") for r in rows}
    else:
        docs = {r[0]: grams(list(r[3]), 1, 7, "") for r in rows}
    fit_ids = [r[0] for r in rows if r[0] < 14]
    want, df_counts = brute_tfidf(docs, fit_ids)
    counts = x.block_counts(df, block)
    labels = df.where("speech_id < 14").select("speech_id", "y")
    fitted = x.fit_block(block, counts.where("speech_id < 14"), labels)
    assert fitted.n_features == len(df_counts)
    got = as_dict(x.apply_block(fitted, counts))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_chi2_selection_equals_brute_force(corpus):
    df, rows = corpus
    docs = {r[0]: grams([t.lower() for t in r[4] if len(t) >= 2], 1, 3, " ") for r in rows}
    weights, vocabulary = brute_tfidf(docs, list(docs))
    label = {r[0]: r[1] for r in rows}
    share = {y: n / len(rows) for y, n in Counter(label.values()).items()}
    score = {}
    for g in vocabulary:
        total = sum(v for (_, h), v in weights.items() if h == g)
        score[g] = sum(
            (sum(v for (i, h), v in weights.items() if h == g and label[i] == y) - p * total) ** 2 / (p * total)
            for y, p in share.items()
        )
    counts = x.block_counts(df, "liwc_gram")
    labels = df.select("speech_id", "y")
    w = x.tfidf(counts, x.document_frequencies(counts), F.lit(len(rows))).join(labels, "speech_id")
    sizes = labels.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    got = {r["gram"]: r["chi2"] for r in x.chi2_scores(w, sizes).collect()}
    assert got.keys() == score.keys() and all(got[g] == pytest.approx(score[g], abs=1e-9) for g in score)
    k = int(0.1 * len(score))
    best = sorted(score, key=lambda g: (round(score[g], 9), g), reverse=True)[:k]
    fitted = x.fit_block("liwc_gram", counts, labels)
    kept = {r["gram"] for r in fitted.vocabulary.where("kept").collect()}
    assert fitted.n_features == k and kept == set(best)
    # Selection happens after the norm: kept values are those of the full weights.
    values = as_dict(x.apply_block(fitted, counts))
    assert all(v == pytest.approx(weights[key], abs=1e-12) for key, v in values.items())


def test_equal_scores_keep_the_later_name(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", 1.0 + 1e-13), ("c", 1.0)], "gram string, chi2 double")
    assert {r["gram"] for r in x.chi2_top(scores, 2).collect()} == {"b", "c"}
    assert x.chi2_top(scores, 0).count() == 0


@pytest.mark.parametrize("block", ["word_lengths", "sentence_lengths"])
def test_length_curves_equal_brute_force(corpus, block):
    df, rows = corpus
    if block == "word_lengths":
        lens = {r[0]: [len(w) for w in r[5].replace(".", " ").split()] for r in rows}
    else:
        lens = {r[0]: [len(s.split()) for s in r[5].replace(". ", "|").rstrip(".").split("|") if s.strip()] for r in rows}
    totals = Counter(v for one in lens.values() for v in one)
    upto = max((v for v, n in totals.items() if n >= 5), default=0)
    counts = x.block_counts(df, block)
    fitted = x.fit_block(block, counts, df.select("speech_id", "y"))
    assert fitted.upto == upto > 1
    want = {}
    for i, one in lens.items():
        shares = [sum(v >= n for v in one) for n in range(1, upto + 1)]
        norm = math.sqrt(sum(s * s for s in shares))
        want.update({(i, f"{x.LENGTH_BLOCKS[block]}{n + 1}"): s / norm for n, s in enumerate(shares) if s})
    got = as_dict(x.apply_block(fitted, counts))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_function_words_have_unit_rows(spark):
    df = spark.createDataFrame([(1, "El de de xyz"), (2, "xyz"), (3, None)], "speech_id long, text string")
    got = as_dict(x.apply_block(x.FittedBlock("function_words", 313), x.function_word_counts(df)))
    assert got == {(1, "el"): pytest.approx(1 / math.sqrt(5)), (1, "de"): pytest.approx(2 / math.sqrt(5))}


def test_vectors_hold_every_row_in_column_order(corpus):
    df, rows = corpus
    train = df.select("speech_id", "y")
    features, fitted = x.build_features(df, train, ["pos_tags", "liwc_gram"])
    index, size = x.feature_index(fitted, df)
    table = {(r["block"], r["feature"]): r["idx"] for r in index.collect()}
    order = sorted(table, key=lambda k: (["pos_tags", "liwc_gram"].index(k[0]), k[1]))
    assert [table[k] for k in order] == list(range(size))
    vectors = {r["speech_id"]: r["features"] for r in x.to_vectors(features, index, size, train).collect()}
    assert len(vectors) == len(rows) and all(v.size == size for v in vectors.values())
    for r in features.collect():
        assert vectors[r["speech_id"]][table[(r["block"], r["feature"])]] == r["value"]
    assert sum(len(v.indices) for v in vectors.values()) == features.count()


def test_method_names(spark):
    assert method_name(["base_features"]) == "BaseFeatures"
    assert method_name(["liwc_feels", "base_features"]) == "BaseFeatures + LIWC_FEELS"
    assert method_name(FULL) == "ALL" and method_name(FULL[1:]) == "ALL - BaseFeatures"
    assert method_name([s for s in FULL if s != "liwc_cog"]) == "ALL - LIWC_COG"
    assert method_name([*FULL, "liwc_obj"]).startswith("BaseFeatures + POS + STRESS + LIWC_GRAM + LIWC_OBJ")
    names = [method_name(s) for s in series()]
    assert len(names) == len(set(names)) == 13 and names[0] == "BaseFeatures" and names[6] == "ALL"
    assert [r["method"] for r in feature_sets(spark).orderBy("set_no").collect()] == names
    with pytest.raises(ValueError):
        x.blocks_of(["topics"])


def test_heavy_grams_are_split_off(spark, monkeypatch):
    rows = [(s, g, 1 + s % 3) for s in range(60) for g in ["all", f"own{s}", f"pair{s // 2}"]]
    counts = spark.createDataFrame(rows, "speech_id long, gram string, tf long")
    vocabulary = x.document_frequencies(counts).where("gram <> 'own7'")
    plain = sorted(map(tuple, x.with_vocabulary(counts, vocabulary).select("speech_id", "gram", "tf", "df").collect()))
    monkeypatch.setattr(x, "HEAVY", 10)
    split = x.with_vocabulary(counts, vocabulary, 10**6).select("speech_id", "gram", "tf", "df")
    assert sorted(map(tuple, split.collect())) == plain and len(plain) == 179


def test_norms_need_no_window(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1)], "speech_id long, gram string, tf long")
    got = x.tfidf(counts, x.document_frequencies(counts), F.lit(2))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    norms = got.groupBy("speech_id").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert len(norms) == 2 and all(abs(r.n - 1) < 1e-12 for r in norms)


@pytest.mark.parametrize("piece", [7, 1 << 19])
def test_ngrams_of_repeated_and_missing_speeches(spark, monkeypatch, piece):
    """Rows of one id are one speech, whatever piece they fall into; n-grams never cross rows."""
    rng = random.Random(9)
    units = ["Prepos", "w", "Éo", "articulo", "xx", "é", None]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choices(units, k=rng.randint(0, 12))) for _ in range(60)] + [(9, None), (9, []), (None, None)]
    df = spark.createDataFrame(rows, "speech_id long, gram array<string>").repartition(3)
    want = Counter()
    for one, words in rows:
        known = [u.lower() for u in words or [] if u and len(u) > 1]
        want.update({(one, g): n for g, n in grams(known, 1, 3, " ").items()})
    monkeypatch.setattr(x, "PIECE", piece)
    got = x.block_counts(df, "liwc_gram").collect()
    assert {(r.speech_id, r.gram): r.tf for r in got} == want and len(got) == len(want)


def test_ngrams_of_many_units_are_renumbered(spark):
    """Numbers of seven digits over 3,000 characters do not fit in 64 bits."""
    rng = random.Random(4)
    rows = [(i, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2000)) + "abab\U0001f600") for i in range(3)]
    df = spark.createDataFrame(rows, "speech_id long, stress string")
    got = {(r.speech_id, r.gram): r.tf for r in x.block_counts(df, "stress").collect()}
    assert got == {(i, g): n for i, text in rows for g, n in grams(list(text), 1, 7, "").items()}
    plan = x.block_counts(df, "stress")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row a position


def long_features(df, train, switches):
    """What ``build_features`` gives by the long counts of each block."""
    rows = []
    for block in x.blocks_of(switches):
        counts = x.block_counts(df, block)
        fit = x.fit_block(block, counts.join(train.select("speech_id"), "speech_id", "left_semi"), train)
        rows += [tuple(r) for r in x.apply_block(fit, counts).collect()]
    return rows


@pytest.mark.parametrize("piece, sums, small", [(7, 3, 200_000), (1 << 19, 1 << 21, 200_000), (1 << 19, 1 << 21, 1)])
def test_features_of_repeated_and_missing_speeches_and_labels(spark, monkeypatch, piece, sums, small):
    """Packed rows meet the long form, also for ids that repeat or are null and speeches with several labels or a null one."""
    rng = random.Random(12)
    units = ["Prepos", "w", "Éo", "articulo", "xx", "é", None, "Humanos"]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choices(units, k=rng.randint(0, 12)), "".join(rng.choices("+-", k=rng.randint(0, 9)))) for _ in range(60)]
    rows += [(9, None, None), (9, [], ""), (None, None, "+"), (10, ["Prepos"], None)]
    df = spark.createDataFrame(rows, "speech_id long, gram array<string>, stress string").repartition(3)
    labels = [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, "b"), (4, None), (9, "a"), (10, "b"), (77, "a"), (None, "a")]
    train = spark.createDataFrame(labels, "speech_id long, y string")
    monkeypatch.setattr(x, "PIECE", piece)
    monkeypatch.setattr(x, "SUMS", sums)
    want = long_features(df, train, ["liwc_gram", "stress"])
    monkeypatch.setattr(x, "PACKED_GRAMS", small)
    features, fitted = x.build_features(df, train, ["liwc_gram", "stress"])
    got = [tuple(r) for r in features.collect()]
    assert {r[:3]: r[3] for r in got} == pytest.approx({r[:3]: r[3] for r in want}, abs=1e-12)
    assert len(got) == len(want) > 100 and [f.block for f in fitted] == ["stress", "liwc_gram"]


def test_ngram_features_move_no_counts(corpus):
    """Weights, norms and choice need no exchange: only masked texts move, and codes that make no n-gram stay behind."""
    df, _ = corpus
    features, _ = x.build_features(df, df.select("speech_id", "y"), ["pos_tags", "liwc_gram"])
    assert "Exchange" not in features._jdf.queryExecution().executedPlan().toString()
    moved = x._masked(df, x.NGRAM_BLOCKS["liwc_gram"])
    assert {len(u) for r in moved.collect() for u in r["gram"]} == {3, 4}


def test_words_are_counted_in_one_reading(corpus):
    """Listed words and word lengths come from the same counts, equal to those of each block."""
    df, _ = corpus
    df = df.unionByName(df.limit(4).withColumn("speech_id", F.lit(None).cast("long")).withColumn("text", F.lit("El de de xyz")))
    train = df.where("speech_id < 14").select("speech_id", "y")
    made = x.fitted_counts(df, train, ["base_features", "stress"])
    assert [fit.block for fit, _ in made] == [*x.BASE_BLOCKS, "stress"]
    got = [tuple(r) for fit, counts in made[:3] for r in x.apply_block(fit, counts).collect()]
    want = long_features(df, train, ["base_features"])
    assert {r[:3]: r[3] for r in got} == pytest.approx({r[:3]: r[3] for r in want}, abs=1e-12) and len(got) == len(want)


@pytest.mark.parametrize("small", [200_000, 1])
def test_arrays_hold_the_long_features(spark, corpus, monkeypatch, small):
    """One row a speech, also for a null id, with the cells and columns that the long features and their index have."""
    df, _ = corpus
    df = df.unionByName(df.limit(3).withColumn("speech_id", F.lit(None).cast("long")))
    train = df.select("speech_id", "y")
    switches = ["base_features", "stress", "liwc_gram"]
    want = {r[:3]: r[3] for r in map(tuple, x.build_features(df, train, switches)[0].collect())}
    monkeypatch.setattr(x, "PACKED_GRAMS", small)
    arrays, index, size = x.feature_arrays(df, train, switches)
    column = {r["idx"]: (r["block"], r["feature"]) for r in index.collect()}
    rows = arrays.collect()
    got = {(r["speech_id"], *column[i]): v for r in rows for i, v in zip(r["indices"], r["values"])}
    assert got == pytest.approx(want, abs=1e-12) and len(column) == size
    assert sum(len(r["indices"]) for r in rows) == len(want) and len({r["speech_id"] for r in rows}) == len(rows)
