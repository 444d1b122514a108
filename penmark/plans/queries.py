"""The registered queries: each composes library operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from penmark.functions import text as tx
from penmark.operators import corpus as c
from penmark.operators import features as x
from penmark.operators import learn
from penmark.operators import metrics as m
from penmark.operators import splits as sp
from penmark.operators import stats as st
from penmark.operators import style
from penmark.operators.lexicon import MACROS, build_lexicon, encode, match_words, prepare_lexicon
from penmark.plans import experiments as ex
from penmark.plans import recipes
from penmark.plans.feature_sets import feature_sets
from penmark.session import scratch_path, spread, staged
from penmark.sources import files, sample
from penmark.sources.lexicon_files import read_dic

Query = Callable[[SparkSession, str], DataFrame]

# Thresholds that fit the small tables; the operators' defaults are larger.
PARTY_ROWS = 120
TRAIN_ROWS = 30


def _r(column: str | Column, name: str | None = None) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, 6).alias(name or column)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("speech_id"), "text")
    return spread(docs, "speech_id")


def _big_parties(spark, sf):
    return c.party_min_rows(c.drop_chair(sample.speeches(spark, sf)), PARTY_ROWS)


def _winged(spark, sf):
    return c.assign_wing(sample.speeches(spark, sf), "four")


def _tokens(spark, sf):
    return sample.with_tokens(sample.speeches(spark, sf))


def _tagged(spark, sf):
    return sample.with_tags(_tokens(spark, sf))


def _stressed(spark, sf):
    rows = _tokens(spark, sf)
    return rows.select("speech_id", tx.stress_text("tokens", recipes.unstressed_words()).alias("stress"))


def encoded_corpus(spark, sf) -> DataFrame:
    """The stored encoded table that features and experiments read."""
    return staged(recipes.encoded(_tokens(spark, sf), sample.lexicon(spark), sample.upos_of))


# ---- corpus ----------------------------------------------------------------


def text_clean(spark, sf):
    return _documents(spark, sf).select("speech_id", tx.clean_es("text").alias("clean"))


def drop_chair(spark, sf):
    return c.drop_chair(sample.speeches(spark, sf)).select("speech_id", "role")


def party_min_rows(spark, sf):
    return _big_parties(spark, sf).select("speech_id", "party")


def min_words(spark, sf):
    return c.min_words(sample.speeches(spark, sf)).select("speech_id", tx.n_words("text").cast("bigint").alias("n_words"))


def uppercase_sentences(spark, sf):
    return _documents(spark, sf).where(tx.all_uppercase("text")).select("speech_id")


def wing_assign(spark, sf):
    wings = [c.wing_of("party", s).alias(f"wing_{s}") for s in ("four", "six", "two")]
    return sample.speeches(spark, sf).select("speech_id", *wings, c.wing_english(c.wing_of("party", "four")).alias("wing_en"))


def top_speakers_per_wing(spark, sf):
    return c.top_speakers_per_wing(c.assign_wing(c.min_words(_big_parties(spark, sf)), "four"))


def top_speakers(spark, sf):
    return c.top_speakers(_big_parties(spark, sf))


def selected_speeches(spark, sf):
    rows = c.assign_wing(_big_parties(spark, sf), "six")
    return c.of_speakers(rows, c.top_speakers_per_wing(rows)).select("speech_id", "speaker", "wing")


def balanced_sample(spark, sf):
    rows = c.assign_wing(_big_parties(spark, sf), "two").where(F.col("wing").isin("Izquierda", "Derecha"))
    return c.balanced_sample(c.of_speakers(rows, c.top_speakers_per_wing(rows))).select("speech_id", "speaker")


def _recipe(name):
    def query(spark, sf):
        rows = recipes.RECIPES[name](sample.speeches(spark, sf), party_rows=PARTY_ROWS)
        return rows.select("speech_id", "speaker", "party", "wing")

    return query


def corpus_totals(spark, sf):
    return c.corpus_totals(_winged(spark, sf))


def corpus_by_speaker(spark, sf):
    return c.corpus_by_speaker(sample.speeches(spark, sf))


def modal_label(spark, sf):
    return c.modal_labels(_winged(spark, sf))


def author_categories(spark, sf):
    return c.author_categories(_winged(spark, sf))


def pattern_count(spark, sf):
    return c.pattern_count(sample.speeches(spark, sf), "de", "text")


def party_status_rows(spark, sf):
    rows = c.without_other_status(sample.speeches(spark, sf), "src0", "Opposition")
    return rows.select("speech_id", "speaker", "party_status")


def label_codes(spark, sf):
    rows = c.with_label(sample.speeches(spark, sf), "party").select("speech_id", "y")
    model = StringIndexer(inputCol="y", outputCol="code", stringOrderType="alphabetAsc").fit(rows)
    return model.transform(rows).withColumn("code", F.col("code").cast("int"))


# ---- files -----------------------------------------------------------------


def utterances(spark, sf):
    return files.assemble_utterances(sample.sentences(spark, sf), ["sent_pos"])


def speech_table(spark, sf):
    """Write the turns as annotated sentence files and metadata files, then build the table from them."""
    conv = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    conv = conv.withColumn("line", F.regexp_replace("text", r"\s+", " "))
    words = F.transform(tx.tokens("line"), lambda w, i: F.concat_ws("\t", (i + 1).cast("string"), w, w, sample.upos(w), *[F.lit("_")] * 6))
    key = F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit(".u"), F.col("conv_id").cast("string"))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("# sent_id = "), key, F.lit(".s"), F.col("turn").cast("string")),
        F.concat(F.lit("# text = "), F.col("line")),
        F.array_join(words, "\n"),
    )
    folder = scratch_path(spark, "corpus")
    # One file per range of utterances keeps the sentences of each in file order.
    ordered = conv.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "turn")
    ordered.select(F.concat(F.rtrim(block), F.lit("\n")).alias("value")).write.text(f"{folder}/sentences")
    people = conv.select("conv_id").distinct().select(
        key.alias("ID"),
        F.concat(F.lit("R"), (F.col("conv_id") % 5).cast("string")).alias("Speaker_name"),
        F.lit("Regular").alias("Speaker_role"),
        (1940 + F.col("conv_id") % 45).alias("Speaker_birth"),
    )
    people.write.csv(f"{folder}/people", sep="\t", header=True)
    metadata = files.read_metadata(spark, f"{folder}/people", suffix="*.csv")
    sents = files.read_conllu(spark, f"{folder}/sentences", suffix="*.txt")
    return files.speech_table(metadata, sents).select("speech_id", "speaker", "birth", "text", "pos_tags")


def metadata_layouts(spark, sf):
    """Metadata files of three layouts, one with another order and a further column, one without the party, read together."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    people = docs.select(
        F.col("doc_id"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("ID"), F.col("source").alias("Speaker_name"),
        F.col("lang").alias("Speaker_party"), (1900 + F.col("doc_id") % 100).alias("Speaker_birth"), F.col("n_chars").alias("Other"),
    )
    layouts = [
        ["ID", "Speaker_name", "Speaker_party", "Speaker_birth"],
        ["Speaker_birth", "Other", "Speaker_party", "ID", "Speaker_name"],
        ["Speaker_name", "ID", "Speaker_birth"],
    ]
    folder = scratch_path(spark, "layouts")
    for k, columns in enumerate(layouts):
        people.where(F.col("doc_id") % 3 == k).select(*columns).write.csv(f"{folder}/{k}", sep="\t", header=True)
    rows = files.read_metadata(spark, f"{folder}/*", suffix="*.csv")
    return rows.select(F.col("ID").alias("id"), F.col("Speaker_name").alias("speaker"), F.col("Speaker_party").alias("party"), F.col("Speaker_birth").alias("birth"))


def lexicon_from_file(spark, sf):
    """The lexicon read from a ``.dic`` file, applied to every word of the corpus."""
    folder = scratch_path(spark, "lexicon")
    spark.range(1).select(F.lit(sample.dic_text().rstrip("\n")).alias("value")).coalesce(1).write.text(folder)
    lexicon = prepare_lexicon(build_lexicon(*read_dic(spark, folder)))
    words = _tokens(spark, sf).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    matched = match_words(words, lexicon).where(F.col("entry").isNotNull())
    return matched.groupBy("entry", "gram", "cdi", "feels").agg(F.sum("n").alias("n_words"))


# ---- tokens, lexicon, stress -----------------------------------------------


def token_stats(spark, sf):
    return sample.speeches(spark, sf).select(
        "speech_id",
        F.size(tx.tokens("text")).cast("bigint").alias("n_tokens"),
        F.coalesce(tx.n_words("text"), F.lit(0)).cast("bigint").alias("n_words"),
        F.size(tx.sentences("text")).cast("bigint").alias("n_sentences"),
    )


def function_word_freq(spark, sf):
    counts = x.function_word_counts(sample.speeches(spark, sf))
    return x.apply_block(x.FittedBlock("function_words", 0), counts).select("speech_id", "feature", _r("value"))


def _curve(counts: DataFrame) -> DataFrame:
    upto = x.longest_common_length(counts).scalar()
    return x.length_curve(counts, upto).select("speech_id", F.col("i").cast("bigint").alias("i"), _r("value"))


def word_length_curve(spark, sf):
    return _curve(x.word_length_counts(sample.speeches(spark, sf)))


def sentence_length_curve(spark, sf):
    return _curve(x.sentence_length_counts(sample.speeches(spark, sf)))


def lexicon_match(spark, sf):
    words = _tokens(spark, sf).select(F.explode("tokens").alias("word")).distinct()
    return match_words(words, sample.lexicon(spark))


def lexicon_encode(spark, sf):
    codes = encode(_tokens(spark, sf).select("speech_id", "tokens"), sample.lexicon(spark))
    return codes.select("speech_id", *[F.array_join(k, " ").alias(k) for k in MACROS])


def pos_text(spark, sf):
    return _tagged(spark, sf).select("speech_id", "pos_tags")


def stress_encode(spark, sf):
    return _stressed(spark, sf)


# ---- features --------------------------------------------------------------


def word_ngram_df(spark, sf):
    return x.document_frequencies(x.block_counts(_tagged(spark, sf), "pos_tags"))


def char_ngram_df(spark, sf):
    return x.document_frequencies(x.block_counts(_stressed(spark, sf), "stress"))


def _tfidf(speeches: DataFrame, block: str) -> DataFrame:
    counts = staged(x.block_counts(speeches, block))
    n_docs = speeches.agg(F.count(F.lit(1))).scalar()
    return x.tfidf(counts, x.document_frequencies(counts), n_docs)


def tfidf_word(spark, sf):
    return _tfidf(_tagged(spark, sf), "pos_tags").select("speech_id", "gram", _r("value"))


def tfidf_char(spark, sf):
    return _tfidf(_stressed(spark, sf), "stress").select("speech_id", "gram", _r("value"))


def _train_side(speeches: DataFrame) -> DataFrame:
    split = sp.split_by_count(speeches.select("speech_id", "speaker", "party"), TRAIN_ROWS)
    return split.select("speech_id", F.col("party").alias("y"), "side")


def tfidf_test_side(spark, sf):
    rows = _tagged(spark, sf)
    side = staged(_train_side(sample.speeches(spark, sf)))
    counts = staged(x.block_counts(rows, "pos_tags"))
    train = counts.join(side.where("side = 'train'").select("speech_id"), "speech_id", "left_semi")
    n_train = side.where("side = 'train'").agg(F.count(F.lit(1))).scalar()
    test = counts.join(side.where("side = 'test'").select("speech_id"), "speech_id", "left_semi")
    return x.tfidf(test, x.document_frequencies(train), n_train).select("speech_id", "gram", _r("value"))


def _gram_codes(spark, sf):
    codes = encode(_tokens(spark, sf).select("speech_id", "tokens"), sample.lexicon(spark))
    return codes.select("speech_id", "gram")


def _gram_chi2(spark, sf):
    speeches = sample.speeches(spark, sf)
    labels = c.with_label(speeches, "party").select("speech_id", "y")
    counts = staged(x.block_counts(_gram_codes(spark, sf), "liwc_gram"))
    weights = x.tfidf(counts, x.document_frequencies(counts), speeches.agg(F.count(F.lit(1))).scalar())
    sizes = labels.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return x.chi2_scores(weights.join(labels, "speech_id"), sizes)


def chi2_scores(spark, sf):
    return _gram_chi2(spark, sf).select("gram", _r("chi2"))


def chi2_top(spark, sf):
    scores = staged(_gram_chi2(spark, sf))
    return x.chi2_top(scores, int(0.1 * scores.count())).select("gram", _r("chi2"))


def feature_table(spark, sf):
    rows = encoded_corpus(spark, sf)
    train = staged(_train_side(rows)).where("side = 'train'").select("speech_id", "y")
    features, _ = x.build_features(rows, train, x.SWITCHES)
    return features.withColumn("value", F.round("value", 6))


def feature_columns(spark, sf):
    rows = encoded_corpus(spark, sf)
    train = staged(_train_side(rows)).where("side = 'train'").select("speech_id", "y")
    fitted = []
    for block, counts in x.staged_counts(rows, x.SWITCHES).items():
        fitted.append(x.fit_block(block, counts.join(train.select("speech_id"), "speech_id", "left_semi"), train))
    return x.feature_index(fitted, rows)[0]


# ---- splits and scores -----------------------------------------------------


def split_50(spark, sf):
    rows = sample.speeches(spark, sf).where(F.col("text").isNotNull()).select("speech_id", "speaker")
    return sp.split_by_count(rows)


def _labelled(spark, sf):
    return c.with_label(sample.speeches(spark, sf), "party").select("speech_id", "y")


def split_stratified(spark, sf):
    return sp.split_stratified(_labelled(spark, sf))


def folds(spark, sf):
    return sp.folds(_labelled(spark, sf))


def binary_labels(spark, sf):
    rows = staged(_labelled(spark, sf))
    return sp.binary_labels(rows, sp.distinct_labels(rows))


def confusion(spark, sf):
    return m.confusion(sample.predictions(spark, sf))


def label_scores(spark, sf):
    return m.label_scores(sample.predictions(spark, sf)).withColumn("f1", F.round("f1", 6))


def f1_binary(spark, sf):
    return m.f1_binary(sample.predictions(spark, sf)).withColumn("f1", F.round("f1", 6))


def f1_macro_micro(spark, sf):
    scores = m.f1_macro_micro(sample.predictions(spark, sf))
    return scores.select(*m.KEYS, _r("macro_f1"), _r("micro_f1"))


def best_method(spark, sf):
    return m.best_methods(m.stored_scores(m.f1_binary(sample.predictions(spark, sf)), ["f1"]), ["run", "task_label"])


def _grid_predictions(spark, sf, tasks: list[str]) -> DataFrame:
    """Out-of-fold predictions of a four-point grid: a length threshold per point."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").unpivot(["doc_id"], tasks, "task_label", "truth")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    points = F.explode(F.lit([1, 2, 3, 4]).cast("array<bigint>")).alias("grid_idx")
    rows = labels.join(docs, "doc_id").select("task_label", "truth", "n_chars", points)
    guess = (F.col("n_chars") > 500 * F.col("grid_idx")).cast("int")
    return rows.select("task_label", "grid_idx", F.col("truth").cast("string").alias("y_true"), guess.cast("string").alias("y_pred"))


def f1_pooled_cv(spark, sf):
    """F1 of pooled out-of-fold predictions: a length rule whose mean length is fitted on the other folds of each task."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("speech_id"), F.col("n_chars").cast("long").alias("n_chars"))
    parts = []
    for task in ("quality", "toxic"):
        rows = labels.select(F.col("doc_id").alias("speech_id"), F.col(task).cast("string").alias("y")).join(docs, "speech_id")
        parts.append(sp.folds(rows).withColumn("task_label", F.lit(task)))
    folded = staged(parts[0].unionByName(parts[1]))
    sums = folded.groupBy("task_label", "fold").agg(F.sum("n_chars").alias("s"), F.count("n_chars").alias("n"))
    whole = sums.groupBy("task_label").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    fitted = sums.join(whole, "task_label").select(
        "task_label", "fold", F.try_divide((F.col("all_s") - F.col("s")).cast("double"), F.col("all_n") - F.col("n")).alias("mean")
    )
    points = F.explode(F.lit([1, 2, 3, 4]).cast("array<bigint>")).alias("grid_idx")
    held = folded.join(fitted, ["task_label", "fold"]).select("*", points)
    said = (F.col("n_chars") > F.col("mean") * F.col("grid_idx") / 4).cast("int").cast("string")
    scores = m.f1_binary(held.select("task_label", "grid_idx", F.col("y").alias("y_true"), said.alias("y_pred")), ["task_label", "grid_idx"])
    return scores.select("task_label", "grid_idx", _r("f1", "score"))


def best_grid(spark, sf):
    scores = m.f1_binary(_grid_predictions(spark, sf, ["quality", "toxic"]), ["task_label", "grid_idx"])
    best = m.best_grid_point(scores.withColumnRenamed("f1", "score"), ["task_label"])
    return best.withColumn("score", F.round("score", 6))


def mcnemar(spark, sf):
    preds = sample.predictions(spark, sf)
    tasks = preds.select("run", "task_label").distinct()
    pairs = tasks.select("*", F.lit("RULE").alias("baseline"), F.explode(F.lit(["LENGTH", "ORACLE11"])).alias("method"))
    return m.mcnemar(preds, pairs).withColumn("p", F.round("p", 6))


def compare_methods(spark, sf):
    preds = sample.predictions(spark, sf)
    scores = m.stored_scores(m.f1_binary(preds), ["f1"])
    out = m.compare_methods(scores.where("method <> 'RULE'"), scores.where("method = 'RULE'"), preds)
    return out.select(
        "run", "task_label", "method", "baseline", _r("score"), _r("baseline_score"), _r("delta_pct"), "yn", "ny", _r("p")
    )


def _model_predictions(spark, sf) -> DataFrame:
    """Stored predictions of the language: own methods by label, an outside model's as codes that are decoded."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    docs = docs.select(F.col("doc_id").alias("speech_id"), F.col("lang").alias("y"))
    table = staged(c.label_table(docs))
    k = table.agg(F.max("code") + 1).first()[0] or 1
    # Every method errs on the multiples of its number, by the next label.
    methods = F.explode(F.create_map(*[F.lit(v) for p in METHOD_ERRORS.items() for v in p])).alias("method", "errs")
    rows = c.encode_labels(docs, table).select("*", methods)
    said = F.when(F.col("speech_id") % F.col("errs") == 0, (F.col("code") + 1) % k).otherwise(F.col("code"))
    rows = c.decode_labels(rows.withColumn("code", said), table)
    path = scratch_path(spark, "predictions")
    files.append_predictions(
        rows.select(F.lit("MC_lang").alias("run"), F.lit("all").alias("task_label"), "method", "speech_id", F.col("y").alias("y_true"), "y_pred"), path
    )
    return files.read_long(spark, path, ex.PREDICTIONS_SCHEMA)


METHOD_ERRORS = {"ALL": 11, "ALL - POS": 7, "BaseFeatures": 3, "MODEL_MASKED": 13, "MODEL_PLAIN": 5}


def outside_model_scores(spark, sf):
    """Macro and micro F1 of an outside model's stored predictions."""
    return ex.score_predictions(_model_predictions(spark, sf).where("method LIKE 'MODEL%'"), "MC")


def compare_multiclass(spark, sf):
    preds = _model_predictions(spark, sf)
    scores = m.stored_scores(m.f1_macro_micro(preds, ["run", "method"]), ["macro_f1", "micro_f1"])
    out = m.compare_multiclass(scores.where("method NOT LIKE 'MODEL%'"), scores.where("method LIKE 'MODEL%'"), preds)
    return out.select(
        "run", "method", "baseline", "macro_f1", "micro_f1", "baseline_macro_f1", "baseline_micro_f1",
        _r("delta_macro"), _r("delta_micro"), "yy", "yn", "ny", "nn", _r("p"),
    )


# ---- style and statistics --------------------------------------------------

INDICES = list(style.INDEX_NAMES.values())


def _style(spark, sf, by: str) -> DataFrame:
    return style.style_indices(style.marks_from_text(_tagged(spark, sf), sample.lexicon(spark), [by]))


def style_indices(spark, sf):
    return _style(spark, sf, "speaker").select("speaker", "n_words", *[_r(i) for i in INDICES])


def style_by_text(spark, sf):
    return _style(spark, sf, "speech_id").select("speech_id", "n_words", *[_r(i) for i in INDICES])


def cni_texts_top(spark, sf):
    return style.extreme_texts(_style(spark, sf, "speech_id")).withColumn("cni", F.round("cni", 6))


def index_by_wing(spark, sf):
    """Every style index of every speaker, beside the wing."""
    values = _style(spark, sf, "speaker").unpivot(["speaker"], INDICES, "style", "idx")
    return style.by_wing(values, _winged(spark, sf), "idx", ("style",)).withColumn("idx", F.round("idx", 6))


def words_by_wing(spark, sf):
    rows = _winged(spark, sf)
    return style.by_wing(c.corpus_by_speaker(rows), rows, "n_words")


def _results(spark, sf) -> DataFrame:
    """F1 per task, speaker and method, to 3 places as result tables hold them."""
    return m.f1_binary(sample.predictions(spark, sf), ["task_label", "method", "speaker"]).withColumn("f1", F.round("f1", 3))


SCORED = ["task_label", "method"]
TESTED = ["task_label", "kind", "method"]


def _grouped(spark, sf) -> DataFrame:
    """Scores with each speaker's wing, party, decade of birth and gender."""
    return staged(st.with_groups(_results(spark, sf), c.modal_labels(_winged(spark, sf))))


def anova(spark, sf):
    out = st.anova(_grouped(spark, sf), TESTED)
    return out.select(*TESTED, "k", "n", "df_between", "df_within", _r("mse"), _r("f_stat"), _r("p"))


def levene(spark, sf):
    return st.levene(_grouped(spark, sf), TESTED).select(*TESTED, "k", "n", _r("f_stat"), _r("p"))


def tukey_q(spark, sf):
    return st.tukey(_grouped(spark, sf), TESTED).select(*TESTED, "group_a", "group_b", _r("mean_diff"), _r("q"))


def tukey_hsd(spark, sf):
    """p of every pair, also where the analysis of variance is not significant."""
    out = st.tukey_hsd(_grouped(spark, sf), TESTED, gate=1.1)
    return out.select(*TESTED, "group_a", "group_b", _r("mean_diff"), _r("q"), "k", "df_within", _r("p"), "reject")


def shapiro(spark, sf):
    return st.shapiro(st.residuals(_grouped(spark, sf), TESTED), TESTED)


def _index_and_f1(spark, sf):
    names = ["ati", "cni", "asi", "pos_minus_neg", "pos_plus_neg"]
    index = staged(_style(spark, sf, "speaker").unpivot(["speaker"], names, "style", "idx").where("idx is not null"))
    return staged(_results(spark, sf).join(index, "speaker"))


def spearman(spark, sf):
    return st.spearman(_index_and_f1(spark, sf), SCORED + ["style"], "idx", "f1").select(*SCORED, "style", "n", _r("r"), _r("p"))


def bestfit(spark, sf):
    out = st.best_fit(_index_and_f1(spark, sf), SCORED + ["style"], "idx", "f1")
    return out.select(*SCORED, "style", F.col("n").cast("bigint").alias("n"), _r("slope"), _r("intercept"), _r("r2"))


def box_summary(spark, sf):
    out = st.box_summary(_grouped(spark, sf), TESTED)
    return out.select(
        *TESTED, "grp", _r("q1"), _r("median"), _r("q3"), "n", _r("whisker_low"), _r("whisker_high"), "n_outliers"
    )


def todo_methods(spark, sf):
    names = F.when(F.col("method") == "LENGTH", "BaseFeatures").when(F.col("method") == "RULE", "ALL").otherwise("ALL - POS")
    results = m.f1_binary(sample.predictions(spark, sf)).select("run", names.alias("method"))
    return files.todo_methods(feature_sets(spark), results, "demo").select("set_no", "method")


def results_csv(spark, sf):
    """Wide ``;`` CSV of the scores, written and read back as long rows."""
    scores = m.f1_binary(sample.predictions(spark, sf))
    wide = scores.groupBy(F.col("method").alias("Method")).pivot("task_label", ["quality", "toxic"]).agg(F.round(F.max("f1"), 3))
    wide = wide.select("Method", F.concat(F.lit("C="), F.length("Method")).alias("Best_params"), F.length("Method").alias("Tot_features"), "quality", "toxic")
    path = scratch_path(spark, "results")
    files.write_results_csv(wide, path)
    return files.read_results_csv(spark, path)


def predictions_store(spark, sf):
    path = scratch_path(spark, "predictions")
    columns = ["run", "task_label", "method", "speech_id", "y_true", "y_pred"]
    files.append_predictions(sample.predictions(spark, sf).select(*columns), path)
    stored = files.read_long(spark, path, ex.PREDICTIONS_SCHEMA)
    return stored.groupBy("task_label", "method").agg(
        F.count(F.lit(1)).alias("n"), F.sum(m.correct()).alias("n_correct")
    )


# ---- learning --------------------------------------------------------------


def lsa_2d(spark, sf):
    return ex.lsa_by_wing(c.assign_wing(encoded_corpus(spark, sf), "four"))


def _experiment(learner: str, task: str, focus: str, switches: list[str], grid: list[dict]):
    def query(spark, sf):
        rows = encoded_corpus(spark, sf)
        rows = c.assign_wing(rows, "four").where(F.col("wing").isNotNull())
        out = ex.run_experiment(rows, task, focus, learner, switches, train_rows=TRAIN_ROWS, grid=grid)
        return out.results

    return query


lr_multiclass = _experiment("lr", "MC", "wing", ["base_features"], learn.full_grid("lr"))
svm_binary = _experiment("svm", "BC", "gender", ["base_features"], learn.full_grid("svm"))
svm_multiclass = _experiment("svm", "MC", "wing", ["pos_tags"], learn.full_grid("svm"))
rf_multiclass = _experiment("rf", "MC", "wing", ["base_features"], [{"n_trees": 10, "impurity": "gini", "balanced": True}])


def party_status(spark, sf):
    rows = encoded_corpus(spark, sf)
    return ex.party_status_experiment(rows, "lr", ["base_features"], author="src0", train_rows=15, grid=learn.full_grid("lr")).results


def experiment_series(spark, sf):
    """Two feature sets of the series, skipping what the result store already holds."""
    rows = c.assign_wing(encoded_corpus(spark, sf), "four").where(F.col("wing").isNotNull())
    store = scratch_path(spark, "store")
    grid = [{"C": 1.0, "balanced": True}]
    sets = [["base_features"], ["base_features", "liwc_feels"]]
    ex.run_series(rows, "MC", "wing", "lr", store, sets[:1], train_rows=TRAIN_ROWS, grid=grid)
    ex.run_series(rows, "MC", "wing", "lr", store, sets, train_rows=TRAIN_ROWS, grid=grid)
    return files.read_long(spark, f"{store}/results", ex.RESULTS_SCHEMA)


QUERIES: dict[str, Query] = {
    "text_clean": text_clean,
    "drop_chair": drop_chair,
    "party_min_rows": party_min_rows,
    "min_words": min_words,
    "uppercase_sentences": uppercase_sentences,
    "wing_assign": wing_assign,
    "top_speakers_per_wing": top_speakers_per_wing,
    "top_speakers": top_speakers,
    "selected_speeches": selected_speeches,
    "balanced_sample": balanced_sample,
    "corpus_4wings": _recipe("4wings"),
    "corpus_6wings": _recipe("6wings"),
    "corpus_2wings": _recipe("2wings"),
    "corpus_nowing": _recipe("nowing"),
    "corpus_totals": corpus_totals,
    "corpus_by_speaker": corpus_by_speaker,
    "modal_label": modal_label,
    "author_categories": author_categories,
    "pattern_count": pattern_count,
    "party_status_rows": party_status_rows,
    "label_codes": label_codes,
    "utterances": utterances,
    "speech_table": speech_table,
    "metadata_layouts": metadata_layouts,
    "lexicon_from_file": lexicon_from_file,
    "token_stats": token_stats,
    "function_word_freq": function_word_freq,
    "word_length_curve": word_length_curve,
    "sentence_length_curve": sentence_length_curve,
    "lexicon_match": lexicon_match,
    "lexicon_encode": lexicon_encode,
    "pos_text": pos_text,
    "stress_encode": stress_encode,
    "word_ngram_df": word_ngram_df,
    "char_ngram_df": char_ngram_df,
    "tfidf_word": tfidf_word,
    "tfidf_char": tfidf_char,
    "tfidf_test_side": tfidf_test_side,
    "chi2_scores": chi2_scores,
    "chi2_top": chi2_top,
    "feature_table": feature_table,
    "feature_columns": feature_columns,
    "split_50": split_50,
    "split_stratified": split_stratified,
    "folds": folds,
    "binary_labels": binary_labels,
    "confusion": confusion,
    "label_scores": label_scores,
    "f1_binary": f1_binary,
    "f1_macro_micro": f1_macro_micro,
    "best_method": best_method,
    "f1_pooled_cv": f1_pooled_cv,
    "best_grid": best_grid,
    "mcnemar": mcnemar,
    "compare_methods": compare_methods,
    "outside_model_scores": outside_model_scores,
    "compare_multiclass": compare_multiclass,
    "style_indices": style_indices,
    "style_by_text": style_by_text,
    "cni_texts_top": cni_texts_top,
    "index_by_wing": index_by_wing,
    "words_by_wing": words_by_wing,
    "anova": anova,
    "levene": levene,
    "tukey_q": tukey_q,
    "tukey_hsd": tukey_hsd,
    "shapiro": shapiro,
    "spearman": spearman,
    "bestfit": bestfit,
    "box_summary": box_summary,
    "todo_methods": todo_methods,
    "results_csv": results_csv,
    "predictions_store": predictions_store,
    "lsa_2d": lsa_2d,
    "lr_multiclass": lr_multiclass,
    "svm_binary": svm_binary,
    "svm_multiclass": svm_multiclass,
    "rf_multiclass": rf_multiclass,
    "party_status": party_status,
    "experiment_series": experiment_series,
}
