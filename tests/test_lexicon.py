import random

import pytest
from pyspark.sql import functions as F

from penmark.functions import text as tx
from penmark.operators import lexicon as lx
from penmark.operators import style
from penmark.plans import recipes
from penmark.sources import sample
from penmark.sources.lexicon_files import read_dic
from penmark.sources.words import function_word_list, function_words

DIC = "%\n1\tArticulo\n2\t\tPrepos\n3\tYo\n4\tPronPer\n5\tNegacio\n6\tEmoPos\n%\n" \
      "el\t1\nyo\t3\t4\nno\t5\npen*\t6\npens*\t4\t3\nyo*\t2\nel\t1\t4\n\npensar\t2\nsin\t99\n"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dic") / "words.dic"
    path.write_text(DIC, encoding="utf8")
    return lx.build_lexicon(*read_dic(spark, str(path)))


@pytest.fixture(scope="module")
def lexicon(built):
    return lx.prepare_lexicon(built)


def test_entries_glue_codes_in_their_own_order(built):
    got = {r["entry"]: r for r in built.collect()}
    assert (got["yo"]["gram"], got["yo"]["cdi"]) == ("Yo", "PronPer")
    assert got["pens*"]["stem"] == "pens" and got["pens*"]["is_prefix"]
    assert got["el"]["cdi"] == "ArticuloPronPer"  # the last of two lines counts
    assert got["no"]["gram"] == got["no"]["cdi"] == "Negacio"  # one name in two macro-categories
    assert got["sin"]["gram"] == got["sin"]["feels"] == "w"


def test_three_marks_are_an_error(spark, tmp_path):
    path = tmp_path / "bad.dic"
    path.write_text(DIC + "%\n", encoding="utf8")
    with pytest.raises(ValueError):
        read_dic(spark, str(path))


def test_matching_prefers_exact_then_longest_stem(spark, lexicon):
    words = ["pensar", "pensamos", "pens", "pena", "yo", "yosoy", "otro", "p", ""]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: r["entry"] for r in lx.match_words(df, lexicon).collect()}
    assert got == {"pensar": "pensar", "pensamos": "pens*", "pens": "pens*", "pena": "pen*", "yo": "yo", "yosoy": "yo*",
                   "otro": None, "p": None, "": None}


def test_matching_without_broadcast_gives_the_same(spark, lexicon):
    words = spark.createDataFrame([(w,) for w in ("pensar", "pensamos", "yosoy", "otro")], "word string")
    large = lx.Lexicon(lexicon.rows, lx.BROADCAST_ENTRIES + 1, lexicon.stem_lengths)
    assert sorted(lx.match_words(words, large).collect()) == sorted(lx.match_words(words, lexicon).collect())


def test_encoding_keeps_token_order(spark, lexicon):
    df = spark.createDataFrame([(1, ["yo", "pensamos", "el", "otro"]), (2, [])], "speech_id long, tokens array<string>")
    got = {r["speech_id"]: r for r in lx.encode(df, lexicon).collect()}
    assert got[1]["gram"] == ["Yo", "Yo", "w", "w"] and got[1]["cdi"] == ["PronPer", "PronPer", "ArticuloPronPer", "w"]
    assert got[2]["gram"] == []


def test_both_encodings_agree(spark, lexicon):
    rows = [(1, "A", ["pensar", "pensamos", "pens", "pena", "yo", "yosoy", "otro", "p", "no"] * 30), (2, "B", []), (3, "C", None)]
    df = spark.createDataFrame(rows, "speech_id long, speaker string, tokens array<string>")
    in_rows, joined = lx.encode(df, lexicon), lx.encode_by_join(df, lexicon)
    assert in_rows.columns == joined.columns and sorted(in_rows.collect()) == sorted(joined.collect())
    plan = in_rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_indices_from_text_and_from_codes_agree(spark, lexicon):
    rows = [(1, "A", "Yo pensamos el otro. No pena", "PRON VERB DET NOUN ADV NOUN"), (2, "B", None, None), (3, "A", "el el", "DET ADJ")]
    df = sample.with_tokens(spark.createDataFrame(rows, "speech_id long, speaker string, text string, pos_tags string"))
    direct = style.marks_from_text(df, lexicon, ["speaker"])
    coded = style.marks_from_codes(recipes.encoded(df.drop("tokens"), lexicon), ["speaker"])
    assert sorted(direct.collect()) == sorted(coded.collect())
    got = {r["speaker"]: r for r in style.style_indices(direct).collect()}
    assert got["A"]["n_words"] == 8 and got["A"]["asi"] == 0.0 and got["A"]["pos_plus_neg"] == pytest.approx(12.5)
    assert got["B"]["n_words"] == 0 and got["B"]["ati"] is None and got["B"]["asi"] is None
    ati = 100 / 8 * (3 - 5 - 1)  # three Articulo; PronPer: yo, pensamos and the three el; one Negacio
    assert got["A"]["ati"] == pytest.approx(ati)


def test_function_words(spark):
    assert len(function_word_list("es")) == 313 and len(function_word_list("it")) == 279
    assert function_words(spark, "it").count() == 279
    with pytest.raises(ValueError):
        function_word_list("fr")


def test_sample_lexicon_matches_its_dic_form(spark, tmp_path):
    path = tmp_path / "sample.dic"
    path.write_text(sample.dic_text(), encoding="utf8")
    from_file = lx.build_lexicon(*read_dic(spark, str(path)))
    assert sorted(from_file.collect()) == sorted(lx.build_lexicon(*sample.lexicon_tables(spark)).collect())


def test_words_are_encoded_once_each_as_by_column(spark, lexicon):
    """The encoded table equals the column expressions, and no expression runs for every token."""
    rng = random.Random(5)
    letters = "aeiouáéíóúünspthrlbg1ªß"
    known = ["pensar", "pensamos", "pens", "yo", "el", "la", "de", "qui", "is", "no", "y", "ing", "x9", "día", "vous", "o", "leer", "lly"]
    rows = [(i, [rng.choice(known) if rng.random() < 0.4 else "".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 40))]) for i in range(80)]
    rows += [(90, []), (91, None), (92, ["yo", None])]
    df = spark.createDataFrame(rows, "speech_id long, tokens array<string>").repartition(3)
    want = recipes.encoded(sample.with_tags(df.where("speech_id < 92")), lexicon)
    plain = lx.encode(df.withColumn("stress", tx.stress_text("tokens", recipes.unstressed_words())), lexicon)
    got = recipes.encoded(df, lexicon, sample.upos_of)
    columns = ["speech_id", "stress", *lx.MACROS]
    assert sorted(got.select(columns).collect()) == sorted(plain.select(columns).collect(), key=lambda r: r.speech_id)
    tagged = sample.with_tags(df.where("speech_id < 92")).select("speech_id", "pos_tags")
    assert sorted(got.where("speech_id < 91").select("speech_id", "pos_tags").collect()) == sorted(tagged.where("speech_id < 91").collect())
    assert sorted(want.columns) == sorted(got.columns)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
