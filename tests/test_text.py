import pytest

import random
import re

from pyspark.sql import functions as F

from penmark.functions import text as tx


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("r")).first()["r"]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r["r"] for r in df.select("i", expr.alias("r")).orderBy("i").collect()]


def test_clean_lowers_after_replacing(spark):
    got = column(spark, ["Ä ä ï ö ¿Qué? ¡Sí!", None, ""], tx.clean_es("t"))
    assert got == ["ä a i o ¿ qué? ¡ sí!", None, ""]


def test_utterance_id_stops_at_first_part(spark):
    got = column(spark, ["A.u12.s3.u4", "x.u7", "none"], tx.utterance_id("t"))
    assert got == ["A.u12", "x.u7", ""]


def test_tokens_need_a_letter(spark):
    got = column(spark, ["Hola, 3 b2b 42x! 7", "12 34", None], tx.tokens("t"))
    assert got == [["hola", "b2b", "42x"], [], []]


def test_tokens_are_linear_on_long_runs(spark):
    assert one(spark, F.size(tx.tokens("t")), t="1" * 300_000 + " fin") == 1
    assert one(spark, F.size(tx.sentences("t")), t="." * 300_000 + "x") == 1


def test_tokens_match_plain_rule_on_random_text(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab1ñ .,-É9") for _ in range(60)) for _ in range(200)]
    want = [[w for w in re.findall(r"[^\W_]+", t.lower()) if re.search(r"[^\W\d_]", w)] for t in texts]
    assert column(spark, texts, tx.tokens("t")) == want


def test_sentences_and_words(spark):
    got = column(spark, ["Uno. Dos!  Tres?\n\nCuatro", "...", None], tx.sentences("t"))
    assert got == [["Uno", "Dos", "Tres", "Cuatro"], ["..."], []]
    assert column(spark, [" a  b\tc\n", "", None], tx.n_words("t")) == [3, 0, None]


def test_uppercase_needs_a_cased_character(spark):
    assert column(spark, ["SÍ, 3", "123", "No"], tx.all_uppercase("t")) == [True, False, False]


def test_occurrences_do_not_overlap_and_keep_case(spark):
    got = column(spark, ["YoverbYOYo w Yo", "aaa", ""], tx.occurrences("t", "Yo"))
    assert got == [3, 0, 0]
    assert column(spark, ["aaaaa"], tx.occurrences("t", "aa")) == [2]


def test_common_prefix(spark):
    got = spark.createDataFrame([("pensar", "pens"), ("a", "b"), ("", "x"), ("yo", "yo")], "x string, y string")
    assert [r[0] for r in got.select(tx.common_prefix("x", "y")).collect()] == [4, 0, 0, 2]


def test_stress_rules(spark):
    words = ["casa", "canción", "árbol", "reloj", "esdrújula", "día", "examen", "y", "de", "sol"]
    got = column(spark, [words], tx.stress_words("t", ["de", "y"]), "array<string>")
    assert got == [["+-", "-+", "+-", "-+", "-+--", "+-", "-+-", "", "-", "+"]]
    assert column(spark, [["casa", "de"], None], tx.stress_text("t", ["de"]), "array<string>") == ["+--", None]


def test_decade_half_to_even(spark):
    assert column(spark, [1965, 1975, 1961, None], tx.decade("t"), "int") == [1960, 1980, 1960, None]


def test_first_name(spark):
    assert column(spark, ["Ana María López", "Ana"], tx.first_name("t")) == ["Ana", "Ana"]


def _grams(units, low, high, glue):
    return sorted(glue.join(units[i : i + n]) for n in range(low, high + 1) for i in range(len(units) - n + 1))


def test_ngrams_through_longest_equal_plain_ngrams(spark):
    rows = [["a1", "b", "c"], ["x"], [], ["a1", "a1", "a1", "a1"]]
    for high in (1, 3):
        got = column(
            spark, rows,
            F.array_compact(F.flatten(F.transform(tx.longest_ngrams("t", high, " "), lambda g: tx.gram_prefixes(g, 1, high, " ")))),
            "array<string>",
        )
        assert [sorted(g) for g in got] == [_grams(r, 1, high, " ") for r in rows]
    chars = [list("+--+-"), list("+")]
    got = column(
        spark, chars, F.array_compact(F.flatten(F.transform(tx.longest_ngrams("t", 7, ""), lambda g: tx.gram_prefixes(g, 1, 7, "")))),
        "array<string>",
    )
    assert [sorted(g) for g in got] == [_grams(r, 1, 7, "") for r in chars]


@pytest.mark.parametrize("text, upper", [("SECCIÓN 1", True), ("SECCIÓN 1.ª", False), ("Nº 3", False), ("12", False), ("ǅA", False), ("", False), (None, None)])
def test_all_uppercase(spark, text, upper):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(tx.all_uppercase("t")).first()[0] is upper
