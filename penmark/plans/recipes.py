"""The four corpus recipes and the encoded speech table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from penmark.functions import text as tx
from penmark.operators import corpus as c
from penmark.operators.lexicon import Lexicon, encode, encode_words
from penmark.sources.words import function_word_list


def four_wings(speeches: DataFrame, party_rows: int = 300, words: int = 50, top: int = 5) -> DataFrame:
    rows = c.min_words(c.party_min_rows(c.drop_chair(speeches), party_rows), words)
    rows = c.assign_wing(rows, "four")
    return c.with_text(c.of_speakers(rows, c.top_speakers_per_wing(rows, top)))


def six_wings(speeches: DataFrame, party_rows: int = 300, top: int = 5) -> DataFrame:
    rows = c.assign_wing(c.party_min_rows(c.drop_chair(speeches), party_rows), "six")
    return c.with_text(c.of_speakers(rows, c.top_speakers_per_wing(rows, top)))


def two_wings(speeches: DataFrame, party_rows: int = 500, top: int = 5) -> DataFrame:
    """Left and right only, balanced before missing texts drop out."""
    rows = c.assign_wing(c.party_min_rows(c.drop_chair(speeches), party_rows), "two")
    rows = rows.where(F.col("wing").isin("Izquierda", "Derecha"))
    rows = c.of_speakers(rows, c.top_speakers_per_wing(rows, top))
    return c.with_text(c.balanced_sample(rows))


def no_wing(speeches: DataFrame, party_rows: int = 300, top: int = 20) -> DataFrame:
    """The most frequent speakers whatever their wing, balanced."""
    rows = c.assign_wing(c.party_min_rows(c.drop_chair(speeches), party_rows), "six")
    rows = c.of_speakers(rows, c.top_speakers(rows, top))
    return c.with_text(c.balanced_sample(rows))


RECIPES = {"4wings": four_wings, "6wings": six_wings, "2wings": two_wings, "nowing": no_wing}


def unstressed_words() -> list[str]:
    """Function words; the stress rule leaves those of one syllable unstressed."""
    return function_word_list("es")


def encoded(speeches: DataFrame, lexicon: Lexicon, tag: Callable[[str], str] | None = None) -> DataFrame:
    """Speeches (with ``pos_tags``, or with those that ``tag`` gives each token) plus ``stress`` and the five code arrays.

    All of it is computed inside each row, once for each distinct word of a task. Callers store
    the result: every feature block and index reads it again.
    """
    rows = speeches if "tokens" in speeches.columns else speeches.withColumn("tokens", tx.tokens("text"))
    texts = {"pos_tags": (tag, " ")} if tag else {}
    if lexicon.constant is not None:
        return encode_words(rows, lexicon, {**texts, "stress": (tx.stress_of(unstressed_words()), "")})
    rows = rows.withColumn("stress", tx.stress_text("tokens", unstressed_words()))
    return encode(rows, lexicon)
