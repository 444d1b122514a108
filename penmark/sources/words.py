"""Function-word lists."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

# The public word lists that Spark ships for these languages, one word a line.
LANGUAGES = {"es": "spanish", "it": "italian"}
_FOLDER = Path(__file__).parent / "function_words"


@cache
def _words(name: str) -> tuple[str, ...]:
    return tuple((_FOLDER / f"{name}.txt").read_text(encoding="utf-8").split())


def function_word_list(lang: str) -> list[str]:
    """The words of one language; a fixed list of a few hundred entries. Needs no session."""
    if lang not in LANGUAGES:
        raise ValueError(f"{lang} not in scope")
    return list(_words(LANGUAGES[lang]))


def function_words(spark: SparkSession, lang: str) -> DataFrame:
    words = function_word_list(lang)
    return spark.range(1).select(F.lit(lang).alias("lang"), F.explode(F.lit(words)).alias("word"))
