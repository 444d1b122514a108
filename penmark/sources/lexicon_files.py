"""Reader of category lexicons in ``.dic`` form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_dic(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(categories(number, name, ord), words(entry, line_no, numbers))`` of one lexicon file.

    The file is a hand-made dictionary (well under a megabyte), read as one row
    so that its line numbers are exact.
    """
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")
    )
    marks = [r["line_no"] for r in lines.where(F.contains("line", F.lit("%"))).orderBy("line_no").limit(3).collect()]
    if len(marks) != 2:
        raise ValueError("a lexicon file needs exactly two % lines around its category list")
    first, second = marks
    parts = F.split("line", "\t+")
    categories = lines.where(F.col("line_no").between(first + 1, second - 1) & (F.size(parts) > 1)).select(
        F.get(parts, F.lit(0)).alias("number"), F.get(parts, F.lit(1)).alias("name"), F.col("line_no").alias("ord")
    )
    cells = F.split(F.regexp_replace("line", r"\s+$", ""), "\t")
    words = lines.where((F.col("line_no") > second) & (F.trim("line") != "")).select(
        F.get(cells, F.lit(0)).alias("entry"),
        "line_no",
        F.slice(cells, F.lit(2), F.size(cells)).alias("numbers"),
    )
    return categories, words
