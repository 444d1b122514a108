"""Style indices from masked texts, per speaker and per text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from penmark.functions import text as tx
from penmark.operators.corpus import modal_labels, wing_english
from penmark.operators.lexicon import CDI, Lexicon, match_words

# Counted names by column; occurrences inside glued codes count.
MARKS: dict[str, list[str]] = {
    "cdi": CDI,
    "gram": ["Yo", "Nosotro", "TuUtd", "VosUtds"],
    "feels": ["EmoPos", "EmoNeg"],
    "pos_tags": ["NOUN", "ADJ", "VERB"],
}
MARK_NAMES = [name for names in MARKS.values() for name in names]


def marks_from_text(speeches: DataFrame, lexicon: Lexicon, by: list[str]) -> DataFrame:
    """Words and category counts per group straight from ``tokens`` and ``pos_tags``.

    One pass: explode the tokens, look each word up in the broadcast lexicon, sum
    before the shuffle. Nothing but the sums is moved. Counts inside a code are
    taken once per lexicon entry; per-text values ride on the first token only.
    """
    per_text = F.struct(
        tx.n_words("text").alias("n_words"), *[tx.occurrences("pos_tags", t).alias(t) for t in MARKS["pos_tags"]]
    )
    rows = speeches.select(*by, per_text.alias("_t"), "tokens")
    rows = rows.select(*by, "_t", F.posexplode_outer("tokens").alias("_pos", "word"))
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    rows = rows.withColumn("_t", F.when(first, F.col("_t")))
    counts = {n: tx.occurrences(c, n) for c, names in MARKS.items() if c != "pos_tags" for n in names}
    coded = match_words(rows, lexicon, counts)
    sums = [F.sum("_t.n_words").alias("n_words"), *[F.sum(n).alias(n) for n in counts]]
    sums += [F.sum(f"_t.{tag}").alias(tag) for tag in MARKS["pos_tags"]]
    return _filled(coded.groupBy(*by).agg(*sums), by)


def marks_from_codes(encoded: DataFrame, by: list[str]) -> DataFrame:
    """The same counts from a stored encoded table (code arrays, tag strings)."""
    sums = [F.sum(tx.n_words("text")).alias("n_words")]
    for column, names in MARKS.items():
        joined = F.col(column) if column == "pos_tags" else F.array_join(column, " ")
        sums += [F.sum(tx.occurrences(joined, name)).alias(name) for name in names]
    return _filled(encoded.groupBy(*by).agg(*sums), by)


def _filled(sums: DataFrame, by: list[str]) -> DataFrame:
    return sums.select(*by, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ["n_words", *MARK_NAMES]])


def _rate(*signed: tuple[int, str]) -> Column:
    total = sum((sign * F.col(name) for sign, name in signed), F.lit(0))
    return F.try_divide(F.lit(100.0) * total, F.col("n_words"))


def style_indices(marks: DataFrame) -> DataFrame:
    """ATI, CNI, ASI and both emotion indices; null where the divisor is zero."""
    yours = F.col("VosUtds") + F.col("TuUtd")
    return marks.select(
        *[c for c in marks.columns if c not in MARK_NAMES],
        _rate((1, "Articulo"), (1, "Prepos"), (-1, "PronPer"), (-1, "PronImp"), (-1, "VerbAux"), (-1, "Conjunc"),
              (-1, "Adverb"), (-1, "Negacio")).alias("ati"),
        _rate((1, "NOUN"), (1, "ADJ"), (1, "Prepos"), (-1, "VERB"), (-1, "Adverb"), (-1, "PronPer")).alias("cni"),
        F.try_divide(yours.cast("double"), F.col("Nosotro") + F.col("Yo") + yours).alias("asi"),
        _rate((1, "EmoPos"), (-1, "EmoNeg")).alias("pos_minus_neg"),
        _rate((1, "EmoPos"), (1, "EmoNeg")).alias("pos_plus_neg"),
    )


INDEX_NAMES = {"ATI": "ati", "CNI": "cni", "ASI": "asi", "P-NI": "pos_minus_neg", "P+NI": "pos_plus_neg"}


def index_column(name: str) -> str:
    if name not in INDEX_NAMES:
        raise ValueError(f"index must be one of {list(INDEX_NAMES)}")
    return INDEX_NAMES[name]


def extreme_texts(text_indices: DataFrame, index: str = "cni", n: int = 10) -> DataFrame:
    """The n texts with the highest and the n with the lowest index."""
    rows = text_indices.where(F.col(index).isNotNull()).select("speech_id", index)
    high = rows.orderBy(F.desc(index), "speech_id").limit(n).withColumn("kind", F.lit("max"))
    low = rows.orderBy(index, "speech_id").limit(n).withColumn("kind", F.lit("min"))
    return high.unionByName(low)


def by_wing(values: DataFrame, speeches: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``value`` per speaker (and ``keys``) with first name and English modal wing, highest first within the keys."""
    wings = modal_labels(speeches, ["wing"]).select("speaker", F.col("label").alias("wing"))
    return (
        values.select("speaker", *keys, value)
        .join(wings, "speaker", "left")
        .select("speaker", *keys, tx.first_name("speaker").alias("first_name"), wing_english("wing").alias("wing"), value)
        .orderBy(*keys, F.desc(value), F.desc("speaker"), F.desc("wing"))
    )
