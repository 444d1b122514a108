"""Corpus preparation: filters, wings, speaker choice, balancing, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from penmark.functions import text as tx
from penmark.operators.ranks import SEED, shuffled_rank, sorted_numbers
from penmark.session import staged

# Party lists of each wing scheme.
WING_SCHEMES: dict[str, dict[str, list[str]]] = {
    "four": {
        "Izquierda": ["PSOE", "PSC-PSOE", "UP"],
        "Derecha": ["PP", "PP-Foro", "Vox"],
        "Regionalista": ["EAJ-PNV", "JxCat-Junts", "CDC", "CiU"],
        "Centro": ["Cs"],
    },
    "six": {
        "Izquierda": ["PSOE", "PSC-PSOE"],
        "Derecha": ["PP", "PP-Foro"],
        "Más izquierda": ["ERC-S", "EH Bildu", "ERC-CATSÍ", "UP"],
        "Más derecha": ["Vox"],
        "Regionalistas": ["EAJ-PNV", "JxCat-Junts", "CDC", "CiU"],
        "Centro": ["Cs"],
    },
    "two": {
        "Izquierda": ["PSOE", "PSC-PSOE", "UP"],
        "Derecha": ["PP", "PP-Foro", "Vox"],
        "Regionalistas": ["EAJ-PNV", "JxCat-Junts", "CDC", "CiU"],
        "Centro": ["Cs"],
    },
}
# English wing names; every other value is the fallback.
WING_ENGLISH = {"Izquierda": "Left", "Derecha": "Right", "Centro": "Centre"}
OTHER_WING = "Regionalist"

FOCUSES = ["name", "wing", "party", "gender", "birth", "party_status"]


def drop_chair(speeches: DataFrame) -> DataFrame:
    """Without chairperson rows; a missing role stays."""
    return speeches.where(~F.col("role").eqNullSafe("Chairperson"))


def party_min_rows(speeches: DataFrame, at_least: int = 300) -> DataFrame:
    """Rows of parties with enough rows; a missing party drops out.

    The size of the party list is not known beforehand, so no broadcast is
    forced: the adaptive plan picks it from the counted size.
    """
    counts = speeches.where(F.col("party").isNotNull()).groupBy("party").agg(F.count(F.lit(1)).alias("_n"))
    return speeches.join(counts.where(F.col("_n") >= at_least), "party", "left_semi")


def min_words(speeches: DataFrame, more_than: int = 50) -> DataFrame:
    return speeches.where(tx.more_words_than("text", more_than))


def with_text(speeches: DataFrame) -> DataFrame:
    return speeches.where(F.col("text").isNotNull() & (F.col("text") != ""))


def wing_of(party: Column | str, scheme: str) -> Column:
    """Wing of a party under a scheme; null for parties it does not list."""
    party = F.col(party) if isinstance(party, str) else party
    out = None
    for wing, members in WING_SCHEMES[scheme].items():
        hit = party.isin(members)
        out = F.when(hit, wing) if out is None else out.when(hit, wing)
    return out


def assign_wing(speeches: DataFrame, scheme: str) -> DataFrame:
    return speeches.withColumn("wing", wing_of("party", scheme))


def wing_english(wing: Column | str) -> Column:
    wing = F.col(wing) if isinstance(wing, str) else wing
    out = None
    for spanish, english in WING_ENGLISH.items():
        out = F.when(wing == spanish, english) if out is None else out.when(wing == spanish, english)
    return out.otherwise(OTHER_WING)


def speaker_counts(speeches: DataFrame, by: list[str]) -> DataFrame:
    return speeches.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def top_speakers_per_wing(speeches: DataFrame, top: int = 5) -> DataFrame:
    """The speakers with most rows in each wing; ties go to the earlier name."""
    counts = speaker_counts(speeches.where(F.col("wing").isNotNull() & F.col("speaker").isNotNull()), ["wing", "speaker"])
    order = Window.partitionBy("wing").orderBy(F.desc("n"), "speaker")
    return counts.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)


def top_speakers(speeches: DataFrame, top: int = 20) -> DataFrame:
    counts = speaker_counts(speeches.where(F.col("speaker").isNotNull()), ["speaker"])
    return counts.orderBy(F.desc("n"), "speaker").limit(top)


def of_speakers(speeches: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows of selected speakers, by name only.

    The names are stored first, so that Spark broadcasts them by their real size
    and joins a large list like any other table.
    """
    return speeches.join(staged(selected.select("speaker").distinct()), "speaker", "left_semi")


def balanced_sample(speeches: DataFrame, seed: int = SEED) -> DataFrame:
    """As many shuffled rows of every speaker as the smallest speaker has.

    Ranking sorts ids alone; texts are fetched by the chosen ids. The smallest size is
    a one-row scalar subquery. Rows without a speaker drop out.
    """
    named = speeches.where(F.col("speaker").isNotNull())
    ids = staged(named.select("speech_id", "speaker"))
    smallest = speaker_counts(ids, ["speaker"]).agg(F.min("n"))
    chosen = staged(shuffled_rank(ids, ["speaker"], seed=seed).where(F.col("rn") <= smallest.scalar()).select("speech_id"))
    return named.join(chosen, "speech_id", "left_semi")


def without_other_status(speeches: DataFrame, author: str, status: str) -> DataFrame:
    """Drop one author's rows of other party statuses; keep everybody else's."""
    is_author = F.col("speaker").eqNullSafe(author)
    return speeches.where(~(is_author & ~F.col("party_status").eqNullSafe(status)))


def label_column(focus: str) -> str:
    if focus not in FOCUSES:
        raise ValueError(f"focus must be one of {FOCUSES}")
    return {"name": "speaker"}.get(focus, focus)


def with_label(speeches: DataFrame, focus: str) -> DataFrame:
    return speeches.withColumn("y", F.col(label_column(focus)).cast("string"))


def label_table(train: DataFrame, label: str = "y") -> DataFrame:
    """``label, code``: the labels of the training rows, numbered from 0 in alphabetic order."""
    labels = train.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label")).distinct()
    return sorted_numbers(labels, [F.col("label")]).select("label", (F.col("rn") - 1).cast("int").alias("code"))


def encode_labels(rows: DataFrame, table: DataFrame, label: str = "y", out: str = "code") -> DataFrame:
    """The code of each row's label; null where the training rows have no such label."""
    codes = table.select(F.col("label").alias("_label"), F.col("code").alias(out))
    return rows.join(codes, F.col(label).cast("string") == F.col("_label"), "left").drop("_label")


def decode_labels(rows: DataFrame, table: DataFrame, code: str = "code", out: str = "y_pred") -> DataFrame:
    """The label of each row's code; null for a code that is not in the table."""
    labels = table.select(F.col("code").alias("_code"), F.col("label").alias(out))
    return rows.join(labels, F.col(code) == F.col("_code"), "left").drop("_code")


# ---- summaries -------------------------------------------------------------


def corpus_totals(speeches: DataFrame) -> DataFrame:
    """Rows, distinct parties and wings; a missing value counts as one more value."""
    values = lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
    return speeches.agg(
        F.count(F.lit(1)).alias("n_samples"),
        values("party").cast("bigint").alias("n_parties"),
        values("wing").cast("bigint").alias("n_wings"),
        F.array_join(F.array_sort(F.collect_set("party")), ",").alias("parties"),
        F.array_join(F.array_sort(F.collect_set("wing")), ",").alias("wings"),
    )


def corpus_by_speaker(speeches: DataFrame) -> DataFrame:
    return speeches.groupBy("speaker").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(tx.n_words("text")).cast("bigint").alias("n_words")
    )


LABEL_KINDS = ["wing", "party", "birth", "gender"]


def modal_labels(speeches: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``speaker, kind, label``: each speaker's commonest label; the lowest on a tie.

    One pass for all kinds. Birth years become decades. Counts are combined
    before the shuffle, so a speaker with very many rows costs no more.
    """
    kinds = kinds or LABEL_KINDS
    unknown = set(kinds) - set(LABEL_KINDS)
    if unknown:
        raise ValueError(f"labels are {LABEL_KINDS}, not {sorted(unknown)}")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("label")) for k in kinds]))
    rows = speeches.select("speaker", pairs.alias("p")).select("speaker", "p.*").where(F.col("label").isNotNull())
    counts = rows.groupBy("speaker", "kind", "label").agg(F.count(F.lit(1)).alias("n"))
    modal = counts.groupBy("speaker", "kind").agg(
        F.min_by("label", F.struct((-F.col("n")).alias("n"), F.col("label"))).alias("label")
    )
    as_decade = F.when(F.col("kind") == "birth", tx.decade("label").cast("string")).otherwise(F.col("label"))
    return modal.withColumn("label", as_decade)


def author_categories(speeches: DataFrame, kinds: tuple[str, ...] = ("gender", "birth", "party")) -> DataFrame:
    """Number of speakers per label value of each kind."""
    modal = modal_labels(speeches, list(kinds))
    return modal.groupBy("kind", F.col("label").alias("value")).agg(F.count(F.lit(1)).alias("n_authors"))


def pattern_count(speeches: DataFrame, pattern: str, where: str) -> DataFrame:
    """Occurrences of a pattern per speaker in a chosen text column."""
    return speeches.groupBy("speaker").agg(
        F.coalesce(F.sum(tx.occurrences(where, pattern)), F.lit(0)).cast("bigint").alias("n")
    )
