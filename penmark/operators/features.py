"""Feature blocks in long form: counts, fitted vocabularies, weights, vectors.

Every block starts from ``speech_id, gram, tf`` counts. What is learned from the
training rows (document frequencies, selected grams, longest length) sits in a
``FittedBlock``; applying it to any rows gives ``speech_id, feature, value``.
Where one fit serves all speeches, the n-grams of a speech and its labels are one
row, so that weights and norms need no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from penmark.functions import text as tx
from penmark.operators.ranks import sorted_numbers
from penmark.session import by_speech, small_side, staged, staged_together
from penmark.sources.words import function_word_list


class Ngrams(NamedTuple):
    column: str  # a blank-joined string or an array of codes
    unit: str  # "word" or "char"
    low: int
    high: int
    keep: float | None  # share of features kept by chi-square


# The n-gram ranges and kept shares of the blocks.
NGRAM_BLOCKS = {
    "pos_tags": Ngrams("pos_tags", "word", 1, 3, None),
    "stress": Ngrams("stress", "char", 1, 7, None),
    "liwc_gram": Ngrams("gram", "word", 1, 3, 0.1),
    "liwc_obj": Ngrams("obj", "word", 1, 3, 0.1),
    "liwc_cog": Ngrams("cog", "word", 1, 3, 0.1),
    "liwc_feels": Ngrams("feels", "word", 1, 3, 0.1),
}
LENGTH_BLOCKS = {"word_lengths": "w_len_", "sentence_lengths": "s_len_"}
BASE_BLOCKS = ["function_words", *LENGTH_BLOCKS]
WORD_BLOCKS = ["function_words", "word_lengths"]
SWITCHES = ["base_features", *NGRAM_BLOCKS]
MIN_LENGTH_COUNT = 5


def blocks_of(switches: list[str]) -> list[str]:
    """Blocks behind the switched-on feature sets, in column order."""
    unknown = set(switches) - set(SWITCHES)
    if unknown:
        raise ValueError(f"unknown feature sets {sorted(unknown)}")
    on = [s for s in SWITCHES if s in switches]
    return [b for s in on for b in (BASE_BLOCKS if s == "base_features" else [s])]


# ---- counts ----------------------------------------------------------------


def usable_codes(codes: Column) -> Column:
    """Lowercased codes of two or more characters; shorter ones leave the sequence."""
    return F.filter(F.transform(codes, lambda c: F.lower(c)), lambda c: F.length(c) >= 2)


PIECE = 1 << 19  # units that are counted at once


def _unit_reader(units: pa.Array, glue: str) -> tuple[np.ndarray, Callable[[int, int], tuple[list[str | None], np.ndarray]]]:
    """Where each row ends, in units, and what gives the distinct units of some rows with the place of each unit among them."""
    if glue or pa.types.is_list(units.type):
        lists = units if pa.types.is_list(units.type) else pc.split_pattern(units, glue)

        def read(a: int, b: int) -> tuple[list[str | None], np.ndarray]:
            flat = lists.slice(a, b - a).flatten().dictionary_encode(null_encoding="encode")
            return flat.dictionary.to_pylist(), flat.indices.to_numpy()

        return np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)), read

    def read_points(a: int, b: int) -> tuple[list[str | None], np.ndarray]:
        points = np.frombuffer("".join(units.slice(a, b - a).drop_null().to_pylist()).encode("utf-32-le"), np.uint32)
        met = np.flatnonzero(np.bincount(points))
        place = np.zeros(met.max(initial=-1) + 1, np.int64)
        place[met] = np.arange(len(met))
        return [chr(c) for c in met.tolist()], place[points]

    return np.cumsum(pc.utf8_length(units).fill_null(0).to_numpy(zero_copy_only=False)), read_points


def _pieces(
    batches: Iterator[pa.RecordBatch], short: int, glue: str
) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Rows of a sorted partition a piece at a time: the rows, the ids of their runs of one speech, the run of
    each row, the row and the number of each unit, and the units. Units of ``short`` characters or fewer are left out."""
    for batch in batches:
        ids = batch.column("speech_id")
        ends, read = _unit_reader(batch.column("units"), glue)
        a = 0
        while a < batch.num_rows:
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + PIECE, "right")))
            mine = ids.slice(a, b - a)
            changed = mine.slice(1).to_numpy(zero_copy_only=False) != mine.slice(0, b - a - 1).to_numpy(zero_copy_only=False)
            gaps = mine.is_null().to_numpy(zero_copy_only=False)
            changed = np.where(gaps[1:] | gaps[:-1], gaps[1:] != gaps[:-1], changed)
            run_of = np.concatenate(([0], np.cumsum(changed))).astype(np.int64)
            runs = mine.take(pa.array(np.concatenate(([0], np.flatnonzero(changed) + 1))))
            distinct, at = read(a, b)
            numbers: dict[str, int] = {}
            place = [-1 if u is None or len(u.lower()) <= short else numbers.setdefault(u.lower(), len(numbers)) for u in distinct]
            unit = np.array(place, np.int64)[at]
            row = np.repeat(np.arange(b - a), np.diff(np.concatenate(([before], ends[a:b]))))
            yield batch.slice(a, b - a), runs, run_of, row[unit >= 0], unit[unit >= 0], list(numbers)
            a = b


def _piece_grams(
    run_of: np.ndarray, row: np.ndarray, unit: np.ndarray, names: list[str], low: int, high: int, glue: str
) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """``run, gram, count`` of the n-grams inside rows, one length after the other.

    An n-gram's number has one digit a unit; where numbers get too long, those met are renumbered.
    """
    n_units, n_runs = len(names), int(run_of[-1]) + 1
    text, start, digits, span, ids = np.array(names, object), np.array(names, object), 0, n_units, unit

    def spelled(used: np.ndarray) -> list[str]:
        parts = []
        for _ in range(digits):
            used, last = np.divmod(used, n_units)
            parts.append(text[last])
        return [glue.join(p) for p in zip(start[used], *reversed(parts))]

    for n in range(1, high + 1):
        if len(unit) < n:
            return
        if n > 1:
            ids = ids[:-1]
            if span * n_units * n_runs >= 1 << 62:
                used, ids = np.unique(ids, return_inverse=True)
                start, digits, span = np.array(spelled(used), object), 0, len(used)
            ids, span, digits = ids * n_units + unit[n - 1 :], span * n_units, digits + 1
        if n < low:
            continue
        inside = row[: len(row) - n + 1] == row[n - 1 :]
        key = run_of[row[: len(row) - n + 1][inside]] * span + ids[inside]
        if not len(key):
            return
        # Few different numbers are tallied, many are sorted.
        if span * n_runs <= 4 * len(key):
            tally = np.bincount(key)
            met = np.flatnonzero(tally)
            times = tally[met]
        else:
            key.sort()
            first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            met, times = key[first], np.diff(np.concatenate((first, [len(key)])))
        run, gram = np.divmod(met, span)
        used, at = np.unique(gram, return_inverse=True)
        yield run, pa.array(spelled(used), pa.string()).take(pa.array(at)), times


def _masked(speeches: DataFrame, spec: Ngrams) -> DataFrame:
    """``speech_id`` and the masked text of the rows that have one; codes of a byte or less, which no n-gram holds, do not travel."""
    masked = F.col(spec.column)
    if spec.unit == "word" and isinstance(speeches.schema[spec.column].dataType, T.ArrayType):
        masked = F.filter(masked, lambda c: F.octet_length(c) > 1)
    return speeches.select("speech_id", masked.alias(spec.column)).where(F.col(spec.column).isNotNull())


def _units(spec: Ngrams, speeches: DataFrame) -> tuple[Column, str, int]:
    """A masked text whose units a task reads, what joins the units, and the longest unit that is left out."""
    is_array = isinstance(speeches.schema[spec.column].dataType, T.ArrayType)
    text = F.col(spec.column) if is_array else F.lower(spec.column)
    return (text, " ", 1) if spec.unit == "word" else (text, "", 0)


def ngram_counts(speeches: DataFrame, spec: Ngrams) -> DataFrame:
    """``speech_id, gram, tf`` of every n-gram in the block's range.

    The masked text is moved once, by speech; a task then counts numbers that stand for units and
    spells each distinct n-gram of a piece once. Rows that share ``speech_id`` are one speech; only
    the counts of the last one are kept from piece to piece.
    """
    units, glue, short = _units(spec, speeches)
    rows = by_speech(_masked(speeches, spec))
    rows = rows.sortWithinPartitions("speech_id").select("speech_id", units.alias("units"))
    schema = T.StructType([rows.schema["speech_id"], T.StructField("gram", T.StringType()), T.StructField("tf", T.LongType())])
    names = schema.names

    def closed(one: pa.Scalar, held: Counter) -> pa.RecordBatch:
        same = pa.array([one.as_py()] * len(held), one.type)
        return pa.RecordBatch.from_arrays([same, pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, Counter()
        for _, runs, run_of, row, unit, known in _pieces(batches, short, glue):
            if held and not runs[0].equals(last):
                yield closed(last, held)
                held = Counter()
            after: Counter = Counter()
            for of, gram, n in _piece_grams(run_of, row, unit, known, spec.low, spec.high, glue) if known else ():
                # Runs are in order; the first may go on from the piece before, the last into the next.
                lo, hi = np.searchsorted(of, [1, max(len(runs) - 1, 1)]).tolist()
                for g, k in zip(gram.slice(0, lo).to_pylist(), n[:lo].tolist()):
                    held[g] += k
                for g, k in zip(gram.slice(hi).to_pylist(), n[hi:].tolist()):
                    after[g] += k
                if hi > lo:
                    yield pa.RecordBatch.from_arrays([runs.take(pa.array(of[lo:hi])), gram.slice(lo, hi - lo), pa.array(n[lo:hi].astype(np.int64))], names)
            if len(runs) > 1:
                if held:
                    yield closed(runs[0], held)
                held = after
            last = runs[len(runs) - 1]
        if held:
            yield closed(last, held)

    return rows.mapInArrow(run, schema)


def packed_ngrams(speeches: DataFrame, spec: Ngrams, labels: DataFrame) -> DataFrame:
    """``speech_id, ys, grams, tfs``: a speech's n-grams with their counts in one row, and all its labels.

    ``labels`` has ``speech_id, y``. They move with the masked text, so a speech meets its labels without
    a join; one that is in several rows of ``labels`` has several, one that is in none has no label.
    """
    units, glue, short = _units(spec, speeches)
    text, y = _masked(speeches, spec), F.col("y").cast("string")
    nothing = F.lit(None).cast(text.schema[spec.column].dataType).alias(spec.column)
    rows = text.withColumn("y", F.lit(None).cast("string")).unionByName(
        labels.where(F.col("speech_id").isNotNull()).select("speech_id", nothing, y.alias("y"))
    )
    rows = by_speech(rows).sortWithinPartitions("speech_id").select("speech_id", "y", units.alias("units"))
    strings, longs = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
    schema = T.StructType([rows.schema["speech_id"], T.StructField("ys", strings), T.StructField("grams", strings), T.StructField("tfs", longs)])
    names = schema.names

    def closed(one: pa.Scalar, ys: list[str | None], held: Counter) -> pa.RecordBatch:
        columns = [[one.as_py()], [ys], [list(held.keys())], [list(held.values())]]
        kinds = [one.type, pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def lists(edges: np.ndarray, values: pa.Array, lo: int, hi: int) -> pa.ListArray:
        inside = values.slice(edges[lo], edges[hi] - edges[lo])
        return pa.ListArray.from_arrays(pa.array((edges[lo : hi + 1] - edges[lo]).astype(np.int32)), inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, held_ys = None, Counter(), []
        for part, runs, run_of, row, unit, known in _pieces(batches, short, glue):
            found = list(_piece_grams(run_of, row, unit, known, spec.low, spec.high, glue)) if known else []
            of = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            order = np.argsort(of, kind="stable")
            gram = pa.concat_arrays([f[1] for f in found]).take(pa.array(order)) if found else pa.array([], pa.string())
            n = pa.array((np.concatenate([f[2] for f in found])[order] if found else of).astype(np.int64))
            named = part.column("units").is_null()
            ys, y_of = part.column("y").filter(named), run_of[named.to_numpy(zero_copy_only=False)]
            bounds = np.arange(len(runs) + 1)
            edges, y_edges = np.searchsorted(of[order], bounds), np.searchsorted(y_of, bounds)
            # The first run may go on from the piece before, the last into the next.
            for at in sorted({0, len(runs) - 1}):
                if last is not None and not (at == 0 and runs[0].equals(last)):
                    if held:
                        yield closed(last, held_ys, held)
                    held, held_ys = Counter(), []
                if at and at > 1:
                    full = np.diff(edges[1 : at + 1]) > 0
                    inner = [runs.slice(1, at - 1), lists(y_edges, ys, 1, at), lists(edges, gram, 1, at), lists(edges, n, 1, at)]
                    yield pa.RecordBatch.from_arrays(inner, names).filter(pa.array(full))
                a, b = edges[at], edges[at + 1]
                for g, k in zip(gram.slice(a, b - a).to_pylist(), n.slice(a, b - a).to_pylist()):
                    held[g] += k
                held_ys += ys.slice(y_edges[at], y_edges[at + 1] - y_edges[at]).to_pylist()
                last = runs[at]
        if held:
            yield closed(last, held_ys, held)

    return rows.mapInArrow(run, schema)


def function_word_counts(speeches: DataFrame, lang: str = "es") -> DataFrame:
    """Counts of the listed words; the fixed list is a hashed filter, not a join."""
    words = speeches.select("speech_id", F.explode_outer(tx.tokens("text")).alias("gram"))
    return (
        words.where(F.col("gram").isin(function_word_list(lang)))
        .groupBy("speech_id", "gram")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def word_counts(speeches: DataFrame, lang: str = "es") -> DataFrame:
    """``speech_id, gram, len, n``: words by length, and by themselves if they are listed; both word blocks in one reading."""
    words = speeches.select("speech_id", F.explode_outer(tx.tokens("text")).alias("w")).where(F.col("w").isNotNull())
    listed = F.when(F.col("w").isin(function_word_list(lang)), F.col("w")).alias("gram")
    return words.groupBy("speech_id", listed, F.length("w").alias("len")).agg(F.count(F.lit(1)).alias("n"))


def word_length_counts(speeches: DataFrame) -> DataFrame:
    words = speeches.select("speech_id", F.explode_outer(tx.tokens("text")).alias("w")).where(F.col("w").isNotNull())
    return words.groupBy("speech_id", F.length("w").alias("len")).agg(F.count(F.lit(1)).alias("n"))


def sentence_length_counts(speeches: DataFrame) -> DataFrame:
    sents = speeches.select("speech_id", F.explode_outer(tx.sentences("text")).alias("s")).where(F.col("s").isNotNull())
    return sents.groupBy("speech_id", F.size(tx.tokens("s")).alias("len")).agg(F.count(F.lit(1)).alias("n"))


def block_counts(speeches: DataFrame, block: str) -> DataFrame:
    if block == "function_words":
        return function_word_counts(speeches)
    if block == "word_lengths":
        return word_length_counts(speeches)
    if block == "sentence_lengths":
        return sentence_length_counts(speeches)
    return ngram_counts(speeches, NGRAM_BLOCKS[block])


# ---- length curves ---------------------------------------------------------


def longest_common_length(length_counts: DataFrame, at_least: int = MIN_LENGTH_COUNT) -> DataFrame:
    """One row ``upto``: the longest length seen often enough over all rows."""
    totals = length_counts.groupBy("len").agg(F.sum("n").alias("n"))
    return totals.where(F.col("n") >= at_least).agg(F.coalesce(F.max("len"), F.lit(0)).alias("upto"))


def length_curve(length_counts: DataFrame, upto: Column) -> DataFrame:
    """Share of items of length i or more for i = 1..upto, unit norm per speech.

    The curve is constant between two lengths that occur, so it is expanded from
    those steps: work follows the output, not lengths times grid points.
    """
    down = Window.partitionBy("speech_id").orderBy(F.desc("len"))
    steps = length_counts.select(
        "speech_id",
        F.sum("n").over(down).cast("double").alias("s"),
        (F.coalesce(F.lead("len").over(down), F.lit(0)) + 1).alias("lo"),
        F.least(F.col("len"), upto).alias("hi"),
    )
    wide = F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(0))
    norm = F.sqrt(F.sum(wide * F.col("s") * F.col("s")).over(Window.partitionBy("speech_id")))
    scaled = steps.withColumn("value", F.col("s") / norm).where(F.col("hi") >= F.col("lo"))
    return scaled.select("speech_id", F.explode(F.sequence("lo", "hi")).alias("i"), "value")


# ---- weights and selection -------------------------------------------------


def unit_norm(rows: DataFrame) -> DataFrame:
    """Scale ``value`` to unit L2 norm per speech.

    One aggregation gives a speech's norm and its cells in one row, as the vectors do later.
    """
    others = [c for c in rows.columns if c not in ("speech_id", "value")]
    cells = F.collect_list(F.struct(*others, "value")).alias("_cells")
    norm = F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm")
    spread_out = rows.groupBy("speech_id").agg(cells, norm).select("speech_id", "_norm", F.explode("_cells").alias("_c"))
    return spread_out.select("speech_id", *[F.col(f"_c.{c}").alias(c) for c in others], (F.col("_c.value") / F.col("_norm")).alias("value"))


HEAVY = 10_000  # at most so many grams can each hold more than this part of all rows


def with_vocabulary(counts: DataFrame, vocabulary: DataFrame, size: int | None = None) -> DataFrame:
    """``counts`` with the columns of a vocabulary (``gram, df, ...``); other grams vanish.

    A counted small vocabulary is broadcast. Of a larger one the grams that hold more than a
    ``HEAVY``-th of all rows are, and only the others' rows are shuffled by gram, so a gram that
    every speech has never fills a task.
    """
    if size is None:
        return counts.join(vocabulary, "gram")
    if size <= 200_000:
        return counts.join(F.broadcast(vocabulary), "gram")
    rows = vocabulary.agg(F.sum("df")).first()[0]
    heavy = vocabulary.where(F.col("df") * HEAVY > F.lit(rows))
    light = vocabulary.where(F.col("df") * HEAVY <= F.lit(rows))
    found = counts.join(F.broadcast(heavy), "gram")
    rest = counts.join(F.broadcast(heavy.select("gram")), "gram", "left_anti").join(light, "gram")
    return found.unionByName(rest)


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def tfidf(counts: DataFrame, vocabulary: DataFrame, n_docs: Column, size: int | None = None) -> DataFrame:
    """Sublinear tf times smooth idf, unit norm per speech.

    ``vocabulary`` (``gram, df``) comes from the training rows, so unseen grams
    vanish. Further columns of ``counts`` and ``vocabulary`` are kept. ``size`` is the
    vocabulary's counted size, if it is known.
    """
    idf = F.log((n_docs + 1) / (F.col("df") + 1)) + 1
    weighted = with_vocabulary(counts, vocabulary, size).withColumn("value", (F.log(F.col("tf").cast("double")) + 1) * idf)
    return unit_norm(weighted.drop("tf", "df"))


def chi2_scores(weights: DataFrame, class_sizes: DataFrame) -> DataFrame:
    """Chi-square of every gram against the classes.

    ``weights`` has ``gram, value, y``; ``class_sizes`` has ``y, n`` over all
    training rows. With o the sum of a gram in a class, F its total and p the
    class share, sum((o - pF)^2 / pF) = sum(o^2 / p) / F - F, so classes without
    the gram need no rows.
    """
    shares = class_sizes.select("y", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    observed = weights.groupBy("gram", "y").agg(F.sum("value").alias("o"))
    parts = observed.join(shares, "y").groupBy("gram").agg(
        F.sum("o").alias("f"), F.sum(F.col("o") * F.col("o") / F.col("p")).alias("q")
    )
    return parts.select("gram", (F.col("q") / F.col("f") - F.col("f")).alias("chi2"))


def chi2_top(scores: DataFrame, k: int) -> DataFrame:
    """The k best grams; equal scores (to 9 places) keep the later name."""
    order = [F.round("chi2", 9).desc(), F.desc("gram")]
    return sorted_numbers(scores.select("gram", "chi2"), order).where(F.col("rn") <= k)


# ---- fit and apply ---------------------------------------------------------


PACKED_GRAMS = 200_000  # a vocabulary up to this size goes to the tasks as a dictionary


def _packed_weights(packed: DataFrame, vocabulary: DataFrame, n_docs: int, others: list[str]):
    """What a task needs to weigh packed rows: a broadcast of the vocabulary (``gram, df`` and ``others``), and the function
    that gives, for a batch, the vocabulary with the row, the vocabulary place and the weight of each n-gram."""
    idf = F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1
    table = vocabulary.select("gram", *others, idf.alias("idf")).toArrow()
    shared = packed.sparkSession.sparkContext.broadcast(table)
    opened: list = []

    def weigh(batch: pa.RecordBatch) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        if not opened:
            given = shared.value
            opened.extend([given, {g: i for i, g in enumerate(given.column("gram").to_pylist())}, given.column("idf").to_numpy()])
        given, place_of, idf_of = opened
        grams = batch.column("grams")
        flat = grams.flatten().dictionary_encode(null_encoding="encode")
        place = np.array([place_of.get(g, -1) for g in flat.dictionary.to_pylist()], np.int64)[flat.indices.to_numpy()]
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(grams).to_numpy(zero_copy_only=False))
        known = place >= 0
        row, place, tf = row[known], place[known], batch.column("tfs").flatten().to_numpy()[known]
        value = (np.log(tf) + 1) * idf_of[place]
        norm = np.sqrt(np.bincount(row, value * value, batch.num_rows))
        return given, row, place, value / norm[row]

    return weigh


SUMS = 1 << 21  # sums by n-gram and label that a task holds


def _label_sums(packed: DataFrame, vocabulary: DataFrame, n_docs: int) -> DataFrame:
    """``gram, y, value``: weights of labelled packed rows, summed by task; one row may have several labels."""
    weigh = _packed_weights(packed, vocabulary, n_docs, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: dict[str | None, int] = {}
        keys, sums = np.zeros(0, np.int64), np.zeros(0)
        given = None

        def made() -> pa.RecordBatch:
            names = pa.array(list(labels), pa.string())
            y, gram = np.divmod(keys, len(given))
            gram = given.column("gram").combine_chunks().take(pa.array(gram))
            return pa.RecordBatch.from_arrays([gram, names.take(pa.array(y)), pa.array(sums)], ["gram", "y", "value"])

        for batch in batches:
            given, row, place, value = weigh(batch)
            ys = batch.column("ys")
            number = np.array([labels.setdefault(y, len(labels)) for y in ys.flatten().to_pylist()], np.int64)
            many = pc.list_value_length(ys).to_numpy(zero_copy_only=False)
            first, times = (np.cumsum(many) - many)[row], many[row]
            # A cell comes once for every label of its row.
            cell = np.repeat(np.arange(len(row)), times)
            step = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
            key = number[first[cell] + step] * len(given) + place[cell] if len(cell) else np.zeros(0, np.int64)
            keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, value[cell]]), len(keys))
            if len(keys) > SUMS:
                yield made()
                keys, sums = np.zeros(0, np.int64), np.zeros(0)
        if len(keys):
            yield made()

    return packed.mapInArrow(run, "gram string, y string, value double")


@dataclass(frozen=True)
class FittedBlock:
    """What one block learned from the training rows."""

    block: str
    n_features: int
    vocabulary: DataFrame | None = None  # gram, df, kept
    n_vocabulary: int = 0
    n_docs: int = 0
    upto: int = 0


def fit_block(block: str, counts: DataFrame, labels: DataFrame) -> FittedBlock:
    """Fit on training rows: ``counts`` of the block, ``labels`` = ``speech_id, y``."""
    if block == "function_words":
        return FittedBlock(block, len(function_word_list("es")))
    if block in LENGTH_BLOCKS:
        upto = longest_common_length(counts).first()["upto"]
        return FittedBlock(block, upto, upto=upto)
    keep = NGRAM_BLOCKS[block].keep
    n_docs = labels.count()
    vocabulary = staged(document_frequencies(counts))
    size = vocabulary.count()
    kept = size
    if keep is None:
        vocabulary = vocabulary.withColumn("kept", F.lit(True))
    else:
        kept = int(keep * size)
        weights = tfidf(counts, vocabulary, F.lit(n_docs), size).join(labels, "speech_id")
        sizes = labels.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
        best = chi2_top(chi2_scores(weights, sizes), kept).select("gram", F.lit(True).alias("kept"))
        vocabulary = staged(
            vocabulary.join(best, "gram", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
        )
    return FittedBlock(block, kept, vocabulary, size, n_docs)


def unpacked(packed: DataFrame) -> DataFrame:
    """``speech_id, gram, tf`` of packed rows."""
    return packed.select("speech_id", F.explode(F.arrays_zip("grams", "tfs")).alias("c")).select("speech_id", F.col("c.grams").alias("gram"), F.col("c.tfs").alias("tf"))


def fit_packed(block: str, packed: DataFrame, labels: DataFrame, n_docs: int) -> FittedBlock:
    """``fit_block`` of an n-gram block on the labelled ones of packed rows; ``n_docs`` is the counted size of ``labels``."""
    keep = NGRAM_BLOCKS[block].keep
    train = packed.where(F.size("ys") > 0)
    vocabulary = staged(document_frequencies(train.select(F.explode("grams").alias("gram"))))
    size = vocabulary.count()
    if keep is None:
        return FittedBlock(block, size, vocabulary.withColumn("kept", F.lit(True)), size, n_docs)
    kept, labels = int(keep * size), labels.select("speech_id", F.col("y").cast("string"))
    if size <= PACKED_GRAMS:
        weights = _label_sums(train, vocabulary, n_docs)
    else:
        weights = tfidf(unpacked(train), vocabulary, F.lit(n_docs), size).join(labels, "speech_id")
    sizes = labels.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    best = chi2_top(chi2_scores(weights, sizes), kept).select("gram", F.lit(True).alias("kept"))
    vocabulary = staged(vocabulary.join(best, "gram", "left").withColumn("kept", F.coalesce("kept", F.lit(False))))
    return FittedBlock(block, kept, vocabulary, size, n_docs)


def apply_packed(fitted: FittedBlock, packed: DataFrame) -> DataFrame:
    """``apply_block`` of an n-gram block on packed rows: weights, norm and choice inside a row."""
    if fitted.n_vocabulary > PACKED_GRAMS:
        return apply_block(fitted, unpacked(packed))
    weigh = _packed_weights(packed, fitted.vocabulary, fitted.n_docs, ["kept"])
    schema = T.StructType([packed.schema["speech_id"], T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, row, place, value = weigh(batch)
            kept = given.column("kept").to_numpy()[place]
            gram = given.column("gram").combine_chunks().take(pa.array(place[kept]))
            yield pa.RecordBatch.from_arrays([batch.column("speech_id").take(pa.array(row[kept])), gram, pa.array(value[kept])], schema.names)

    rows = packed.select("speech_id", "grams", "tfs").mapInArrow(run, schema)
    return rows.select("speech_id", F.lit(fitted.block).alias("block"), "feature", "value")


def packed_arrays(fitted: FittedBlock, packed: DataFrame, index: DataFrame) -> DataFrame:
    """``speech_id, indices, values``: ``apply_packed`` with the columns' numbers, a row a speech."""
    numbers = index.where(F.col("block") == fitted.block).select(F.col("feature").alias("gram"), "idx")
    if fitted.n_vocabulary > PACKED_GRAMS:
        return _arrays(apply_packed(fitted, packed), index, fitted.n_features)
    weigh = _packed_weights(packed, fitted.vocabulary.join(numbers, "gram", "left"), fitted.n_docs, ["idx"])
    lists = [T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([packed.schema["speech_id"], *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, row, place, value = weigh(batch)
            idx = given.column("idx").fill_null(-1).to_numpy()[place]
            row, idx, value = row[idx >= 0], idx[idx >= 0], value[idx >= 0]
            edges = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            made = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (idx.astype(np.int32), value)]
            full = pa.array(np.diff(edges.to_numpy()) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("speech_id"), *made], schema.names).filter(full)

    return packed.select("speech_id", "grams", "tfs").mapInArrow(run, schema)


def _arrays(features: DataFrame, index: DataFrame, size: int) -> DataFrame:
    cells = features.join(small_side(index, size), ["block", "feature"])
    rows = cells.groupBy("speech_id").agg(F.collect_list(F.struct("idx", "value")).alias("c"))
    return rows.select("speech_id", F.col("c.idx").alias("indices"), F.col("c.value").alias("values"))


def apply_block(fitted: FittedBlock, counts: DataFrame) -> DataFrame:
    """``speech_id, block, feature, value`` (non-zero values only)."""
    if fitted.block == "function_words":
        rows = unit_norm(counts.withColumn("value", F.col("tf").cast("double"))).withColumnRenamed("gram", "feature")
    elif fitted.block in LENGTH_BLOCKS:
        name = F.concat(F.lit(LENGTH_BLOCKS[fitted.block]), F.col("i").cast("string"))
        rows = length_curve(counts, F.lit(fitted.upto)).withColumn("feature", name)
    else:
        rows = tfidf(counts, fitted.vocabulary, F.lit(fitted.n_docs), fitted.n_vocabulary)
        rows = rows.where("kept").withColumnRenamed("gram", "feature")
    return rows.select("speech_id", F.lit(fitted.block).alias("block"), "feature", "value")


def feature_names(fitted: list[FittedBlock], like: DataFrame) -> DataFrame:
    """``block, feature, place``: every feature with its order inside the block."""
    spark = like.sparkSession
    parts = []
    for f in fitted:
        if f.block == "function_words":
            part = spark.range(1).select(F.posexplode(F.lit(function_word_list("es"))).alias("place", "feature"))
        elif f.block in LENGTH_BLOCKS:
            part = spark.range(1, f.upto + 1).select(
                F.col("id").cast("int").alias("place"),
                F.concat(F.lit(LENGTH_BLOCKS[f.block]), F.col("id").cast("string")).alias("feature"),
            )
        else:
            part = f.vocabulary.where("kept").select(F.lit(0).alias("place"), F.col("gram").alias("feature"))
        parts.append(part.select(F.lit(f.block).alias("block"), "feature", "place"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def staged_counts(speeches: DataFrame, switches: list[str]) -> dict[str, DataFrame]:
    """Per-speech counts of every block, written once for all fits that read them."""
    return staged_together({b: block_counts(speeches, b) for b in blocks_of(switches)})


def fitted_counts(speeches: DataFrame, train: DataFrame, switches: list[str], parallelism: int = 4) -> list[tuple[FittedBlock, DataFrame]]:
    """Every block fitted on ``train`` (``speech_id, y``), with its counts of all speeches; those of n-grams are packed rows.

    The counts of a block are written once: fitting and applying read them up to
    three times, and a column store holds the repeated grams compactly.
    """
    train = staged(train.select("speech_id", "y"))
    n_docs = train.count()

    def fitted(blocks: list[str]) -> list[tuple[FittedBlock, DataFrame]]:
        if blocks[0] in NGRAM_BLOCKS:
            packed = staged(packed_ngrams(speeches, NGRAM_BLOCKS[blocks[0]], train))
            return [(fit_packed(blocks[0], packed, train, n_docs), packed)]
        if blocks == WORD_BLOCKS:
            words = staged(word_counts(speeches))
            lengths = words.groupBy("speech_id", "len").agg(F.sum("n").alias("n"))
            counts = [words.where(F.col("gram").isNotNull()).select("speech_id", "gram", F.col("n").alias("tf")), lengths]
        else:
            counts = [staged(block_counts(speeches, b)) for b in blocks]
        mine = [c.join(train.select("speech_id"), "speech_id", "left_semi") for c in counts]
        return [(fit_block(b, m, train), c) for b, m, c in zip(blocks, mine, counts)]

    blocks = blocks_of(switches)
    # A switch has both word blocks or none.
    groups = [WORD_BLOCKS] * (WORD_BLOCKS[0] in blocks) + [[b] for b in blocks if b not in WORD_BLOCKS]
    with ThreadPool(parallelism) as pool:
        made = [one for group in pool.map(fitted, groups, 1) for one in group]
    return sorted(made, key=lambda one: blocks.index(one[0].block))


def build_features(speeches: DataFrame, train: DataFrame, switches: list[str]) -> tuple[DataFrame, list[FittedBlock]]:
    """Long features of every speech, fitted on ``train`` (``speech_id, y``)."""
    made = fitted_counts(speeches, train, switches)
    parts = [apply_packed(fit, counts) if fit.block in NGRAM_BLOCKS else apply_block(fit, counts) for fit, counts in made]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, [fit for fit, _ in made]


def feature_arrays(speeches: DataFrame, train: DataFrame, switches: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """``build_features`` as one row a speech, ``speech_id, indices, values``, with the index of the columns and its size.

    Speeches without a feature have no row; the cells of a row are in no order.
    """
    made = fitted_counts(speeches, train, switches)
    index, size = feature_index([fit for fit, _ in made], speeches)
    index = staged(index)
    parts, long = [], None
    for fit, counts in made:
        if fit.block in NGRAM_BLOCKS:
            parts.append(packed_arrays(fit, counts, index))
        else:
            rows = apply_block(fit, counts)
            long = rows if long is None else long.unionByName(rows)
    if long is not None:
        parts.append(_arrays(long, index, size))
    if len(parts) == 1:
        return parts[0], index, size
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    rows = out.groupBy("speech_id").agg(F.collect_list(F.struct("indices", "values")).alias("c"))
    return rows.select("speech_id", F.flatten("c.indices").alias("indices"), F.flatten("c.values").alias("values")), index, size


def feature_index(fitted: list[FittedBlock], like: DataFrame) -> tuple[DataFrame, int]:
    """``block, feature, idx`` in column order (blocks as fitted, then place, then name)."""
    place_of = {f.block: i for i, f in enumerate(fitted)}
    block_no = F.element_at(F.create_map(*[F.lit(x) for kv in place_of.items() for x in kv]), F.col("block"))
    names = feature_names(fitted, like).withColumn("block_no", block_no)
    order = [F.col("block_no"), F.col("place"), F.col("feature")]
    numbered = sorted_numbers(names, order).select("block", "feature", (F.col("rn") - 1).cast("int").alias("idx"))
    return numbered, sum(f.n_features for f in fitted)


def to_arrays(features: DataFrame, index: DataFrame, size: int, rows: DataFrame) -> DataFrame:
    """``rows`` with ``indices`` and ``values`` of their cells; speeches without a feature have none."""
    cells = features.join(small_side(index, size), ["block", "feature"])
    packed = cells.groupBy("speech_id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("c"))
    both = rows.join(packed, "speech_id", "left").withColumn(
        "c", F.coalesce("c", F.array().cast("array<struct<idx:int,value:double>>"))
    )
    return both.select(*rows.columns, F.col("c.idx").alias("indices"), F.col("c.value").alias("values"))


def to_vectors(features: DataFrame, index: DataFrame, size: int, rows: DataFrame) -> DataFrame:
    """``rows`` with a sparse ``features`` vector; speeches without a feature get an empty one.

    The vectors are assembled as the storage layout of an ML vector, written, and
    read back under the vector type, so no row passes through Python.
    """
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), "indices", "values")
    plain = to_arrays(features, index, size, rows).select(*rows.columns, vector.alias("features"))
    typed = T.StructType(
        [T.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in plain.schema]
    )
    return staged(plain, typed)
