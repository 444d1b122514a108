"""Category lexicon: build, match by exact word or longest stem, encode texts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from penmark.session import by_speech, small_side, staged

# The category names of the five macro-categories.
GRAM = ["Yo", "Nosotro", "TuUtd", "ElElla", "VosUtds", "Ellos", "Pasado", "Present", "Futuro", "Subjuntiv",
        "Negacio", "Cuantif", "Numeros", "verbYO", "verbTU", "verbNOS", "verbVos", "verbosEL", "verbELLOS",
        "formal", "informal"]
OBJ = ["Social", "Familia", "Amigos", "Humanos", "Biolog", "Cuerpo", "Salud", "Sexual", "Espacio", "Tiempo",
       "Trabajo", "Logro", "Hogar", "Dinero", "Relig", "Muerte"]
COG = ["MecCog", "Insight", "Causa", "Discrep", "Asentir", "Tentat", "Certeza", "Inhib", "Incl", "Excl",
       "Percept", "Ver", "Oir", "Sentir", "NoFluen", "Relleno", "Ingerir", "Relativ", "Movim"]
FEELS = ["Maldec", "Afect", "EmoPos", "EmoNeg", "Ansiedad", "Enfado", "Triste", "Placer"]
CDI = ["Articulo", "Prepos", "PronPer", "PronImp", "VerbAux", "Conjunc", "Adverb", "Negacio"]

MACROS = {"gram": GRAM, "obj": OBJ, "cog": COG, "feels": FEELS, "cdi": CDI}
NO_CODE = "w"

# A dictionary of more entries than this is joined without a broadcast hint.
BROADCAST_ENTRIES = 200_000
# Up to this many entries the dictionary fits into an expression as a constant.
CONSTANT_ENTRIES = 50_000


@dataclass(frozen=True)
class Lexicon:
    """Built lexicon rows with the facts the matching plans depend on."""

    rows: DataFrame  # entry, is_prefix, stem, gram, obj, cog, feels, cdi
    n_entries: int
    stem_lengths: tuple[int, ...]
    constant: str | None = None  # entries as JSON maps in hash order, when few enough
    slots: int = 0


def build_lexicon(categories: DataFrame, words: DataFrame) -> DataFrame:
    """One row per entry with its glued code in every macro-category.

    Names follow the word's own number order, glued without a separator; a
    repeated entry keeps its last line.
    """
    last = words.groupBy("entry").agg(F.max_by("numbers", "line_no").alias("numbers"))
    used = last.select("entry", F.posexplode("numbers").alias("pos", "number")).join(categories, "number")
    name_of = F.struct("pos", "ord", "name")

    def code(names):
        hits = F.array_sort(F.collect_list(F.when(F.col("name").isin(names), name_of)))
        glued = F.array_join(hits["name"], "")
        return F.when(glued == "", F.lit(NO_CODE)).otherwise(glued)

    coded = used.groupBy("entry").agg(*[code(names).alias(m) for m, names in MACROS.items()])
    is_prefix = F.col("entry").endswith("*")
    return (
        last.select("entry")
        .join(coded, "entry", "left")
        .select(
            "entry",
            is_prefix.alias("is_prefix"),
            F.when(is_prefix, F.expr("left(entry, length(entry) - 1)")).otherwise(F.col("entry")).alias("stem"),
            *[F.coalesce(m, F.lit(NO_CODE)).alias(m) for m in MACROS],
        )
    )


def prepare_lexicon(rows: DataFrame) -> Lexicon:
    """Write the lexicon once; read off its size, stem lengths and constant form."""
    rows = staged(rows)
    stems = rows.where("is_prefix").groupBy(F.length("stem").alias("n")).count()
    lengths = tuple(sorted(r["n"] for r in stems.collect()))
    n_entries = rows.count()
    if n_entries > CONSTANT_ENTRIES:
        return Lexicon(rows, n_entries, lengths)
    slots = max(1, n_entries)
    item = F.struct(F.col("entry").alias("key"), F.struct(*MACROS).alias("value"))
    maps = rows.groupBy(_slot("entry", slots).alias("slot")).agg(
        F.to_json(F.map_from_entries(F.collect_list(item))).alias("json")
    )
    by_slot = {r["slot"]: r["json"] for r in maps.collect()}
    constant = "[" + ",".join(by_slot.get(i, "{}") for i in range(slots)) + "]"
    return Lexicon(rows, n_entries, lengths, constant, slots)


def _slot(key: Column | str, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def word_codes(word: Column, lexicon: Lexicon) -> Column:
    """Struct of the five codes of one word, null without a match.

    The dictionary is a folded constant: an array of small maps in which the hash
    of a key finds its map. Exact entry first, then stems from the longest.
    """
    kind = "array<map<string,struct<" + ",".join(f"{m}:string" for m in MACROS) + ">>>"
    table = F.from_json(F.lit(lexicon.constant), F.lit(kind))
    find = lambda key: F.try_element_at(F.get(table, _slot(key, lexicon.slots)), key)
    stems = [F.concat(F.substring(word, 1, n), F.lit("*")) for n in sorted(lexicon.stem_lengths, reverse=True)]
    return F.coalesce(find(word), *[find(s) for s in stems])


def match_words(
    words: DataFrame, lexicon: Lexicon, payload: dict[str, Column] | None = None, word: str = "word"
) -> DataFrame:
    """Add the payload of the entry that each row's word matches (null when none does).

    ``payload`` names expressions over lexicon rows, evaluated there and not per
    word; by default the entry and its five codes. An exact entry wins, else the
    longest stem that starts the word. There is one lookup per stem length, each
    an equi join with a part of the lexicon, so rows are never multiplied and the
    words are not shuffled.
    """
    payload = payload or {c: F.col(c) for c in ("entry", *MACROS)}
    value = F.struct(*[expr.alias(name) for name, expr in payload.items()]).alias("_hit")
    out, hits = words, []
    lookups = [("_exact", ~F.col("is_prefix"), F.col(word))]
    for n in sorted(lexicon.stem_lengths, reverse=True):
        lookups.append((f"_stem{n}", F.col("is_prefix") & (F.length("stem") == n), F.substring(word, 1, n)))
    for name, condition, key in lookups:
        part = small_side(lexicon.rows.where(condition), lexicon.n_entries, BROADCAST_ENTRIES)
        side = part.select(F.col("stem").alias("_stem"), value)
        out = out.join(side, key == F.col("_stem"), "left").withColumnRenamed("_hit", name).drop("_stem")
        hits.append(name)
    best = F.coalesce(*hits)
    return out.select(*words.columns, *[best[name].alias(name) for name in payload])


def encode(speech_tokens: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Replace ``tokens`` by one code array per macro-category, a code per token.

    A dictionary of usual size is looked up inside each row: no explode, no join
    and no shuffle. A larger one goes through ``encode_by_join``.
    """
    if lexicon.constant is None:
        return encode_by_join(speech_tokens, lexicon)
    others = [c for c in speech_tokens.columns if c != "tokens"]
    hits = F.transform("tokens", lambda w: word_codes(w, lexicon))
    rows = speech_tokens.select(*others, hits.alias("_hits"))
    return rows.select(*others, *[_codes(f"_hits.{m}").alias(m) for m in MACROS])


def _codes(found: str) -> Column:
    codes = F.transform(found, lambda c: F.coalesce(c, F.lit(NO_CODE)))
    return F.coalesce(codes, F.array().cast("array<string>"))


def encode_by_join(speech_tokens: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``encode`` for a dictionary of any size, through the word lookup join.

    The token arrays are moved once, partitioned by speech; explode, lookups and
    ordered collect then stay in their partition.
    """
    words = by_speech(speech_tokens.select("speech_id", "tokens"))
    words = words.select("speech_id", F.posexplode_outer("tokens").alias("pos", "word"))
    # A token without a match carries a null, not five codes.
    coded = match_words(words, lexicon, {"hit": F.struct(*MACROS)})
    cell = F.when(F.col("pos").isNotNull(), F.struct("pos", "hit"))
    rows = coded.groupBy("speech_id").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    codes = rows.select("speech_id", *[_codes(f"c.hit.{m}").alias(m) for m in MACROS])
    return speech_tokens.drop("tokens").join(codes, "speech_id")


TASK_WORDS = 500_000  # distinct words whose codes a task remembers
PIECE = 1 << 19  # tokens that are coded at once


def codes_of(lexicon: Lexicon) -> Callable[[str], tuple[str, ...]]:
    """The codes of one word in every macro-category, by the rule of ``word_codes``."""
    entries = {key: tuple(v[m] for m in MACROS) for slot in json.loads(lexicon.constant) for key, v in slot.items()}
    lengths, none = sorted(lexicon.stem_lengths, reverse=True), (NO_CODE,) * len(MACROS)

    def codes(word: str) -> tuple[str, ...]:
        if word in entries:
            return entries[word]
        for n in lengths:
            stem = word[:n] + "*"
            if stem in entries:
                return entries[stem]
        return none

    return codes


def encode_words(speech_tokens: DataFrame, lexicon: Lexicon, texts: dict[str, tuple[Callable[[str], str], str]]) -> DataFrame:
    """``encode``, and one text a row for every ``(rule, glue)`` of ``texts``: the rule's word for each token, joined.

    What a token becomes depends on the token alone, so a task works each distinct word out once
    and the tokens of a row are looked up. Nothing is shuffled.
    """
    codes = codes_of(lexicon)
    others = [f for f in speech_tokens.schema.fields if f.name != "tokens"]
    made = [T.StructField(name, T.StringType()) for name in texts] + [T.StructField(m, T.ArrayType(T.StringType())) for m in MACROS]
    names = [f.name for f in (*others, *made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, tuple] = {}
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("tokens")).fill_null(0).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                before = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, before + PIECE, "right")))
                part = batch.slice(a, b - a)
                edges = pa.array(np.concatenate(([0], ends[a:b] - before)).astype(np.int32))
                tokens = part.column("tokens")
                flat = tokens.flatten().dictionary_encode(null_encoding="encode")
                if len(known) > TASK_WORDS:
                    known.clear()
                words = flat.dictionary.to_pylist()
                for w in words:
                    if w not in known:
                        # A null token has no text and no entry.
                        known[w] = (*["" if w is None else rule(w) for rule, _ in texts.values()], *([NO_CODE] * len(MACROS) if w is None else codes(w)))
                columns = zip(*[known[w] for w in words]) if words else [()] * len(made)
                found = [pa.array(c, pa.string()).take(flat.indices) for c in columns]
                lists = [pa.ListArray.from_arrays(edges, f) for f in found]
                joined = [
                    pc.if_else(tokens.is_null(), pa.scalar(None, pa.string()), pc.binary_join(x, glue)) for x, (_, glue) in zip(lists, texts.values())
                ]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in others], *joined, *lists[len(texts) :]], names=names)
                a = b

    return speech_tokens.mapInArrow(run, T.StructType([*others, *made]))
