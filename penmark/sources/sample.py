"""Views over the given tables that stand for a parliamentary corpus.

The expressions are mirrored in ``penmark.plans.oracle``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from penmark.functions import text as tx
from penmark.operators.lexicon import CDI, COG, FEELS, GRAM, OBJ, Lexicon, build_lexicon, prepare_lexicon
from penmark.session import spread

PARTIES = ["PSOE", "UP", "PP", "Vox", "EAJ-PNV", "Cs", "Mixto"]

# A small lexicon of our own over the function words and stems of the texts.
LEXICON_WORDS: list[tuple[str, list[str]]] = [
    ("el", ["Articulo"]), ("la", ["Articulo"]), ("los", ["Articulo"]), ("las", ["Articulo"]),
    ("un", ["Articulo"]), ("una", ["Articulo"]), ("the", ["Articulo"]), ("a", ["Articulo"]),
    ("le", ["Articulo"]), ("les", ["Articulo"]), ("des", ["Articulo"]), ("der", ["Articulo"]),
    ("die", ["Articulo"]), ("das", ["Articulo"]),
    ("de", ["Prepos", "Relativ"]), ("en", ["Prepos", "Espacio"]), ("con", ["Prepos", "Incl"]),
    ("of", ["Prepos"]), ("in", ["Prepos", "Espacio", "Incl"]), ("to", ["Prepos", "Movim"]),
    ("for", ["Prepos", "Causa"]), ("pour", ["Prepos", "Causa"]), ("mit", ["Prepos", "Incl"]),
    ("yo", ["Yo", "PronPer"]), ("me", ["PronPer", "Yo"]), ("je", ["Yo", "PronPer"]),
    ("nosotros", ["Nosotro", "PronPer"]), ("er", ["ElElla", "PronPer", "Yo"]), ("on", ["Nosotro", "Espacio"]),
    ("su", ["TuUtd", "PronPer"]), ("sich", ["VosUtds", "PronPer", "formal"]), ("you", ["TuUtd", "PronPer"]),
    ("as", ["Conjunc", "Adverb"]), ("au", ["Prepos", "VosUtds"]), ("with", ["Prepos", "TuUtd"]),
    ("it", ["ElElla", "PronImp"]), ("this", ["PronImp"]), ("that", ["PronImp", "Relativ"]),
    ("que", ["Conjunc", "PronImp"]), ("qui", ["PronImp"]), ("elle", ["ElElla", "PronPer"]),
    ("they", ["Ellos", "PronPer", "Humanos"]),
    ("is", ["VerbAux", "Present"]), ("was", ["VerbAux", "Pasado"]), ("be", ["VerbAux"]),
    ("ist", ["VerbAux", "Present"]), ("es", ["VerbAux", "Present"]), ("have", ["VerbAux", "Present"]),
    ("and", ["Conjunc", "Incl"]), ("y", ["Conjunc", "Incl"]), ("et", ["Conjunc"]), ("und", ["Conjunc"]),
    ("as", ["Conjunc", "Adverb"]), ("or", ["Conjunc", "Tentat", "Excl"]),
    ("not", ["Negacio", "Discrep"]), ("no", ["Negacio"]), ("nicht", ["Negacio", "Adverb"]),
    ("mas", ["Adverb", "Cuantif"]), ("ti*", ["Tiempo", "Cuantif"]), ("tion*", ["EmoPos", "Logro", "Afect"]),
    ("th*", ["Social", "Percept"]), ("thin*", ["Insight", "MecCog", "EmoNeg"]), ("an*", ["Numeros", "Certeza"]),
    ("ant*", ["EmoNeg", "Inhib", "Enfado"]), ("re*", ["Trabajo", "Relativ"]), ("real*", ["EmoPos", "Dinero"]),
    ("éo*", ["EmoPos", "Ver", "Cuerpo"]), ("éon*", ["EmoNeg", "Oir", "Ansiedad"]), ("ou*", ["Sentir", "Familia"]),
    ("ge*", ["Movim", "Hogar", "Pasado"]), ("ver*", ["Salud", "Biolog", "Futuro"]), ("ci*", ["EmoPos", "Relig"]),
    ("ar*", ["EmoNeg", "Triste", "Muerte"]), ("en*", ["Amigos", "Placer", "verbosEL"]),
    ("ent*", ["Maldec", "Sexual", "Subjuntiv"]), ("st*", ["Asentir", "NoFluen", "verbYO"]),
    ("sch*", ["Relleno", "Ingerir", "informal"]), ("ha*", ["verbTU", "verbNOS"]), ("o*", ["verbVos", "verbELLOS"]),
    ("el", ["Articulo", "ElElla"]),  # repeated entry: this line counts
]


def lexicon_categories() -> list[tuple[str, str]]:
    """Numbered category names; a name in two macro-categories has one number."""
    names = list(dict.fromkeys(GRAM + OBJ + COG + FEELS + CDI))
    return [(str(100 + i), name) for i, name in enumerate(names)]


def dic_text() -> str:
    """The lexicon as the text of a ``.dic`` file."""
    number = {name: n for n, name in lexicon_categories()}
    head = [f"{n}\t{name}" for n, name in lexicon_categories()]
    body = ["\t".join([entry, *[number[c] for c in cats]]) for entry, cats in LEXICON_WORDS]
    return "\n".join(["%", *head, "%", *body]) + "\n"


def _arrow(spark: SparkSession, columns: dict) -> DataFrame:
    return spark.createDataFrame(pa.table(columns))


def lexicon_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``(categories, words)`` in the form ``read_dic`` gives."""
    cats = lexicon_categories()
    number = {name: n for n, name in cats}
    categories = _arrow(
        spark, {"number": [c[0] for c in cats], "name": [c[1] for c in cats], "ord": list(range(len(cats)))}
    )
    words = _arrow(
        spark,
        {
            "entry": [w for w, _ in LEXICON_WORDS],
            "line_no": list(range(len(LEXICON_WORDS))),
            "numbers": [[number[c] for c in cs] for _, cs in LEXICON_WORDS],
        },
    )
    return categories, words


_prepared: dict[str, Lexicon] = {}


def lexicon(spark: SparkSession) -> Lexicon:
    """The built lexicon, written once per application."""
    key = spark.sparkContext.applicationId
    if key not in _prepared:
        _prepared[key] = prepare_lexicon(build_lexicon(*lexicon_tables(spark)))
    return _prepared[key]


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech rows derived from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = spread(docs.withColumnRenamed("doc_id", "speech_id"), "speech_id")
    k = F.expr("cast(substr(source, 4) as int)")
    doc = F.col("speech_id")
    party = F.element_at(F.lit(PARTIES), k % 7 + 1)
    flipped = (k + F.when(doc % 29 == 0, 1).otherwise(0)) % 2
    return docs.select(
        "speech_id",
        F.col("source").alias("speaker"),
        party.alias("party"),
        F.when(doc % 17 == 0, "Chairperson").when(doc % 17 == 1, None).otherwise("Regular").alias("role"),
        F.when(flipped == 0, "F").otherwise("M").alias("gender"),
        (1940 + (k * 7) % 45).cast("int").alias("birth"),
        F.when(doc % 3 == 0, "Opposition").otherwise("Coalition").alias("party_status"),
        F.when(doc % 97 == 3, None).otherwise(F.col("text")).alias("text"),
    )


# The words and endings of each tag, in the order they are tried.
TAG_WORDS = {
    "DET": ["el", "la", "los", "las", "un", "una", "the", "a", "le", "les", "des", "der", "die", "das"],
    "ADP": ["de", "en", "con", "of", "in", "to", "for", "pour", "mit", "por", "von"],
    "PRON": ["yo", "me", "je", "nous", "tu", "vous", "you", "it", "they", "elle", "qui"],
    "CCONJ": ["and", "y", "et", "und", "or", "que"],
    "AUX": ["is", "was", "be", "ist", "es", "have"],
    "ADV": ["not", "no", "nicht", "as", "mas"],
}
TAG_PATTERNS = {"NUM": "[0-9]", "VERB": "(ing|ed|er|ar|ir|en|ez)$", "ADJ": "(able|ble|al|if|ivo|iva|lich|ly|oso|eux)$"}


def upos(token: Column) -> Column:
    """Stand-in for annotated part-of-speech tags, from word lists and suffixes."""
    tries = [(token.isin(*words), tag) for tag, words in TAG_WORDS.items()]
    tries += [(token.rlike(pattern), tag) for tag, pattern in TAG_PATTERNS.items()]
    out = F.when(*tries[0])
    for condition, tag in tries[1:]:
        out = out.when(condition, tag)
    return out.when(F.length(token) == 1, "X").otherwise("NOUN")


_TAG_OF = {word: tag for tag, words in TAG_WORDS.items() for word in words}
_TRIED = [(tag, re.compile(pattern).search) for tag, pattern in TAG_PATTERNS.items()]


def upos_of(token: str) -> str:
    """``upos`` of one token, for steps that see each distinct token once."""
    if token in _TAG_OF:
        return _TAG_OF[token]
    for tag, fits in _TRIED:
        if fits(token):
            return tag
    return "X" if len(token) == 1 else "NOUN"


def with_tokens(speeches: DataFrame) -> DataFrame:
    return speeches.withColumn("tokens", tx.tokens("text"))


def with_tags(speech_tokens: DataFrame) -> DataFrame:
    return speech_tokens.withColumn("pos_tags", F.array_join(F.transform("tokens", upos), " "))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of utterances, from the turns of ``conversations``."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    conv_id, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    sent_id = F.concat(F.lit("C"), conv_id, F.lit(".u"), conv_id, F.lit(".s"), turn)
    return conv.select(sent_id.alias("sent_id"), F.col("turn").alias("sent_pos"), "text").withColumn(
        "utterance_id", tx.utterance_id("sent_id")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rule-made methods that predict both labels of the labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "speech_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("speech_id"), F.col("source").alias("speaker"), "n_chars"
    )
    by_length = (F.col("n_chars") > 1000).cast("int")
    by_rule = (F.col("speech_id") % 5 != 0).cast("int")
    by_label = F.when(F.col("speech_id") % 11 == 0, 1 - F.col("truth")).otherwise(F.col("truth"))
    truth = labels.unpivot(["speech_id"], ["quality", "toxic"], "task_label", "truth")
    rows = truth.join(docs, "speech_id")
    methods = F.explode(
        F.create_map(F.lit("LENGTH"), by_length, F.lit("RULE"), by_rule, F.lit("ORACLE11"), by_label)
    ).alias("method", "y_pred")
    return rows.select(
        F.lit("demo").alias("run"), "task_label", "speech_id", "speaker",
        F.col("truth").cast("string").alias("y_true"), methods,
    ).withColumn("y_pred", F.col("y_pred").cast("string"))
