"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

Postings ``(term, document, position)`` are stored for the terms that anchor a test
phrase: in each window of an item the rarest term by corpus count. Lists are adjusted by
the term's offset in the item, so that all postings of one occurrence meet at the same
alignment; an alignment's words are then compared one by one.

Defined results: a null text has no words and is never contaminated; an item without
words is ignored; repeated items and rows count as themselves; rows that share ``doc_id``
and text share their result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from penmark.llm.common import small_side
from penmark.session import staged

WINDOW = 13
ROW_ALIGNMENTS = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # the text is in lower case by then


def words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case; none for null."""
    # lower() is the cheaper form where it changes the same letters.
    folded = F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    # Only the first and last part can be empty.
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), NOT_WORD), "")


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents by id and text hash, so that equal ids with other texts stay apart."""
    return docs.select("doc_id", text_hash().alias("_th"), "text")


def text_hash() -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))


def _same_doc(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["_d"]) & (left["_th"] == right["_t"])


def benchmark_items(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct items: id, words, and the length of their windows."""
    items = benchmark.select("item_id", words(F.col("text")).alias("terms")).where(F.size("terms") > 0).distinct()
    return items.withColumn("w", F.least(F.size("terms"), F.lit(window)))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, doc_id, _th, pos`` of every occurrence of the given terms in whole texts."""
    tokens = _keyed(docs).select("doc_id", "_th", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return tokens.join(terms.select("term").distinct(), "term")


def anchors(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``term, item_id, offset, len``: in each window the term that is rarest in the corpus."""
    spread = items.select("item_id", "terms", "w", F.posexplode("terms").alias("offset", "term"))
    vocabulary = staged(spread.select("term").distinct())
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    counts = tokens.join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    starts = items.select("item_id", "terms", "w", F.explode(F.sequence(F.lit(0), F.size("terms") - F.col("w"))).alias("at"))
    inside = starts.select("item_id", F.size("terms").alias("len"), "at", F.posexplode(F.slice("terms", F.col("at") + 1, F.col("w"))).alias("p", "term"))
    inside = inside.join(counts, "term", "left").withColumn("offset", F.col("at") + F.col("p"))
    rarest = inside.groupBy("item_id", "len", "at").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")).alias("r"))
    # A window with a term that occurs nowhere cannot occur.
    return rarest.where("r.n > 0").select(F.col("r.term").alias("term"), "item_id", F.col("r.offset").alias("offset"), "len").distinct()


def alignments(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``doc_id, _th, item_id, at, len`` where the adjusted list of an anchor places an item in a document."""
    met = postings(docs, chosen).join(chosen, "term")
    return met.select("doc_id", "_th", "item_id", (F.col("pos") - F.col("offset")).alias("at"), "len").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, _th, item_id, spans``: the windows of an item that occur, as word spans ``{a, b}`` of the document."""
    chosen = staged(anchors(docs, items))
    found = staged(alignments(docs, chosen))
    # A document with a frequent anchor has many alignments: they go through its text some hundred at a time.
    counts = found.groupBy("doc_id", "_th").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROW_ALIGNMENTS)).alias("_rows"))
    counts = counts.select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), "_rows")
    part = F.pmod(F.xxhash64("item_id", "at"), F.col("_rows")).alias("_part")
    asked = found.join(counts, _same_doc(found, counts)).groupBy("doc_id", "_th", part).agg(
        F.collect_list(F.struct("item_id", "at", "len")).alias("asked")
    )
    asked = asked.select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), "asked")
    keyed = _keyed(docs)
    near = keyed.join(asked, _same_doc(keyed, asked)).select("doc_id", "_th", words(F.col("text")).alias("doc"), "asked")
    # An item may stand out at either end of the document; only the words inside are cut.
    piece = lambda a: F.struct(
        a["item_id"].alias("item_id"), a["at"].alias("at"),
        F.slice("doc", F.greatest(a["at"], F.lit(0)) + 1, F.least(a["len"], a["len"] + a["at"])).alias("here"),
    )
    cut = near.select("doc_id", "_th", F.explode(F.transform("asked", piece)).alias("a")).select("doc_id", "_th", "a.*")
    cut = cut.join(items, "item_id")
    skipped = F.greatest(-F.col("at"), F.lit(0))
    theirs = F.slice("terms", skipped + 1, F.size("here"))
    same = F.zip_with("here", theirs, lambda x, y: x == y)
    marked = cut.select("doc_id", "_th", "item_id", F.greatest("at", F.lit(0)).alias("from"), "w", same.alias("same"))
    # Runs of equal words: a run of at least w words is a chain of windows. Most alignments have none, and go
    # after one pass over their words; a condition on the runs themselves would be worked out anew for each run.
    marked = marked.where(longest_run(F.col("same")) >= F.col("w"))
    broken = F.filter(F.transform("same", lambda x, i: F.when(x, -1).otherwise(i)), lambda i: i >= 0)
    marked = marked.withColumn("cuts", F.concat(F.array(F.lit(-1)), broken, F.array(F.size("same"))))
    lengths = F.transform("cuts", lambda c, i: F.struct((c + 1).alias("a"), F.get("cuts", i + 1).alias("b")))
    runs = F.filter(lengths, lambda r: r["b"] - r["a"] >= F.col("w"))
    spans = F.transform(runs, lambda r: F.struct((r["a"] + F.col("from")).alias("a"), (r["b"] + F.col("from")).alias("b")))
    return marked.select("doc_id", "_th", "item_id", spans.alias("spans"))


def longest_run(same: Column) -> Column:
    """The length of the longest run of true values."""

    def step(acc: Column, x: Column) -> Column:
        n = F.when(x, acc["n"] + 1).otherwise(0)
        return F.struct(n.alias("n"), F.greatest(acc["m"], n).alias("m"))

    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(0).alias("m")), step, lambda acc: acc["m"])


def covered(spans: Column) -> Column:
    """Words in the union of the spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["end"], s["b"]).alias("end"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    return _judged(docs, benchmark, window).drop("_th")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows, told by id and text; all columns."""
    gone = _judged(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t")).distinct()
    gone = small_side(staged(gone), 40)
    here = docs.withColumn("_th", text_hash())
    return here.join(gone, _same_doc(here, gone), "left_anti").select(*docs.columns)


def _judged(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    items = staged(benchmark_items(benchmark, window))
    found = phrase_matches(docs, items)
    hits = found.groupBy("doc_id", "_th").agg(
        covered(F.flatten(F.collect_list("spans"))).alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    hits = hits.select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), "n_hit", "items")
    sizes = docs.select("doc_id", text_hash().alias("_th"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    rows = sizes.join(hits, _same_doc(sizes, hits), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "_th", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, phrases: DataFrame, slop: int, share: float = 1.0) -> DataFrame:
    """``doc_id, item_id, pos, n_terms``: looser matches of short phrases ``(item_id, text)``.

    From each posting of a phrase's rarest term, the adjusted lists of its other terms are
    met within ``slop`` words; a match holds at least ``share`` of the phrase's places.
    """
    items = phrases.select("item_id", words(F.col("text")).alias("terms")).where(F.size("terms") > 0).distinct()
    lists = staged(items.select("item_id", F.size("terms").alias("len"), F.posexplode("terms").alias("offset", "term")))
    held = staged(postings(docs, lists))
    counts = held.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = lists.join(counts, "term").groupBy("item_id").agg(F.min(F.struct("n", "offset", "term")).alias("r"))
    rarest = rarest.select("item_id", F.col("r.term").alias("term"), F.col("r.offset").alias("_o"))
    begun = held.join(rarest, "term").select("doc_id", "_th", "item_id", (F.col("pos") - F.col("_o")).alias("start"))
    placed = held.join(lists, "term").select(
        F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), F.col("item_id").alias("_i"), "len", "offset",
        (F.col("pos") - F.col("offset")).alias("at"),
    )
    # Alignments are met by cells of slop + 1 places, so only near postings come together.
    cell = lambda x: F.floor(x / F.lit(slop + 1))
    begun = begun.withColumn("_c", F.explode(F.array(*[cell(F.col("start")) + d for d in (-1, 0, 1)])))
    placed = placed.withColumn("_cell", cell(F.col("at")))
    on = _same_doc(begun, placed) & (begun["item_id"] == placed["_i"]) & (begun["_c"] == placed["_cell"])
    met = begun.join(placed, on).where(F.abs(F.col("at") - F.col("start")) <= slop)
    found = met.groupBy("doc_id", "item_id", F.col("start").alias("pos"), "len").agg(F.count_distinct("offset").alias("n_terms"))
    return found.where(F.col("n_terms") >= F.ceil(F.col("len") * F.lit(share))).drop("len")
