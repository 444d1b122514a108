"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two values, its minimum and its maximum, so
64 permutations fill a signature of 128 values. Bands of four of them (two permutations)
choose candidates; every link is confirmed on the full shingle sets. At the threshold of
0.8 a pair shares no band with a chance of (1 - 0.8^4)^32 = 4.7e-8.

Defined results: a null or wordless text has an empty set, is linked with nothing and is
kept. ``near_duplicates`` judges by ids: rows of one group that share its smallest id are all
kept, and a null ``doc_id`` counts as no id, kept only where its whole group has none.
``without_copies`` judges rows: of each group one row stays, that with the smallest id (null
last), then the smallest text hash; rows that share an id but are no copies stay. An empty table
gives an empty one. Other columns are ignored, or returned by ``without_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from penmark.llm.common import U64, mix, shingles, small_side, texts_in
from penmark.llm.graph import components
from penmark.session import staged

PERMUTATIONS, PER_BAND = 64, 2
_RANDOM = np.random.default_rng(7)
_A = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, U64) * U64(2) + U64(1)
_B = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, U64)


def min_max_bands(hashes: np.ndarray) -> np.ndarray:
    """The band keys of a set: minimum and maximum of each permutation, two permutations a band."""
    low = np.full(PERMUTATIONS, np.iinfo(U64).max, U64)
    high = np.zeros(PERMUTATIONS, U64)
    for i in range(0, len(hashes), 4096):
        ranks = _A[:, None] * hashes[None, i : i + 4096] + _B[:, None]
        low, high = np.minimum(low, ranks.min(axis=1)), np.maximum(high, ranks.max(axis=1))
    values = np.stack([low, high], axis=1).reshape(-1, 2 * PER_BAND)
    key = np.arange(len(values), dtype=U64)
    for column in values.T:
        key = mix(key * U64(31) + column)
    return key.view(np.int64)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that are equal for equal sets."""
    one = mix(hashes).sum(dtype=U64)
    two = mix(hashes ^ U64(0x5BD1E995CAFEF00D)).sum(dtype=U64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """One row a document: set size, fingerprint of the set, band keys, and a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for part, texts in texts_in(batches):
            size, one, two, bands = [], [], [], []
            for text in texts:
                found = shingles(text, words)
                f, g = fingerprint(found)
                size.append(len(found))
                one.append(f)
                two.append(g)
                bands.append(min_max_bands(found) if len(found) else np.zeros(0, np.int64))
            rows = pa.array(range(row, row + len(texts)), pa.int64())
            row += len(texts)
            offsets = pa.array(np.cumsum([0, *map(len, bands)]), pa.int32())
            keys = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands or [np.zeros(0, np.int64)])))
            of_row = [part.column(c) for c in ("doc_id", "h1", "h2")]
            columns = [rows, *of_row, pa.array(size, pa.int64()), pa.array(one), pa.array(two), keys]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "h1", "h2", "n", "f", "g", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text", *text_hashes()).mapInArrow(
        run, "row long, doc_id long, h1 long, h2 long, n long, f long, g long, bands array<long>"
    )


def text_hashes() -> list[Column]:
    """128 bits of a text, as ``h1`` and ``h2``; with the id they tell rows apart."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """Fingerprint and full set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches):
            for i in range(0, len(texts), 64):
                found = [shingles(text, words) for text in texts[i : i + 64]]
                prints = [fingerprint(x) for x in found]
                columns = [pa.array([p[0] for p in prints]), pa.array([p[1] for p in prints])]
                columns.append(pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["f", "g", "set"])

    return docs.select("text").mapInArrow(run, "f long, g long, set array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""

    def of(side: str, name: str) -> DataFrame:
        """The sets of the ids on one side only; ids are few where the other side is a hub or the pairs are few."""
        ids = small_side(staged(pairs.select(F.col(side).alias("cid")).distinct()), 16)
        return sets.join(ids, "cid", "left_semi").select(F.col("cid").alias(side), F.col("set").alias(name))

    left, right = of("a", "_x"), of("b", "_y")
    both = F.size(F.array_intersect("_x", "_y"))
    near = 100 * both >= percent * (F.size("_x") + F.size("_y") - both)
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row."""
    rows = grouped(docs, words, percent)
    group = F.when(F.col("comp").isNotNull(), F.col("low")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept")
    )


def without_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies; all columns."""
    rows = staged(grouped(docs, words, percent).where("comp IS NOT NULL").select("doc_id", "h1", "h2", "comp"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    first = rows.groupBy("comp").agg(F.min(key).alias("_first"))
    keys = rows.groupBy("comp", "doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("copies")).join(first, "comp")
    stays = F.col("_first") == key
    marked = keys.where(~stays | (F.col("copies") > 1)).select(
        F.col("doc_id").alias("_d"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), stays.alias("_stays")
    )
    marked = staged(marked)
    here = docs.select("*", *[h.alias(f"_{n}") for h, n in zip(text_hashes(), ("h1", "h2"))])
    same = lambda k: here["doc_id"].eqNullSafe(k["_d"]) & (here["_h1"] == k["_1"]) & (here["_h2"] == k["_2"])
    all_marked = small_side(marked, 32)
    rest = here.join(all_marked, same(all_marked), "left_anti").select(*docs.columns)
    again = marked.where("_stays")
    if again.isEmpty():
        return rest
    # Equal rows of an id and a text that stay: one of them.
    again = small_side(staged(again), 32)
    rows = here.join(again, same(again), "left_semi")
    one = rows.groupBy("doc_id", "_h1", "_h2").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return rest.union(one.select("_row.*"))


def grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Each row's ``doc_id, h1, h2, n``, its group ``comp`` (null without words) and the group's smallest id ``low``.

    Documents with equal sets are one class. Classes that share a band are compared in
    three turns, each leaving out pairs that are known to be connected: every class with
    the one of its bucket-mates that shares most bands with others; every class with that
    hub of each of its buckets; and the classes that are still apart by an exact prefix
    filter (see ``_apart``). So no link is lost, and a large group of near copies never
    gives all its pairs.
    """
    sigs = staged(signatures(docs, words))
    classes = sigs.where("n > 0").groupBy("f", "g", "n").agg(F.min("row").alias("cid"), F.min("doc_id").alias("lowest"))
    classes = staged(classes)
    bands = sigs.join(classes.select(F.col("cid").alias("row")), "row", "left_semi")
    bands = bands.select(F.col("row").alias("cid"), "n", F.explode("bands").alias("h"))
    shared = staged(bands.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    members = staged(bands.join(shared, "h").select("h", "cid", "n", "k"))
    popular = members.groupBy("cid").agg(F.sum("k").alias("pop"))
    members = staged(members.drop("k").join(popular, "cid"))
    hubs = members.groupBy("h").agg(F.max(F.struct("pop", (-F.col("cid")).alias("c"))).alias("hub"))
    members = staged(members.join(hubs, "h").select("h", "cid", "n", "hub"))
    labels = _linked(docs, sigs, members, words, percent)

    by_class = classes.join(labels.select(F.col("id").alias("cid"), "comp"), "cid", "left")
    by_class = by_class.withColumn("comp", F.coalesce("comp", "cid"))
    lowest = by_class.groupBy("comp").agg(F.min("lowest").alias("component_id"))
    by_class = by_class.join(lowest, "comp").select("f", "g", "n", F.col("component_id").alias("low"), "comp")
    return sigs.select("doc_id", "h1", "h2", "n", "f", "g").join(by_class, ["f", "g", "n"], "left")


def _apart(here: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of unconnected classes that can be similar enough, by prefix and position.

    Shingles are put in one order, rarest first. Of two similar sets the smaller has a
    common shingle among its first ``s - 2p/(1+p) s + 1``, the larger among its first
    ``s - p s + 1``, and at the first common one enough shingles must follow in both.
    Variants of one text differ in shingles that nobody else has, which come first and
    push the common ones behind these limits. A shingle counts only for classes that
    another component could meet there.
    """
    held = sets.join(here.select("cid", "comp").distinct(), "cid")
    tokens = held.select("cid", F.explode("set").alias("t"))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("k"))
    ordered = tokens.join(often, "t").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("o"))
    ordered = ordered.join(held.select("cid", "comp").distinct(), "cid")
    size = F.size("o").cast("long")
    longest = size - F.ceil(size * percent / 100) + 1
    rows = ordered.select("cid", "comp", size.alias("s"), F.posexplode(F.slice("o", F.lit(1), longest.cast("int"))).alias("i", "e"))
    # What may still follow, itself included, against the overlap two sizes need.
    rows = staged(rows.select("cid", "comp", "s", F.col("e.t").alias("t"), (F.col("s") - F.col("i")).alias("left")))
    enough = lambda left, x, y: left * (100 + percent) >= percent * (x + y)
    stored = rows.where(enough(F.col("left"), F.col("s"), F.col("s")))

    def met(side: DataFrame, other: DataFrame, smallest: Column) -> DataFrame:
        facts = other.groupBy("t").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y"), F.min("s").alias("_s"))
        able = enough(F.col("left"), F.col("s"), F.greatest(smallest, F.col("_s")))
        return side.join(facts, "t").where(able & ((F.col("_x") != F.col("comp")) | (F.col("_y") != F.col("comp")))).drop("_x", "_y", "_s")

    probing = met(rows, stored, F.ceil(F.col("s") * percent / 100))
    stored = met(stored, probing, F.col("s"))
    left = stored.select("t", *[F.col(c).alias(f"_{c}") for c in ("cid", "comp", "s", "left")])
    smaller = (F.col("_s") < F.col("s")) | ((F.col("_s") == F.col("s")) & (F.col("_cid") < F.col("cid")))
    fits = smaller & (F.col("_comp") != F.col("comp")) & (100 * F.col("_s") >= percent * F.col("s"))
    fits &= enough(F.least("_left", "left"), F.col("_s"), F.col("s"))
    return left.join(probing, "t").where(fits).select(F.col("cid").alias("a"), F.col("_cid").alias("b"))


def _linked(docs: DataFrame, sigs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """``(id, comp)`` of the classes that have a confirmed link."""
    wanted = sigs.select(F.col("row").alias("cid"), "doc_id", "f", "g").join(members.select("cid").distinct(), "cid", "left_semi")
    wanted = staged(wanted)
    ids = small_side(staged(wanted.select(F.col("doc_id").cast("long").alias("_id")).distinct()), 16)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    found = shingle_sets(texts, words).join(wanted.select("cid", "f", "g"), ["f", "g"])
    sets = staged(found.groupBy("f", "g", "cid").agg(F.any_value("set").alias("set")).select("cid", "set"))

    sizes = members.select(F.col("cid").alias("b"), F.col("n").alias("_m")).distinct()
    labels = members.select(F.col("cid").alias("id"), F.col("cid").alias("comp")).where(F.lit(False))
    tested = None
    for turn in ("hub", "hubs", "rest"):
        known = labels.select(F.col("id").alias("cid"), "comp")
        here = members.join(known, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        if turn == "hub":
            best = members.groupBy("cid", "n").agg(F.max("hub").alias("hub")).select("cid", "n", (-F.col("hub.c")).alias("b"))
            pairs = best.where("cid <> b").withColumnRenamed("cid", "a")
        else:
            mixed = here.groupBy("h").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x <> _y")
            here = staged(here.join(mixed.select("h"), "h", "left_semi").withColumn("b", -F.col("hub.c")))
            if turn == "hubs":
                ends = here.where("cid = b").select("h", F.col("comp").alias("_to"))
                pairs = here.join(ends, "h").where("comp <> _to").select(F.col("cid").alias("a"), "n", "b").distinct()
            else:
                pairs = _apart(here, sets, percent)
        if turn != "rest":
            pairs = pairs.join(sizes, "b").where(f"100 * least(n, _m) >= {percent} * greatest(n, _m)")
        # ``b`` stays the hub; a pair is told by its larger and smaller id.
        pairs = pairs.select("a", "b", F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["hi", "lo"], "left_anti")
        pairs = staged(pairs)
        if pairs.isEmpty():
            continue
        done = pairs.select("hi", "lo")
        tested = done if tested is None else tested.union(done)
        links = staged(_confirmed(pairs, sets, percent))
        # New links join components: contract them, then move the labels.
        one = labels.select(F.col("id").alias("a"), F.col("comp").alias("_a"))
        two = labels.select(F.col("id").alias("b"), F.col("comp").alias("_b"))
        joined = links.join(one, "a", "left").join(two, "b", "left")
        moves = components(joined.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
        fresh = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        known = labels.join(fresh, "id", "full").select("id", F.coalesce("comp", "id").alias("comp"))
        moves = moves.select(F.col("id").alias("comp"), F.col("comp").alias("_to"))
        labels = staged(known.join(moves, "comp", "left").select("id", F.coalesce("_to", "comp").alias("comp")))
    return labels
