"""Exact phrases, word spans and proximity on small cases."""

import hashlib
import random
import re

from penmark.llm import decontaminate


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _expected(docs, items, window=13):
    out = []
    for doc, text in docs:
        words, hit, found = _words(text), set(), set()
        for item, passage in items:
            theirs = _words(passage)
            w = min(window, len(theirs))
            runs = {tuple(theirs[i : i + w]) for i in range(len(theirs) - w + 1)} if theirs else set()
            for i in range(len(words) - w + 1) if theirs else ():
                if tuple(words[i : i + w]) in runs:
                    hit |= set(range(i, i + w))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(12)] + ["É", "é", "漢字"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 13, 20, 30])))) for i in range(14)]
    items += [(90, None), (91, "..."), (92, items[3][1]), (3, items[3][1])]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(3)]
        if d % 2:
            words = items[rng.randrange(14)][1].upper().split()
            cut = rng.randint(0, 3)
            parts.insert(rng.randrange(4), "--" + ", ".join(words[cut : len(words) - rng.randint(0, 3)]))
        docs.append((d, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, items[4][1]), (102, "x y"), (None, items[5][1]), docs[1]]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_hit int")
    got = decontaminate.contamination(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, _expected(docs, items)))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontaminate.contamination(docs, items.limit(0)).first().n_hit == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red then blue fox runs"), (2, "red x x x x x x x fox"), (3, "blue red fox")], "doc_id long, text string")
    phrase = spark.createDataFrame([(5, "red blue fox")], "item_id long, text string")
    got = decontaminate.proximity_matches(docs, phrase, slop=1).collect()
    assert {(r.doc_id, r.n_terms) for r in got} == {(1, 3)}
    loose = decontaminate.proximity_matches(docs, phrase, slop=2).collect()
    assert {r.doc_id for r in loose} == {1, 3}


def test_runs_are_found_in_one_pass_before_they_are_cut(spark):
    """Runs are cut for alignments that have a long one only: no join condition works them out."""
    from pyspark.sql import functions as F

    same = [[], [True], [False, True, True, None, True], [True] * 4 + [False], [None, False]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(same)], "i int, same array<boolean>")
    got = rows.select("i", decontaminate.longest_run(F.col("same")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [0, 1, 2, 4, 0]
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o")], "doc_id long, text string")
    items = decontaminate.benchmark_items(spark.createDataFrame([(1, "b c d e f g h i j k l m n")], "item_id long, text string"))
    found = decontaminate.phrase_matches(docs, items)
    assert [(s.a, s.b) for r in found.collect() for s in r.spans] == [(1, 14)]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and not any("filter(" in line for line in joins)
