"""Line dedup against a brute-force reading of its rule."""

import random

import pytest
from pyspark.sql import functions as F

from penmark.llm import lines


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.choice("ids")
        if kind == "i":
            chars.insert(at, rng.choice("abé漢"))
        elif kind == "d":
            del chars[at]
        else:
            chars[at] = rng.choice("abé漢")
    return "".join(chars)


def _expected(docs, edits, min_chars):
    all_lines = []
    for doc, text in {(d, t) for d, t in docs if t is not None}:
        for pos, line in enumerate(text.split("\n")):
            if len(line.strip(" ")) >= min_chars:
                all_lines.append((-1 if doc is None else doc, pos, line))
    exact, near = set(), set()
    for a in all_lines:
        for b in all_lines:
            if b[:2] < a[:2] and abs(len(a[2]) - len(b[2])) <= edits:
                if a[2] == b[2]:
                    exact.add(a[:2])
                elif _distance(a[2], b[2]) <= edits:
                    near.add(a[:2])
    return exact, near - exact


@pytest.mark.parametrize("edits, pairs", [(1, 1024), (1, 4), (2, 9)])
def test_dedup_equals_brute_force(spark, monkeypatch, edits, pairs):
    monkeypatch.setattr(lines, "GROUP_PAIRS", pairs)  # small: groups grow their keys
    rng = random.Random(3)
    base = ["the quick brown fox jumps over it", "another line that is long enough", "seven times seven is forty-nine ok"]
    pick = lambda: rng.choice([_edited(rng, rng.choice(base), rng.randint(0, 3)), "short", ""])
    docs = [(d, "\n".join(pick() for _ in range(rng.randint(0, 6)))) for d in range(50)]
    docs += [(None, base[0] + "\n" + base[0]), (500, None), (501, ""), docs[5], (502, "x" * 5000), (503, "x" * 5000 + "y")]
    exact, near = _expected(docs, edits, 20)
    text = {(d, t): t for d, t in docs}
    frame = spark.createDataFrame([(d, t, 9) for d, t in docs], "doc_id long, text string, n_near int")
    got = lines.dedup_lines(frame, edits, 20).collect()
    assert len(got) == len(docs)
    left = {}
    for doc, whole in text:
        place = -1 if doc is None else doc
        parts = [] if whole is None else whole.split("\n")
        kept = [p for i, p in enumerate(parts) if (place, i) not in exact | near]
        counts = (len(parts), sum((place, i) in exact for i in range(len(parts))), sum((place, i) in near for i in range(len(parts))))
        left[doc] = (None if whole is None else "\n".join(kept), *counts)
    assert {(r.doc_id, r.text, r.n_lines, r.n_exact, r.n_near) for r in got} == {(d, *v) for d, v in left.items()}


def test_automaton_equals_edit_distance(spark):
    rng = random.Random(4)
    words = ["", "a", "ab", "ba", "aé", "a漢b"] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 8))) for _ in range(30)]
    frame = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for edits in (1, 2, 3):
        assert frame.where(lines.within(F.col("a"), F.col("b"), edits) != (F.levenshtein("a", "b") <= edits)).count() == 0


def test_empty_table_and_small_minimum(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string"), 2, 5)


def test_crowded_keys_of_two_lengths(spark):
    """Above the production cap, lines one character longer are linked to the stored ones of their key."""
    text, rng = "Part number in stock: {}b (see list)", random.Random(5)
    codes = [p + q for p in "cdefghijklmn" for q in "CDEFGHIJKLMN"]
    longer = [p + x + q for p in "cdefghijklmn" for x in "opqrstuvwxyz" for q in "CDEFGHIJKLMN"]
    rng.shuffle(longer)  # only without its middle is one of them a code
    frame = spark.createDataFrame([(d, text.format(c)) for d, c in enumerate(codes + longer)], "doc_id long, text string")
    assert [r.doc_id for r in lines.dedup_lines(frame, 1, 20).where("n_near = 0").collect()] == [0]


def test_slots_of_two_edits(spark, monkeypatch):
    """The same with two edits and every key above the cap, against brute force."""
    monkeypatch.setattr(lines, "GROUP_PAIRS", 0)
    rng = random.Random(6)
    code = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))
    docs = [(d, "a line with a code: " + code() + " and " + code()) for d in range(150)]
    exact, near = _expected(docs, 2, 20)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = lines.dedup_lines(frame, 2, 20).collect()
    assert {(r.doc_id, 0) for r in got if r.n_near} == near and {(r.doc_id, 0) for r in got if r.n_exact} == exact


def test_lines_within_reach_share_a_rough_key(spark):
    """Around the borders of the length classes too, with edits anywhere."""
    rng = random.Random(7)
    pairs = []
    for size in [*range(20, 36), *range(60, 84), 200]:
        for edits in (1, 2, 2, 2):
            text = "".join(rng.choice("abc é") for _ in range(size))
            pairs.append((edits, text, _edited(rng, text, edits)))
    frame = spark.createDataFrame(pairs, "edits int, x string, y string")
    for edits in (1, 2, 3):
        sides = []
        for c in "xy":
            cut = frame.where(F.col("edits") <= edits).select("x", "y", F.col(c).alias("line"), F.length(c).alias("size"))
            sides.append(cut.select("x", "y", lines._rough_keys(edits).alias(f"k{c}")))
        assert sides[0].join(sides[1], ["x", "y"]).where(~F.arrays_overlap("kx", "ky")).count() == 0
    marks = frame.select("edits", F.bit_count(lines._marks("x").bitwiseXOR(lines._marks("y"))).alias("n"))
    assert marks.where("n > 2 * edits").count() == 0


def test_crowd_of_near_copies_makes_few_rows(spark, monkeypatch):
    """Lines that differ from one by a word each stay apart, and their keys do not grow with the square of the crowd."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base, texts = [word() for _ in range(60)], []
    codes = [x * 3 + y * 3 + z * 3 for x in "abcdefghi" for y in "jklmnopq" for z in "rstuvwx"]  # three edits apart
    for code in rng.sample(codes, 500):
        at = rng.randrange(60)
        texts.append(" ".join([*base[:at], code, *base[at + 1 :]]))
    texts.append(texts[0][:30] + "#" + texts[0][31:])
    frame, made, write = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], lines.staged
    monkeypatch.setattr(lines, "staged", lambda df: made.append(write(df)) or made[-1])
    got = lines.dedup_lines(frame, 2, 20).where("n_near > 0").collect()
    assert [r.doc_id for r in got] == [500]
    keys = [m.count() for m in made if "key" in m.columns]
    assert max(keys) <= 25 * len(texts)
