"""Near duplicates against all pairs."""

import random
import re

import pytest

from penmark.llm import minmax
from penmark.llm.common import shingles, word_hashes
from penmark.llm.graph import components


def _set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _groups(docs, n):
    sets, up = {d: _set(t, n) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if b < a and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}, sets


def test_components_equal_all_pairs(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for d in range(120):
        words = list(base if d % 3 else reversed(base))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(80)] = f"new{rng.random()}"
        docs.append((d, " ".join(words[: rng.choice([80, 80, 70, 40])])))
    docs += [(300, ""), (301, None), (302, " \t\n"), (303, "one two"), (304, "One  TWO"), (305, "É é"), (306, "é é"), (307, "x" * 50_000)]
    groups, sets = _groups(docs, 4)
    frame = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, kept int")
    got = minmax.near_duplicates(frame, words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        d: (len(sets[d]), groups[d], groups[d] == d) for d, _ in docs
    }


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (7, text), (7, text), (9, text), (None, "other words that nobody has here")]
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("7", "7", True), ("7", "7", True), ("9", "7", False), ("None", "7", False), ("None", "None", True),
    ]
    assert minmax.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_words_and_pieces_hash_alike():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(300_000)]
    whole = word_hashes(" ".join(words))
    assert len(whole) == len(words)
    assert [whole[i] for i in (0, 150_000, 299_999)] == [word_hashes(words[i])[0] for i in (0, 150_000, 299_999)]
    assert len(word_hashes("x" * 3_000_000 + " y")) == 2
    assert len(shingles("a b a b a b", 2)) == 2


@pytest.mark.parametrize("links", [[], [(2, 1), (3, 2), (4, 3), (9, 8)], [(i + 1, i) for i in range(40)]])
def test_components_of_chains(spark, links):
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    ids = {x for pair in links for x in pair}
    up = {x: min(y for y in ids if all((k + 1, k) in links or (k, k + 1) in links for k in range(y, x))) for x in ids} if len(links) > 4 else {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} if links else {}
    assert {r.id: r.comp for r in got} == up
