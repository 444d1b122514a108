"""Fill-in-middle: skip lists against running sums, the transformation against a plain one, round trips."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.llm import fim

SCHEMA = "doc_id long, text string, n int, form string, output string"


def plain(text, doc_id):
    """The contract, word by word."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return len(lines), "plain", None, None, text
    p, m, s = ("".join(part) for part in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_skip_list_reaches_every_rank():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 4, 5, 17, 64, 500, 3000]:
        lengths = [rng.randint(0, 9) for _ in range(n)]
        lanes = fim.SkipList(np.array(lengths, np.int64))
        assert [lanes.offset(k) for k in range(n + 1)] == [0, *itertools.accumulate(lengths)]
        with pytest.raises(IndexError):
            lanes.offset(n + 1)
    assert len(lanes.lanes) > 3 and all(len(a[0]) > len(b[0]) for a, b in zip(lanes.lanes, lanes.lanes[1:]))
    assert all(int(units.sum()) == n and int(chars.sum()) == sum(lengths) for units, chars, _ in lanes.lanes)


def test_a_rank_takes_few_steps():
    lanes = fim.SkipList(np.ones(200_000, np.int64))
    visited = 0

    class Counted(np.ndarray):
        def __getitem__(self, i):
            nonlocal visited
            visited += 1
            return super().__getitem__(i)

    lanes.lanes = [(u.view(Counted), c, b) for u, c, b in lanes.lanes]
    assert lanes.offset(123_457) == 123_457 and visited < 200


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_units_tile_the_text(unit):
    for text in ["", "\n", "a", "a\n", "\n\na b \r\n é漢\U0001f600 \n", " x", "x  y\t\n "]:
        parts = re.findall(fim.UNITS[unit], text)
        assert "".join(parts) == text and fim.unit_lengths(text, unit).tolist() == [len(p) for p in parts]


def test_against_the_plain_rule(spark):
    rng = random.Random(5)
    bits = ["a", "é漢", "\n", "\n", "\r\n", "word ", "<", "<P", "S>", ">M", "\U0001f600"]
    rows = [(d, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))), 1, "x", "y") for d in range(400)]
    rows += [(1000, None, 1, "x", "y"), (1001, "", 1, "x", "y"), (None, "a\nb\nc", 1, "x", "y"), (1002, "a <S> b", 1, "x", "y")]
    rows += [(1003, "same\nrow\n", 1, "x", "y")] * 3 + [(-5, "no line end", 1, "x", "y"), (1004, "long é\n" * 300_000, 1, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("prefix_chars", F.lit("clash"))
    got = fim.restored(fim.fill_in_middle(docs)).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = [(d, *plain(t, d), t or "") for d, t, *_ in rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_other_units_and_marks(spark):
    assert fim.restored(fim.fill_in_middle(spark.createDataFrame([], SCHEMA))).collect() == []
    docs = spark.createDataFrame([(d, f"one two é{d} <P> four\nfive", 0, "", "") for d in range(40)], SCHEMA)
    for unit in ("word", "char"):
        how = fim.Template("[pre]", "[suf]", "[mid]", seed=1, fim_percent=60, spm_percent=10, unit=unit)
        rows = fim.restored(fim.fill_in_middle(docs, how), how).collect()
        assert {r.form for r in rows} == {"plain", "psm", "spm"}
        assert all(r.text == f"one two é{r.doc_id} <P> four\nfive" for r in rows)
    for bad in [fim.Template("<P>", "<P>", "<M>"), fim.Template("<P<", "<S>", "<M>"), fim.Template("a", "b", "c"), fim.Template(unit="page")]:
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, bad)
