"""Ranks against sorting, the manifest against a plain tree, over arrays of several rounds."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from penmark.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, s, lang, n, t):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, lang, n, t)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def steps(levels, i):
    for nodes in levels[:-1]:
        run = i - i % 3
        yield nodes[run:i], nodes[i + 1 : run + 3]
        i //= 3


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in order}
    trees = {s: tree([leaf(*r) for r in made[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(made[s]):
            path = [*steps(trees[s], i), *steps(top, k)]
            now = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = (*r[:4], r[4].replace("\n", ""))
            node = leaf(*now)
            for a, b in path:
                node = h(*a, node, *b)
            proof = h(*[x for a, b in path for x in a + b])
            out.append((r[0], leaf(*r), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return manifest.manifest(docs, tampered=F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))), **how)


def table(seed, n, sources):
    rng = random.Random(seed)
    ids = rng.sample(range(-(10**6), 10**6), n // 2) + rng.sample(range(10**12, 10**12 + 2 * n), n - n // 2)
    text = lambda: rng.choice([None, "", "a\nb", "é漢\n", "plain"])
    return [(d, rng.choice(sources), rng.choice(["en", None, "fr"]), rng.choice([3, None]), text()) for d in ids]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_against_a_plain_tree(spark, levels):
    rows = table(levels, 200, [None, "", "b", "a", "ä", "-"] + ["hot"] * 4)
    rows += [(None, "hot", "en", 1, "x"), (None, "hot", "en", 2, "y\n"), (None, None, None, None, None)]
    rows += [rows[3]] * 4 + [(rows[5][0], rows[5][1], "zz", 9, f"other {i}\n") for i in range(3)]
    got = run(spark, rows, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_small_tables(spark):
    assert run(spark, [(1, "s", "en", 1, "x")]).limit(0).collect() == [] == run(spark, []).collect()
    for rows in ([(1, None, "en", 1, "x\ny")], [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "x")], [(i, "a", "e", 1, "x") for i in range(4)]):
        assert sorted(map(tuple, run(spark, rows).collect()), key=str) == plain(rows)


def test_ranks_without_a_sort(spark):
    rng = random.Random(2)
    ids = [*range(-70, 70), *rng.sample(range(-(2**40), 2**40), 300), 2**63 - 1, -(2**63), None, None, 65535, 65536, 2**32, 2**32 - 1]
    rows = [(g, i, h(str(k))) for g in (None, "a") for k, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "grp string, id long, leaf string")
    got = sorted(((r.grp or "", r.pos, r.id, r.leaf) for r in manifest.ranked(frame).collect()), key=lambda r: r[:2])
    for g in ("", "a"):
        mine = [(i, l) for k, p, i, l in got if k == g]
        assert [p for k, p, _, _ in got if k == g] == list(range(len(ids)))
        assert mine == sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_a_changed_leaf_is_found(spark):
    rows = [(i, "s", "en", 1, f"{i}") for i in range(30)]
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = manifest.manifest(docs, tampered=F.when(F.col("doc_id") == 7, F.lit("8"))).collect()
    assert {r.doc_id for r in got if not r.verified} == {7}
