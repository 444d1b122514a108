"""Merkle manifest of a dataset: leaf places by bitmap ranks, levels reduced in keyed slot arrays.

**Ranks.** Each group (source) has a bitmap of its ids, kept only in words of 64 ids that are not
empty: the words of all tasks are merged with a bitwise or. A directory of counts at three levels
(words in a container of 2^16 ids, containers in a block of 2^32, blocks) holds the ids before each
word. The place of a leaf is the directory's count plus the bits of its word below its own, so no
leaves are sorted. Ids that occur more than once add their further rows to the counts; only the
rows of such ids are numbered by a sort, which range partitions split.

**Levels.** A run of ``fanout ** LEVELS`` neighbouring leaves is a slot array of its own, whatever
the size of the group: it is reduced by that many levels at once, and its node takes the slot of
its number in the next round. Proofs come down the same way: each array gets the siblings above
its node, and every leaf adds those inside the array.

Defined results: nulls count as ``-``; a null group comes first, a null id comes first in its
group; rows that share group and id are ordered by their leaves, equal rows are leaves of their
own; a group of one leaf has it as its root, and a table of one group has that group's root; an
empty table gives an empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from penmark.llm.common import small_side
from penmark.operators.ranks import sorted_numbers
from penmark.session import staged

FANOUT, LEVELS = 3, 7  # an array has 3 ** 7 = 2187 slots
ABOVE = "key string, pos long, path string, subroot string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    """Hex sha256 of the fields, each as its UTF-8 length, ``:`` and value."""
    return F.sha2(F.concat(*[_field(c) for c in columns.values()]), 256)


# ---- ranks ------------------------------------------------------------------


def _before(frame: DataFrame, keys: list[str], order: str, count: str, name: str) -> DataFrame:
    """``frame`` with the sum of ``count`` over the rows of ``keys`` that come earlier."""
    window = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return frame.withColumn(name, F.coalesce(F.sum(count).over(window), F.lit(0)))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"_{k}"])
    return out


def _renamed(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in frame.columns])


def id_bitmaps(rows: DataFrame) -> DataFrame:
    """``grp, block, container, word, bits, extra, before``: the words of each group's bitmap with their directory.

    ``extra`` lists the bits of ids that occur more than once with their further rows; a null id has
    a word of its own, before all others.
    """
    ids = rows.groupBy("grp", "id").agg(F.count(F.lit(1)).alias("n"))
    place = F.col("id").bitwiseAND(F.lit(63)).cast("int")
    words = ids.groupBy("grp", F.shiftright("id", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("bits"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct(place.alias("bit"), (F.col("n") - 1).alias("more"))))).alias("extra"),
        F.sum("n").alias("n"),
    )
    words = staged(words.withColumn("container", F.shiftright("word", 10)).withColumn("block", F.shiftright("word", 26)))
    containers = words.groupBy("grp", "block", "container").agg(F.sum("n").alias("n"))
    blocks = _before(containers.groupBy("grp", "block").agg(F.sum("n").alias("n")), ["grp"], "block", "n", "b0").drop("n")
    # Windows see at most 2^10 words of a container and 2^16 containers of a block.
    containers = _before(containers, ["grp", "block"], "container", "n", "b1").drop("n", "block")
    words = _before(words, ["grp", "container"], "word", "n", "b2").drop("n")
    containers, blocks = _renamed(containers, ["grp", "container"]), _renamed(blocks, ["grp", "block"])
    words = words.join(containers, _same(words, containers, ["grp", "container"])).drop("_grp", "_container")
    words = words.join(blocks, _same(words, blocks, ["grp", "block"])).drop("_grp", "_block")
    return words.select("grp", "word", "bits", "extra", (F.col("b0") + F.col("b1") + F.col("b2")).alias("before"))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (``grp, id, leaf, ...``) with ``pos``, the place of each row in its group from 0."""
    bitmaps = _renamed(staged(id_bitmaps(rows)), ["grp", "word"])
    keyed = rows.withColumn("word", F.shiftright("id", 6)).withColumn("bit", F.col("id").bitwiseAND(F.lit(63)).cast("int"))
    met = keyed.join(bitmaps, _same(keyed, bitmaps, ["grp", "word"]))
    lower = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, bit)"))))
    more = F.aggregate(
        F.filter("extra", lambda e: e["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda n, e: n + e["more"]
    )
    # A null id is alone in its word and has no bits below it.
    pos = F.col("before") + F.coalesce(lower, F.lit(0)) + F.when(F.col("id").isNull(), F.lit(0)).otherwise(more)
    again = F.exists("extra", lambda e: e["bit"].eqNullSafe(F.col("bit")))
    met = staged(met.select(*rows.columns, pos.alias("pos"), again.alias("_again")))
    once = met.where("NOT _again").drop("_again")
    repeated = met.where("_again").drop("_again")
    if repeated.isEmpty():
        return once
    # Rows of one id share ``pos``; the sorted order numbers them from its smallest number on.
    numbered = staged(sorted_numbers(repeated, [F.col("grp").asc_nulls_first(), F.col("pos"), F.col("leaf"), F.xxhash64(*rows.columns)]))
    firsts = _renamed(numbered.groupBy("grp", "pos").agg(F.min("rn").alias("_first")), ["grp", "pos"])
    numbered = numbered.join(firsts, _same(numbered, firsts, ["grp", "pos"]))
    moved = numbered.withColumn("pos", F.col("pos") + F.col("rn") - F.col("_first")).select(*once.columns)
    return once.union(moved)


# ---- levels -----------------------------------------------------------------


def tree_levels(n: int) -> int:
    """Levels until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of an array level by level; a run of one is hashed too."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([digest(*last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def _slots(table: pa.Table, size: int) -> list[str]:
    """The nodes of an array in the slots that their places name."""
    out = [""] * table.num_rows
    for place, node in zip(table.column("pos").to_pylist(), table.column("node").to_pylist()):
        out[place % size] = node
    return out


def _path(levels: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """From a slot up: its number in each run and the run's other nodes."""
    out = []
    for nodes in levels[:-1]:
        run = i - i % FANOUT
        out.append((i % FANOUT, nodes[run:i] + nodes[i + 1 : run + FANOUT]))
        i //= FANOUT
    return out


def _packed(path: list[tuple[int, list[str]]]) -> str:
    return ";".join(f"{at}{''.join(others)}" for at, others in path)


def _unpacked(text: str) -> list[tuple[int, list[str]]]:
    return [(int(p[0]), [p[i : i + 64] for i in range(1, len(p), 64)]) for p in text.split(";")] if text else []


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a node and its siblings give."""
    for at, others in path:
        node = digest(*others[:at], node, *others[at:])
    return node


def _arrays(nodes: DataFrame, levels: int, *columns: str):
    arr = F.expr(f"pos div {FANOUT**levels}").alias("arr")
    return nodes.select("key", arr, "pos", "node", "height", *columns).groupBy("key", "arr")


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """One round: ``key, pos, node, height`` of arrays reduced to one node each; ``height`` counts the levels still to go."""

    def run(table: pa.Table) -> pa.Table:
        key, arr, height = (table.column(c)[0].as_py() for c in ("key", "arr", "height"))
        steps = min(height, levels)
        top = _reduced(_slots(table, FANOUT**levels), steps)[-1][0]
        return pa.table({"key": [key], "pos": pa.array([arr], pa.int64()), "node": [top], "height": pa.array([height - steps], pa.int32())})

    return _arrays(nodes, levels).applyInArrow(run, "key string, pos long, node string, height int")


def _paths_inside(mine: pa.Table, upper: pa.Table, levels: int) -> tuple[list[list[tuple[int, list[str]]]], str]:
    """The path of each row inside its array, and the array's own path."""
    size = FANOUT**levels
    nodes = _reduced(_slots(mine, size), min(mine.column("height")[0].as_py(), levels))
    return [_path(nodes, p % size) for p in mine.column("pos").to_pylist()], upper.column("path")[0].as_py()


def _down(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``key, pos, path, subroot`` of each node: its siblings up to the root, from those above its array."""

    def run(mine: pa.Table, upper: pa.Table) -> pa.Table:
        inside, rest = _paths_inside(mine, upper, levels)
        paths = [";".join(filter(None, (_packed(path), rest))) for path in inside]
        same = [upper.column("subroot")[0].as_py()] * len(paths)
        return pa.table({"key": mine.column("key"), "pos": mine.column("pos"), "path": pa.array(paths, pa.string()), "subroot": pa.array(same, pa.string())})

    return _arrays(nodes, levels).cogroup(_upper(above)).applyInArrow(run, ABOVE)


def _proved(leaves: DataFrame, above: DataFrame, root: str | None, levels: int) -> DataFrame:
    """The rows of the manifest: proofs as digests, and the root that each leaf as it is now folds to."""

    def run(mine: pa.Table, upper: pa.Table) -> pa.Table:
        inside, rest = _paths_inside(mine, upper, levels)
        rest = _unpacked(rest)
        leaf, subroot = mine.column("node"), upper.column("subroot")[0].as_py()
        proofs, folded = [], []
        for node, now, path in zip(leaf.to_pylist(), mine.column("now").to_pylist(), inside):
            path = path + rest
            proofs.append(digest(*[other for _, others in path for other in others]))
            folded.append(fold(now or node, path))
        n = len(proofs)
        return pa.table({
            "doc_id": mine.column("id"), "leaf": leaf, "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        })

    return _arrays(leaves, levels, "id", "now").cogroup(_upper(above)).applyInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def _upper(above: DataFrame):
    return above.select("key", F.col("pos").alias("arr"), "path", "subroot").groupBy("key", "arr")


def rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The stored nodes of each round, from the leaves (``key, pos, node, height``) to one node a key."""
    out = [nodes]
    for _ in range(-(-(nodes.agg(F.max("height")).first()[0] or 0) // levels)):
        out.append(staged(_up(out[-1], levels)))
    return out


def paths(made: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """Paths of the nodes that the arrays of the first round became, from those of the keys' roots."""
    above = top
    for nodes in reversed(made[1:-1]):
        above = staged(_down(nodes, above, levels))
    return above


def with_height(nodes: DataFrame) -> DataFrame:
    """Adds ``height``, the levels of each key's tree, from its number of nodes."""
    sizes = staged(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("_n")))
    height = F.lit(0)
    for k in range(40):  # 3 ** 39 is the last power in a long
        height = height + (F.col("_n") > F.lit(FANOUT**k)).cast("int")
    sizes = small_side(sizes.select(F.col("key").alias("_key"), height.alias("height")), 256)
    return nodes.join(sizes, F.col("key") == F.col("_key")).drop("_key")


def manifest(docs: DataFrame, group: str = "source", tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row a document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``tampered`` is the text to verify in place of the stored one; null means the row is as it was.
    """
    fields = {c: F.col(c) for c in FIELDS}
    changed = tampered if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").alias("id"), F.col(group).alias("grp"), leaf(fields).alias("leaf"),
        F.when(changed.isNotNull(), leaf({**fields, "text": changed})).alias("now"),
    )
    leaves = ranked(staged(rows))
    # Keys order as groups do, by their bytes, and null first.
    key = F.when(F.col("grp").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("grp")))
    leaves = staged(with_height(leaves.select(key.alias("key"), "id", "pos", F.col("leaf").alias("node"), "now")))
    made = rounds(leaves, levels)
    subroots = made[-1].select("key", F.col("node").alias("subroot"))
    # The groups' roots are the leaves of one more tree.
    top = sorted_numbers(subroots, [F.col("key")]).select(
        F.lit("").alias("key"), (F.col("rn") - 1).alias("pos"), F.col("subroot").alias("node"), F.col("key").alias("name")
    )
    top = staged(with_height(top))
    tops = rounds(top, levels)
    last = tops[-1].first()  # one row, or none
    begin = tops[-1].select("key", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"))
    lead = _down(top, paths(tops, begin, levels), levels).select(F.col("pos").alias("_pos"), "path")
    lead = top.join(lead, F.col("pos") == F.col("_pos"))
    lead = staged(lead.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot")))
    return _proved(leaves, paths(made, lead, levels), last["node"] if last else None, levels)
