"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line goes if the corpus has an earlier line, in the order of ``doc_id`` and position,
that is equal or at most ``max_edits`` single-character edits away. Only lines of at least
``min_chars`` characters without outer blanks take part; others always stay.

Two lines within t edits of each other share one of t + 1 segments of the shorter (or
equally long) one, at a place that its number and the two lengths bound. Each line stores
its own segments and looks for those of lines up to t characters shorter; a key is the
length, the segment's number and its text. They are made for candidates alone: lines that
share a rough key, of a class of lengths, with a different line. Keys that two different lines
share give pairs; marks of their characters part most that are too far apart, and a banded
bit-parallel automaton confirms the rest. Where a key has too many
lines to be compared pair by pair, the rest of each line is cut into segments again and
the key grows, until groups are small or hold only lines that are all within reach; such a
group is compared with its earliest lines alone, which is all the rule asks.

Defined results: a null text stays null and has no lines; an empty text has one empty
line, which stays; of repeated rows with equal id and text each keeps the same lines; a
null id comes before all others. All columns are returned; ``text`` is the new text, and
columns named like the counts are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from penmark.llm.common import small_side
from penmark.session import staged

MAX_EDITS, MIN_CHARS = 2, 20
GROUP_PAIRS = 1 << 14  # lines of a key are compared pair by pair up to this product, else the key grows


def _taking_part(lines: DataFrame, min_chars: int) -> DataFrame:
    return lines.where(F.length(F.trim("line")) >= min_chars)


def _instances(docs: DataFrame, min_chars: int, edits: int) -> DataFrame:
    """Every line that takes part, without its text: its place, a 128-bit id and its rough keys."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = _taking_part(rows, min_chars).withColumn("size", F.length("line"))
    place = F.struct("doc_id", "th", "pos").alias("at")
    return rows.select(place, F.xxhash64("line").alias("h"), _second_id("line").alias("g"), _rough_keys(edits).alias("rough"))


def _second_id(line: str) -> Column:
    return F.xxhash64(F.lit(1), line)


def _rough_keys(edits: int) -> Column:
    """Keys of a line of which two lines within ``edits`` edits share one, by classes of lengths.

    The segments are those of the shortest length of a class, so lines of near lengths cut alike; a line just
    above a border has the keys of the class below too. The first segment is counted from the beginning, the
    last from the end. One between them, if it is the first without an edit, moved by at most the edits
    before it; it is short by that many characters and kept at each place up to there, so that whichever
    line has the longer beginning finds the other.
    """

    def keys(base: Column) -> list[Column]:
        out = []
        for i in range(1, edits + 2):
            start, stop = _cut(base, i, edits)
            if i == edits + 1:
                places = [(F.col("size") - (base - start) + 1, base - start)]
            else:
                moves = i - 1
                places = [(start + move + 1, stop - start - moves) for move in range(moves + 1)]
            out += [F.xxhash64(base, F.lit(i), F.substring("line", at, n)) for at, n in places]
        return out

    def base(n: Column) -> Column:
        return n - n % F.when(n < 64, 4).otherwise(16)

    own, below = base(F.col("size")), base(F.col("size") - edits)
    return F.when(own == below, F.array(*keys(own))).otherwise(F.array(*keys(own), *keys(below)))


def _part(a: Column, b: Column, n: Column, t: Column | int) -> Column:
    """Characters a..b of a line still to be matched with n characters of the other, within t edits."""
    return F.struct(a.alias("a"), b.alias("b"), n.alias("n"), (F.lit(t) if isinstance(t, int) else t).alias("t"))


def _left_over(parts: Column) -> Column:
    """Without parts that hold nothing and allow nothing; the places in what is left agree for all lines of a key."""
    return F.filter(parts, lambda p: (p["t"] > 0) | (p["n"] > 0))


def _is_open(p: Column) -> Column:
    """Whether a part can be out of reach, by what it holds."""
    return F.greatest(p["b"] - p["a"], p["n"]) > p["t"]


def _shapes(edits: int) -> list[tuple[int, int, int]]:
    """``(shorter, i, shift)``: how much shorter the other line is, the segment, and how far it may have moved."""
    out = []
    for shorter in range(edits + 1):
        for i in range(1, edits + 2):
            rest = edits + 1 - i
            out += [(shorter, i, shift) for shift in range(max(1 - i, shorter - rest), min(i - 1, shorter + rest) + 1)]
    return out


def _cut(n: Column, i: Column | int, edits: int) -> tuple[Column, Column]:
    """First and last character of segment ``i`` of ``n`` characters."""
    return F.floor(n * (i - 1) / (edits + 1)).cast("int"), F.floor(n * i / (edits + 1)).cast("int")


def _segment_keys(instances: DataFrame, columns: list[str], edits: int) -> DataFrame:
    """``columns`` of each line with its keys ``{key, own, shape}``; ``own`` keys are also stored."""
    made = []
    for k, (shorter, i, shift) in enumerate(_shapes(edits)):
        n = F.col("size") - shorter
        start, stop = _cut(n, i, edits)
        key = F.xxhash64(n, F.lit(i), F.substring("line", start + shift + 1, stop - start))
        made.append(F.struct(key.alias("key"), F.lit(shorter == 0 and shift == 0).alias("own"), F.lit(k).alias("shape")))
    # The array is a column of its own, so that what its keys share is computed once.
    keyed = instances.select(*columns, F.array(*made).alias("made"))
    return keyed.select(*columns, F.explode("made").alias("k")).select(*columns, "k.*")


def _segment_parts(edits: int) -> Column:
    """The rest of a line beside the segment of its key, by ``size`` and ``shape``."""
    pick = lambda j: F.element_at(F.lit([s[j] for s in _shapes(edits)]), F.col("shape") + 1)
    shorter, i, shift = pick(0), pick(1), pick(2)
    n = F.col("size") - shorter
    start, stop = _cut(n, i, edits)
    left = _part(F.lit(0), start + shift, start, i - 1)
    return _left_over(F.array(left, _part(stop + shift, F.col("size"), n - stop, F.lit(edits + 1) - i)))


def _grown_keys(edits: int) -> Column:
    """The keys that follow when the first part that can be cut is cut into segments."""
    cut = F.filter("parts", lambda p: p["n"] > p["t"])[0]
    at = F.array_position(F.transform("parts", lambda p: p["n"] > p["t"]), True) - 1
    others = F.filter("parts", lambda p, j: j != at)
    a, b, n, t = cut["a"], cut["b"], cut["n"], cut["t"]
    longer, out = b - a - n, []
    for i in range(1, edits + 2):
        start, stop = F.floor(n * (i - 1) / (t + 1)).cast("int"), F.floor(n * i / (t + 1)).cast("int")
        rest = t + 1 - i
        for shift in range(-edits, edits + 1):
            left = _part(a, a + start + shift, start, F.lit(i - 1))
            right = _part(a + stop + shift, b, n - stop, rest)
            # A side without edits must be equal as it is.
            same = [F.when(p["t"] == 0, F.substring(F.col("line"), p["a"] + 1, p["b"] - p["a"])) for p in (left, right)]
            fits = reduce(lambda x, y: x & y, [(p["t"] > 0) | (p["b"] - p["a"] == p["n"]) for p in (left, right)])
            possible = (F.lit(i) <= t + 1) & (F.lit(shift) >= F.greatest(F.lit(1 - i), longer - rest))
            possible &= (F.lit(shift) <= F.least(F.lit(i - 1), longer + rest)) & fits
            text = F.substring(F.col("line"), a + start + shift + 1, stop - start)
            parts = F.filter(F.concat(others, F.array(left, right)), lambda p: p["t"] > 0)
            own = F.col("own") & F.lit(shift == 0)
            row = F.struct(
                F.xxhash64("key", F.lit(i), text, *same).alias("key"), own.alias("own"), F.lit(shift).alias("shift"), parts.alias("parts")
            )
            out.append(F.when(possible, row))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


_STEPS = [1 << k for k in range(20, -1, -1)]


def _common(a: Column, b: Column, end: bool = False) -> Column:
    """Characters that two strings share at the beginning, or at the end; found by halving."""
    n = F.least(F.length(a), F.length(b))

    def part(x: Column, k: Column, step: Column) -> Column:
        start = F.length(x) - k - step + 1 if end else k + 1
        return F.substring(x, start, step)

    def longer(k: Column, step: Column) -> Column:
        return F.when((k + step <= n) & (part(a, k, step) == part(b, k, step)), k + step).otherwise(k)

    # The longest step twice, so that very long strings get there too; what is left equal is only more work.
    return F.aggregate(F.lit([_STEPS[0], *_STEPS]), F.lit(0), longer)


HEAD = 16  # characters after which most pairs that are too far apart are known to be


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are at most ``edits`` edits apart.

    What they share at both ends needs no edit. The automaton reads a short piece of the rest first:
    if it is dead by then, so it is after the whole.
    """

    def middle(s: Column) -> Column:
        x, y = s["x"], s["y"]
        far = F.abs(F.length(x) - F.length(y)) > edits
        short = F.greatest(F.length(x), F.length(y)) <= edits
        alive = _automaton(F.substring(x, F.lit(1), F.lit(HEAD + edits)), F.substring(y, F.lit(1), F.lit(HEAD)), edits, whole=False)
        return F.when(far, False).when(short, True).when(~alive, False).otherwise(_automaton(x, y, edits, whole=True))

    cut = lambda x, k: F.substring(x, k + 1, F.length(x) - k)
    left = lambda x, k: F.substring(x, F.lit(1), F.length(x) - k)
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ends = lambda s: _let(_common(s["x"], s["y"], end=True), lambda k: pair(left(s["x"], k), left(s["y"], k)))
    tail = _let(_common(a, b), lambda k: pair(cut(a, k), cut(b, k)))
    return _let(_let(tail, ends), middle)


def _automaton(a: Column, b: Column, edits: int, whole: bool) -> Column:
    """An automaton over the band of 2 * edits + 1 diagonals.

    Bit d of word e says that the diagonal d can be reached with at most e edits. Each character of
    ``b`` updates all diagonals of a word at once. The answer is whether the end is reached, or, not
    ``whole``, whether any diagonal is still alive.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    names = [f"r{e}" for e in range(edits + 1)]
    begin = F.struct(*[F.lit(((1 << (e + 1)) - 1) << edits).cast("long").alias(name) for e, name in enumerate(names)])
    n, m = F.length(a), F.length(b)
    left, right = F.split(a, ""), F.split(b, "")
    # Beside each character of b, the characters of a on the band's diagonals.
    shifted = [F.concat(F.array_repeat(F.lit(""), edits - d), left) if d < edits else F.slice(left, d - edits + 1, n + 1) for d in range(width)]
    beside = F.arrays_zip(*[F.slice(x, 1, m).alias(f"c{k}") for k, x in enumerate([right, *shifted])])

    def step(words: Column, at: Column) -> Column:
        match = F.lit(0).cast("long")
        for d in range(width):
            hit = F.when(at["c0"] == at[f"c{d + 1}"], F.lit(1 << d)).otherwise(F.lit(0))
            match = match.bitwiseOR(hit.cast("long"))
        new = [words[names[0]].bitwiseAND(match)]
        for e in range(1, edits + 1):
            old, here = words[names[e - 1]], words[names[e]].bitwiseAND(match)
            here = here.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(here.bitwiseAND(F.lit(mask).cast("long")))
        return F.struct(*[w.alias(name) for w, name in zip(new, names)])

    def last(words: Column) -> Column:
        if not whole:
            return words[names[-1]] != 0
        return reduce(lambda x, y: x | y, [
            (n - m == F.lit(d - edits)) & (words[names[-1]].bitwiseAND(F.lit(1 << d).cast("long")) != 0) for d in range(width)
        ])

    return F.aggregate(beside, begin, step, last)


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` of keys that a stored segment and another line share, with the number of pairs of the key."""
    keys = rows.groupBy("key").agg(
        (F.sum(F.col("own").cast("long")) * F.count(F.lit(1))).alias("pairs"), F.min("h").alias("x"), F.max("h").alias("y")
    )
    return rows.join(keys.where("pairs > 0 AND x <> y").select("key", "pairs"), "key")


def _marks(line: str) -> Column:
    """64 bits, each whether the characters of a class occur an odd number of times: an edit turns two at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(bit(c)))


_SIDE = ["h", "g", "line", "at", "marks"]


def _pairs(own: DataFrame, probing: DataFrame, edits: int) -> DataFrame:
    left = own.select("key", *[F.col(c).alias(f"x_{c}") for c in _SIDE])
    right = probing.select("key", *[F.col(c).alias(f"y_{c}") for c in _SIDE])
    # Lines of one length meet in both directions; one of them is enough.
    once = (F.length("x_line") < F.length("y_line")) | (F.col("x_h") < F.col("y_h"))
    other = (F.col("x_h") != F.col("y_h")) & once
    may = F.bit_count(F.col("x_marks").bitwiseXOR(F.col("y_marks"))) <= 2 * edits
    return left.join(right, "key").where(other & may).drop("key")


def _with_leaders(rows: DataFrame) -> DataFrame:
    """Groups whose lines are all within reach: the earliest stored line with every line, and the earliest line with every stored one."""
    own = rows.where("own")
    first = lambda x: x.groupBy("key").agg(F.min_by(F.struct(*_SIDE), "at").alias("r")).select("key", "r.*")
    pairs = []
    for side, led in ((first(own), rows), (own, first(rows))):
        left = side.select("key", *[F.col(c).alias(f"x_{c}") for c in _SIDE])
        right = led.select("key", *[F.col(c).alias(f"y_{c}") for c in _SIDE])
        pairs.append(left.join(right, "key").where("x_h <> y_h").drop("key"))
    return pairs[0].union(pairs[1])


def _slot_pairs(own: DataFrame, stuck: DataFrame, edits: int) -> DataFrame:
    """Lines with a part that cannot be cut but is open, and the stored lines of their key that share a character with it.

    Such a part has more than ``t`` characters, so within ``t`` edits at least one of them is kept.
    """
    marks = lambda p: F.array_distinct(F.split(F.substring("line", p["a"] + 1, p["b"] - p["a"]), ""))
    slots = F.transform("parts", lambda p, j: F.transform(marks(p), lambda c: F.struct(j.alias("j"), c.alias("c"))))
    first = F.array_position(F.transform("parts", _is_open), True).cast("int")
    asked = F.element_at(slots, first)
    left, right = [
        rows.select(*_SIDE, "key", F.explode(chars).alias("s")).select(*_SIDE, F.xxhash64("key", "s.j", "s.c").alias("key"))
        for rows, chars in ((own, F.flatten(slots)), (stuck, asked))
    ]
    return _pairs(left, right, edits)


def _candidates(docs: DataFrame, instances: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """The different lines that share a rough key with another one: ``h, g, line, at, size, marks``."""
    rough = instances.select("h", F.explode("rough").alias("key"))
    shared = rough.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("key")
    wanted = rough.join(small_side(staged(shared), 16), "key", "left_semi").select("h").distinct()
    wanted = small_side(staged(wanted), 16)
    lines = _taking_part(docs.select(F.explode(F.split("text", "\n")).alias("line")), min_chars)
    lines = lines.select("line", F.xxhash64("line").alias("h")).join(wanted, "h", "left_semi")
    lines = lines.groupBy("h", _second_id("line").alias("g")).agg(F.any_value("line").alias("line"))
    places = instances.join(wanted, "h", "left_semi").groupBy("h", "g").agg(F.min("at").alias("at"))
    return lines.join(places, ["h", "g"]).select("*", F.length("line").alias("size"), _marks("line").alias("marks"))


def near_lines(candidates: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """``h, g, near``: for lines with an edited twin, the place of its earliest one."""
    candidates = staged(candidates)
    # Keys meet with hashes alone; texts and places come after, for the lines that are left.
    keys = _shared(staged(_segment_keys(candidates, ["h", "g"], edits).distinct()))
    columns = [*_SIDE, "key", "own", "pairs", "parts"]
    rows, levels = staged(keys.join(candidates, ["h", "g"]).withColumn("parts", _segment_parts(edits)).select(*columns)), []
    # All lines of a key can be cut, or none: then stored lines are closed, and others closed or stuck with an open part.
    can_grow, is_open = F.exists("parts", lambda p: p["n"] > p["t"]), F.exists("parts", _is_open)
    small = F.col("pairs") <= GROUP_PAIRS
    kinds = {"grows": ~small & can_grow, "few": small, "closed": ~small & ~is_open, "stuck": ~small & is_open & ~can_grow}
    there = set()
    while True:
        levels.append(rows)
        new = rows.agg(*[F.max(v).alias(k) for k, v in kinds.items()]).first().asDict()
        there |= {k for k, v in new.items() if v}
        if not new["grows"]:
            break
        grown = rows.where(kinds["grows"]).select(*_SIDE, "key", "own", "parts")
        grown = staged(grown.select(*_SIDE, F.explode(_grown_keys(edits)).alias("k")).select(*_SIDE, "k.*"))
        rows = staged(_shared(grown).select(*columns))
    # Keys of all levels meet at once.
    rows = reduce(lambda x, y: x.union(y), levels)
    few, closed, stuck = [rows.where(kinds[k]) for k in ("few", "closed", "stuck")]
    found = [_pairs(few.where("own"), few, edits)] if "few" in there else []
    found += [_with_leaders(closed)] if "closed" in there else []
    found += [_slot_pairs(closed.where("own"), stuck, edits)] if "stuck" in there else []
    if not found:
        return candidates.select("h", "g", F.col("at").alias("near")).where(F.lit(False))
    links = staged(reduce(lambda x, y: x.union(y), found).distinct()).where(within(F.col("x_line"), F.col("y_line"), edits))
    both = F.array(*[F.struct(F.col(f"{s}_h").alias("h"), F.col(f"{s}_g").alias("g"), F.col(f"{o}_at").alias("at")) for s, o in ("xy", "yx")])
    sides = links.select(F.explode(both).alias("s")).select("s.*")
    return sides.groupBy("h", "g").agg(F.min("at").alias("near"))


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without repeated lines, and ``n_lines``, ``n_exact``, ``n_near``.

    The counts are of all lines, of lines equal to an earlier one, and of other lines with an
    earlier near one. ``min_chars`` must leave room for the segments.
    """
    if min_chars < 2 * max_edits + 2:
        raise ValueError("min_chars must be at least 2 * max_edits + 2")
    instances = staged(_instances(docs, min_chars, max_edits))
    exact = instances.groupBy("h", "g").agg(F.min("at").alias("exact"), F.count(F.lit(1)).alias("k")).where("k > 1")
    near = near_lines(_candidates(docs, instances, max_edits, min_chars), max_edits)
    none = F.lit(None).cast(exact.schema["exact"].dataType)
    firsts = exact.select("h", "g", "exact", none.alias("near")).union(near.select("h", "g", none, "near"))
    firsts = staged(firsts.groupBy("h", "g").agg(F.min("exact").alias("exact"), F.min("near").alias("near")))
    again = F.coalesce(F.col("at") > F.col("exact"), F.lit(False))
    close = F.coalesce(F.col("at") > F.col("near"), F.lit(False))
    gone = instances.select("h", "g", "at").join(firsts, ["h", "g"]).where(again | close)
    gone = gone.groupBy(F.col("at.doc_id").alias("__d"), F.col("at.th").alias("__t")).agg(
        F.array_sort(F.collect_set("at.pos")).alias("__gone"),
        F.collect_set(F.when(again, F.col("at.pos"))).alias("__same"),
    )
    rows = docs.withColumn("__h", F.xxhash64("text"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["__d"]) & (rows["__h"] == gone["__t"]), "left")
    lines, cuts = F.split("text", "\n"), F.concat(F.array(F.lit(-1)), F.col("__gone"))
    runs = F.transform(cuts, lambda c, i: F.slice(lines, c + 2, F.coalesce(F.get(cuts, i + 1), F.size(lines)) - c - 1))
    left = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    n_gone, n_same = [F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long") for c in ("__gone", "__same")]
    counts = {
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_exact": n_same, "n_near": n_gone - n_same,
    }
    kept = [c for c in docs.columns if c not in counts]
    return rows.select(*[left.alias("text") if c == "text" else F.col(c) for c in kept], *[v.alias(k) for k, v in counts.items()])
