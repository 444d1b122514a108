"""Fill-in-middle transformation: texts cut at two unit ranks, found with an indexable skip list.

A text is a row of units: lines with their line feed, words with the blanks after them, or code
points. The units of one text are the bottom lane of a skip list; each lane above holds about a
quarter of the nodes below it, and each node carries how many units and how many code points lie
between it and the next node of its lane. Going down from the top lane by the accumulated unit
widths reaches a rank in a logarithmic number of steps, and the code point widths summed on the
way are the exact place of the cut.

The cuts and the form come from the first four 8-digit groups of the hex sha256 of
``seed:doc_id``, so a repeated task, another partitioning or another order give the same output.

Defined results: a null text is empty; an empty text, or one that holds a mark, is plain and
stays as it is; a null ``doc_id`` is hashed as an empty one; rows that share ``doc_id`` and text
get the same output, and every row is kept; an empty table gives an empty one; columns other than
``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from penmark.llm.common import mix, texts_in

STEP = 2  # bits of the height hash per lane: a quarter of the nodes reach the next one
#: Units of a text, left to right; each pattern tiles every text.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\s*\S+\s*|\s+", "char": r"(?s:.)"}
_LINE_FEED = 10


@dataclass(frozen=True)
class Template:
    """Marks, seed and rates (in percent) of the transformation."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    fim_percent: int = 100
    spm_percent: int = 50
    unit: str = "line"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def unit_lengths(text: str, unit: str = "line") -> np.ndarray:
    """Code points of each unit of a text."""
    if unit == "char":
        return np.ones(len(text), np.int64)
    if unit == "line":
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if not len(data):
            return np.zeros(0, np.int64)
        ends = np.flatnonzero(data == _LINE_FEED) + 1
        starts = np.concatenate(([0], ends[: len(ends) - (len(ends) > 0 and ends[-1] == len(data))]))
        return np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64)
    return np.array([m.end() - m.start() for m in re.finditer(UNITS[unit], text)], np.int64)


class SkipList:
    """Lanes over a row of units; ``offset(rank)`` is the number of code points before a rank."""

    def __init__(self, lengths: np.ndarray):
        self.n = len(lengths)
        #: From the bottom lane up: units and code points to the next node, and the node's number one lane below.
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        units, chars, below = np.ones(self.n, np.int64), lengths, np.arange(self.n)
        # The height of a node is a hash of its number, so equal texts have equal lists.
        heights = mix(np.arange(self.n, dtype=np.uint64))
        while True:
            self.lanes.append((units, chars, below))
            heights >>= np.uint64(STEP)
            up = (heights & np.uint64((1 << STEP) - 1)) == 0
            up[:1] = True  # the head of every lane is the first node
            if up.sum() <= 1:
                return
            below = np.flatnonzero(up)
            units, chars = np.add.reduceat(units, below), np.add.reduceat(chars, below)
            heights = heights[below]

    def offset(self, rank: int) -> int:
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        node = at = passed = 0
        for units, chars, below in reversed(self.lanes):
            while node < len(units) and passed + units[node] <= rank:
                passed += int(units[node])
                at += int(chars[node])
                node += 1
            if passed == rank:
                return at
            node = int(below[node])
        return at


def _numbers(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str | None, doc_id: int | None, how: Template) -> tuple[int, str, int | None, int | None, str]:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    text = text or ""
    lengths = unit_lengths(text, how.unit)
    n = len(lengths)
    a, b, form, order = _numbers(doc_id, how.seed)
    if not text or any(mark in text for mark in how.marks) or form % 100 >= how.fim_percent:
        return n, "plain", None, None, text
    lanes = SkipList(lengths)
    first, last = [lanes.offset(rank) for rank in sorted((a % (n + 1), b % (n + 1)))]
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if order % 100 < how.spm_percent:
        form, output = "spm", f"{how.suffix}{suffix}{how.prefix}{prefix}{how.middle}{middle}"
    else:
        form, output = "psm", f"{how.prefix}{prefix}{how.suffix}{suffix}{how.middle}{middle}"
    return n, form, len(prefix), len(middle), output


def restore(output: str, form: str, how: Template) -> str:
    """The text an output was made from.

    The parts hold no mark, so the first of each mark after the one before it is its own.
    """
    if form == "plain":
        return output
    one, two = (how.prefix, how.suffix) if form == "psm" else (how.suffix, how.prefix)
    head, middle = output[len(one) :].split(how.middle, 1)
    left, right = head.split(two, 1)
    prefix, suffix = (left, right) if form == "psm" else (right, left)
    return prefix + middle + suffix


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, how: Template = Template()) -> DataFrame:
    """One row a document: ``doc_id, n, form, prefix_chars, middle_chars, output``; each row is its own work."""
    if any(not mark or mark[0] in mark[1:] for mark in how.marks) or len({mark[0] for mark in how.marks}) > 1 or len(set(how.marks)) < 3:
        raise ValueError("marks must differ, begin with one character and not hold it again")
    if how.unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches):
            ids = part.column("doc_id").to_pylist()
            made = list(zip(*[transform(text, doc_id, how) for text, doc_id in zip(texts, ids)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([ids, *made], kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def restored(rows: DataFrame, how: Template = Template()) -> DataFrame:
    """``rows`` with ``text``, read back from ``output`` and ``form``."""
    names = [*rows.columns, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, outputs in texts_in(batches, "output"):
            texts = [restore(o, f, how) for o, f in zip(outputs, part.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("text", StringType())]))
