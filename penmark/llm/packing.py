"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Defined results: a null text is empty and still gives its end id; a repeated row is a
document of its own; an empty table gives an empty table; columns besides ``doc_id`` and
``text`` are ignored, whatever their names; equal lengths are interchangeable.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from penmark.llm.common import texts_in
from penmark.llm.encode import encoder
from penmark.session import staged

CAPACITY = 4096
GROUP_TOKENS = 1 << 24  # tokens packed together by one task: about 4096 sequences, one of them not full
GROUP_PIECES = 1 << 18  # short documents fill a group before its tokens do
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"


def token_pieces(
    docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """The ids of each whole text and its end id, cut only where longer than ``capacity``.

    ``slot`` numbers the pieces; ``keep_ids`` adds them as little-endian 32-bit ``ids``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, slot = encoder(tokenizer, kind), TaskContext.get().partitionId() << 36
        for part, texts in texts_in(batches, limit=4 << 20):
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode.ids(texts)):
                data = np.append(ids, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(data), capacity)):
                    raw = data[start : start + capacity].tobytes()
                    row = (doc_id, piece, start, len(raw) // 4, zlib.crc32(raw), slot, raw)
                    for column, value in zip(rows, row):
                        column.append(value)
                    slot += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "slot", "ids"][: 7 if keep_ids else 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(rows, kinds, names)], names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1..capacity).

    A bin is filled greedily with the longest unpacked document that still fits. If a gap
    is left, its smallest document is taken out again and replaced by the two unpacked
    documents that fill the expanded gap best, where they fill more than it did.
    """
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    next_of = np.cumsum(count)  # the rows of one length are order[next_of[l] - count[l] : next_of[l]]
    left = count.copy()
    floor = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def refresh(n: int) -> None:
        """``floor`` after length ``n`` is used up or back again: it changes up to the next length there is."""
        above = np.flatnonzero(left[n + 1 :])
        floor[n : n + 1 + (int(above[0]) if len(above) else capacity - n)] = n if left[n] else floor[n - 1]

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            refresh(n)

    number, todo = 0, len(lengths)
    while todo:
        inside, gap = [], capacity
        while gap and (n := int(floor[gap])):
            take(n)
            inside.append(n)
            gap -= n
        if gap and floor[capacity]:
            room = gap + inside[-1]
            a = np.flatnonzero(left[: room + 1])
            b = floor[room - a]
            same = (a == b) & (left[a] < 2)
            b[same] = floor[a[same] - 1]
            both = np.where(b > 0, a + b, 0)
            if len(a) and both[best := int(np.argmax(both))] > inside[-1]:
                back = inside.pop()
                inside += [int(a[best]), int(b[best])]
                take(inside[-2])
                take(inside[-1])
                left[back] += 1
                if left[back] == 1:
                    refresh(back)
        at = 0
        for n in inside:
            next_of[n] -= 1
            row = order[next_of[n]]
            bins[row], offsets[row] = number, at
            at += n
        todo -= len(inside)
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces with ``length`` and ``slot``.

    Pieces are dealt at random into groups of about ``group_tokens`` tokens and at most about
    ``GROUP_PIECES`` pieces, and each group is packed by one task. Lengths above ``capacity`` are refused.
    """
    total = pieces.agg(F.sum("length"), F.max("length"), F.count(F.lit(1))).first()
    if (total[1] or 0) > capacity:
        raise ValueError("cut documents to the capacity first")
    groups = max(1, -(-(total[0] or 0) // group_tokens), -(-total[2] // GROUP_PIECES))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot", kind="stable").reset_index(drop=True)
        bins, rows["offset"] = best_two_fit(rows["length"].to_numpy(np.int64), capacity)
        rows["sequence_id"] = (int(key[0]) << 32) + bins
        return rows

    schema = StructType([*pieces.schema.fields]).add("offset", "long").add("sequence_id", "long")
    dealt = pieces.groupBy(F.pmod(F.xxhash64("slot"), F.lit(groups)).alias("_group"))
    return dealt.applyInPandas(run, schema)


def packed_documents(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence."""
    # Stored once: tokenizing is the dear step, and the count of groups reads it too.
    pieces = staged(token_pieces(docs, tokenizer, kind, end_id, capacity))
    return pack(pieces, capacity).drop("slot")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves: one row a sequence, from pieces stored with ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
