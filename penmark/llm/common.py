"""Helpers shared by the operators: tables, files in the shared folder, words as hashes."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers look for this package in the driver's folder too, if it is not installed.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_BYTES = 16 << 20


def small_side(stored: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast a stored table whose counted rows fit in ``BROADCAST_BYTES``; else the join shuffles it."""
    return F.broadcast(stored) if stored.count() * row_bytes <= BROADCAST_BYTES else stored


def lowest_hashes(rows: DataFrame, key: str, size: int, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the lowest hashes of ``key``, of ``size`` counted ones.

    A share of the hash range that holds little more than ``limit`` rows is kept first, so that tasks
    do not hand on ``limit`` rows each.
    """
    share = (limit + 8 * limit**0.5 + 16) / max(1, size)
    if share < 1:
        rows = rows.where(F.xxhash64(key) <= F.lit(int(share * 2**64) - 2**63))
    return rows.orderBy(F.xxhash64(key), key).limit(limit)


# ---- files that tasks write and read by byte ranges ------------------------


def _store(url: str):
    """``(pyarrow file system, path)``; a bare path or ``file:`` is the shared local folder."""
    from pyarrow import fs

    if urlparse(url).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(url).path
    return fs.FileSystem.from_uri(url)


def write_file(url: str, parts: Iterable[bytes]) -> int:
    """Write the parts one after another; the number of bytes written.

    The file takes its name only when it is whole. Callers put a new random name into
    ``url`` for each attempt of a task, so a repeated task never meets an earlier file.
    """
    store, path = _store(url)
    store.create_dir(os.path.dirname(path), recursive=True)
    size = 0
    with store.open_output_stream(path + ".part") as out:
        for part in parts:
            out.write(part)
            size += len(part)
    store.move(path + ".part", path)
    return size


class RangeReader:
    """Byte ranges of one file."""

    def __init__(self, url: str):
        store, path = _store(url)
        self._file = store.open_input_file(path)

    def size(self) -> int:
        return self._file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self._file.read_at(length, offset)

    def close(self) -> None:
        self._file.close()


# ---- words as 64-bit hashes, without Python objects per word ---------------

_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.arange(256) < 128
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_POW = _powers(_BASE, _STEP + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _STEP + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _chunk_words(data: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each run of bytes that are not gaps."""
    word = ~gaps[data]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _POW[: len(data)], dtype=U64, out=total[1:])
    h = (total[end] - total[start]) * _INV[start]
    return mix(h ^ ((end - start).astype(U64) << U64(40))), start, end


def word_hashes(text: str | None, fold: bool = True, spans: bool = False, gaps: np.ndarray = _SPACES):
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a whole text, in order.

    ``gaps`` marks other bytes that part words; ``fold`` lower-cases A-Z first. With ``spans``, also the byte range of each word and
    the bytes themselves. Long texts go through pieces cut between words; a word longer
    than a piece is hashed alone.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if fold:
        data = _FOLD[data]
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(data):
        stop = min(at + _STEP, len(data))
        if stop < len(data):
            gap = np.flatnonzero(gaps[data[at:stop]])
            if len(gap):
                stop = at + int(gap[-1]) + 1
            else:  # one word fills the piece: find its end and fold its parts together
                rest = np.flatnonzero(gaps[data[at:]])
                stop = at + int(rest[0]) if len(rest) else len(data)
                h = U64(stop - at)
                for i in range(at, stop, _STEP):
                    part = data[i : min(i + _STEP, stop)].astype(U64) + U64(1)
                    h = mix(np.array([h ^ (part * _POW[: len(part)]).sum(dtype=U64)]))[0]
                hashes.append(np.array([h], U64))
                starts.append(np.array([at]))
                ends.append(np.array([stop]))
                at = stop
                continue
        h, s, e = _chunk_words(data[at:stop], gaps)
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    out = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    if not spans:
        return out
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return out, join(starts), join(ends), data


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(hashes) - n + 1, U64)
    for i in range(n):
        out = mix(out + hashes[i : len(hashes) - n + 1 + i] * U64(2 * i + 0x5851F42D4C957F2D))
    return out


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct shingles of ``n`` words; with fewer words, the whole sequence as one."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(windows(words, min(n, len(words))))


def texts_in(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 16 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches cut so small that about ``limit`` bytes of text are in Python at once."""
    for batch in batches:
        size = max(1, batch.nbytes)
        step = max(1, batch.num_rows * limit // size)
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part, part.column(column).to_pylist()
