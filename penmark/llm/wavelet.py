"""Token ids of documents as wavelet matrices: one compressed file a shard, read by byte ranges.

A file holds, for each bit of an id from the highest down, the bits of all ids in the matrix's
order. Each plane is cut into blocks of 2^17 bits; a block is compressed by itself, or kept raw
where that saves little, and a directory has its place in the file and the ones before it. Rank
reads one block a plane; select finds its block in the directory. That gives the id at a place,
how often an id occurs before a place, and the place of its k-th occurrence. Documents are stored
in ascending order of ``doc_id``.

Defined results: a null text is empty and has its end id; null ids come first; rows
that share an id are documents of their own, next to each other in the order of the table; an empty table has no shards; other
columns are ignored; an id that does not fit the planes is an error.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from penmark.llm.common import RangeReader, texts_in, write_file
from penmark.llm.encode import encoder
from penmark.session import scratch_path, staged

MAGIC = b"PMWM0002"
BLOCK = 1 << 17  # bits of a plane that are compressed together
SHARD_TOKENS = 1 << 22  # a shard is closed at the first document end past so many ids
_BYTES, _WORDS = BLOCK // 8, BLOCK // 64
_WORTH = 0.95  # a block is kept raw if compression leaves more than this


def _ones_before(bits: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ones before each place of a plane given as whole words of bytes."""
    counts = np.concatenate(([0], np.cumsum(np.bitwise_count(bits.view(np.uint64)), dtype=np.int64)))
    word, rest = ends // 64, ends % 64
    # The bits of the word in which a place lies, from the first on.
    last = np.unpackbits(np.append(bits, np.zeros(8, np.uint8)).reshape(-1, 8)[word], axis=1)
    inside = (last * (np.arange(64) < rest[:, None])).sum(axis=1, dtype=np.int64)
    return counts[word] + inside


class WaveletMatrix:
    """Rank, select and access over one shard file, without reading it whole."""

    def __init__(self, url: str, keep_blocks: int = 64):
        self.file = RangeReader(url)
        head = self.file.read(0, 16)
        if head[:8] != MAGIC:
            raise ValueError(f"not a shard: {url}")
        (size,) = struct.unpack("<Q", head[8:])
        self.head = json.loads(self.file.read(16, size))
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        at, blocks = 16 + size, -(-self.n // BLOCK)
        table = np.frombuffer(self.file.read(at, 16 * self.bits * (blocks + 1)), "<i8").reshape(self.bits, 2, blocks + 1)
        #: Ones before each block, and where each block begins in the file, by plane.
        self.ones, self.places = table[:, 0], table[:, 1] + at + table.nbytes
        self._block = lru_cache(keep_blocks)(self._read_block)

    def close(self) -> None:
        self.file.close()

    def _inflated(self, raw: bytes) -> bytes:
        return raw if len(raw) == _BYTES else zstandard.decompress(raw, _BYTES)

    def _read_block(self, k: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits of a block and the ones before each of its words."""
        at, end = self.places[k, b : b + 2].tolist()
        bits = np.frombuffer(self._inflated(self.file.read(at, end - at)), np.uint8)
        counts = np.cumsum(np.bitwise_count(bits.view(np.uint64)), dtype=np.int64)
        return bits, np.concatenate(([0], counts))

    def _plane(self, k: int) -> np.ndarray:
        """All bits of a plane, packed, in whole blocks."""
        at, end = int(self.places[k, 0]), int(self.places[k, -1])
        raw, edges = self.file.read(at, end - at), (self.places[k] - at).tolist()
        return np.frombuffer(b"".join(self._inflated(raw[a:b]) for a, b in zip(edges, edges[1:])), np.uint8)

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``k``."""
        b, rest = divmod(i, BLOCK)
        before = int(self.ones[k, b])
        if not rest:
            return before
        bits, counts = self._block(k, b)
        word, rest = divmod(rest, 64)
        inside = np.unpackbits(bits[8 * word : 8 * word + 8])[:rest].sum() if rest else 0
        return before + int(counts[word]) + int(inside)

    def _select(self, k: int, bit: int, i: int) -> int:
        """Place of the ``i``-th (from 0) such bit of plane ``k``."""
        size = np.arange(len(self.ones[k])) * BLOCK
        before = self.ones[k] if bit else size - self.ones[k]
        b = int(np.searchsorted(before[:-1], i, side="right")) - 1
        bits, counts = self._block(k, b)
        counts = counts if bit else np.arange(len(counts)) * 64 - counts
        i -= int(before[b])
        word = int(np.searchsorted(counts, i, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(bits[8 * word : 8 * word + 8]) == bit)
        return b * BLOCK + word * 64 + int(inside[i - int(counts[word])])

    def _step(self, k: int, bit: int, i: int) -> int:
        ones = self._rank1(k, i)
        return self.zeros[k] + ones if bit else i - ones

    def _bit(self, token: int, k: int) -> int:
        return token >> (self.bits - 1 - k) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            bits, _ = self._block(k, i // BLOCK)
            at = i % BLOCK
            bit = int(bits[at // 8] >> (7 - at % 8) & 1)
            value = 2 * value + bit
            i = self._step(k, bit, i)
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among the first ``i`` ids lie after the last plane."""
        low, high = 0, i
        for k in range(self.bits):
            low, high = self._step(k, self._bit(token, k), low), self._step(k, self._bit(token, k), high)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first ``i`` ids."""
        if token >> self.bits:
            return 0
        low, high = self._range(token, min(i, self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th occurrence (from 0): up from the last plane by select."""
        if token >> self.bits:
            raise IndexError(k)
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for plane in range(self.bits - 1, -1, -1):
            bit = self._bit(token, plane)
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def documents(self) -> tuple[list, np.ndarray]:
        """Document ids (null as None) and lengths, in file order."""
        at = int(self.places[-1, -1])
        ids, lengths = self.head["docs"]
        packed = zlib.decompress(self.file.read(at, ids))
        return json.loads(packed), np.frombuffer(zlib.decompress(self.file.read(at + ids, lengths)), "<u8")

    def tokens(self, token: int = 0, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in document order, and the rank of ``token`` at ``places``; each plane is read once."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        planes = [self._plane(k) for k in range(self.bits)]
        at = np.zeros(0, np.int64) if places is None else places.astype(np.int64)
        low = 0
        for k, plane in enumerate(planes):
            ones = _ones_before(plane, np.append(at, low))
            here = self.zeros[k] + ones if self._bit(token, k) else np.append(at, low) - ones
            at, low = here[:-1], int(here[-1])
        values = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):  # from the lowest plane up
            values[self.zeros[k] :] |= kind(1 << (self.bits - 1 - k))
            values = _joined(values, np.unpackbits(planes.pop())[: self.n].view(bool), self.zeros[k])
        return values, at - low


_STRETCH = 1 << 15  # ids moved at a time, so that the places of ones stay in the cache


def _parted(values: np.ndarray, ones: np.ndarray, zeros: int) -> np.ndarray:
    """The values without a one, then those with one, each in their order."""
    out, a, b = np.empty_like(values), 0, zeros
    for i in range(0, len(values), _STRETCH):
        here, one = values[i : i + _STRETCH], ones[i : i + _STRETCH]
        low, high = np.compress(~one, here), np.compress(one, here)
        out[a : a + len(low)], out[b : b + len(high)] = low, high
        a, b = a + len(low), b + len(high)
    return out


def _joined(values: np.ndarray, ones: np.ndarray, zeros: int) -> np.ndarray:
    """The order before ``_parted``."""
    out, a, b = np.empty_like(values), 0, zeros
    for i in range(0, len(values), _STRETCH):
        here, one = out[i : i + _STRETCH], ones[i : i + _STRETCH]
        low, high = np.flatnonzero(~one), np.flatnonzero(one)
        here[low], here[high] = values[a : a + len(low)], values[b : b + len(high)]
        a, b = a + len(low), b + len(high)
    return out


def shard_bytes(ids: np.ndarray, doc_ids: list, lengths: list[int], bits: int) -> Iterator[bytes]:
    """The parts of a shard file, one plane at a time."""
    blocks = -(-len(ids) // BLOCK)
    planes, zeros, values = [], [], ids
    table = np.zeros((bits, 2, blocks + 1), "<i8")
    squeeze, at = zstandard.ZstdCompressor(level=1), 0
    for k in range(bits):
        ones = (values & values.dtype.type(1 << (bits - 1 - k))) != 0
        raw = np.packbits(ones)
        raw = np.concatenate([raw, np.zeros(-len(raw) % _BYTES, np.uint8)])
        table[k, 0, 1:] = np.cumsum(np.bitwise_count(raw.view(np.uint64)).reshape(-1, _WORDS).sum(axis=1, dtype=np.int64))
        for b in range(blocks):
            block = raw[b * _BYTES : (b + 1) * _BYTES].tobytes()
            small = squeeze.compress(block)
            planes.append(small if len(small) < _WORTH * _BYTES else block)
            table[k, 1, b] = at
            at += len(planes[-1])
        table[k, 1, blocks] = at
        zeros.append(len(ids) - int(table[k, 0, -1]))
        values = _parted(values, ones, zeros[-1])
    names = zlib.compress(json.dumps(doc_ids).encode(), 1)
    sizes = zlib.compress(np.array(lengths, "<u8").tobytes(), 1)
    head = {"n": len(ids), "bits": bits, "zeros": zeros, "docs": [len(names), len(sizes)]}
    head = json.dumps(head).encode()
    yield MAGIC + struct.pack("<Q", len(head)) + head
    yield table.tobytes()
    yield from planes
    yield names
    yield sizes


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, kind: str, end_id: int, bits: int | None = None, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Write all documents in ascending order; one row a shard: ``path, start, n_docs, n_tokens``.

    Texts are dealt by ranges of ``doc_id``, tokenized and written by the task that holds
    them; ``start`` counts all ids before the shard. The rows are stored, so that a
    repeated task leaves at most a file that nothing names. ``bits`` planes hold an id; by
    default as many as the largest id of the vocabulary and the end id need.
    """
    needed = max(encoder(tokenizer, kind).largest, end_id).bit_length()
    bits = bits or needed
    if bits < needed:
        raise ValueError(f"ids of {tokenizer} need {needed} bits, not {bits}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer, kind), TaskContext.get().partitionId()
        store = np.uint16 if bits <= 16 else np.uint32
        before = held = 0
        parts: list[np.ndarray] = []
        names: list = []

        def flush() -> pa.RecordBatch:
            nonlocal before, held, parts, names
            path = f"{folder}/{task:05d}-{uuid.uuid4().hex}.wm"
            write_file(path, shard_bytes(np.concatenate(parts), names, [len(p) for p in parts], bits))
            row = [[task], [path], [before], [len(names)], [held]]
            before, held, parts, names = before + held, 0, [], []
            return pa.RecordBatch.from_arrays(
                [pa.array(v, pa.string() if i == 1 else pa.int64()) for i, v in enumerate(row)],
                ["task", "path", "before", "n_docs", "n_tokens"],
            )

        for part, texts in texts_in(batches, limit=4 << 20):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode.ids(texts)):
                whole = np.empty(len(ids) + 1, store)
                whole[:-1], whole[-1] = ids, end_id
                parts.append(whole)
                names.append(doc_id)
                held += len(parts[-1])
                if held >= shard_tokens:
                    yield flush()
        if parts:
            yield flush()

    # The place in the table parts equal ids, which else would all come to one task; no text is read to find the ranges.
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_at")]
    dealt = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_at"))
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    shards = staged(dealt.mapInArrow(run, "task long, path string, before long, n_docs long, n_tokens long"))
    # One row a task: as many as the shuffle has partitions.
    totals = shards.groupBy("task").agg(F.sum("n_tokens").alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("task").alias("_task"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    placed = shards.join(totals, F.col("task") == F.col("_task"))
    return placed.select("path", (F.col("before") + F.col("_ahead")).alias("start"), "n_docs", "n_tokens")


def read_documents(shards: DataFrame, count_id: int = 0) -> DataFrame:
    """Every document as its shard file has it: ``doc_id, start, n_tokens, ids_crc32, n_counted``.

    ``n_counted`` says how often ``count_id`` occurs in the document, by rank at its two ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = WaveletMatrix(row["path"])
                names, lengths = shard.documents()
                edges = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
                ids, ranks = shard.tokens(count_id, edges)
                shard.close()
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges.tolist(), edges[1:].tolist())]
                columns = [names, row["start"] + edges[:-1], np.diff(edges), sums, np.diff(ranks)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32", "n_counted"]
                )

    # A row stands for a whole file, so the files are dealt out one by one.
    files = shards.repartition(max(1, shards.count()))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_counted long")


def stored_documents(docs: DataFrame, tokenizer: str, kind: str, end_id: int, folder: str | None = None, count_id: int = 0) -> DataFrame:
    """Write the shards, to a new folder of the shared one if none is given, and read them back."""
    folder = folder or scratch_path(docs.sparkSession, "wavelet")
    return read_documents(staged(write_shards(docs, folder, tokenizer, kind, end_id)), count_id)
