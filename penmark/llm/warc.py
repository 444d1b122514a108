"""Web archives and their two-level capture index.

``write_archives`` writes one gzip member a record. ``build_index`` sorts the captures by
reversed-host key into compressed blocks of lines; each index file ends with a sparse
directory, the first key and byte range of each block, and the table of index files has
the first and last key of each. A lookup searches the table, then a directory, then one
block, by halving, before it reads the byte range of a record.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the largest
``page_id`` holds the payload; the others are revisit records that refer to it.

Defined results: a null html is an empty payload; a null url has an empty key and no target
line; control characters in an url are written as percent codes; a null ``page_id`` is
written as none, counts as smaller than any id and comes back null; repeated rows are
records of their own, and all rows with the largest id of a group are responses; an empty
table gives no files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from penmark.llm.common import RangeReader, texts_in, write_file
from penmark.session import scratch_path, staged

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20  # an archive is closed at the first record end past this size
BLOCK_LINES = 3000
SEGMENT_BYTES = 16 << 20  # records of one stretch of an archive are read by one task
_SAFE = re.compile(r"[\x00-\x20\x7f]")
ENTRY = "key string, page_id long, url string, path string, offset long, length long"


def capture_key(url: str | None) -> str:
    """``https://www.Example.com/a?b`` as ``com,example,www)/a?b``."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    cut = re.search(r"[/?#]", rest)
    host, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "/")
    return ",".join(reversed(host.lower().split("."))) + ")" + path.split("#", 1)[0]


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, refers_to``; ``refers_to`` is set for revisits.

    Only digests are grouped; a payload that a third of all pages share is one row there,
    and the join splits its large side.
    """
    body = payload(F.col("html"))
    rows = pages.select(
        F.col("page_id").cast("long"), "url", "html", F.octet_length(body).cast("long").alias("size"),
        F.sha1(body).alias("digest"), F.sha2(body, 256).alias("check"),
    )
    groups = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "check").agg(
        F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("k")
    )
    groups = groups.where("k > 1").drop("k")
    rows = rows.join(groups, ["digest", "check"], "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    return rows.select("page_id", "url", "html", "digest", F.when(other, F.col("first_id")).alias("refers_to"))


def _record(row: dict, date: str) -> bytes:
    data = (row["html"] or "").encode("utf-8", "surrogatepass")
    name = lambda page: f"<urn:x-page:{'none' if page is None else page}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
    again = row["refers_to"] is not None
    block = http if again else http + data
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {name(row['page_id'])}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + _SAFE.sub(lambda m: f"%{ord(m[0]):02X}", row["url"]))
    if again:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {name(row['refers_to'])}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parse_record(raw: bytes) -> dict:
    """Type, ids, digest and payload of one gzip member; a response's payload must fit its digest."""
    head, _, block = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    page = lambda name: None if name.endswith(":none>") else int(name.rsplit(":", 1)[1][:-1])
    http, _, data = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(data) != size or hashlib.sha1(data).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
        "payload_digest": digest, "record_type": kind,
        "refers_to": page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload": data if kind == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every page as a record; one row a capture, stored: key, page, file and byte range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rows = (row for part, _ in texts_in(batches, "html") for row in part.to_pylist())
        row = next(rows, None)
        while row is not None:
            path, entries = f"{folder}/{task:05d}-{uuid.uuid4().hex}.warc.gz", []

            def records() -> Iterator[bytes]:
                nonlocal row
                at = 0
                while row is not None and at < ARCHIVE_BYTES:
                    raw = _record(row, date)
                    entries.append((capture_key(row["url"]), row["page_id"], row["url"], path, at, len(raw)))
                    at += len(raw)
                    row = next(rows, None)
                    yield raw

            write_file(path, records())
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            names = ["key", "page_id", "url", "path", "offset", "length"]
            for i in range(0, len(entries), 10_000):
                columns = zip(*entries[i : i + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return staged(with_revisits(pages).mapInArrow(run, ENTRY))


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index files; one row a file, stored: ``path, first_key, last_key, n_blocks, n_lines``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.idx"
        rows = (row for batch in batches for row in batch.to_pylist())
        first = next(rows, None)
        if first is None:
            return
        directory, last, lines = [], [""], [0]

        def blocks() -> Iterator[bytes]:
            held, at, row = [], 0, first
            while row is not None:
                held.append(row)
                row = next(rows, None)
                if len(held) == block_lines or row is None:
                    raw = zlib.compress("\n".join(json.dumps(list(r.values())) for r in held).encode(), 6)
                    directory.append((held[0]["key"], at, len(raw)))
                    last[0], lines[0], at = held[-1]["key"], lines[0] + len(held), at + len(raw)
                    held = []
                    yield raw
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            yield tail
            yield len(tail).to_bytes(8, "little")

        write_file(path, blocks())
        row = {"path": path, "first_key": first["key"], "last_key": last[0], "n_blocks": len(directory), "n_lines": lines[0]}
        yield pa.RecordBatch.from_pylist([row])

    order = ["key", "page_id", "path", "offset"]
    dealt = captures.select(*[f.split()[0] for f in ENTRY.split(", ")]).repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(dealt.mapInArrow(run, "path string, first_key string, last_key string, n_blocks long, n_lines long"))


class IndexFile:
    """One index file: its directory is read once, its blocks when a key needs them."""

    def __init__(self, url: str):
        self.file = RangeReader(url)
        size = self.file.size()
        tail = int.from_bytes(self.file.read(size - 8, 8), "little")
        self.directory = json.loads(zlib.decompress(self.file.read(size - 8 - tail, tail)))
        self.keys = [block[0] for block in self.directory]

    def block(self, n: int) -> list[list]:
        _, offset, length = self.directory[n]
        return [json.loads(line) for line in zlib.decompress(self.file.read(offset, length)).decode().split("\n")]

    def find(self, key: str) -> list[list]:
        """The captures of a key: the blocks that can hold it, and in them its lines."""
        out = []
        for n in range(max(0, bisect_left(self.keys, key) - 1), bisect_right(self.keys, key)):
            lines = self.block(n)
            keys = [line[0] for line in lines]
            out += lines[bisect_left(keys, key) : bisect_right(keys, key)]
        return out

    def close(self) -> None:
        self.file.close()


def _entry_batch(lines: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines) if lines else [[]] * 6, kinds)], names)


def all_captures(index: DataFrame) -> DataFrame:
    """Every line of the index, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                file = IndexFile(path)
                for n in range(len(file.directory)):
                    yield _entry_batch(file.block(n))
                file.close()

    return index.repartition(max(1, index.count())).mapInArrow(run, ENTRY)


def lookup(index: DataFrame, urls: DataFrame) -> DataFrame:
    """The captures of each url of ``urls`` (column ``url``).

    The table of index files, one row a task that wrote the index, goes to every task;
    keys are dealt to the files that can hold them.
    """
    files = sorted((r["first_key"], r["last_key"], r["path"]) for r in index.collect())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [f[0] for f in files], [f[1] for f in files]
        for batch in batches:
            keys = [capture_key(url) for url in batch.column("url").to_pylist()]
            found = [(files[i][2], key) for key in keys for i in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            columns = list(zip(*found)) if found else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["file", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    if file:
                        file.close()
                    file, name = IndexFile(row["file"]), row["file"]
                yield _entry_batch(file.find(row["key"]))

    asked = urls.select("url").distinct().mapInArrow(route, "file string, key string").distinct()
    return asked.repartition("file", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("file", "key").mapInArrow(search, ENTRY)


def read_records(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """Each capture's record by its byte range, in stretches of an archive."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" if with_payload else ""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    names = names if with_payload else names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name = None, None
        for batch in batches:
            rows = batch.to_pylist()
            for i in range(0, len(rows), 256):
                out = []
                for row in rows[i : i + 256]:
                    if row["path"] != name:
                        if file:
                            file.close()
                        file, name = RangeReader(row["path"]), row["path"]
                    out.append(parse_record(file.read(row["offset"], row["length"])))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names)

    total = captures.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / F.lit(SEGMENT_BYTES))
    # The number of tasks follows the archives, not the few bytes of the index lines.
    dealt = captures.repartition(max(1, -(-total // (SEGMENT_BYTES // 4))), "path", stretch)
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(run, schema)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives and index, to a new folder of the shared one if none is given, and read all back through the index."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    index = build_index(write_archives(pages, folder), folder)
    return read_records(staged(all_captures(index)))
