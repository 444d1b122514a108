"""URL rules by a sort-merge range join over reversed-host keys.

A host written from its last label, each label with a dot after it, turns "this host and
its subdomains" into an interval of keys. Rules and urls are dealt by ranges of the key and
sorted; one sweep over a range keeps the rules whose interval is open on a stack, which
are the rules of the url's host and its parents, from outer to inner.

Defined results: a null url, or one without ``://``, has an empty host and path and no
rule; a rule needs a host; of equal rules with different verdicts the blocking one counts;
repeated rows are judged alike; other columns are ignored. Of the rules that fit, the one
with the longest text (host and path) wins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SAMPLED_KEYS = 20_000  # keys drawn to place the range bounds; the bounds decide no verdict


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of an url; both empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _bounds(keys: DataFrame, parts: int) -> list[tuple[str, int]]:
    """Upper bounds ``(key, salt)`` of all ranges but the last, from a bounded draw of keys."""
    share = SAMPLED_KEYS / max(1, keys.count())
    lucky = F.pmod(F.xxhash64("salt", "key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    drawn = keys.where(lucky).limit(2 * SAMPLED_KEYS).collect()
    drawn = sorted((row["key"], row["salt"]) for row in drawn)
    return sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", parts: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each page; ``rules`` has ``host, path, verdict``.

    A range holds the rules whose interval touches it: those that begin in it, and the
    parents of its first key, which are no more than a host has labels. An url that is
    very common is spread over ranges by a salt.
    """
    parts = parts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.xxhash64("page_id", "url").alias("salt"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    bounds = _bounds(rows.select("key", "salt"), parts)
    lows = [""] + [b[0] for b in bounds]

    def place_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(bounds, p) for p in pairs], pa.int32())], [*batch.schema.names, "part"])

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                # From the range that can hold the first such key to that of the last.
                first = max(0, bisect_left(lows, row["key"]) - 1)
                last = bisect_left(lows, row["key"][:-1] + "/") - 1 if row["key"] else len(lows) - 1
                out += [row | {"part": part} for part in range(first, max(first, last) + 1)]
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema.append(pa.field("part", pa.int32())))

    known = rules.where("host is not null and host <> '' and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.select(F.lit(None).cast("long").alias("page_id"), "host", "path", F.lit(0).cast("long").alias("salt"), host_key(F.col("host")).alias("key"), "verdict")
    fields = "page_id long, host string, path string, salt long, key string"
    known = known.mapInArrow(place_rules, f"{fields}, verdict string, part int")
    rows = rows.select(F.col("page_id").cast("long"), "host", "path", "salt", "key").mapInArrow(place_pages, f"{fields}, part int")
    events = known.unionByName(rows.withColumn("verdict", F.lit(None).cast("string")))
    # Rules sort before the urls of their key, and outer hosts before inner ones.
    events = events.repartition(len(lows), "part").sortWithinPartitions("part", "key", F.col("verdict").isNull(), "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, str, str]] = []
        part = None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["part"] != part:
                    stack, part = [], row["part"]
                while stack and not row["key"].startswith(stack[-1][0]):
                    stack.pop()
                if row["verdict"] is not None:
                    stack.append((row["key"], row["path"], row["host"] + row["path"], row["verdict"]))
                    continue
                fits = [r for r in stack if row["path"].startswith(r[1])]
                best = max(fits, key=lambda r: (len(r[2]), r[2]), default=None)
                out.append((row["page_id"], row["host"], row["path"], best and best[2], best[3] if best else default))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "host", "path", "rule", "verdict"])

    return events.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
