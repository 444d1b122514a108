"""Secret scans: the rules of all kinds compiled into one automaton that reads each text once, byte by byte.

Each rule has a probe, a pattern that every match of the rule begins with (proved when the rules
are compiled). The probes of all rules become one minimal automaton; with whole patterns instead,
its states would be nearly the product of the rules', 35,000 for the ten below. Between two places
where no probe is alive lies a stretch; in a stretch where a probe ended, the automaton of that rule
completes the leftmost longest matches that do not overlap, each kind by itself. A match whose
value is shorter than the rule asks is dropped, but its characters stay used.

Defined results: a null or empty text has no spans; spans count code points, the end is
exclusive; spans of different kinds may overlap; equal rows give equal spans and every row is
kept; a null ``doc_id`` stays null; an empty table gives an empty one; columns other than
``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from penmark.llm.automaton import Anchored, compiled
from penmark.llm.common import texts_in


@dataclass(frozen=True)
class Rule:
    """``head`` then ``value``; the value, after the longest head that leaves a match, needs ``least`` characters.

    Every match begins with a match of ``probe``; the more it asks, the fewer places are read again.
    """

    kind: str
    head: str
    value: str
    least: int
    probe: str
    any_case: bool = False


_ASSIGNED = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"
_USER = "://[A-Za-z0-9._~%+-]+:"
_HEX = "[0-9a-f]"
#: The three base rules, then further well-known forms of keys.
BASE = (
    Rule("assign", _ASSIGNED + "\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 6, _ASSIGNED, any_case=True),
    Rule("access", "", "AKIA[A-Z0-9]+", 20, "AKIA[A-Z0-9]"),
    # Shorter runs are dropped in any case, so the pattern asks for the whole length.
    Rule("hex", "", _HEX * 24 + _HEX + "*", 24, _HEX * 24),
)
RULES = BASE + (
    Rule("pem", "", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 1, "-----BEGIN "),
    Rule("webtoken", "", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 30, "eyJ[A-Za-z0-9_-]"),
    Rule("forge", "", "gh[pousr]_[A-Za-z0-9]+", 40, "gh[pousr]_"),
    Rule("chat", "", "xox[abprs]-[A-Za-z0-9-]+", 15, "xox[abprs]-"),
    Rule("pay", "", "[rs]k_(live|test)_[A-Za-z0-9]+", 24, "[rs]k_(live|test)_"),
    Rule("cloud", "", "AIza[A-Za-z0-9_-]+", 39, "AIza"),
    Rule("login", _USER, "[A-Za-z0-9._~%!$&*+,;=-]+@", 2, "://[A-Za-z0-9._~%+-]"),
)


class Scanner:
    """All rules over one text after another."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.probes = compiled([(r.probe, r.any_case) for r in rules], anywhere=True).rows()
        self.whole = [Anchored(r.head + r.value, r.any_case) for r in rules]
        self.head = [Anchored(r.head, r.any_case) if r.head else None for r in rules]
        self.value = [Anchored(r.value, r.any_case) for r in rules]
        for rule, whole in zip(rules, self.whole):
            if not whole.begins_with(Anchored(rule.probe, rule.any_case)):
                raise ValueError(f"a match of {rule.kind} need not begin with its probe")

    def _stretches(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """``(start, end, rules)`` of stretches between idle places in which some probe ended."""
        row, begin, hit = self.probes[0], 0, 0
        for i, byte in enumerate(data):
            row = row[byte]
            if row[257]:
                if hit:
                    yield begin, i, hit
                    hit = 0
                begin = i + 1
            elif row[256]:
                hit |= row[256]
        if hit:
            yield begin, len(data), hit

    def _value_start(self, r: int, data: bytes, start: int, end: int) -> int:
        if self.head[r] is None:
            return start
        heads = self.head[r].ends(data, start, end)
        return next(h for h in reversed(heads) if end in self.value[r].ends(data, h, end))

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(start, rule, end)`` in code points, sorted."""
        data = (text or "").encode("utf-8", "surrogatepass")
        found, used = [], [0] * len(self.rules)
        for begin, stop, hit in self._stretches(data):
            for r, rule in enumerate(self.rules):
                if not hit >> r & 1:
                    continue
                at, failed = max(begin, used[r]), []
                while at < stop:
                    end = self.whole[r].longest(data, at, failed)
                    if end and end - self._value_start(r, data, at, end) >= rule.least:
                        found.append((at, r, end))
                    at = used[r] = end or at + 1
        if found and len(data) != len(text):
            # Bytes to code points: what begins a character is counted once.
            points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
            found = [(int(points[a]), r, int(points[b])) for a, r, b in found]
        return sorted(found)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: ``doc_id``, and ``spans``, an array of ``{kind, start, end}`` by start, then rule."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for part, texts in texts_in(batches):
            spans = [[{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in scanner.spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def listed(spans, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` of the spans, comma-joined; with ``kinds``, of those kinds alone."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
