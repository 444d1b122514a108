"""Deterministic automata over bytes: rule patterns compiled by subset construction and minimised.

Patterns know literals, escapes (also ``\\xHH``), classes, groups, ``|``, ``?``, ``*`` and ``+``, all over
ASCII; anything else in a pattern is an error. There are no back references and no lazy repeats:
a pattern stands for a set of byte strings.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

ANY = frozenset(range(256))


class _Nfa:
    """States with edges on byte sets and empty edges, one fragment after another."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen = set(states)
        stack = list(seen)
        while stack:
            for to in self.empty[stack.pop()]:
                if to not in seen:
                    seen.add(to)
                    stack.append(to)
        return frozenset(seen)


class _Pattern:
    """Recursive descent over one pattern; each part becomes a fragment ``(first, last)``."""

    def __init__(self, nfa: _Nfa, text: str, any_case: bool):
        self.nfa, self.text, self.any_case, self.at = nfa, text, any_case, 0

    def whole(self) -> tuple[int, int]:
        out = self.either()
        if self.at < len(self.text):
            raise ValueError(f"pattern {self.text!r}: unexpected {self.text[self.at]!r}")
        return out

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        char = self.peek()
        if not char or ord(char) > 127:
            raise ValueError(f"pattern {self.text!r}: ends early or is not ASCII")
        self.at += 1
        return char

    def either(self) -> tuple[int, int]:
        first, last = self.nfa.state(), self.nfa.state()
        while True:
            a, b = self.sequence()
            self.nfa.empty[first].append(a)
            self.nfa.empty[b].append(last)
            if self.peek() != "|":
                return first, last
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        first = last = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            self.nfa.empty[last].append(a)
            last = b
        return first, last

    def repeated(self) -> tuple[int, int]:
        a, b = self.atom()
        while self.peek() and self.peek() in "?*+":
            sign, first, last = self.take(), self.nfa.state(), self.nfa.state()
            self.nfa.empty[first].append(a)
            self.nfa.empty[b].append(last)
            if sign in "?*":
                self.nfa.empty[first].append(last)
            if sign in "*+":
                self.nfa.empty[b].append(a)
            a, b = first, last
        return a, b

    def atom(self) -> tuple[int, int]:
        char = self.take()
        if char == "(":
            out = self.either()
            if self.take() != ")":
                raise ValueError(f"pattern {self.text!r}: group without end")
            return out
        if char in "?*+{}^$.":
            raise ValueError(f"pattern {self.text!r}: {char!r} is not known here")
        chars = self.members() if char == "[" else frozenset([self.escaped() if char == "\\" else ord(char)])
        first, last = self.nfa.state(), self.nfa.state()
        self.nfa.edges[first].append((self.cased(chars), last))
        return first, last

    def escaped(self) -> int:
        char = self.take()
        if char == "x":
            return int(self.take() + self.take(), 16)
        if char.isalnum():
            raise ValueError(f"pattern {self.text!r}: unknown escape {char!r}")
        return ord(char)

    def members(self) -> frozenset[int]:
        chars: set[int] = set()
        while (char := self.take()) != "]":
            low = self.escaped() if char == "\\" else ord(char)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                char = self.take()
                chars.update(range(low, (self.escaped() if char == "\\" else ord(char)) + 1))
            else:
                chars.add(low)
        return frozenset(chars)

    def cased(self, chars: frozenset[int]) -> frozenset[int]:
        if not self.any_case:
            return chars
        letters = {c for c in chars if 65 <= c & ~32 <= 90}
        return chars | {c ^ 32 for c in letters}


@dataclass(frozen=True)
class Automaton:
    """``table[state, byte]`` is the next state; ``accepts[state]`` has a bit for each pattern that ends there.

    ``idle[state]`` says that no match that has begun is still alive: only the start is.
    State 0 is the start.
    """

    table: np.ndarray
    accepts: np.ndarray
    idle: np.ndarray

    def rows(self) -> list[list]:
        """The transition array for the byte loop: each row holds the rows it leads to, then its accept bits and idle flag."""
        rows: list[list] = [[] for _ in range(len(self.table))]
        for row, to, accepts, idle in zip(rows, self.table.tolist(), self.accepts.tolist(), self.idle.tolist()):
            row.extend(rows[k] for k in to)
            row += [accepts, idle]
        return rows


def _byte_classes(sets: Iterable[frozenset[int]]) -> np.ndarray:
    """Bytes that no set tells apart have one number."""
    kinds = np.zeros(256, np.int64)
    for chars in sets:
        inside = np.zeros(256, np.int64)
        inside[list(chars)] = 1
        kinds = np.unique(kinds * 2 + inside, return_inverse=True)[1]
    return kinds


def _subsets(nfa: _Nfa, first: list[int], ends: list[int], anywhere: bool) -> Automaton:
    """Subset construction; with ``anywhere`` every place starts a match."""
    kinds = _byte_classes(chars for edges in nfa.edges for chars, _ in edges)
    begin = nfa.closure(first)
    sample = [int(np.flatnonzero(kinds == k)[0]) for k in range(kinds.max() + 1)]
    number, order, moves = {begin: 0}, [begin], []
    for states in order:
        row = []
        for byte in sample:
            to = nfa.closure(t for s in states for chars, t in nfa.edges[s] if byte in chars)
            to = to | begin if anywhere else to
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        moves.append(row)
    accepts = [sum(1 << r for r, end in enumerate(ends) if end in states) for states in order]
    return Automaton(np.array(moves)[:, kinds], np.array(accepts, np.int64), np.array([s == begin for s in order]))


def _minimised(made: Automaton) -> Automaton:
    """States that no byte string tells apart become one, by refining the partition until it holds."""
    block = np.unique(np.stack([made.accepts, made.idle.astype(np.int64)]), axis=1, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[made.table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    # Blocks are numbered by their first state, so the start keeps 0.
    first = np.unique(block, return_index=True)[1]
    order = np.argsort(first)
    renumber = np.empty_like(order)
    renumber[order] = np.arange(len(order))
    keep = first[order]
    return Automaton(renumber[block[made.table[keep]]], made.accepts[keep], made.idle[keep])


def compiled(patterns: list[tuple[str, bool]], anywhere: bool) -> Automaton:
    """One minimal automaton for all ``(pattern, any_case)``; at most 62 of them."""
    if not 0 < len(patterns) <= 62:
        raise ValueError("between 1 and 62 patterns")
    nfa = _Nfa()
    parts = [_Pattern(nfa, text, any_case).whole() for text, any_case in patterns]
    return _minimised(_subsets(nfa, [a for a, _ in parts], [b for _, b in parts], anywhere))


class Anchored:
    """One pattern matched from a given place."""

    def __init__(self, pattern: str, any_case: bool):
        self.made = compiled([(pattern, any_case)], anywhere=False)
        self.rows = self.made.rows()
        # A state that leads only to itself and accepts nothing ends the walk.
        table = self.made.table
        dead = (table == np.arange(len(table))[:, None]).all(axis=1) & (self.made.accepts == 0)
        self.dead = {id(self.rows[k]) for k in np.flatnonzero(dead).tolist()}

    def ends(self, data: bytes, start: int, stop: int) -> list[int]:
        """Ends of all matches that begin at ``start``, ascending; nothing past ``stop`` is read."""
        row, out = self.rows[0], []
        for i in range(start, stop):
            row = row[data[i]]
            if row[256]:
                out.append(i + 1)
            elif id(row) in self.dead:
                break
        return out

    def longest(self, data: bytes, start: int, failed: list[tuple[int, list]]) -> int:
        """End of the longest match that begins at ``start``; 0 if there is none.

        ``failed`` holds the last walk that ended without a match. A walk that meets it in one
        state at one place ends the same way, so many failing beginnings cost one walk.
        """
        row, end, trail = self.rows[0], 0, []
        before, states = failed[0] if failed else (start, [])
        for i in range(start, len(data)):
            row = row[data[i]]
            if row[256]:
                end = i + 1
            elif id(row) in self.dead:
                break
            elif not end:
                if i - before < len(states) and states[i - before] is row:
                    return 0
                trail.append(row)
        if not end and len(trail) > 8:
            failed[:] = [(start, trail)]
        return end

    def begins_with(self, other: Anchored) -> bool:
        """Whether every match of this pattern begins with a match of the other: a walk over pairs of states."""
        seen, stack = {(0, 0)}, [(0, 0)]
        while stack:
            a, b = stack.pop()
            if other.made.accepts[b]:
                continue
            if self.made.accepts[a]:
                return False
            for pair in set(zip(self.made.table[a].tolist(), other.made.table[b].tolist())):
                if pair not in seen:
                    seen.add(pair)
                    stack.append(pair)
        return True
