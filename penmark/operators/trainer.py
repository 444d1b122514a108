"""Many linear models in one pass: every grid point, fold and class pair shares each reading of the vectors.

A *space* is a set of vectors with its own features, such as those of one fold. A *problem* is one
model over a space: softmax over all classes, a logistic model of two, or a smoothed hinge of one
pair. Every pass sends the coefficients of all unfinished problems to the tasks, which return the
losses and gradients of their rows; slices of these are summed by Spark, so no task or group holds
more than one slice of every partition. The driver moves each problem by its own limited-memory
quasi-Newton step, halving a step that does not lower the loss, and drops problems that are done.

Coefficients live on the driver and in a broadcast, so problems are taken in blocks of at most
``BLOCK_VALUES`` coefficients, neighbouring ``C`` first, each block starting from the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from penmark.session import staged

BLOCK_VALUES = 1 << 23  # 64 MB of coefficients at once
SLICE = 1 << 13  # values of a gradient in one row
HISTORY = 8
SMOOTH = 0.05  # width of the rounded corner of the hinge
TASK_CELLS = 1 << 22  # dense cells that a task of a pass reads at least
CHUNK = 1 << 21  # cells of a dense piece of rows


@dataclass(frozen=True)
class Problem:
    """``kind`` is softmax, logit or hinge; ``classes`` are codes, ``weights`` belong to them.

    The loss is averaged over the total weight, ``reg / 2`` times the squared weights is added;
    the intercepts are free. A logit or hinge model tells ``classes[0]`` (positive) from ``classes[1]``.
    """

    space: int
    size: int
    kind: str
    classes: tuple[int, ...]
    weights: tuple[float, ...]
    total: float
    reg: float

    @property
    def columns(self) -> int:
        return len(self.classes) if self.kind == "softmax" else 1


def _dense(rows: list, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Pieces of sparse rows as dense ones with a last column of ones."""
    step = max(1, CHUNK // (size + 1))
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        out = np.zeros((len(part), size + 1))
        for k, (idx, value) in enumerate(part):
            out[k, idx] = value
        out[:, size] = 1.0
        yield a, a + len(part), out


def _loss(problem: Problem, z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss of rows with margins ``z``, and its derivative by them."""
    place = np.full(max(problem.classes) + 1, -1)
    place[list(problem.classes)] = np.arange(len(problem.classes))
    at = np.where(y < len(place), place[np.minimum(y, len(place) - 1)], -1)
    used = at >= 0
    w = np.where(used, np.array(problem.weights)[at], 0.0) / problem.total
    if problem.kind == "softmax":
        z = z - z.max(axis=1, keepdims=True)
        e = np.exp(z)
        p = e / e.sum(axis=1, keepdims=True)
        own = np.arange(len(y)), np.maximum(at, 0)
        loss = np.log(e.sum(axis=1)) - z[own]
        p[own] -= 1.0
        return float((w * loss).sum()), p * w[:, None]
    sign = np.where(at == 0, 1.0, -1.0)
    margin = sign * z[:, 0]
    if problem.kind == "logit":
        loss, slope = np.logaddexp(0.0, -margin), -1.0 / (1.0 + np.exp(np.minimum(margin, 700)))
    else:
        gap = 1.0 - margin
        loss = np.where(gap >= SMOOTH, gap - SMOOTH / 2, np.maximum(gap, 0.0) ** 2 / (2 * SMOOTH))
        slope = -np.clip(gap / SMOOTH, 0.0, 1.0)
    return float((w * loss).sum()), (w * slope * sign)[:, None]


def _by_space(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list, list[list]]]:
    """Rows of a task by space: their sparse cells and the other columns."""
    for batch in batches:
        spaces = batch.column("space").to_numpy()
        idx, values = batch.column("indices"), batch.column("values")
        other = [batch.column(c).to_pylist() for c in columns]
        for space in np.unique(spaces).tolist():
            here = np.flatnonzero(spaces == space).tolist()
            rows = [(idx[k].values.to_numpy(), values[k].values.to_numpy()) for k in here]
            yield space, rows, [[c[k] for k in here] for c in other]


def _gradients(rows: DataFrame, problems: list[Problem], points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Loss and gradient of every problem at its point, in one reading of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast((problems, points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, at = shared.value
        by_space: dict[int, tuple] = {}
        for space, cells, (ys,) in _by_space(batches, ["y"]):
            if space not in by_space:
                mine = [k for k, p in enumerate(asked) if p.space == space]
                w = np.concatenate([at[k] for k in mine], axis=1) if mine else None
                by_space[space] = mine, np.cumsum([0, *[asked[k].columns for k in mine]]), w, np.zeros(len(mine)), 0.0 if w is None else np.zeros(w.shape)
            mine, edges, w, losses, grad = by_space[space]
            if not mine:
                continue
            y = np.array(ys, np.int64)
            for a, b, x in _dense(cells, asked[mine[0]].size):
                z = x @ w
                slopes = np.empty_like(z)
                for j, (k, lo, hi) in enumerate(zip(mine, edges, edges[1:])):
                    loss, slopes[:, lo:hi] = _loss(asked[k], z[:, lo:hi], y[a:b])
                    losses[j] += loss
                grad += x.T @ slopes
        for space, (mine, _, _, losses, grad) in by_space.items():
            if not mine:
                continue
            flat = np.concatenate([losses, grad.ravel()])
            for s in range(0, len(flat), SLICE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([space], pa.int32()), pa.array([s], pa.int64()), pa.array([flat[s : s + SLICE]])], ["space", "slice", "part"]
                )

    def summed(table: pa.Table) -> pa.Table:
        part = np.sum([g.values.to_numpy() for g in table.column("part")], axis=0)
        head = table.slice(0, 1)
        return pa.table({"space": head.column("space"), "slice": head.column("slice"), "part": pa.array([part])})

    # A space's losses and gradients are one array, so there are few slices however many problems share it.
    schema = "space int, slice long, part array<double>"
    parts = rows.mapInArrow(run, schema).groupBy("space", "slice").applyInArrow(summed, schema).toArrow()
    members: dict[int, list[int]] = {}
    for k, p in enumerate(problems):
        members.setdefault(p.space, []).append(k)
    flats = {space: np.zeros(sum(1 + points[k].size for k in mine)) for space, mine in members.items()}
    for space, s, part in zip(*(parts.column(c) for c in ("space", "slice", "part"))):
        at, values = s.as_py(), part.values.to_numpy()
        flats[space.as_py()][at : at + len(values)] = values
    shared.unpersist()
    result: list = [None] * len(problems)
    for space, mine in members.items():
        losses, grads = flats[space][: len(mine)], flats[space][len(mine) :].reshape(problems[mine[0]].size + 1, -1)
        edges = np.cumsum([0, *[problems[k].columns for k in mine]])
        for k, loss, lo, hi in zip(mine, losses, edges, edges[1:]):
            free = points[k].copy()
            free[-1] = 0.0  # the intercepts
            reg = problems[k].reg
            result[k] = float(loss) + reg / 2 * float((free**2).sum()), grads[:, lo:hi] + reg * free
    return result


class _Walk:
    """One problem's quasi-Newton walk."""

    def __init__(self, start: np.ndarray):
        self.x, self.f, self.g = start, np.inf, None
        self.trial, self.step, self.move = start, 1.0, None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.done, self.halved = False, 0

    def _direction(self) -> np.ndarray:
        q, kept = self.g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            kept.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(self.pairs, reversed(kept)):
            q += s * (a - (y * q).sum() / (s * y).sum())
        return -q

    def take(self, f: float, g: np.ndarray, tol: float) -> None:
        """The loss and gradient at ``trial``; sets the next trial, or ``done``."""
        if self.g is not None and not f <= self.f + 1e-4 * self.step * (self.move * self.g).sum():
            self.step, self.halved = self.step / 2, self.halved + 1
            if self.halved > 25:
                self.done = True
            self.trial = self.x + self.step * self.move
            return
        if self.g is not None:
            s, y = self.trial - self.x, g - self.g
            if (s * y).sum() > 1e-12 * (y * y).sum():
                self.pairs = [*self.pairs, (s, y)][-HISTORY:]
            small = self.f - f <= tol * max(abs(f), 1e-12)
        else:
            small = False
        self.x, self.f, self.g = self.trial, f, g
        if small or np.abs(g).max() <= tol * 1e-2:
            self.done = True
            return
        self.move = self._direction()
        if (self.move * g).sum() >= 0:
            self.pairs, self.move = [], -g
        # Without curvature yet, the first step is of unit length.
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / max(np.sqrt((g * g).sum()), 1e-12))
        self.halved = 0
        self.trial = self.x + self.step * self.move


def _gathered(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """The rows written once, in no more tasks than their cells are worth; every pass reads them again."""
    rows = staged(rows.select("space", "y", "indices", "values"))
    counted = rows.groupBy("space").count().collect()
    cells = sum(r["count"] * (sizes.get(r["space"], 0) + 1) for r in counted)
    return rows.coalesce(max(1, -(-cells // TASK_CELLS)))


def fit_many(rows: DataFrame, problems: list[Problem], max_iter: int = 100, tol: float = 1e-4) -> list[np.ndarray]:
    """Coefficients of every problem, ``[size + 1, columns]`` with the intercepts last.

    ``rows`` hold ``space, y, indices, values``: the rows to fit on, ``y`` as class codes.
    """
    rows = _gathered(rows, {p.space: p.size for p in problems})
    order = sorted(range(len(problems)), key=lambda k: -problems[k].reg)
    fitted: dict[int, np.ndarray] = {}
    last: dict[tuple, np.ndarray] = {}
    while order:
        block, held = [], 0
        while order and (not block or held + (problems[order[0]].size + 1) * problems[order[0]].columns <= BLOCK_VALUES):
            block.append(order.pop(0))
            held += (problems[block[-1]].size + 1) * problems[block[-1]].columns
        like = lambda p: (p.space, p.kind, p.classes)
        walks = {k: _Walk(last.get(like(problems[k]), np.zeros((problems[k].size + 1, problems[k].columns)))) for k in block}
        for _ in range(max_iter):
            todo = [k for k in block if not walks[k].done]
            if not todo:
                break
            for k, (f, g) in zip(todo, _gradients(rows, [problems[k] for k in todo], [walks[k].trial for k in todo])):
                walks[k].take(f, g, tol)
        for k in block:
            fitted[k] = last[like(problems[k])] = walks[k].x
    return [fitted[k] for k in range(len(problems))]


@dataclass(frozen=True)
class Voter:
    """One classifier of a space: its problems and their coefficients, told by ``point``."""

    point: int
    space: int
    n_classes: int
    problems: tuple[Problem, ...]
    fitted: tuple[np.ndarray, ...]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The class of each row: the largest margin, or most votes; the earlier class on a tie."""
        if not self.problems:
            return np.zeros(len(x), np.int64)
        if self.problems[0].kind == "softmax":
            return np.argmax(x @ self.fitted[0], axis=1)
        votes = np.zeros((len(x), self.n_classes), np.int64)
        for p, w in zip(self.problems, self.fitted):
            said = (x @ w)[:, 0] > 0
            votes[:, p.classes[0]] += said
            votes[:, p.classes[1]] += ~said
        return np.argmax(votes, axis=1)


def predict_many(rows: DataFrame, voters: list[Voter], sizes: dict[int, int]) -> DataFrame:
    """``space, speech_id, y_true, grid_idx, code`` of every row by every classifier of its space, in one reading."""
    shared = rows.sparkSession.sparkContext.broadcast((voters, sizes))
    names = ["space", "speech_id", "y_true", "grid_idx", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said, size = shared.value
        for space, cells, (ids, ys) in _by_space(batches, ["speech_id", "y_true"]):
            for a, b, x in _dense(cells, size[space]):
                for v in said:
                    if v.space == space:
                        columns = [pa.array(np.full(b - a, space), pa.int32()), pa.array(ids[a:b], pa.string()), pa.array(ys[a:b], pa.string())]
                        columns += [pa.array(np.full(b - a, v.point), pa.int32()), pa.array(v.codes(x), pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, names)

    rows = rows.select("space", F.col("speech_id").cast("string"), "y_true", "indices", "values")
    return rows.mapInArrow(run, "space int, speech_id string, y_true string, grid_idx int, code int")
