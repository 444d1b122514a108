"""Learners over sparse feature vectors: grids, class weights, fit and predict, SVD."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from penmark.operators import kernels, trainer
from penmark.session import staged

LEARNERS = ["lr", "rf", "svm"]
SEED = 42

# The parameter grids. Order is the tie order of the search.
DECADES = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]
TREES = [10, 50, 100, 150, 200, 350, 500]
WEIGHTS = [True, False]


def full_grid(learner: str) -> list[dict]:
    """Every parameter combination of a learner."""
    if learner == "rf":
        return [
            {"balanced": w, "impurity": i, "n_trees": n} for w, i, n in product(WEIGHTS, ["gini", "entropy"], TREES)
        ]
    if learner == "lr":
        return [{"C": c, "balanced": w} for c, w in product(DECADES, WEIGHTS)]
    if learner == "svm":
        return [{"C": c, "balanced": w, "kernel": k} for c, w, k in product(DECADES, WEIGHTS, kernels.KERNELS)]
    raise ValueError(f"learner must be one of {LEARNERS}")


def class_sizes(train: DataFrame) -> dict[str, int]:
    """Rows per class in alphabetic order; a class list is small by nature."""
    return {r["y"]: r["count"] for r in train.groupBy("y").count().orderBy("y").collect()}


def class_weights(sizes: dict[str, int], balanced: bool) -> dict[str, float]:
    """n / (k n_c) for balanced classes, else 1."""
    n, k = sum(sizes.values()), len(sizes)
    return {y: n / (k * s) if balanced else 1.0 for y, s in sizes.items()}


def _by_class(values: list, y: Column, labels: list[str]) -> Column:
    return F.get(F.lit(values), F.array_position(F.lit(labels), y).cast("int") - 1)


def _prepared(rows: DataFrame, labels: list[str], weights: dict[str, float]) -> DataFrame:
    return rows.withColumn("_label", _by_class([float(i) for i in range(len(labels))], F.col("y"), labels)).withColumn(
        "_weight", _by_class([weights[y] for y in labels], F.col("y"), labels)
    )


_COLUMNS = {"featuresCol": "features", "labelCol": "_label", "weightCol": "_weight"}


def fit_predict(learner: str, point: dict, train: DataFrame, test: DataFrame, max_iter: int = 1000, tol: float = 1e-4) -> DataFrame:
    """``speech_id, y_true, y_pred`` of the test rows. Both inputs hold ``speech_id, y, features``."""
    sizes = class_sizes(train)
    labels = list(sizes)
    weights = class_weights(sizes, point["balanced"])
    rows = _prepared(train, labels, weights)
    if len(labels) == 1:
        return test.select("speech_id", F.col("y").alias("y_true"), F.lit(labels[0]).alias("y_pred"))
    # The loss is averaged over the weights, so C turns into 1 / (C * total weight).
    total = lambda classes: sum(weights[y] * sizes[y] for y in classes)
    if learner == "lr":
        model = LogisticRegression(
            regParam=1.0 / (point["C"] * total(labels)), elasticNetParam=0.0, standardization=False, maxIter=max_iter,
            tol=tol, **_COLUMNS,
        ).fit(rows)
        scored = model.transform(test)
    elif learner == "rf":
        model = RandomForestClassifier(
            numTrees=point["n_trees"], impurity=point["impurity"], seed=SEED, maxDepth=point.get("max_depth", 30),
            featureSubsetStrategy="sqrt", **_COLUMNS,
        ).fit(rows)
        scored = model.transform(test)
    elif learner == "svm":
        if point.get("kernel", "linear") != "linear":
            raise ValueError("kernels other than linear are fitted by fit_predict_many")
        scored = _pairwise_svm(rows, test, labels, point["C"], total, max_iter)
    else:
        raise ValueError(f"learner must be one of {LEARNERS}")
    said = F.get(F.lit(labels), F.col("prediction").cast("int"))
    return scored.select("speech_id", F.col("y").alias("y_true"), said.alias("y_pred"))


def _pairwise_svm(rows: DataFrame, test: DataFrame, labels: list[str], c: float, total, max_iter: int) -> DataFrame:
    """One linear machine per class pair; most votes win, the earlier class on a tie."""
    votes, scored = [], test
    for i, j in combinations(range(len(labels)), 2):
        pair = rows.where(F.col("_label").isin(float(i), float(j)))
        pair = pair.withColumn("_label", (F.col("_label") == float(i)).cast("double"))
        name = f"_vote_{i}_{j}"
        model = LinearSVC(
            regParam=1.0 / (c * total([labels[i], labels[j]])), maxIter=max_iter, tol=1e-3, standardization=False,
            predictionCol=name, rawPredictionCol=f"{name}_raw", **_COLUMNS,
        ).fit(pair)
        scored = model.transform(scored).drop(f"{name}_raw")
        votes.append((i, j, F.col(name)))
    tally = F.array(
        *[
            sum(
                (v if k == i else 1 - v for i, j, v in votes if k in (i, j)),
                F.lit(0.0),
            )
            for k in range(len(labels))
        ]
    )
    return scored.withColumn("_t", tally).withColumn("prediction", F.array_position("_t", F.array_max("_t")) - 1)


def linear_problems(learner: str, point: dict, sizes: dict[str, int], space: int, size: int) -> list[trainer.Problem]:
    """The problems of one grid point over one space; the classes are coded in alphabetic order."""
    labels = list(sizes)
    weights = class_weights(sizes, point["balanced"])
    total = lambda codes: sum(weights[labels[i]] * sizes[labels[i]] for i in codes)

    def problem(kind: str, codes: tuple[int, ...]) -> trainer.Problem:
        w = total(codes)
        return trainer.Problem(space, size, kind, codes, tuple(weights[labels[i]] for i in codes), w, 1.0 / (point["C"] * w))

    codes = tuple(range(len(labels)))
    if len(labels) < 2:
        return []
    if learner == "svm":
        return [problem("hinge", pair) for pair in combinations(codes, 2)]
    return [problem("softmax" if len(labels) > 2 else "logit", codes)]


def fit_predict_many(
    learner: str, grid: list[dict], fit: DataFrame, held: DataFrame, sizes: dict[int, int], classes: dict[int, dict[str, int]], tol: float = 1e-4
) -> DataFrame:
    """``speech_id, y_true, y_pred, grid_idx`` of the held rows by every grid point of every space.

    ``fit`` and ``held`` hold ``space, speech_id, y, indices, values``; ``sizes`` are the features and
    ``classes`` the rows per label of each space's fit rows. All models are fitted together; a point
    with a ``kernel`` is fitted over the mapped rows of its space.
    """
    kernel_of = [point.get("kernel", "linear") for point in grid]
    used = [k for k in kernels.KERNELS if k in kernel_of]
    columns = ["space", "speech_id", "y", "indices", "values"]
    spaces = {(space, "linear"): space for space in sizes}
    if used != ["linear"]:
        # The trainer writes the mapped fit rows; those to predict are mapped where they are read, once.
        mapped, spaces, sizes = kernels.mapping(fit, sizes, used)
        fit, held = mapped(fit.select(*columns)), mapped(held.select(*columns))
        classes = {n: classes[space] for (space, _), n in spaces.items()}
    made = [
        (i, n, linear_problems(learner, point, classes[n], n, sizes[n]))
        for (_, kernel), n in spaces.items() for i, point in enumerate(grid) if kernel == kernel_of[i]
    ]
    labels = F.create_map(*[F.lit(v) for space in sizes for v in (space, list(classes[space]))])
    coded = fit.withColumn("y", (F.array_position(F.element_at(labels, F.col("space")), F.col("y")) - 1).cast("int"))
    fitted = iter(trainer.fit_many(coded.select("space", "y", "indices", "values"), [p for _, _, ps in made for p in ps], tol=tol))
    voters = [trainer.Voter(i, space, len(classes[space]), tuple(ps), tuple(next(fitted) for _ in ps)) for i, space, ps in made]
    said = trainer.predict_many(held.withColumnRenamed("y", "y_true"), voters, sizes)
    return said.select("speech_id", "y_true", F.get(F.element_at(labels, F.col("space")), F.col("code")).alias("y_pred"), "grid_idx")


EXTRA = 6  # further columns of the block, so that the wanted ones settle fast


def _gram(frame: DataFrame, names: list[str]) -> np.ndarray:
    """The k x k matrix of inner products of some columns."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = frame.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in pairs]).first()
    out = np.zeros((len(names), len(names)))
    for (a, b), value in zip(pairs, sums):
        out[names.index(a), names.index(b)] = out[names.index(b), names.index(a)] = value or 0.0
    return out


def _turned(frame: DataFrame, names: list[str], by: np.ndarray, out: list[str]) -> DataFrame:
    """Linear combinations of some columns: ``frame[names] @ by`` as ``out``."""
    made = [sum((F.col(n) * float(by[i, j]) for i, n in enumerate(names)), F.lit(0.0)).alias(o) for j, o in enumerate(out)]
    return frame.select(frame.columns[0], *made)


DRIVER_FEATURES = 1 << 20  # up to this many, the thin factor is an array of 64 MB on the driver
CELLS = 1 << 18  # cells of a stored piece of rows
SLICE = 1 << 13  # values of a sum in one row


def stored_rows(rows: DataFrame) -> DataFrame:
    """A sparse matrix ``row, indices, values`` written once, some rows a piece: their ids, and row edges, column numbers
    and values as plain bytes."""
    rows = rows.select("row", F.col("indices").cast("array<int>").alias("indices"), F.col("values").cast("array<double>").alias("values"))
    kind = T.StructType([T.StructField("row", T.ArrayType(rows.schema["row"].dataType))])
    for name in ("edges", "idx", "value"):
        kind = kind.add(name, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("indices")
            ends = np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False))
            idx, value = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("indices", "values")]
            a = 0
            while a < len(ends):
                lo = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, lo + CELLS, "right")))
                hi, edges = int(ends[b - 1]), np.concatenate(([0], ends[a:b] - lo)).astype(np.int64)
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column("row").slice(a, b - a))
                made = [edges, idx[lo:hi].astype(np.int32), value[lo:hi].astype(np.float64)]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([x.tobytes()], pa.binary()) for x in made]], kind.names)
                a = b

    return staged(rows.mapInArrow(run, kind))


def _pieces(cells: DataFrame) -> DataFrame:
    """``stored_rows`` of a matrix ``row, idx, value``."""
    rows = cells.groupBy("row").agg(F.collect_list(F.struct("idx", "value")).alias("c"))
    return stored_rows(rows.select("row", F.col("c.idx").alias("indices"), F.col("c.value").alias("values")))


def _read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row edges, column numbers and values of each piece of a batch."""
    for piece in zip(*(batch.column(c) for c in ("edges", "idx", "value"))):
        yield tuple(np.frombuffer(x.as_buffer(), kind) for x, kind in zip(piece, (np.int64, np.int32, np.float64)))


def _columns(pieces: DataFrame) -> DataFrame:
    """``idx``: the columns that have a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(0, np.int32)
        for batch in batches:
            for _, idx, _ in _read(batch):
                met = np.union1d(met, idx)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32())], ["idx"])

    return pieces.select("edges", "idx", "value").mapInArrow(run, "idx int").distinct()


def _cells(pieces: DataFrame) -> DataFrame:
    """``row, idx, value`` of stored rows."""
    kind = T.StructType([T.StructField("row", pieces.schema["row"].dataType.elementType)]).add("idx", T.IntegerType()).add("value", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, (edges, idx, value) in zip(batch.column("row"), _read(batch)):
                row = ids.values.take(pa.array(np.repeat(np.arange(len(edges) - 1), np.diff(edges))))
                yield pa.RecordBatch.from_arrays([row, pa.array(idx), pa.array(value)], kind.names)

    return pieces.mapInArrow(run, kind)


def _turn_piece(edges: np.ndarray, idx: np.ndarray, value: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows times ``basis``; the columns met, and their rows of the transpose times that."""
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    met, at = np.unique(idx, return_inverse=True)
    part, n = basis[met], len(edges) - 1
    # Dense where that takes at most a few times the cells, by parts of the rows.
    if n * len(met) <= 16 * len(idx):
        dense = np.bincount(row * len(met) + at, value, n * len(met)).reshape(n, len(met))
        left = dense @ part
        return left, met, dense.T @ left
    left, back = np.empty((n, basis.shape[1])), np.empty(part.shape)
    for j in range(basis.shape[1]):
        left[:, j] = np.bincount(row, value * part[at, j], n)
        back[:, j] = np.bincount(at, value * left[row, j], len(met))
    return left, met, back


def _multiplied(pieces: DataFrame, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inner products of ``matrix @ basis``, and the transposed matrix times it, in one reading."""
    shared = pieces.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        inner, thin, any_row = np.zeros((given.shape[1],) * 2), np.zeros(given.shape), False
        for batch in batches:
            for read in _read(batch):
                left, met, back = _turn_piece(*read, given)
                inner += left.T @ left
                thin[met] += back
                any_row = True
        flat = np.concatenate([inner.ravel(), thin.ravel()]) if any_row else np.zeros(0)
        for s in range(0, len(flat), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([flat[s : s + SLICE]])], ["slice", "part"])

    def summed(table: pa.Table) -> pa.Table:
        part = np.sum([g.values.to_numpy() for g in table.column("part")], axis=0)
        return pa.table({"slice": table.slice(0, 1).column("slice"), "part": pa.array([part])})

    schema = "slice long, part array<double>"
    sums = pieces.select("edges", "idx", "value").mapInArrow(run, schema).groupBy("slice").applyInArrow(summed, schema).toArrow()
    shared.unpersist()
    width = basis.shape[1]
    flat = np.zeros(width * width + basis.size)
    for s, part in zip(sums.column("slice"), sums.column("part")):
        values = part.values.to_numpy()
        flat[s.as_py() : s.as_py() + len(values)] = values
    return flat[: width * width].reshape(width, width), flat[width * width :].reshape(basis.shape)


def _array_svd(pieces: DataFrame, thin: pa.Table, k: int, max_iter: int, tol: float) -> tuple[pa.Table, np.ndarray]:
    """The iteration of ``block_svd`` with the thin factor as an array: one reading of the rows a round, no join."""
    columns = thin.column("idx").to_numpy()
    now = np.zeros((int(columns.max()) + 1, thin.num_columns - 1))
    now[columns] = np.stack([thin.column(c).to_numpy() for c in thin.column_names[1:]], axis=1)
    last = None
    for _ in range(max_iter):
        inner = now.T @ now
        values, turn = np.linalg.eigh(inner)
        flat = np.where(values > 1e-13 * (np.trace(inner) or 1.0), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        basis = now @ (turn * flat)
        gram, now = _multiplied(pieces, basis)
        energy, mix = np.linalg.eigh(gram)
        order = np.argsort(-energy)
        found = np.sqrt(np.maximum(energy[order], 0.0))
        if last is not None and np.abs(found[:k] - last[:k]).max() <= tol * max(found[0], 1e-300):
            break
        last = found
    vectors = (basis @ mix[:, order[:k]])[columns]
    for j in range(k):
        top = np.flatnonzero(np.abs(vectors[:, j]) == np.abs(vectors[:, j]).max())
        if vectors[top[np.argmin(columns[top])], j] < 0:
            vectors[:, j] *= -1
    return pa.table({"idx": columns, **{f"v{j + 1}": vectors[:, j] for j in range(k)}}), found[:k]


def block_svd(cells: DataFrame, k: int = 2, max_iter: int = 60, tol: float = 1e-10) -> tuple[DataFrame, np.ndarray]:
    """``idx, v1..vk`` and the singular values of a sparse matrix ``row, idx, value`` or ``stored_rows``, without centring.

    Block power iteration: a thin factor is a table with one row a feature, multiplied by the matrix
    and its transpose with joins and sums, and made orthonormal by the Cholesky factor of its small
    matrix of inner products; only such k x k matrices come to the driver. Signs make each vector's
    largest entry positive. Up to ``DRIVER_FEATURES`` columns, the thin factor goes to the tasks as an
    array, and a round is one reading of the stored rows; only sums come back.
    """
    pieces = cells if "edges" in cells.columns else None
    if pieces is None:
        cells = staged(cells.select("row", "idx", "value"))
    columns = cells.select("idx").distinct() if pieces is None else _columns(pieces)
    width = k + EXTRA
    names = [f"b{j}" for j in range(width)]
    # A start that depends on the feature's number alone.
    noise = [(F.pmod(F.xxhash64("idx", F.lit(j)), F.lit(2_000_003)) / 1_000_001.5 - 1).alias(n) for j, n in enumerate(names)]
    thin, last = staged(columns.select("idx", *noise)), None
    if 0 < (thin.agg(F.max("idx")).first()[0] or 0) < DRIVER_FEATURES:
        vectors, found = _array_svd(_pieces(cells) if pieces is None else pieces, thin.orderBy("idx").toArrow(), k, max_iter, tol)
        return staged(cells.sparkSession.createDataFrame(vectors)).select(F.col("idx").cast(thin.schema["idx"].dataType), *vectors.column_names[1:]), found
    if pieces is not None:
        cells = staged(_cells(pieces))
    for _ in range(max_iter):
        inner = _gram(thin, names)
        scale = np.trace(inner) or 1.0
        # Fewer independent directions than columns: the others become zero.
        values, turn = np.linalg.eigh(inner)
        flat = np.where(values > 1e-13 * scale, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        basis = _turned(thin, names, turn * flat, names)
        left = cells.join(basis, "idx").groupBy("row").agg(*[F.sum(F.col("value") * F.col(n)).alias(n) for n in names])
        left = staged(left)
        energy, mix = np.linalg.eigh(_gram(left, names))
        order = np.argsort(-energy)
        found = np.sqrt(np.maximum(energy[order], 0.0))
        if last is not None and np.abs(found[:k] - last[:k]).max() <= tol * max(found[0], 1e-300):
            break
        last = found
        thin = staged(cells.join(left, "row").groupBy("idx").agg(*[F.sum(F.col("value") * F.col(n)).alias(n) for n in names]))
    wanted = [f"v{j + 1}" for j in range(k)]
    vectors = staged(_turned(basis, names, mix[:, order[:k]], wanted))
    largest = vectors.agg(*[F.max_by(F.col(v), F.struct(F.abs(F.col(v)), -F.col("idx"))).alias(v) for v in wanted]).first()
    signed = [F.col(v) * (1.0 if (largest[v] or 0.0) >= 0 else -1.0) for v in wanted]
    return vectors.select("idx", *[c.alias(v) for c, v in zip(signed, wanted)]), found[:k]


def truncated_svd(vectors: DataFrame, k: int = 2) -> DataFrame:
    """``idx, v1..vk``: right singular vectors of rows with a ``features`` vector."""
    rows = staged(vectors.select(F.monotonically_increasing_id().alias("row"), vector_to_array("features").alias("values")))
    rows = rows.select("row", F.posexplode("values").alias("idx", "value"))
    return block_svd(rows.where("value <> 0"), k)[0]


def project(rows: DataFrame, components: DataFrame) -> DataFrame:
    """``row, c1..ck``: ``stored_rows`` times the singular vectors ``idx, v1..vk``."""
    names = [c for c in components.columns if c != "idx"]
    if (components.agg(F.max("idx")).first()[0] or 0) >= DRIVER_FEATURES:
        summed = [F.sum(F.col("value") * F.col(v)).alias(f"c{v[1:]}") for v in names]
        return _cells(rows).join(components, "idx").groupBy("row").agg(*summed)
    table = components.toArrow()
    idx = table.column("idx").to_numpy()
    basis = np.zeros((int(idx.max(initial=-1)) + 1, len(names)))
    basis[idx] = np.stack([table.column(v).to_numpy() for v in names], axis=1)
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    kind = T.StructType([T.StructField("row", rows.schema["row"].dataType.elementType)])
    for v in names:
        kind = kind.add(f"c{v[1:]}", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, (edges, idx, value) in zip(batch.column("row"), _read(batch)):
                n = len(edges) - 1
                row, part = np.repeat(np.arange(n), np.diff(edges)), shared.value[idx]
                sums = [pa.array(np.bincount(row, value * part[:, j], n)) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([ids.values, *sums], kind.names)

    return rows.mapInArrow(run, kind)
