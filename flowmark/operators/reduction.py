"""PCA and linear discriminant analysis, fitted once and cut to any number of components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmark.functions.blocks import Sums, added, blocks, merged, state_batch, state_items, vector_rows
from flowmark.functions.scalars import vector_width
from flowmark.functions.ship import ship

#: Memory of the driver for the matrices of a fit, unless a call gives its own.
DRIVER_BYTES = 1 << 30
#: Residual of an iteration, as a share of where it began or of the largest value, that counts as none.
SOLVED = 1e-9
#: Eigenvalues of the within-class scatter below this share of the largest count as zero.
RANK_CUTOFF = 1e-10


@dataclass(frozen=True)
class Scatter:
    """Class statistics: counts, means, and the within- and between-class scatter matrices."""

    labels: tuple[float, ...]
    counts: np.ndarray
    means: np.ndarray  # classes x width
    overall: np.ndarray
    within: np.ndarray
    between: np.ndarray


@dataclass(frozen=True)
class LdaModel:
    """Discriminant directions in descending order of their share of between-class variance."""

    mean: np.ndarray
    projection: np.ndarray  # width x components
    ratios: tuple[float, ...]
    rank: int | None  # of the within-class scatter under RANK_CUTOFF, if known


def class_moments(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Count and mean vector per class, combined on the executors."""
    return df.groupBy(F.col(label).cast("double").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col(features)).alias("mean")
    )


class ClassState:
    """Rows, mean and co-moments of every class, mergeable: one pass over the data in any number of parts.

    Each part is summed up around its own means, and parts are merged by the distance of their means, so nothing
    cancels, whatever the offset of the features.
    """

    def __init__(self, width: int, most: int):
        self.width, self.most = width, most
        self.rows: dict[float, float] = {}
        self.means: dict[float, np.ndarray] = {}
        self.within = np.zeros((width, width))

    def add(self, labels: np.ndarray, block: np.ndarray, columns) -> None:
        values = block
        if not isinstance(columns, slice):
            values = np.zeros((len(block), self.width))
            values[:, columns] = block
        for label in np.unique(labels):
            own = values[labels == label]
            mean = own.mean(axis=0)
            apart = own - mean
            self._meet(float(label), float(len(own)), mean)
            self.within += apart.T @ apart

    def _meet(self, label: float, rows: float, mean: np.ndarray) -> None:
        if label not in self.rows:
            if len(self.rows) == self.most:
                raise ValueError("more classes than driver_bytes allows: raise driver_bytes")
            self.rows[label], self.means[label] = rows, mean.copy()
            return
        known = self.rows[label]
        gap = mean - self.means[label]
        self.within += np.outer(gap, gap * (known * rows / (known + rows)))
        self.means[label] += gap * (rows / (known + rows))
        self.rows[label] = known + rows

    def batch(self) -> pa.RecordBatch:
        classes = [(repr(x), np.append(self.means[x], n)[None, :]) for x, n in self.rows.items()]
        return state_batch([("within", self.within), *classes])

    def take(self, batch: pa.RecordBatch) -> None:
        for key, matrix in state_items(batch):
            if key == "within":
                self.within += matrix
            else:
                self._meet(float(key), float(matrix[0, -1]), matrix[0, :-1])


def _too_much(width: int, driver_bytes: int) -> ValueError:
    return ValueError(
        f"a fit on {width} features needs more than {driver_bytes} bytes on the driver: raise driver_bytes, "
        "or hash wide text columns"
    )


def fit_scatter(
    df: DataFrame,
    features: str = "features",
    label: str = "label",
    driver_bytes: int = DRIVER_BYTES,
) -> Scatter:
    """Class counts, means and scatter in one pass over ``df``.

    ``driver_bytes`` is the memory the driver gives to the matrices of the fit; what does not fit in it is
    refused before anything is read, or, if there are too many classes, by the tasks.
    """
    width = vector_width(df, features)
    return scatter_of(vector_rows(df, features=features, label=label), width, driver_bytes)


def scatter_of(rows: DataFrame, width: int, driver_bytes: int = DRIVER_BYTES) -> Scatter:
    """:func:`fit_scatter` of rows in the form of ``blocks.vector_rows`` or ``blocks.packed``."""
    most = max(0, driver_bytes // 8 - 4 * width * width) // (2 * width)
    if most == 0:
        raise _too_much(width, driver_bytes)
    state = merged(
        rows,
        rows.rdd.getNumPartitions(),
        lambda: ClassState(width, most),
        lambda state, group, labels, block, columns: state.add(labels, block, columns),
        8 * width * width,
    )
    labels = tuple(sorted(state.rows))
    counts = np.array([state.rows[x] for x in labels])
    means = np.stack([state.means[x] for x in labels])
    overall = counts @ means / counts.sum()
    apart = (means - overall) * np.sqrt(counts)[:, None]
    return Scatter(labels, counts, means, overall, (state.within + state.within.T) / 2, apart.T @ apart)


def scatter_table(spark: SparkSession, scatter: Scatter) -> DataFrame:
    """Within-class scatter as one row per matrix line: ``(line, values)``."""
    rows = [(i, line.tolist()) for i, line in enumerate(scatter.within)]
    return spark.createDataFrame(rows, "line int, values array<double>")


def solve_lda(scatter: Scatter, k_max: int, normalise: str = "unit") -> LdaModel:
    """Directions that separate the class means best.

    The within-class scatter is whitened on the space where it is not zero, which turns the
    problem into a symmetric one. ``unit`` scales directions to length one, ``whiten`` to unit
    within-class variance. The largest entry of a direction is positive. Components beyond the rank of
    the scatter are zero.
    """
    values, vectors = np.linalg.eigh(scatter.within)
    real = values > RANK_CUTOFF * max(values.max(initial=0.0), 0.0)
    rank = int(real.sum())
    width = len(scatter.overall)
    if rank == 0:
        return LdaModel(scatter.overall, np.zeros((width, k_max)), (0.0,) * k_max, 0)
    whitener = vectors[:, real] / np.sqrt(values[real])
    spread, directions = np.linalg.eigh(whitener.T @ scatter.between @ whitener)
    order = np.argsort(spread)[::-1]
    projection = whitener @ directions[:, order[:k_max]]
    return _lda_model(scatter.overall, projection, spread[order], scatter.counts, k_max, normalise, rank)


def _lda_model(
    mean: np.ndarray,
    projection: np.ndarray,
    spread: np.ndarray,
    counts: np.ndarray,
    k_max: int,
    normalise: str,
    rank: int | None,
) -> LdaModel:
    """Directions with unit within-class scatter, in falling order of their ``spread``, scaled as asked for."""
    spread = np.maximum(spread, 0.0)
    if normalise == "unit":
        lengths = np.linalg.norm(projection, axis=0)
        projection = projection / np.maximum(lengths, np.finfo(float).eps)
    elif normalise == "whiten":
        free = counts.sum() - len(counts)
        projection = projection * np.sqrt(max(free, 1.0))
    else:
        raise ValueError(f"unknown normalisation {normalise!r}")
    peak = projection[np.abs(projection).argmax(axis=0), range(projection.shape[1])]
    projection = projection * np.where(peak < 0, -1.0, 1.0)
    total = spread.sum()
    ratios = tuple(float(x) for x in (spread[:k_max] / total if total else spread[:k_max] * 0))
    beyond = k_max - projection.shape[1]
    projection = np.pad(projection, ((0, 0), (0, beyond)))
    ratios += (0.0,) * beyond
    return LdaModel(mean, projection, ratios, rank)


def _class_sums(sums: Sums, width: int, group, labels, block, columns) -> None:
    """Sums of every class, and its rows in the last line."""
    columns = slice(0, width) if isinstance(columns, slice) else columns
    for label in np.unique(labels):
        own = labels == label
        key = (float(label),)
        sums.add(key, columns, block[own].sum(axis=0)[:, None], (width + 1, 1))
        sums.add(key, slice(width, None), np.array([[own.sum()]]), (width + 1, 1))


def _scattered(sums: Sums, means: np.ndarray, classes: np.ndarray, wanted: np.ndarray, group, labels, block, columns):
    """Within-class scatter times the columns of ``wanted``: the product, and sums by class that centre it."""
    own = np.searchsorted(classes, labels)
    shown = block @ wanted[columns] - (means @ wanted)[own]
    sums.add(("product",), columns, block.T @ shown, wanted.shape)
    for number in np.unique(own):
        sums.add(("sums",), slice(number, number + 1), shown[own == number].sum(axis=0)[None, :], (len(classes), wanted.shape[1]))


def fit_lda_wide(
    df: DataFrame,
    k_max: int,
    normalise: str = "unit",
    features: str = "features",
    label: str = "label",
    driver_bytes: int = DRIVER_BYTES,
    max_passes: int = 200,
) -> LdaModel:
    """LDA without a scatter matrix, for features of any width.

    The directions span ``pinv(within) @ (class means - mean)``. One system for each class is solved by conjugate
    residuals, all of them in the same passes over ``df``, each of which multiplies sparse rows with a few columns.
    Parts of the class means in which no class has any spread are left out, as :func:`solve_lda` does; the rank of
    the scatter stays unknown.
    """
    width = vector_width(df, features)
    most = driver_bytes // _held(width) + 1
    found = df.select(F.col(label).cast("double").alias("label")).distinct().limit(most).collect()
    rows = vector_rows(df, features=features, label=label)
    return wide_lda_of(rows, width, [r["label"] for r in found], k_max, normalise, driver_bytes, max_passes)


def _held(width: int) -> int:
    """Bytes that the iteration of :func:`wide_lda_of` holds for each class."""
    return 10 * 8 * width


def wide_lda_of(
    rows: DataFrame,
    width: int,
    labels: Sequence[float],
    k_max: int,
    normalise: str = "unit",
    driver_bytes: int = DRIVER_BYTES,
    max_passes: int = 200,
) -> LdaModel:
    """:func:`fit_lda_wide` of rows in the form of ``blocks.vector_rows`` or ``blocks.packed``, with their labels."""
    if len(labels) * _held(width) > driver_bytes:
        raise _too_much(width, driver_bytes)
    tasks = rows.rdd.getNumPartitions()
    totals = added(rows, tasks, lambda sums, *block: _class_sums(sums, width, *block), 8 * width * len(labels))
    classes = np.array(sorted(map(float, labels)))
    table = np.stack([totals[str((float(x),))][:, 0] for x in classes])
    counts, means = table[:, -1], table[:, :-1] / table[:, -1:]
    overall = counts @ means / counts.sum()
    target = ((means - overall) * np.sqrt(counts)[:, None]).T

    def times(wanted: np.ndarray) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast((means, classes, wanted))
        try:
            got = added(rows, tasks, lambda sums, *block: _scattered(sums, *shared.value, *block), wanted.nbytes)
        finally:
            shared.unpersist()
        return got[str(("product",))] - means.T @ got[str(("sums",))]

    solved, rest = np.zeros_like(target), target.copy()
    moved = times(rest)
    step, step_moved = rest.copy(), moved.copy()
    first = np.maximum(np.linalg.norm(moved, axis=0), np.finfo(float).tiny)
    for _ in range(max_passes):
        power, length = (rest * moved).sum(axis=0), np.square(step_moved).sum(axis=0)
        active = (np.linalg.norm(moved, axis=0) > SOLVED * first) & (length > 0) & (power > 0)
        if not active.any():
            break
        share = np.where(active, power / np.where(length > 0, length, 1), 0.0)
        solved += share * step
        rest -= share * step_moved
        moved = np.where(active, times(rest), moved)
        turn = np.where(active, (rest * moved).sum(axis=0) / np.where(power > 0, power, 1), 0.0)
        step, step_moved = rest + turn * step, moved + turn * step_moved
    # what is left of a target has no spread within classes; the solution must not use it
    size = np.square(rest).sum(axis=0)
    flat = size > 1e-12 * np.square(target).sum(axis=0)
    solved -= np.where(flat, (solved * rest).sum(axis=0) / np.where(flat, size, 1), 0.0) * rest
    small = target.T @ solved
    spread, mixed = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(spread)[::-1]
    real = [i for i in order if spread[i] > RANK_CUTOFF * max(spread.max(initial=0.0), 0.0)][:k_max]
    projection = solved @ mixed[:, real] / np.sqrt(spread[real]) if real else np.zeros((width, 0))
    if not real:
        return LdaModel(overall, np.zeros((width, k_max)), (0.0,) * k_max, None)
    return _lda_model(overall, projection, spread[order], counts, k_max, normalise, None)


def fit_lda(
    df: DataFrame,
    k_max: int,
    normalise: str = "unit",
    features: str = "features",
    label: str = "label",
    driver_bytes: int = DRIVER_BYTES,
) -> LdaModel:
    """Fit LDA; smaller component counts are prefixes of this model.

    Class statistics in one pass, if their matrices fit in ``driver_bytes``, else without matrices.
    """
    if not matrices_fit(vector_width(df, features), driver_bytes):
        return fit_lda_wide(df, k_max, normalise, features, label, driver_bytes)
    return solve_lda(fit_scatter(df, features, label, driver_bytes), k_max, normalise)


def matrices_fit(width: int, driver_bytes: int = DRIVER_BYTES) -> bool:
    """Whether the driver has room for the matrices of an LDA fit."""
    return 8 * 6 * width * width <= driver_bytes


def lda_project(df: DataFrame, model: LdaModel, k: int, features: str = "features") -> DataFrame:
    """Replace ``features`` by the first ``k`` discriminant scores, one product per Arrow batch."""
    return _projected(df, features, model.projection[:, :k], model.mean)


def _projected(df: DataFrame, features: str, matrix: np.ndarray, centre: np.ndarray | None) -> DataFrame:
    """``features`` times ``matrix``, one product per block of rows; only the columns a block has take part."""
    ship(df.sparkSession)
    k = matrix.shape[1]
    shared = df.sparkSession.sparkContext.broadcast((np.ascontiguousarray(matrix), None if centre is None else centre @ matrix))

    @F.arrow_udf("array<double>")
    def project(vectors: pa.Array) -> pa.Array:
        matrix, offset = shared.value
        nothing = pa.array(np.zeros(len(vectors)))
        batch = pa.RecordBatch.from_arrays([nothing, nothing, vectors], names=["group", "label", "vector"])
        parts = [block @ matrix[columns] for _, _, block, columns in blocks(batch)]
        scores = np.concatenate(parts) if parts else np.zeros((0, k))
        if offset is not None:
            scores = scores - offset
        return pa.ListArray.from_arrays(np.arange(0, scores.size + 1, k, dtype=np.int32), scores.ravel())

    return _swap(df, array_to_vector(project(F.unwrap_udt(features))), features)


@dataclass(frozen=True)
class PcaModel:
    """Principal components in falling order of their variance, and the shares of variance they explain."""

    components: np.ndarray  # width x components
    ratios: tuple[float, ...]
    passes: int
    residual: float  # largest distance of a component from an exact one, as a share of the largest variance

    @property
    def explainedVariance(self) -> DenseVector:
        return DenseVector(self.ratios)


def _spread(sums: Sums, mean: np.ndarray, wanted: np.ndarray, group, labels, block, columns) -> None:
    """Covariance (times rows) by the columns of ``wanted``, and the total variance (times rows)."""
    shown = block @ wanted[columns] - mean @ wanted
    sums.add(("product",), columns, block.T @ shown, wanted.shape)
    sums.add(("sums",), slice(None), shown.sum(axis=0)[None, :], (1, wanted.shape[1]))
    apart = np.square(block - mean[columns]).sum()
    if not isinstance(columns, slice):
        apart += len(block) * (np.square(mean).sum() - np.square(mean[columns]).sum())
    sums.add(("total",), slice(None), np.array([[apart]]), (1, 1))


def fit_pca(
    df: DataFrame, k_max: int, features: str = "features", driver_bytes: int = DRIVER_BYTES, max_passes: int = 100
) -> PcaModel:
    """Fit principal components once at the largest count, without a covariance matrix.

    A random block of directions is multiplied by the covariance in a pass over ``df``; what of the products is not
    yet spanned becomes the next block (block Krylov, restarted from its best directions when the driver's
    share of memory is full). Components are those of the spanned space, and exact once their residuals vanish. The
    driver holds blocks of a few columns, the tasks one block; rows stay sparse. The largest entry of a component
    is positive.
    """
    width = vector_width(df, features)
    rows = vector_rows(df, features=features, label=None)
    return pca_of(rows, width, k_max, driver_bytes, max_passes)


def pca_of(
    rows: DataFrame, width: int, k_max: int, driver_bytes: int = DRIVER_BYTES, max_passes: int = 100
) -> PcaModel:
    """:func:`fit_pca` of rows in the form of ``blocks.vector_rows`` or ``blocks.packed``."""
    if not 1 <= k_max <= width:
        raise ValueError(f"{k_max} components of {width} features")
    block = min(width, k_max + 8)
    most = min(width, driver_bytes // (8 * width) // 3 - 2 * block, max(4 * block, 64))
    if most < min(width, 2 * block):
        raise _too_much(width, driver_bytes)
    tasks = rows.rdd.getNumPartitions()
    totals = added(rows, tasks, lambda sums, *found: _class_sums(sums, width, *found), 8 * width)
    if not totals:
        raise ValueError("no rows to fit principal components on")
    total = sum(totals.values())
    n, mean = float(total[-1, 0]), total[:-1, 0] / total[-1, 0]
    if n < 2:
        raise ValueError("principal components need two rows")

    def times(wanted: np.ndarray) -> tuple[np.ndarray, float]:
        shared = rows.sparkSession.sparkContext.broadcast((mean, wanted))
        try:
            got = added(rows, tasks, lambda sums, *found: _spread(sums, *shared.value, *found), wanted.nbytes)
        finally:
            shared.unpersist()
        product = got[str(("product",))] - np.outer(mean, got[str(("sums",))])
        return product / (n - 1), float(got[str(("total",))][0, 0]) / (n - 1)

    new = np.linalg.qr(np.random.default_rng(0).normal(size=(width, block)))[0]
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    for passes in range(1, max_passes + 1):
        product, variance = times(new)
        basis, image = np.hstack([basis, new]), np.hstack([image, product])
        small = basis.T @ image
        values, mixed = np.linalg.eigh((small + small.T) / 2)
        values, mixed = values[::-1], mixed[:, ::-1]
        left = image @ mixed[:, :block] - basis @ mixed[:, :block] * values[:block]
        scale = max(values[0], np.finfo(float).tiny)
        residual = float(np.linalg.norm(left[:, :k_max], axis=0).max() / scale)
        if residual <= SOLVED or basis.shape[1] == width:
            break
        if basis.shape[1] + block > most < width:  # go on from the best directions
            keep = min(basis.shape[1], k_max + block // 2)
            basis, image = basis @ mixed[:, :keep], image @ mixed[:, :keep]
        for _ in range(2):
            left = left - basis @ (basis.T @ left)
        new, upper = np.linalg.qr(left)
        new = new[:, np.abs(np.diag(upper)) > 1e-12 * scale][:, : width - basis.shape[1]]
        for _ in range(2):
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        if not new.shape[1]:
            break
    if basis.shape[1] == width:
        residual = 0.0
    components = basis @ mixed[:, :k_max] if basis.shape[1] == len(mixed) else basis[:, :k_max]
    peak = components[np.abs(components).argmax(axis=0), range(k_max)]
    components = components * np.where(peak < 0, -1.0, 1.0)
    shares = np.maximum(values[:k_max], 0.0) / variance if variance > 0 else np.zeros(k_max)
    return PcaModel(components, tuple(float(x) for x in shares), passes, residual)


def pca_project(df: DataFrame, model: PcaModel, k: int, features: str = "features") -> DataFrame:
    """Replace ``features`` by the first ``k`` principal components (not centred)."""
    return _projected(df, features, model.components[:, :k], None)


def _swap(df: DataFrame, value, features: str) -> DataFrame:
    kept = [c for c in df.columns if c != features and not c.startswith("__")]
    return df.select(*kept, value.alias(features))


def variance_table(spark: SparkSession, ratios, identity: dict | None = None) -> DataFrame:
    """Explained and cumulative variance per component, counted from 1."""
    rows = [(i, float(x)) for i, x in enumerate(ratios, 1)]
    table = spark.createDataFrame(rows, "component int, explained_variance double")
    table = table.select(*[F.lit(v).alias(c) for c, v in (identity or {}).items()], "*")
    return cumulative_variance(table, list(identity or {}))


def cumulative_variance(df: DataFrame, by: list[str]) -> DataFrame:
    """Running sum of explained variance by component within an identity."""
    running = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("component")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn("cumulative_variance", F.sum("explained_variance").over(running))
