"""Linear machines with hinge loss, any number of them fitted in shared passes over the training rows.

A *group* is a set of training rows. A *view* is what a machine sees of them: the features, or a projection
made while they are read, of which it may use the first few columns. A machine separates one label from
the others in the view of a group: ``mean(max(0, 1 - y (x w + b)))`` is made as small as it gets.

One pass yields, for several candidate weights of every machine at once, the loss and a subgradient: per block
of rows two matrix products, whose results are added up in the task, then over tasks in a tree. What the
driver holds is a few vectors per machine. From them it proposes the candidates of the next pass: points along a
quasi-Newton direction, and the lowest points of the cutting planes seen so far near the best weights. All
planes lie below the loss, so a mixture of them bounds it from below: each fit comes with a gap that proves
how far from the least loss it can be.

The number of passes does not depend on the number of machines, and a fit of many passes holds those of fewer
as snapshots.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmark.functions.blocks import Sums, added, blocks
from flowmark.functions.ship import ship

#: Cutting planes and quasi-Newton pairs of a machine, and bytes the driver gives to all planes.
PLANES, PAIRS, PLANE_BYTES = 40, 10, 256 << 20
#: Steps along the quasi-Newton direction, and distances (as factors) of the planes' lowest points.
STEPS, NEAR = (1.0, 0.2), (0.1, 1.0, 10.0)
#: A fit ends when its gap is this share of the loss, or after passes without a better loss.
GAP, GAIN, PATIENCE = 1e-4, 1e-7, 15
#: Length of standardised weights within which the gap is proved, unless the best are longer than half of it.
RADIUS = 10.0
MIX_STEPS = 120


@dataclass(frozen=True)
class View:
    """Columns a machine sees: the features, or ``(x - centre) @ matrix``."""

    matrix: np.ndarray | None = None
    centre: np.ndarray | None = None


@dataclass(frozen=True)
class Machine:
    """Label ``positive`` against the others in the first ``width`` columns of a view of a group."""

    group: int
    view: int
    width: int
    positive: float


@dataclass
class Fit:
    """Weights and intercept in the columns of the view, and how they were found."""

    weights: np.ndarray
    intercept: float
    loss: float
    gap: float
    iterations: int
    converged: bool
    history: list[float] = field(default_factory=list)
    gaps: list[float] = field(default_factory=list)
    #: the fit as it would be with so many passes
    snapshots: dict[int, Fit] = field(default_factory=dict)


# --- on the executors ----------------------------------------------------------------------


def _seen(view: View, block: np.ndarray, columns) -> np.ndarray:
    """What a view shows of a block."""
    if view.matrix is None:
        return block
    shown = block @ view.matrix[columns]
    return shown if view.centre is None else shown - view.centre @ view.matrix


def _moments(sums: Sums, views: dict[int, list[View]], widths: dict[int, int], group, labels, block, columns):
    """Rows, sums and squares of every view, and rows by label, of a block."""
    for number, view in enumerate(views[group]):
        shown = _seen(view, block, columns)
        rows = columns if view.matrix is None else slice(None)
        width = widths[group] if view.matrix is None else view.matrix.shape[1]
        value = np.stack([shown.sum(axis=0), np.square(shown).sum(axis=0)], axis=1)
        sums.add((group, number), rows, value, (width, 2))
    sums.add((group, "rows"), slice(None), np.array([[len(labels)]]), (1, 1))


@dataclass(frozen=True)
class _Candidates:
    """Weights (a column each), intercepts and positive labels of the candidates in one view."""

    view: View
    weights: np.ndarray
    intercepts: np.ndarray
    positive: np.ndarray


def _losses(sums: Sums, tried: dict[tuple[int, int], _Candidates], group, labels, block, columns):
    """Losses, subgradients by intercept and by weight of all candidates on a block: rows 0, 1, and from 2 on."""
    for (own, number), c in tried.items():
        if own != group:
            continue
        shown = _seen(c.view, block, columns)
        rows = columns if c.view.matrix is None else slice(None)
        sign = np.where(labels[:, None] == c.positive, 1.0, -1.0)
        lack = 1.0 - sign * (shown @ c.weights[rows] + c.intercepts)
        active = lack > 0
        pull = np.where(active, -sign, 0.0)
        shape = (2 + len(c.weights), c.weights.shape[1])
        key = (group, number)
        sums.add(key, slice(0, 2), np.stack([np.where(active, lack, 0.0).sum(axis=0), pull.sum(axis=0)]), shape)
        below = slice(2, None) if isinstance(rows, slice) else rows + 2
        sums.add(key, below, shown.T @ pull, shape)


# --- on the driver -------------------------------------------------------------------------


def _to_simplex(x: np.ndarray) -> np.ndarray:
    """The nearest mixtures (non-negative, sum one) to the rows of ``x``."""
    ordered = -np.sort(-x, axis=1)
    above = np.cumsum(ordered, axis=1) - 1
    count = np.arange(1, x.shape[1] + 1)
    last = (ordered - above / count > 0).sum(axis=1)
    cut = above[np.arange(len(x)), last - 1] / last
    return np.maximum(x - cut[:, None], 0.0)


def _mixtures(gram: np.ndarray, errors: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each row, the mixture of planes with the least ``near / 2 * |sum|^2 + errors``, by accelerated
    projected gradients."""
    scale = near * np.maximum(np.trace(gram, axis1=1, axis2=2), 1e-300)
    x = y = np.full(errors.shape, 1.0 / errors.shape[1])
    t = 1.0
    for _ in range(MIX_STEPS):
        slope = near[:, None] * np.einsum("mij,mj->mi", gram, y) + errors
        new = _to_simplex(y - slope / scale[:, None])
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


class _Search:
    """The state of one machine's fit, in standardised columns; the last entry is the intercept."""

    def __init__(self, machine: Machine, mean: np.ndarray, spread: np.ndarray, planes: int):
        self.machine, self.mean, self.planes = machine, mean, planes
        self.inverse = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
        n = machine.width + 1
        self.at, self.loss, self.slope = np.zeros(n), np.inf, np.zeros(n)
        self.best, self.best_loss = np.zeros(n), np.inf
        self.slopes, self.levels = np.zeros((0, n)), np.zeros(0)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.near, self.bound = 1.0, 0.0  # no loss is negative
        self.history: list[float] = []
        self.gaps: list[float] = []
        self.quiet = 0
        self.done = False

    def raw(self, point: np.ndarray) -> tuple[np.ndarray, float]:
        weights = point[:-1] * self.inverse
        return weights, float(point[-1] - weights @ self.mean)

    def take(self, points: np.ndarray, losses: np.ndarray, slopes: np.ndarray) -> None:
        """Note the candidates of a pass and go on from the best that is better than the place held."""
        self.slopes = np.concatenate([self.slopes, slopes])[-self.planes :]
        self.levels = np.concatenate([self.levels, losses - (slopes * points).sum(axis=1)])[-self.planes :]
        least = int(np.argmin(losses))
        if losses[least] < self.loss:
            step, turn = points[least] - self.at, slopes[least] - self.slope
            if np.isfinite(self.loss) and step @ turn > 1e-10 * (step @ step):
                self.pairs = [*self.pairs, (step, turn)][-PAIRS:]
            moved = least - len(STEPS)
            if np.isfinite(self.loss) and moved >= 0:
                self.near *= NEAR[moved]
            gained = self.loss - losses[least] > GAIN * max(abs(losses[least]), 1e-12)
            self.at, self.loss, self.slope = points[least], float(losses[least]), slopes[least]
            self.quiet = 0 if gained else self.quiet + 1
        else:
            self.pairs = []
            self.near *= min(NEAR)
            self.quiet += 1
        self.near = float(np.clip(self.near, 1e-8, 1e8))
        self.best, self.best_loss = self.at, self.loss
        self.history.append(self.loss)

    def newton(self) -> np.ndarray:
        """Quasi-Newton direction from the last pairs; the first is a unit step downhill."""
        q, used = self.slope.copy(), []
        for step, turn in reversed(self.pairs):
            share = (step @ q) / (step @ turn)
            q -= share * turn
            used.append(share)
        if self.pairs:
            step, turn = self.pairs[-1]
            q *= (step @ turn) / (turn @ turn)
        else:
            q /= max(np.linalg.norm(q), 1e-12)
        for (step, turn), share in zip(self.pairs, reversed(used)):
            q += (share - (turn @ q) / (step @ turn)) * step
        return -q

    def certify(self, mixtures: np.ndarray) -> None:
        """Raise the lower bound by mixtures of planes."""
        reach = max(RADIUS, 2 * np.linalg.norm(self.best))
        slopes = mixtures @ self.slopes
        self.bound = max(self.bound, float((mixtures @ self.levels - reach * np.linalg.norm(slopes, axis=1)).max()))
        self.gaps.append(max(self.best_loss - self.bound, 0.0))
        self.done = self.gaps[-1] <= GAP * self.best_loss or self.quiet >= PATIENCE

    def fit(self, converged: bool) -> Fit:
        weights, intercept = self.raw(self.best)
        gap = self.gaps[-1] if self.gaps else self.best_loss
        return Fit(weights, intercept, self.best_loss, gap, len(self.history), converged, list(self.history), list(self.gaps))


def _proposals(searches: Sequence[_Search]) -> list[np.ndarray]:
    """Candidates of the next pass, and the lower bounds that follow from the planes."""
    out: list[np.ndarray] = []
    by_planes: dict[int, list[int]] = {}
    for i, s in enumerate(searches):
        out.append(s.at + np.outer(STEPS, s.newton()))
        by_planes.setdefault(len(s.levels), []).append(i)
    for which in by_planes.values():
        grams, errors, near = [], [], []
        for i in which:
            s = searches[i]
            gram = s.slopes @ s.slopes.T
            error = np.maximum(s.loss - (s.levels + s.slopes @ s.at), 0.0)
            for factor in NEAR:
                grams.append(gram), errors.append(error), near.append(s.near * factor)
        mixed = _mixtures(np.stack(grams), np.stack(errors), np.array(near)).reshape(len(which), len(NEAR), -1)
        for i, own in zip(which, mixed):
            s = searches[i]
            s.certify(own)
            steps = np.array([s.near * f for f in NEAR])[:, None] * (own @ s.slopes)
            out[i] = np.concatenate([out[i], s.at - steps])
            # what the middle mixture knows stays when its planes are dropped
            middle = own[len(NEAR) // 2]
            s.slopes = np.concatenate([s.slopes[-s.planes + 1 :], [middle @ s.slopes]])
            s.levels = np.append(s.levels[-s.planes + 1 :], middle @ s.levels)
    return out


def _pass(rows: DataFrame, tasks: int, views: dict[int, list[View]], searches: Sequence[_Search], points, counts, widths) -> None:
    """One pass over the training rows: all candidates of all machines."""
    places: dict[tuple[int, int], list[int]] = {}
    for i, s in enumerate(searches):
        places.setdefault((s.machine.group, s.machine.view), []).append(i)
    tried, result_bytes = {}, 0
    for (group, number), which in places.items():
        view = views[group][number]
        width = widths[group] if view.matrix is None else view.matrix.shape[1]
        total = sum(len(points[i]) for i in which)
        weights, intercepts, positive, column = np.zeros((width, total)), np.zeros(total), np.zeros(total), 0
        for i in which:
            for point in points[i]:
                own, intercepts[column] = searches[i].raw(point)
                weights[: len(own), column] = own
                positive[column] = searches[i].machine.positive
                column += 1
        tried[group, number] = _Candidates(view, weights, intercepts, positive)
        result_bytes += 8 * (width + 2) * total
    shared = rows.sparkSession.sparkContext.broadcast(tried)
    try:
        sums = added(rows, tasks, lambda *block: _losses(block[0], shared.value, *block[1:]), result_bytes)
    finally:
        shared.unpersist()
    for key, which in places.items():
        found, column = sums[str(key)] / counts[key[0]], 0
        for i in which:
            s, n = searches[i], len(points[i])
            own = found[:, column : column + n]
            by_weight = (own[2 : 2 + s.machine.width] - np.outer(s.mean, own[1])) * s.inverse[:, None]
            s.take(points[i], own[0], np.concatenate([by_weight, own[1:2]]).T)
            column += n


def fit_machines(
    rows: DataFrame,
    views: dict[int, list[View]],
    widths: dict[int, int],
    machines: Sequence[Machine],
    max_iter: int,
    snapshots: Sequence[int] = (),
) -> list[Fit]:
    """Fit all ``machines`` in at most ``max_iter`` passes over ``rows`` (see ``blocks.vector_rows``) and one before.

    ``views`` and ``widths`` (of the feature vectors) are by group. A label without rows of a group is told apart by
    the intercept alone. Rows are read once per pass, so keep them cached or in a table.
    """
    if not machines:
        return []
    size = 16 * sum(widths[g] + sum(v.matrix.shape[1] for v in vs if v.matrix is not None) for g, vs in views.items())
    tasks = rows.rdd.getNumPartitions()
    moments = added(rows, tasks, lambda *block: _moments(block[0], views, widths, *block[1:]), size)
    counts = {g: float(moments[str((g, "rows"))][0, 0]) for g in views if str((g, "rows")) in moments}
    lost = {m.group for m in machines} - counts.keys()
    if lost:
        raise ValueError(f"no training rows in groups {sorted(lost)}")
    planes = PLANE_BYTES // (8 * sum(m.width + 1 for m in machines))
    searches = []
    for m in machines:
        total = moments[str((m.group, m.view))][: m.width] / counts[m.group]
        mean, square = total[:, 0], total[:, 1]
        spread = np.sqrt(np.maximum(square - mean * mean, 0.0))
        spread[spread <= 1e-7 * np.abs(mean)] = 0.0  # a column of one value has no weight
        searches.append(_Search(m, mean, spread, int(np.clip(planes, 2 * (len(STEPS) + len(NEAR)), PLANES))))
    kept: list[dict[int, Fit]] = [{} for _ in machines]
    for number in range(1, max_iter + 1):
        active = [s for s in searches if not s.done]
        if not active:
            break
        if number == 1:  # no weights, and an intercept for either majority
            points = []
            for s in active:
                start = np.zeros((3, s.machine.width + 1))
                start[1:, -1] = 1, -1
                points.append(start)
        else:
            points = _proposals(active)
        _pass(rows, tasks, views, active, points, counts, widths)
        for s, snaps in zip(searches, kept):
            if number in snapshots and not s.done:
                snaps[number] = s.fit(False)
    for s in searches:  # the planes of the last pass count too
        if not s.done:
            _proposals([s])
    fits = []
    for s, snaps in zip(searches, kept):
        fit = s.fit(len(s.history) < max_iter)
        fit.snapshots = {n: snaps.get(n, fit) for n in snapshots}
        for n, snap in snaps.items():
            snap.gap = s.gaps[n - 1]  # a pass is certified before the next
        fits.append(fit)
    return fits


@dataclass(frozen=True)
class Variant:
    """Machines that judge the same rows of a group: one and its threshold, or one for each class."""

    group: int
    machines: tuple[int, ...]
    threshold: float | None = None  # None: the class with the highest score


def _margins(views: Sequence[View], known: Sequence[tuple], block: np.ndarray, columns) -> np.ndarray:
    """A column of margins for each of the machines ``known`` (view, weights, intercept)."""
    seen = [_seen(v, block, columns) if any(k[0] == i for k in known) else None for i, v in enumerate(views)]
    margins = np.empty((len(block), len(known)))
    for i, (view, weights, intercept) in enumerate(known):
        if views[view].matrix is None:
            margins[:, i] = seen[view] @ weights[columns] + intercept
        else:
            margins[:, i] = seen[view][:, : len(weights)] @ weights + intercept
    return margins


def _scores(margins: np.ndarray, threshold: float | None) -> tuple[np.ndarray, pa.ListArray]:
    """Predictions and scores: of both sides for one machine, of every class for several."""
    if threshold is None:
        prediction = margins.argmax(axis=1).astype(float)
    else:
        prediction = (margins[:, 0] > threshold).astype(float)
        margins = np.concatenate([-margins, margins], axis=1)
    offsets = np.arange(0, margins.size + 1, margins.shape[1], dtype=np.int32)
    return prediction, pa.ListArray.from_arrays(offsets, margins.ravel())


def _known(machines: Sequence[Machine], fits: Sequence[Fit]) -> list[tuple]:
    return [(m.view, f.weights, f.intercept) for m, f in zip(machines, fits)]


def scores(
    rows: DataFrame,
    views: dict[int, list[View]],
    machines: Sequence[Machine],
    fits: Sequence[Fit],
    variants: Sequence[Variant],
) -> DataFrame:
    """Every row judged by every variant of its group: ``variant``, ``label``, ``prediction`` and ``scores``.

    A single machine gives the scores of both sides; its positive side wins above the threshold. Of several, the
    first with the highest score wins, and classes count from 0.
    """
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((views, _known(machines, fits), list(variants)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, known, variants = shared.value
        for batch in batches:
            for group, labels, block, columns in blocks(batch):
                own = [(i, v) for i, v in enumerate(variants) if v.group == group]
                used = sorted({m for _, v in own for m in v.machines})
                margins = _margins(views[group], [known[m] for m in used], block, columns)
                for number, v in own:
                    mine = margins[:, [used.index(m) for m in v.machines]]
                    prediction, found = _scores(mine, v.threshold)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(labels), number, dtype=np.int32)),
                            pa.array(labels),
                            pa.array(prediction),
                            found,
                        ],
                        names=["variant", "label", "prediction", "scores"],
                    )

    return rows.mapInArrow(judge, "variant int, label double, prediction double, scores array<double>")


def with_scores(
    df: DataFrame, machines: Sequence[Machine], fits: Sequence[Fit], features: str = "features"
) -> DataFrame:
    """``df`` with ``scores``, one for each machine on its features; other columns stay."""
    ship(df.sparkSession)
    known = _known(machines, fits)

    @F.arrow_udf("array<double>")
    def judge(vectors: pa.Array) -> pa.Array:
        nothing = pa.array(np.zeros(len(vectors)))
        batch = pa.RecordBatch.from_arrays([nothing, nothing, vectors], names=["group", "label", "vector"])
        parts = [_margins([View()], known, block, columns) for _, _, block, columns in blocks(batch)]
        margins = np.concatenate(parts) if parts else np.zeros((0, len(known)))
        offsets = np.arange(0, margins.size + 1, len(known), dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, margins.ravel())

    return df.withColumn("scores", judge(F.unwrap_udt(features)))
