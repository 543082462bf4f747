"""Quality scores by Bradley-Terry ranking of documents.

A document's worth is a linear function of features of its text. A pair of a good and a bad document is a
preference, and the weights maximise the likelihood that good ones win: logistic loss on the
difference of their features. The cut between kept and rejected is a quantile of the scores of
all labelled documents outside the held-out part.

Features come from whole texts and depend on nothing but the text: shares of kinds of characters and words,
repetition inside the text, and the worst stretch of a text in each respect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmark.functions.durable import durable
from flowmark.functions.ship import ship
from flowmark.llm.common import settled, texts
from flowmark.llm.labelled import labels_of, sample_per_label
from flowmark.llm.hashing import runs_of, text_blocks, word_hashes, word_spans

#: Labelled rows per label that the weights are fitted on.
SAMPLE = 3_000
#: Preferences drawn from the sample, and quantiles among which the cut is chosen.
PAIRS = 40_000
LEVELS = 200
STRETCH = 32
#: Score at the cut.
CUT = 0.7

_CLASSES = {
    "upper": range(ord("A"), ord("Z") + 1),
    "lower": range(ord("a"), ord("z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "sign": b"#$%&*@|~^<>{}[]\\_=+/",
    "mark": b"!?",
    "stop": b".,;:",
    "line": b"\n",
    "high": range(128, 256),
}


def _table(members) -> np.ndarray:
    out = np.zeros(256, dtype=np.float32)
    out[list(members)] = 1
    return out


_TABLES = {name: _table(members) for name, members in _CLASSES.items()}


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _worst(flags: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The greatest part of flagged words in a stretch of every text."""
    total = np.concatenate([[0.0], np.cumsum(flags, dtype=np.float64)])
    n = len(flags)
    position = np.arange(n)
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    ends = np.minimum(position + STRETCH, before[1:][doc])
    parts = (total[ends] - total[position]) / STRETCH
    out = np.zeros(len(before) - 1)
    full = np.diff(before) > 0
    if full.any():
        out[full] = np.maximum.reduceat(parts, before[:-1][full])
    return out


def _seen_before(keys: np.ndarray, doc: np.ndarray, within: int | None) -> np.ndarray:
    """Whether the same key stands earlier in the text, at most ``within`` places back."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    same = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    if within:
        same &= np.diff(order) <= within
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    return out


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text; a text without words has a row too."""
    made = []
    for _, data, offsets in text_blocks(column):
        starts, ends, before = word_spans(data, offsets)
        size = np.diff(offsets)
        n = np.diff(before)
        per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(n, 1)
        classes = {k: t[data] if len(data) else np.zeros(0) for k, t in _TABLES.items()}
        out = [np.log1p(size), np.log1p(n), size * per_word]
        out += [_sums(v, offsets) * per_byte for v in classes.values()]
        spans = np.stack([starts, ends], axis=1)
        counts = {}
        for k in ("upper", "lower", "sign", "mark", "stop", "digit"):
            total = np.concatenate([[0.0], np.cumsum(classes[k], dtype=np.float64)])
            counts[k] = total[spans[:, 1]] - total[spans[:, 0]] if len(spans) else np.zeros(0)
        length = ends - starts
        words = word_hashes(data, starts, ends, lower=True)
        doc = np.repeat(np.arange(len(n)), n)
        again = _seen_before(words, doc, STRETCH) if len(words) else np.zeros(0, bool)
        runs = np.zeros(len(words), dtype=bool)
        grams = runs_of(words, 4)
        if len(grams):
            inside = np.arange(len(grams)) + 4 <= before[1:][doc[: len(grams)]]
            runs[: len(grams)] = _seen_before(grams, doc[: len(grams)], None) & inside
        previous = np.zeros(len(words), dtype=bool)
        previous[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        flags = {
            "shout": (counts["upper"] >= 2) & (counts["lower"] == 0),
            "sign": counts["sign"] > 0,
            "mark": counts["mark"] > 0,
            "stop": counts["stop"] > 0,
            "digit": counts["digit"] > 0,
            "short": length <= 2,
            "long": length >= 16,
            "again": again,
            "runs": runs,
            "previous": previous,
        }
        for flag in flags.values():
            out += [_sums(flag, before) * per_word, _worst(flag, before)]
        made.append(np.stack(out, axis=1))
    return np.concatenate(made) if made else np.zeros((0, 31))


class Ranking:
    """Weights of standardised features, their squares included."""

    def __init__(self, x: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.weights = np.zeros(2 * x.shape[1])

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z / 6], axis=1)

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = 400) -> Ranking:
        """Adam on the logistic loss of ``pairs`` random preferences."""
        model, rng = cls(x), np.random.default_rng(11)
        z = model.inputs(x)
        winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
        if not len(winners) or not len(losers):
            return model
        ahead = z[rng.choice(winners, pairs)] - z[rng.choice(losers, pairs)]
        w, m, v = model.weights, 0.0, 0.0
        for step in range(1, steps + 1):
            lost = 1 / (1 + np.exp(np.clip(ahead @ w, -50, 50)))
            slope = 1e-3 * w - ahead.T @ lost / pairs
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.weights = w
        return model


FEATURED = "doc_id long, row long, features array<float>"


def _featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text")).astype(np.float32)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), lists],
                names=["doc_id", "row", "features"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, FEATURED)


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 31))


def _cut(labelled: DataFrame) -> float:
    """The quantile of the worth of all labelled rows that tells the labels apart best."""
    levels = labelled.agg(
        F.percentile_approx("worth", [i / LEVELS for i in range(1, LEVELS)], 10 * LEVELS)
    ).first()[0]
    if not levels:
        return 0.0
    levels = sorted(set(levels))
    reached = F.size(F.filter(F.array(*map(F.lit, levels)), lambda q: q <= F.col("worth")))
    counts = labelled.groupBy(reached.alias("reached"), "good").count().collect()
    right = [
        sum(r["count"] for r in counts if (r["reached"] > i) == r["good"])
        for i in range(len(levels))
    ]
    return levels[right.index(max(right))]


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    held_out,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
) -> DataFrame:
    """``doc_id``, ``row`` and ``score`` of every row of ``docs``: 0 to 1, ``CUT`` at the chosen quantile.

    ``held_out`` makes a condition of an id column; labels of such ids are not looked at. Weights
    are fitted on at most ``sample`` labelled rows of either label; all labelled rows choose the cut.
    A null text is scored as an empty one. Equal texts have equal scores. Without labels of both kinds
    there are no preferences, and every text has the score ``CUT``. No rows, no scores.
    """
    ship(docs.sparkSession)
    featured = durable(_featured(docs, id_col, text_col))
    learned = labels_of(labels, label_col, held_out)
    labelled = featured.join(learned, "doc_id")
    # bounded: at most twice ``sample`` rows of features
    table = sample_per_label(labelled.select("doc_id", "features", "good"), sample).toArrow()
    model, cut = None, 0.0
    good = np.array(table.column("good").to_pylist(), dtype=bool)
    if good.any() and not good.all():
        model = Ranking.fit(_rows(table.column("features").combine_chunks()), good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worth = model.worth(_rows(batch.column("features")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(worth, pa.float64())],
                names=["doc_id", "row", "worth"],
            )

    if model is None:
        ranked = featured.select("doc_id", "row", F.lit(0.0).alias("worth"))
    else:
        ranked = durable(featured.mapInArrow(run, "doc_id long, row long, worth double"))
        cut = _cut(ranked.join(learned, "doc_id"))
    ahead = F.col("worth") - F.lit(float(cut)) + float(np.log(CUT / (1 - CUT)))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), ahead))))
    return ranked.select(
        "doc_id",
        "row",
        # the rounding of the logistic function does not decide
        F.when(F.col("worth") >= float(cut), F.greatest(score, F.lit(CUT))).otherwise(score).alias("score"),
    )


def of_good_quality(
    docs: DataFrame,
    labels: DataFrame,
    held_out,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``CUT``, with all their columns."""
    docs = settled(docs)
    scores = quality_scores(docs, labels, held_out, label_col, id_col, text_col)
    kept = scores.filter(F.col("score") >= CUT).select(F.col("row").alias("__row"))
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    return numbered.join(kept, "__row", "left_semi").drop("__row")
