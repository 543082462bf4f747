"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters the network as an embedding of the whole word beside the sum of embeddings of its character
runs, both by hash. Two gated recurrent layers read a window of words, one from either end; attention weighs
the places of the window, and the weighted states and inputs decide. All windows of a text are scored, each
overlapping the next by half, and the highest one is the text's, so that no part is left out and a long
clean text does not outweigh a short insult.

The network is fitted on the driver on a bounded sample of labelled texts: in each step the windows of a text
that score highest learn its label. Texts are scored where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmark.functions.durable import durable
from flowmark.functions.ship import ship
from flowmark.llm.common import known_rows, texts
from flowmark.llm.hashing import LOWER, mix, text_blocks, word_hashes, word_spans
from flowmark.llm.labelled import labels_of, sample_per_label

WINDOW, STRIDE = 32, 16
#: Buckets and sizes of the embeddings; size of a recurrent state and of the attention layer.
BUCKETS, WORD, CHARS, STATE, ATTEND = 1 << 15, 12, 12, 8, 8
#: Lengths of character runs, the blanks around a word included.
RUNS = (4, 7)
#: Windows scored together.
BATCH = 2048
#: Labelled texts per label that the network is fitted on, and their bytes in all; one text counts always.
SAMPLE, SAMPLE_BYTES = 1_500, 1 << 25
EPOCHS, BATCH_TEXTS = 6, 48
#: Part of the whole-word embeddings hidden in each step of the fit.
HIDDEN = 0.3

_FACTORS = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(max(RUNS))]


class Words:
    """The words of a block of texts: distinct ones as hash buckets, and every window as places in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, before = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends, lower=True)
        known, first, self.place = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (known % np.uint64(BUCKETS)).astype(np.int64)
        self.runs, self.run_counts = self._runs(data, starts[first], ends[first])
        counts = np.diff(before)
        windows = np.where(counts > 0, 1 + np.maximum(-(-(counts - WINDOW) // STRIDE), 0), 0)
        self.text = np.repeat(np.arange(len(counts)), windows)
        step = np.arange(len(self.text)) - np.repeat(np.cumsum(windows) - windows, windows)
        # the last window ends with the text
        latest = np.maximum(counts - WINDOW, 0)[self.text]
        self.begin = before[:-1][self.text] + np.minimum(step * STRIDE, latest)
        self.length = np.minimum(counts[self.text], WINDOW)

    @staticmethod
    def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Buckets of the character runs of words, and their number per word and length of run."""
        width = ends - starts + 2
        after = np.cumsum(width)
        index = np.arange(int(after[-1]) if len(after) else 0) + np.repeat(
            starts - 1 - (after - width), width
        )
        letters = LOWER[data[np.clip(index, 0, max(len(data) - 1, 0))]].astype(np.uint64)
        letters[after - 1] = letters[after - width] = 32
        runs, counts = [], []
        for n in RUNS:
            number = np.maximum(width - n + 1, 0)
            ahead = np.cumsum(number) - number
            at = np.arange(int(number.sum())) + np.repeat(after - width - ahead, number)
            total = np.full(len(at), n, dtype=np.uint64)
            for i in range(n):
                total += letters[at + i] * _FACTORS[i]
            runs.append((mix(total) % np.uint64(BUCKETS)).astype(np.int64))
            counts.append(number)
        return runs, counts

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of some windows, a row each, and which places are filled."""
        steps = np.arange(WINDOW)
        filled = steps < self.length[chosen][:, None]
        at = self.begin[chosen][:, None] + np.where(filled, steps, 0)
        return self.place[at], filled.astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
        size = WORD + CHARS
        self.p = {"word": draw(0.1, BUCKETS, WORD), "char": draw(0.1, BUCKETS, CHARS)}
        for way in ("f", "b"):
            self.p[f"in_{way}"] = draw(0.3, size, 3 * STATE)
            self.p[f"rec_{way}"] = draw(0.3, STATE, 3 * STATE)
            self.p[f"bias_{way}"] = np.zeros(3 * STATE, np.float32)
        self.p["att"] = draw(0.3, 2 * STATE + size, ATTEND)
        self.p["pick"] = draw(0.3, ATTEND)
        self.p["out"] = draw(0.3, 2 * STATE + size)
        self.p["base"] = np.zeros(1, np.float32)
        #: how the highest window's value becomes the score of a text; the score of a text without words
        self.slope, self.shift, self.empty = 1.0, 0.0, 0.0
        self.fitted = False

    # inputs

    def inputs(self, words: Words) -> np.ndarray:
        chars = np.zeros((len(words.bucket), CHARS), np.float32)
        for runs, counts in zip(words.runs, words.run_counts):
            some = counts > 0
            if some.any():
                ahead = (np.cumsum(counts) - counts)[some]
                chars[some] += np.add.reduceat(self.p["char"][runs], ahead, axis=0)
        return np.concatenate([self.p["word"][words.bucket], 0.3 * chars], axis=1)

    # forward

    def _way(self, way: str, x: np.ndarray, filled: np.ndarray, keep: list | None):
        """States of one layer at every place (places first), read from the front or from the back."""
        rec = self.p[f"rec_{way}"]
        h = np.zeros((x.shape[1], STATE), np.float32)
        states = np.empty((WINDOW, x.shape[1], STATE), np.float32)
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            own, carried = x[t], h @ rec
            gates = _sigmoid(own[:, : 2 * STATE] + carried[:, : 2 * STATE])
            z, r = gates[:, :STATE], gates[:, STATE:]
            new = np.tanh(own[:, 2 * STATE :] + r * carried[:, 2 * STATE :])
            step = filled[t][:, None] * (1 - z)
            if keep is not None:
                keep.append((t, h, z, r, new, carried[:, 2 * STATE :]))
            h = h + step * (new - h)
            states[t] = h
        return states

    def forward(self, x: np.ndarray, places: np.ndarray, filled: np.ndarray, kept: dict | None = None):
        """Value of every window. ``x`` has the inputs of the distinct words."""
        p, places, filled = self.p, places.T, filled.T
        ways = []
        for way in ("f", "b"):
            keep = [] if kept is not None else None
            own = (x @ p[f"in_{way}"] + p[f"bias_{way}"])[places]
            ways.append(self._way(way, own, filled, keep))
            if kept is not None:
                kept[way] = keep
        full = np.concatenate([*ways, x[places]], axis=2)
        hidden = np.tanh(full @ p["att"])
        weight = hidden @ p["pick"] + (filled - 1) * 1e9
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tb,tbd->bd", weight, full)
        if kept is not None:
            kept |= {"full": full, "hidden": hidden, "weight": weight, "pooled": pooled}
            kept |= {"places": places, "filled": filled, "x": x}
        return pooled @ p["out"] + p["base"][0]

    def values(self, words: Words) -> np.ndarray:
        x = self.inputs(words)
        parts = [
            self.forward(x, *words.windows(np.arange(at, min(at + BATCH, len(words.text)))))
            for at in range(0, len(words.text), BATCH)
        ]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    # backward

    def backward(self, slope: np.ndarray, kept: dict) -> dict[str, np.ndarray]:
        """Gradients of the dense parameters and of ``x``, given the slope at every window's value."""
        p, full, hidden, weight = self.p, kept["full"], kept["hidden"], kept["weight"]
        g = {"out": kept["pooled"].T @ slope, "base": np.array([slope.sum()], np.float32)}
        d_pooled = slope[:, None] * p["out"]
        d_full = weight[:, :, None] * d_pooled
        d_weight = np.einsum("bd,tbd->tb", d_pooled, full)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["pick"] = np.einsum("tb,tba->a", d_score, hidden)
        d_hidden = d_score[:, :, None] * p["pick"] * (1 - hidden * hidden)
        g["att"] = np.einsum("tbd,tba->da", full, d_hidden)
        d_full += d_hidden @ p["att"].T
        places, x = kept["places"], kept["x"]
        d_x = np.zeros_like(x)
        np.add.at(d_x, places, d_full[:, :, 2 * STATE :])
        for i, way in enumerate(("f", "b")):
            d_states = d_full[:, :, i * STATE : (i + 1) * STATE]
            rec, d_h = p[f"rec_{way}"], np.zeros_like(d_states[0])
            d_own = np.zeros((*places.shape, 3 * STATE), np.float32)
            d_rec = np.zeros_like(rec)
            for t, before, z, r, new, carried in reversed(kept[way]):
                d_h = d_h + d_states[t]
                m = kept["filled"][t][:, None]
                d_new = d_h * m * (1 - z) * (1 - new * new)
                d_z = -d_h * m * (new - before) * z * (1 - z)
                d_r = d_new * carried * r * (1 - r)
                d_own[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_carried = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_rec += before.T @ d_carried
                d_h = d_h * (1 - m * (1 - z)) + d_carried @ rec.T
            g[f"rec_{way}"] = d_rec
            g[f"bias_{way}"] = d_own.sum((0, 1))
            sums = np.zeros((len(x), 3 * STATE), np.float32)
            np.add.at(sums, places, d_own)
            g[f"in_{way}"] = x.T @ sums
            d_x += sums @ p[f"in_{way}"].T
        g["x"] = d_x
        return g

    # fitting

    def fit(self, column: pa.Array, toxic: np.ndarray, part_toxic: float, epochs: int = EPOCHS) -> Network:
        """Fit to labelled texts; ``part_toxic`` is the part of toxic ones among all labelled rows."""
        rng = np.random.default_rng(3)
        has_words = np.array([bool(t.as_py().split()) for t in column], dtype=bool)
        self.empty = part_toxic
        bad, good = np.flatnonzero(toxic & has_words), np.flatnonzero(~toxic & has_words)
        if not len(bad) or not len(good):
            return self
        self.fitted = True
        adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items() if k not in ("word", "char")}
        grown = {k: np.full((BUCKETS, 1), 1e-6, np.float32) for k in ("word", "char")}
        step, half = 0, BATCH_TEXTS // 2
        rounds = max(1, max(len(bad), len(good)) // half)
        for epoch in range(epochs):
            for _ in range(rounds):
                step += 1
                rows = np.concatenate([rng.choice(bad, half), rng.choice(good, half)])
                words = _words(column.take(pa.array(rows)))
                values = self.values(words)
                # highest windows: one of a toxic text, two of a clean one
                order = np.lexsort((-values, words.text))
                rank = np.arange(len(order)) - np.searchsorted(words.text[order], words.text[order])
                label = np.arange(len(rows)) < half
                chosen = order[rank < np.where(label[words.text[order]], 1, 2)]
                x, kept = self.inputs(words), {}
                # rare words are told by their characters: whole words are hidden at random
                shown = np.ones_like(x)
                shown[rng.random(len(x)) < HIDDEN, :WORD] = 0
                out = self.forward(x * shown, *words.windows(chosen), kept)
                slope = (_sigmoid(out) - label[words.text[chosen]]) / half
                g = self.backward(slope.astype(np.float32), kept)
                g["x"] *= shown
                self._update(words, g, adam, grown, step)
        self._calibrate(column, toxic, has_words, part_toxic)
        return self

    def _update(self, words: Words, g: dict, adam: dict, grown: dict, step: int) -> None:
        for k, (m, v) in adam.items():
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] ** 2 - v)
            self.p[k] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        d_x = g["x"]
        used = np.flatnonzero(np.abs(d_x).sum(1) > 0)
        self._rows("word", words.bucket[used], d_x[used, :WORD], grown)
        for runs, counts in zip(words.runs, words.run_counts):
            owner = np.repeat(np.arange(len(counts)), counts)
            mine = np.isin(owner, used)
            self._rows("char", runs[mine], 0.3 * d_x[owner[mine], WORD:], grown)

    def _rows(self, name: str, rows: np.ndarray, slopes: np.ndarray, grown: dict) -> None:
        distinct, place = np.unique(rows, return_inverse=True)
        total = np.zeros((len(distinct), slopes.shape[1]), np.float32)
        np.add.at(total, place, slopes)
        grown[name][distinct] += (total**2).mean(1, keepdims=True)
        self.p[name][distinct] -= 0.05 * total / np.sqrt(grown[name][distinct])

    def _calibrate(self, column, toxic, has_words, part_toxic) -> None:
        """Logistic fit of labels to highest windows, with labels weighed as often as they occur."""
        values, toxic = self.highest(column)[has_words], toxic[has_words]
        weight = np.where(toxic, part_toxic / toxic.sum(), (1 - part_toxic) / (~toxic).sum())
        self.slope, self.shift = 1.0, 0.0
        for _ in range(500):
            error = weight * (_sigmoid(self.slope * values + self.shift) - toxic)
            self.slope = max(0.05, self.slope - 0.5 * float((error * values).sum()))
            self.shift -= 0.5 * float(error.sum())

    # scoring

    def highest(self, column: pa.Array) -> np.ndarray:
        """The highest window value of each text; NaN without words."""
        out = np.full(len(column), np.nan)
        for first, data, offsets in text_blocks(column):
            words = Words(data, offsets)
            values = self.values(words)
            if len(values):
                begin = np.flatnonzero(np.concatenate([[True], words.text[1:] != words.text[:-1]]))
                out[first + words.text[begin]] = np.maximum.reduceat(values, begin)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if not self.fitted:
            return np.full(len(column), self.empty)
        values = self.highest(column)
        return np.where(np.isnan(values), self.empty, _sigmoid(self.slope * values + self.shift))


def _words(column: pa.Array) -> Words:
    blocks = list(text_blocks(column, 1 << 40))
    return Words(*blocks[0][1:])


def within_budget(rows: list[tuple], budget: int) -> list[tuple]:
    """Ids of ``(id, label, bytes, ...)`` whose texts have room in ``budget`` bytes a label, in order;
    the shortest text of a label always has."""
    shortest, used, out = {}, {}, []
    for doc_id, label, size, *_ in rows:
        shortest[label] = min(shortest.get(label, (size, doc_id)), (size, doc_id))
    for label, (size, doc_id) in shortest.items():
        used[label] = size
        out.append((doc_id,))
    for doc_id, label, size, *_ in rows:
        if doc_id != shortest[label][1] and used[label] + size <= budget:
            used[label] += size
            out.append((doc_id,))
    return out


def _fitted(
    docs: DataFrame, learned: DataFrame, sample: int, sample_bytes: int, epochs: int, id_col: str, text_col: str
) -> Network:
    """A network fitted to at most ``sample`` whole texts of either label, ``sample_bytes`` in all."""
    counts = {r["good"]: r["count"] for r in learned.groupBy("good").count().collect()}
    share = counts.get(True, 0) / max(1, sum(counts.values()))
    ids = [tuple(r) for r in sample_per_label(learned, sample).collect()]
    if len(counts) < 2:
        network = Network()
        network.empty = share
        return network
    wanted = known_rows(docs.sparkSession, ids, "doc_id long, good boolean")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    drawn = durable(
        plain.filter(F.col("text").isNotNull())
        .join(wanted, "doc_id")
        .groupBy("doc_id", "good")
        .agg(F.min("text").alias("text"))
    )
    # lengths only, a row per drawn text; a text past the budget leaves room for shorter ones after it
    lengths = drawn.select("doc_id", "good", F.octet_length("text"), F.xxhash64("doc_id").alias("at"))
    fits = within_budget([tuple(r) for r in lengths.orderBy("at", "doc_id").collect()], sample_bytes)
    table = (
        drawn.join(known_rows(docs.sparkSession, fits, "doc_id long"), "doc_id").orderBy("doc_id").toArrow()
    )
    labels = np.array(table.column("good").to_pylist(), dtype=bool)
    column = table.column("text").combine_chunks()
    return Network().fit(column, labels, share, epochs)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    held_out,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    sample_bytes: int = SAMPLE_BYTES,
    epochs: int = EPOCHS,
) -> DataFrame:
    """``doc_id``, ``row`` and ``score`` (0 to 1, higher: label 1 likelier) of every row of ``docs``.

    ``held_out`` makes a condition of an id column; labels of such ids are not looked at. The
    network learns from at most ``sample`` whole texts of either label, of at most ``sample_bytes`` in all
    for a label (one text counts always); the driver holds no more of the documents.
    A null, empty or blank text has the part of label 1 as its score, and so has every text where
    labels of one kind are missing (0 without labels). Equal texts have equal scores. No rows, no scores.
    """
    ship(docs.sparkSession)
    network = _fitted(
        docs, labels_of(labels, label_col, held_out), sample, sample_bytes, epochs, id_col, text_col
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array(network.scores(batch.column("text")), pa.float64()),
                ],
                names=["doc_id", "row", "score"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, row long, score double")
