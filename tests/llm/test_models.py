"""Quality and toxicity: held-out accuracy, gradients by differences, awkward tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

from flowmark.llm import quality, toxicity
from flowmark.llm.labelled import remainder
from flowmark.llm.queries import quality_held_out, toxic_held_out

from .tables import awkward, awkward_rows, empty, words

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n, seed):
    """Every fifth text shouts, every fourth one has an insult with a changing end."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = words(rng.randrange(5, 150), seed * 7919 + i, 900)
        bad, toxic = i % 5 == 0, i % 4 == 1
        if bad:
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() + "!!" for w in words(30, i)]
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text) + 1), f"zwurgl{rng.randrange(10**5)}")
        rows.append((i, " ".join(text), int(not bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(
        [(i, q, t, "other") for i, _, q, t in rows if i % 3]
        + [(None, 0, 0, ""), (2, None, None, ""), (10**9, 1, 1, "")],
        LABELS,
    )
    return rows, docs, labels


def test_quality_on_held_out_rows(spark, tables):
    rows, docs, labels = tables
    scores = quality.quality_scores(docs, labels, quality_held_out).withColumn(
        "held", quality_held_out(quality.F.col("doc_id"))
    )
    found = {r.doc_id: r for r in scores.collect()}
    held = [r for r in rows if found[r[0]].held]
    assert len(found) == len(rows) and 100 < len(held) < 400
    right = sum((found[i].score >= 0.7) == bool(q) for i, _, q, _ in held)
    assert right >= 0.97 * len(held)
    kept = quality.of_good_quality(docs, labels, quality_held_out).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i in found if found[i].score >= 0.7)


def test_toxicity_on_held_out_rows(spark, tables):
    rows, docs, labels = tables
    scores = toxicity.toxicity_scores(docs, labels, toxic_held_out, epochs=8)
    found = {r.doc_id: r.score for r in scores.collect()}
    held = {
        r.doc_id for r in docs.filter(toxic_held_out(quality.F.col("doc_id"))).collect()
    }
    right = sum((found[i] >= 0.5) == bool(t) for i, _, _, t in rows if i in held)
    assert right >= 0.95 * len(held)


def test_held_out_parts(spark):
    import zlib

    ids = spark.createDataFrame([(i,) for i in range(-5, 50)] + [(None,)], "doc_id long")
    for r in ids.withColumn("m", remainder(ids.doc_id, 4)).collect():
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.m == zlib.crc32(text.encode()) % 4


def test_gradients_by_differences():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    column = pa.array([" ".join(words(50, 1)), "a few words", "ääh öö"])
    block = toxicity._words(column)
    every = np.arange(len(block.text))
    weight = np.array([0.3, -0.7, 1.1, 0.4, -0.2])[: len(every)]

    def value():
        return float(net.forward(net.inputs(block).astype(np.float64), *block.windows(every)) @ weight)

    kept = {}
    x = net.inputs(block).astype(np.float64)
    net.forward(x, *block.windows(every), kept)
    slopes = net.backward(weight, kept)
    for name in ("in_f", "rec_f", "bias_b", "rec_b", "att", "pick", "out", "base"):
        flat = net.p[name].reshape(-1)
        for at in (0, len(flat) // 2, len(flat) - 1):
            old = flat[at]
            flat[at] = old + 1e-3
            up = value()
            flat[at] = old - 1e-3
            down = value()
            flat[at] = old
            assert slopes[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=2e-3)


def test_windows_cover_whole_texts():
    texts = [" ".join(words(n, n)) for n in (1, 31, 32, 33, 47, 48, 49, 500)]
    block = toxicity._words(pa.array([*texts, "", " "]))
    for i, text in enumerate(texts):
        mine = block.text == i
        first = block.begin[mine] - block.begin[mine].min()
        assert first[0] == 0 and first[-1] + block.length[mine][-1] == len(text.split())
        assert (np.diff(first) <= toxicity.STRIDE).all()
    assert set(block.text) == set(range(len(texts)))


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0, "") for i in range(40)], LABELS)
    for scores, empty_score in (
        (quality.quality_scores(docs, labels, quality_held_out), None),
        (toxicity.toxicity_scores(docs, labels, toxic_held_out, epochs=1), None),
        (quality.quality_scores(docs, empty(spark).select("doc_id", quality.F.lit(1).alias("quality")), quality_held_out), quality.CUT),
        (toxicity.toxicity_scores(docs, empty(spark).select("doc_id", quality.F.lit(1).alias("toxic")), toxic_held_out), 0.0),
    ):
        rows = scores.collect()
        assert len(rows) == len(awkward_rows())
        assert all(0 <= r.score <= 1 for r in rows)
        by_id = {r.doc_id: r.score for r in rows}
        assert by_id[0] == by_id[1] and by_id[8] == by_id[9]
        if empty_score is not None:
            assert set(by_id.values()) == {empty_score}


def test_no_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0, ""), (2, 0, 1, "")], LABELS)
    assert quality.quality_scores(empty(spark), labels, quality_held_out).count() == 0
    assert toxicity.toxicity_scores(empty(spark), labels, toxic_held_out).count() == 0


def test_toxicity_learns_from_long_texts(spark):
    """All labelled texts are longer than 16 KB: they are fitted whole, insults at their ends included."""
    filler = "the meeting went on about plans and figures of the year " * 320
    rows = [(i, filler + ("you worthless stupid idiot" if i % 2 else "with kind regards"), i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    none = lambda column: column < 0
    scores = toxicity.toxicity_scores(frame.drop("toxic"), frame.drop("text"), none, epochs=3)
    by_id = {r.doc_id: r.score for r in scores.collect()}
    assert min(by_id[i] for i in by_id if i % 2) > 0.5 > max(by_id[i] for i in by_id if i % 2 == 0)


def test_budget_of_bytes_keeps_a_text_of_either_label():
    rows = [(1, True, 90), (2, True, 20), (3, False, 500), (4, True, 70), (5, False, 900)]
    assert sorted(toxicity.within_budget(rows, 100)) == [(2,), (3,), (4,)]


def test_the_byte_budget_keeps_whole_texts_and_one_of_each_label():
    rows = [(1, True, 50, 0), (2, True, 200, 0), (3, False, 90, 0), (4, True, 60, 0), (5, True, 10, 0), (6, False, 95, 0)]
    assert sorted(toxicity.within_budget(rows, 100)) == [(1,), (3,), (5,)]
    assert sorted(toxicity.within_budget(rows, 0)) == [(3,), (5,)]
