"""Repeated passages against brute force."""

import random
import re

import pytest

from flowmark.llm import phrases

from .tables import awkward, awkward_rows, empty, words


def brute_force(rows, window):
    seen, out = set(), []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            t = tuple(w[i : i + window])
            if t in seen:
                gone.update(range(i, i + window))
            seen.add(t)
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=str)


def passages(n, seed):
    """Texts that share passages, one of them in many texts, some repeated inside a text."""
    rng = random.Random(seed)
    shared = [words(rng.randrange(15, 90), 100 + i) for i in range(8)]
    rows = []
    for i in range(n):
        text = words(rng.randrange(0, 120), seed * 10_000 + i)
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(text) + 1)
            piece = rng.choice(shared) if rng.random() < 0.5 else shared[0]
            text[at:at] = piece * rng.choice([1, 1, 2])
        if rng.random() < 0.1:
            text += ["echo"] * 45
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(n + i, rows[i][1]) for i in range(0, n, 9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [(8000, 4000), (40, 10)])
def test_shared_passages(spark, monkeypatch, limits):
    monkeypatch.setattr(phrases, "SHARD", limits[0])
    monkeypatch.setattr(phrases, "HOT", limits[1])
    rows = passages(250, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(phrases.without_repeats(docs, 20)) == brute_force(rows, 20)


def test_awkward_rows(spark):
    # of the rows with one id, both have texts that are too short to matter
    assert found(phrases.without_repeats(awkward(spark), 20)) == brute_force(awkward_rows(), 20)


def test_no_rows(spark):
    assert phrases.without_repeats(empty(spark), 20).count() == 0
