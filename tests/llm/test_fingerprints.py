"""Fingerprints against the true generalised Jaccard similarity."""

import hashlib
import re
from collections import Counter

from flowmark.llm import weighted_sampling as ws

from .tables import awkward, awkward_rows, empty, words


def similarity(a, b):
    a, b = (Counter(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in (a, b))
    every = a.keys() | b.keys()
    if not every:
        return 1.0
    return sum(min(a[w], b[w]) for w in every) / sum(max(a[w], b[w]) for w in every)


def edited(text, following):
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def check(rows, found):
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    gaps = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        r, other = by_id[doc_id], edited(text, following)
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        gaps.append(r.near_edited - similarity(text, other))
        gaps.append(r.near_next - similarity(text, following))
    return gaps


def shown(df):
    own, edit, following = (df[c] for c in ("signature", "edited_signature", "next_signature"))
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        ws.as_text(own).alias("fingerprint"),
        ws.likeness(own, edit).alias("near_edited"),
        ws.likeness(own, following).alias("near_next"),
    ).collect()


def test_likeness_estimates_similarity(spark, monkeypatch):
    monkeypatch.setattr(ws, "RANGE_CHARS", 40_000)
    rows = [(3 * i, " ".join(words(20 + 7 * i % 300, i // 2, 60))) for i in range(150)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)
    gaps = check(rows, shown(ws.neighbour_fingerprints(docs)))
    assert abs(sum(gaps) / len(gaps)) < 0.02
    assert sum(g * g for g in gaps) / len(gaps) < 1.5 * 0.25 / ws.SAMPLES


def test_awkward_rows(spark):
    rows = [(r[0], r[1] or "") for r in awkward_rows()[:17]]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(rows, schema).withColumn("range", awkward(spark).limit(0).count() + ws.F.lit(1))
    found = shown(ws.neighbour_fingerprints(docs))
    check(rows, found)
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints[8] == prints[9] != prints[10] and prints[0] == prints[1] == prints[2] == ""
    assert len(prints[3]) == 8 * ws.SAMPLES


def test_nulls_and_repeated_ids(spark):
    found = ws.neighbour_fingerprints(awkward(spark)).collect()
    assert len(found) == len(awkward_rows())
    one = spark.createDataFrame([(None, "a b c d e f g h")], "doc_id long, text string")
    (row,) = shown(ws.neighbour_fingerprints(one))
    assert row.near_next == 1.0 and row.doc_id is None


def test_no_rows(spark):
    assert ws.neighbour_fingerprints(empty(spark)).count() == 0
