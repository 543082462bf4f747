"""Benchmark passages in documents against brute force."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from flowmark.llm import decontamination
from flowmark.llm.queries import op13_decontamination

from .tables import SCHEMA, awkward, awkward_rows, empty, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BENCH = "item_id long, text string, doc_id long, spans string"


def tokens(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_force(rows, benchmark, n=10):
    windows = {}
    for item, text, *_ in benchmark:
        w = tokens(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, items = tokens(text), set(), set()
        for size in range(1, n + 1):
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    items |= found
        names = ",".join(sorted(items))
        out.append((doc_id, len(w), len(hit), len(items), sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def found(spark, tmp_path, docs, benchmark):
    path = str(tmp_path / "t")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*b, 1, "s") for b in benchmark], BENCH).write.parquet(f"{path}/benchmark.parquet")
    return sorted((tuple(r) for r in op13_decontamination(spark, path).select(*NAMES).collect()), key=str)


def leaks(n, seed):
    rng = random.Random(seed)
    benchmark = [(i, " ".join(words(rng.randrange(1, 30), 50 + i, 60))) for i in range(12)]
    benchmark += [(3, "Three WORDS-only."), (20, benchmark[0][1]), (None, "no id here at all"), (21, None), (22, " .,; ")]
    rows = []
    for i in range(n):
        text = words(rng.randrange(0, 90), seed * 1000 + i, 60)
        for _ in range(rng.randrange(0, 3)):
            leak = (rng.choice(benchmark)[1] or "").split()
            cut = rng.randrange(len(leak) + 1)
            text[rng.randrange(len(text) + 1) : 0] = leak[cut:] if rng.random() < 0.4 else leak
        joined = rng.choice([" ", ", ", "\n", "-"]).join(text)
        rows.append((i, joined.upper() if rng.random() < 0.3 else joined))
    return rows, benchmark


@pytest.mark.parametrize("limits", [(8 << 20, 20_000), (300, 14)])
def test_leaks(spark, tmp_path, monkeypatch, limits):
    monkeypatch.setattr(decontamination, "PART_BYTES", limits[0])
    monkeypatch.setattr(decontamination, "PIECE_WORDS", limits[1])
    rows, benchmark = leaks(200, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(spark, tmp_path, docs, benchmark) == brute_force(rows, benchmark)


def test_equal_hashes_are_told_apart(spark, tmp_path, monkeypatch):
    # with hashes of three values all that decides is the comparison of words
    real = decontamination.runs_of
    monkeypatch.setattr(decontamination, "runs_of", lambda x, n: real(x, n) % 3)
    rows, benchmark = leaks(1, 5)
    known = decontamination.WindowSet([(str(i), " ".join(tokens(t))) for i, t in benchmark if tokens(t)], 10)
    for _, text in leaks(40, 6)[0]:
        data = text.encode()
        block = decontamination._Words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
        hit = {w for first, n, _ in known.hits(block) for w in range(first, first + n)}
        named = [("", t) if i is None else (i, t) for i, t in benchmark]
        assert len(hit) == brute_force([(0, text)], named)[0][2]


def test_awkward_rows(spark, tmp_path):
    rows = awkward_rows()
    benchmark = [(1, "same text"), (2, "  "), (3, rows[8][1][500:900]), (4, "Σας İ"), (5, "ONE"), (4, "don't do"), (6, "word " * 40)]
    assert found(spark, tmp_path, awkward(spark), benchmark) == brute_force(rows, benchmark)


def test_one_endless_word_and_megabytes(spark, tmp_path):
    rows = [(0, "x" * 3_000_000), (1, "a b c " * 400_000 + "p q r s"), (2, "p q r s")]
    benchmark = [(0, "p q r s"), (1, "c a b c a b c a b c a"), (2, "x" * 3_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1:4] for r in found(spark, tmp_path, docs, benchmark)}
    assert got == {0: (1, 1, 1), 1: (1_200_004, 1_200_004, 2), 2: (4, 4, 1)}


def test_no_rows(spark, tmp_path):
    assert found(spark, tmp_path, empty(spark), [(1, "a b")]) == []
    rows = [(1, "a b")]
    assert found(spark, tmp_path / "b", spark.createDataFrame(rows, "doc_id long, text string"), []) == brute_force(rows, [])


def test_removal(spark):
    docs = spark.createDataFrame(
        [(1, "Keep this, LEAKED one two! and that.", "en", 5), (2, None, "en", 6), (3, "leaked One two", "de", 7), (3, "clean", "", 8)],
        "doc_id long, text string, row string, __row int",
    )
    benchmark = spark.createDataFrame([(1, "leaked one two")], "item_id long, text string")
    cut = decontamination.decontaminated(docs, benchmark)
    assert cut.columns == docs.columns
    assert sorted(map(tuple, cut.collect()), key=str) == [
        (1, "Keep this, ! and that.", "en", 5), (2, None, "en", 6), (3, "", "de", 7), (3, "clean", "", 8),
    ]
    kept = decontamination.decontaminated(docs, benchmark, remove="documents")
    assert sorted(map(tuple, kept.collect()), key=str) == [(2, None, "en", 6), (3, "clean", "", 8)]
    with pytest.raises(ValueError):
        decontamination.decontaminated(docs, benchmark, remove="lines")


def test_clashing_columns(spark):
    assert {"row", "blob", "words"} <= {f.split()[0] for f in SCHEMA.split(", ")}
    out = decontamination.decontaminated(awkward(spark), spark.createDataFrame([], "item_id long, text string"))
    assert sorted(map(str, out.collect())) == sorted(map(str, awkward(spark).collect()))
