"""Packing and encoding against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from flowmark.llm import packing, word_bpe
from flowmark.llm.queries import tokenizer_file

from .tables import awkward, awkward_rows, empty

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_ids():
    t = Tokenizer.from_file(BYTE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_hold_every_id_once(spark, byte_ids):
    rows = packing.pack(awkward(spark), BYTE, group_pieces=8).collect()
    wanted = sorted((r[0] is None, r[0], byte_ids(r[1])) for r in awkward_rows() if r[0] is not None)
    by_row = defaultdict(list)
    for r in rows:
        by_row[r.row].append(r)
    found = []
    for parts in by_row.values():
        parts.sort(key=lambda r: r.start)
        doc = parts[0].doc_id
        assert [p.start for p in parts] == list(range(0, parts[0].doc_tokens, 2048))
        assert sum(p.length for p in parts) == parts[0].doc_tokens
        found.append((doc, parts))
    assert len(found) == len(awkward_rows())
    lists = defaultdict(list)
    for _, doc, ids in wanted:
        lists[doc].append(ids)
    for doc, parts in found:
        if doc is None:
            continue
        assert any(
            len(ids) == parts[0].doc_tokens
            and all(
                zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
                == p.ids_crc32
                for p in parts
            )
            for ids in lists[doc]
        )


@pytest.mark.parametrize(
    "text", ["a   b\tc\td", " a", "a ", "a \n b", "a\n\nb c", "a\u00a0 b", "x\x1cy  z", "a b\nc", "", " ", "é  è"]
)
def test_ids_where_white_space_meets(byte_ids, text):
    ids = np.frombuffer(packing.ByteBpe(BYTE)(text), "<u4").tolist()
    assert ids == byte_ids(text)[:-1]


def test_sequences_are_gapless_and_full(spark):
    sequences = defaultdict(list)
    for r in packing.pack(awkward(spark), BYTE).collect():
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(3)
    lengths = sorted(rng.integers(1, 129, 700).tolist(), reverse=True)
    rooms, wanted = [], []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
            wanted.append(128 - min(fits))
        else:
            rooms.append(128 - n)
            wanted.append(0)
    placed = packing.best_fit(lengths, 128)
    assert [offset for _, offset in placed] == wanted
    assert len({w for w, _ in placed}) == len(rooms)


def test_word_ids_are_those_of_the_library(spark):
    t = Tokenizer.from_file(WORD)
    rows = word_bpe.decode(word_bpe.encode(awkward(spark), WORD), WORD).collect()
    found = sorted((r.doc_id, r.ids, r.decoded) for r in rows if r.doc_id is not None)
    wanted = []
    for doc_id, text, *_ in awkward_rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        wanted.append((doc_id, ids, t.decode(ids, skip_special_tokens=False)))
    assert found == sorted(w for w in wanted if w[0] is not None)
    assert len(rows) == len(wanted)
    both = word_bpe.encode_and_decode(awkward(spark), WORD).collect()
    assert sorted(map(tuple, both), key=str) == sorted(map(tuple, rows), key=str)


def test_no_rows(spark):
    assert packing.pack(empty(spark), BYTE).count() == 0
    assert word_bpe.decode(word_bpe.encode(empty(spark), WORD), WORD).count() == 0


def test_words_in_lines_have_the_ids_they_have_alone():
    t = Tokenizer.from_file(WORD)
    table = word_bpe._WordTable(WORD)
    words = ["plain", "İstanbul", "ΣΑΣ", "x.", "wow!?", "a.b", "é", "ǅ", "naïve,", "日本語", "", "...", "q" * 300, "don't"]
    words += [f"w{'abcdefghij'[i % 10]}{'xyz'[i % 3] * (i // 10)}" for i in range(200)]
    counts, ids = table(words)
    at = 0
    for w, n in zip(words, counts):
        assert ids[at : at + n].tolist() == t.encode(w, add_special_tokens=False).ids, w
        at += n


def test_words_are_joined_back_across_parts_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(word_bpe, "PART_BYTES", 300)
    monkeypatch.setattr(word_bpe, "BUCKET_BYTES", 500)
    rng = np.random.default_rng(5)
    words = [f"{'abcdefghij'[i % 10] * (1 + i % 4)}{i}" for i in range(60)] + ["The", "é.", "<|endoftext|>"]
    rows = [(i, rng.choice([" ", "\t", "\n"]).join(rng.choice(words, rng.integers(0, 40)))) for i in range(150)]
    rows += [(150, None), (151, "z" * 100_000), (152, "the " * 30_000)]
    t = Tokenizer.from_file(WORD)
    got = word_bpe.encode_and_decode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORD).collect()
    found = {r.doc_id: (r.ids, r.decoded) for r in got}
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert found[doc_id] == (ids, t.decode(ids, skip_special_tokens=False)), doc_id


def test_each_distinct_word_is_asked_for_once_per_part_and_encoded_once():
    import pyarrow as pa

    text = pa.array(["a b a", "b c", "a"])
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 7]), text], names=["part", "text"])
    asked = pa.Table.from_batches(list(word_bpe._requests(4)(iter([batch]))))
    words = [
        (p, w)
        for p, n, d in zip(*(asked[c].to_pylist() for c in ("part", "size", "words")))
        for w in bytes(word_bpe._unpacked(d, n)).decode().split("\n")
    ]
    assert sorted(words) == [(0, "a"), (0, "b"), (0, "c"), (7, "a")]
    bucket_of = {w: b for b, p, n, d in asked.to_pandas().itertuples(index=False) for w in bytes(word_bpe._unpacked(d, n)).decode().split("\n")}
    assert len({(w, b) for w, b in bucket_of.items()}) == 3
