"""Benchmark passages in documents: a broadcast hash set of the benchmark's word windows.

A word is a run of ASCII letters (lower-cased), digits and characters beyond ASCII. A window is a number of
consecutive words of a benchmark item; an item of fewer words, but not none, is one window.

1. Spark cuts the items into pieces of bounded length that overlap by a window less one word, and deals them
   into parts of about ``PART_BYTES``. Each part is collected, turned into a sorted set of window hashes
   with the words behind them, and broadcast, so no broadcast grows with the benchmark: a larger one has more
   parts, and the documents are scanned once for each.
2. A scan hashes all word windows of the documents, looks them up in the set, and compares the words of
   every hit with those of the benchmark. Nothing of the documents is shuffled for one part; with several, the
   hits of a document in each part are brought together by its row.
3. The words that hits cover, or the documents that have any, are removed.

Nulls and empty texts have no words. A text may be of any length: blocks are hashed one text at a time. Items
with equal ids are one item; an item without id is called by the empty text. Repeated documents are judged one
by one, equal windows of several items count for each of them. An empty benchmark leaves all documents as
they are. Columns of any name are kept by :func:`decontaminated` and left behind by :func:`contamination`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmark.functions.durable import durable
from flowmark.functions.ship import ship
from flowmark.llm.common import settled, texts
from flowmark.llm.hashing import LOWER, runs_of, text_blocks, word_hashes, word_spans

#: Bytes of normalised benchmark text in one broadcast, and words of a piece of an item.
PART_BYTES = 8 << 20
PIECE_WORDS = 20_000
SPANS = "array<struct<start:long,end:long>>"
#: Every byte of a word in lower case, every other byte as a space.
_NORMAL = np.full(256, 0x20, dtype=np.uint8)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _NORMAL[_first : _last + 1] = LOWER[_first : _last + 1]


class _Words:
    """The words of a block of texts, one space apart, and a hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        plain = _NORMAL[data]
        starts, ends, self.before = word_spans(plain, offsets)
        self.at, self.until = starts, ends  # in the texts as they are
        self.hashes = word_hashes(plain, starts, ends)
        lengths = ends - starts
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.ends = self.starts + lengths
        joined = np.full(int(lengths.sum()) + len(lengths), 0x20, dtype=np.uint8)
        places = np.repeat(self.starts - starts, lengths) + np.flatnonzero(plain != 0x20)
        joined[places] = plain[plain != 0x20]
        self.joined = joined.tobytes()

    def run(self, first: int, n: int) -> bytes:
        return self.joined[self.starts[first] : self.ends[first + n - 1]]

    def windows(self, n: int) -> np.ndarray:
        """Numbers of the words at which ``n`` words of one text start."""
        counts = np.maximum(np.diff(self.before) - n + 1, 0)
        ahead = np.cumsum(counts) - counts
        return np.arange(counts.sum()) + np.repeat(self.before[:-1] - ahead, counts)


def pieces(benchmark: DataFrame, words: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item`` and ``piece``: normalised text of at most ``PIECE_WORDS`` words, in which every window of
    the item lies somewhere."""
    size = max(PIECE_WORDS, words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, items, found = batch.column(0).to_pylist(), [], []
            for base, data, offsets in text_blocks(batch.column(1)):
                block = _Words(data, offsets)
                for i, (first, last) in enumerate(zip(block.before[:-1], block.before[1:])):
                    for start in range(first, max(last - words + 1, first + 1), size - words + 1):
                        if start < last:
                            found.append(block.run(start, min(size, last - start)).decode())
                            items.append(names[base + i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(found, pa.string())], names=["item", "piece"]
            )

    ship(benchmark.sparkSession)
    named = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return named.mapInArrow(cut, "item string, piece string").distinct()


class WindowSet:
    """Window hashes of a part of the benchmark, sorted, with the words and items behind them."""

    def __init__(self, rows: list[tuple[str, str]], words: int):
        self.items = sorted({item for item, _ in rows})
        number = {item: i for i, item in enumerate(self.items)}
        encoded = [piece.encode() for _, piece in rows]
        offsets = np.cumsum([0, *map(len, encoded)])
        block = _Words(np.frombuffer(b"".join(encoded), dtype=np.uint8), offsets)
        owner = np.array([number[item] for item, _ in rows], dtype=np.int64)
        counts = np.diff(block.before)
        self.joined, self.tables = block.joined, {}
        for n in sorted({min(int(c), words) for c in counts if c}):
            at = block.windows(n)
            if n < words:  # only items that have no more words
                at = block.before[:-1][counts == n]
            piece_of = np.searchsorted(block.before, at, side="right") - 1
            self.tables[n] = self._table(block, at, owner[piece_of], n)

    @staticmethod
    def _table(block: _Words, at: np.ndarray, item: np.ndarray, n: int):
        """Distinct windows by hash: where their words lie, and the items of each (a range of a list)."""
        hashes = runs_of(block.hashes, n)[at]
        order = np.lexsort((item, hashes))
        at, item, hashes = at[order], item[order], hashes[order]
        text = np.arange(len(at))  # number of the first window with the same words
        for i in np.flatnonzero(hashes[1:] == hashes[:-1]) + 1:
            j = i - 1
            while j >= 0 and hashes[j] == hashes[i]:
                if text[j] == j and block.run(at[j], n) == block.run(at[i], n):
                    text[i] = j
                    break
                j = text[j] if text[j] < j else j - 1
        grouped = np.lexsort((item, text))
        text, item = text[grouped], item[grouped]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        text, item = text[new], item[new]
        distinct, first = np.unique(text, return_index=True)
        ends = np.append(first[1:], len(text))
        return hashes[distinct], block.starts[at[distinct]], block.ends[at[distinct] + n - 1], first, ends, item

    def hits(self, block: _Words) -> Iterator[tuple[int, int, np.ndarray]]:
        """First word, number of words and items of every window that occurs in ``block``."""
        for n, (hashes, starts, ends, first, last, item) in self.tables.items():
            at = block.windows(n)
            looked = runs_of(block.hashes, n)[at]
            place = np.searchsorted(hashes, looked)
            place[place == len(hashes)] = 0
            for i in np.flatnonzero(hashes[place] == looked):
                word, entry = int(at[i]), int(place[i])
                while entry < len(hashes) and hashes[entry] == looked[i]:
                    if self.joined[starts[entry] : ends[entry]] == block.run(word, n):
                        yield word, n, item[first[entry] : last[entry]]
                        break
                    entry += 1


def _parts(benchmark: DataFrame, words: int, id_col: str, text_col: str) -> Iterator[WindowSet]:
    """The window sets of the benchmark, one part in memory at a time."""
    found = durable(pieces(benchmark, words, id_col, text_col))
    total = found.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    parts = -(-total // PART_BYTES)
    for part in range(parts):
        own = F.pmod(F.xxhash64("item", "piece"), F.lit(parts)) == part
        rows = found.filter(own).toArrow()  # about PART_BYTES
        yield WindowSet(list(zip(rows["item"].to_pylist(), rows["piece"].to_pylist())), words)


def _scan(docs: DataFrame, windows: WindowSet, doc_type: T.DataType) -> DataFrame:
    """Hits of one part in each document: spans of word numbers, merged, and names of items."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            counts, spans, items = [], [], []
            for _, data, offsets in text_blocks(batch.column("text")):
                block = _Words(data, offsets)
                cover = np.zeros(len(block.hashes) + 1, dtype=np.int64)
                named: dict[int, set[int]] = {}
                for word, n, owners in known.hits(block):
                    cover[word] += 1
                    cover[word + n] -= 1
                    text = int(np.searchsorted(block.before, word, side="right")) - 1
                    named.setdefault(text, set()).update(owners.tolist())
                covered = np.cumsum(cover) > 0
                for i, (first, last) in enumerate(zip(block.before[:-1], block.before[1:])):
                    counts.append(int(last - first))
                    own = np.flatnonzero(np.diff(covered[first:last], prepend=False, append=False)) if i in named else ()
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(own[::2], own[1::2])])
                    items.append(sorted(known.items[k] for k in named.get(i, ())))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["doc_id", "row", "n_words", "spans", "items"],
            )

    schema = T.StructType([T.StructField("doc_id", doc_type)])
    for name, kind in (("row", "long"), ("n_words", "long"), ("spans", SPANS), ("items", "array<string>")):
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return docs.mapInArrow(scan, schema)


def _merged(spans):
    """Spans in order of their starts, those that overlap or touch as one."""
    one = "struct<start:long,end:long>"
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(SPANS),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
                    ).cast(one)
                ),
            ),
        ).otherwise(F.concat(done, F.array(x.cast(one)))),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row per document: ``doc_id``, ``row`` (tells repeated rows apart), ``n_words``, ``spans`` of word
    numbers (from 0, end exclusive, in order, apart) that windows of the benchmark cover, and ``items``,
    the ids as text, sorted, of the items with windows in it."""
    ship(docs.sparkSession)
    plain = texts(docs, id_col, text_col)
    kind = plain.schema["doc_id"].dataType
    sets = _parts(benchmark, words, item_col, item_text_col)
    scans = [_scan(plain, part, kind) for part in sets] or [_scan(plain, WindowSet([], words), kind)]
    if len(scans) == 1:
        return scans[0]
    found = scans[0]
    for scan in scans[1:]:
        found = found.unionByName(scan)
    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        _merged(F.flatten(F.collect_list("spans"))).alias("spans"),  # a list per part
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).select("doc_id", "row", "n_words", "spans", "items")


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = 10,
    remove: str = "spans",
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without benchmark passages: ``remove="spans"`` cuts the covered words out of the texts, from
    the first letter of a span to the last; ``"documents"`` leaves out documents that have any.

    Texts without hits, null ones too, stay as they are. Input that comes out of a shuffle is stored first.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"unknown removal {remove!r}")
    docs = settled(docs)
    row = "__row"
    while row in docs.columns:
        row = f"_{row}"
    found = contamination(docs, benchmark, words, id_col, text_col, item_col, item_text_col)
    found = found.filter(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(f"{row}s"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    if remove == "documents":
        return numbered.join(found, row, "left_anti").select(*docs.columns)
    cut = F.arrow_udf(_without, "string")
    kept = F.when(F.col(f"{row}s").isNull(), F.col(text_col)).otherwise(cut(text_col, f"{row}s"))
    return numbered.join(found, row, "left").withColumn(text_col, kept).select(*docs.columns)


def _without(column: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words of their spans; null where there are none to cut."""
    out = []
    for text, cuts in zip(column, spans):
        if not text.is_valid or not cuts.is_valid:
            out.append(None)
            continue
        data = text.as_py().encode()
        block = _Words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
        kept, at = [], 0
        for span in cuts.as_py():
            kept.append(data[at : block.at[span["start"]]])
            at = int(block.until[span["end"] - 1])
        out.append(b"".join([*kept, data[at:]]).decode())
    return pa.array(out, pa.string())
