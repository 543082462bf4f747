"""Encoding and decoding with a word-level BPE through one table of distinct words.

Texts are split into words at white space, which no token of such a tokenizer crosses.

1. Documents next to each other form a part. Each part asks for its distinct words; the requests are dealt to buckets
   by a hash of the word, so that all requests for a word meet in one task.
2. A bucket has a table of its distinct words, each of which is encoded once in the whole corpus, by the tokenizers
   library itself. Plain words are encoded many to a line, since a call costs more than a word. The bucket answers
   every part with the ids of the words it asked for.
3. Answers and documents of a part meet in one task, the answers first. Words are joined with them by their
   positions, a block of documents at a time, and ids with the table of pieces for decoding.

Requests, answers and blocks of documents are shuffled packed and compressed: a row for every word would be several
times the input. A task holds the distinct words of one part or bucket and one block; their numbers grow with
the corpus, not their sizes. A word is asked for at most once per part, so a frequent one is no hot key.

Null and empty texts have no ids. Texts and words of any length are whole, in a block of their own if need be.
Repeated rows are encoded one by one; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmark.functions.ship import ship
from flowmark.llm.common import PART_BITS, texts
from flowmark.llm.hashing import word_hashes

#: Bytes of text of a part, of a block of documents, and for which there is one more bucket.
PART_BYTES, BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 1 << 20, 16 << 20
#: Marks that a plain word may end with, words encoded in one line, and how a token ends that ends a word.
MARKS, LINE, END = ".,;:!?", 64, "</w>"
#: List entries decoded at a time.
BLOCK_ENTRIES = 500_000
ANSWER, DOCUMENTS = 0, 1


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray:
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    ends = np.zeros(1 + max(vocab.values()), dtype=bool)
    ends[[i for t, i in vocab.items() if t.endswith(END)]] = True
    return ends


class _WordTable:
    """The distinct words of a bucket and their ids, each encoded once."""

    def __init__(self, path: str):
        self.coder, self.ends = _tokenizer(path), _word_ends(path)
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]):
        return self.coder.encode_batch_fast(texts, add_special_tokens=False)

    def _cut(self, line: list[str], ids: list[int]) -> None:
        """Deal the ids of a line of plain words out to them, if they have as many ends as expected."""
        found = np.array(ids, dtype="<i4")
        ends = np.flatnonzero(self.ends[found])
        last = np.cumsum([1 if w.isalpha() else 2 for w in line]) - 1
        if len(ends) != last[-1] + 1:
            return
        data, at = found.tobytes(), 0
        for word, end in zip(line, (4 * (ends[last] + 1)).tolist()):
            self.known[word] = data[at:end]
            at = end

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids one after the other."""
        new = [w for w in words if w not in self.known]
        # letters, with or without marks behind them: one token ends with the letters, one with the marks
        plain = [w for w in new if w.rstrip(MARKS).isalpha()]
        lines = [plain[at : at + LINE] for at in range(0, len(plain), LINE)]
        for at in range(0, len(lines), 64):
            some = lines[at : at + 64]
            for line, e in zip(some, self._encode([" ".join(x) for x in some])):
                self._cut(line, e.ids)
        rest = [w for w in new if w not in self.known]
        for at in range(0, len(rest), 1024):
            some = rest[at : at + 1024]
            for word, e in zip(some, self._encode(some)):
                self.known[word] = np.array(e.ids, dtype="<i4").tobytes()
        parts = [self.known[w] for w in words]
        counts = np.fromiter(map(len, parts), "int64", len(parts)) // 4
        return counts, np.frombuffer(b"".join(parts), dtype="<i4")


def _packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> memoryview:
    return memoryview(pa.decompress(data, decompressed_size=size, codec="zstd"))


def _strings(data, lengths: np.ndarray) -> pa.Array:
    """Texts of these lengths in bytes, one after the other in ``data``."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    buffers = [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(data)]
    return pa.LargeStringArray.from_buffers(len(lengths), buffers[1], buffers[2])


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where its texts start and end in them."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], "<i8")[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _row_batch(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    part, sort, seq, ids, numbers, sizes, *blobs = list(zip(*rows)) or [()] * 9
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part, pa.int64()), pa.array(sort, pa.int32()), pa.array(seq, pa.int64()),
            pa.array([pa.array(x, kind) for x in ids] if ids else [], pa.list_(kind)),
            pa.array(numbers, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64())),
            *[pa.array(b, pa.binary()) for b in blobs],
        ],
        names=_NAMES,
    )


_NAMES = ["part", "kind", "seq", "doc_ids", "rows", "sizes", "first", "second", "third"]


def _packed_schema(kind: T.DataType) -> T.StructType:
    types = [T.LongType(), T.IntegerType(), T.LongType(), T.ArrayType(kind), *[T.ArrayType(T.LongType())] * 2]
    types += [T.BinaryType()] * 3
    return T.StructType([T.StructField(n, t) for n, t in zip(_NAMES, types)])


def _requests(buckets: int):
    """Documents to rows (bucket, part, packed words): the distinct words of every part, by their buckets."""

    def asked(part: int, found: list[pa.Array]) -> pa.RecordBatch:
        words = pa.chunked_array(found).unique().cast(pa.large_string())
        words = words.take(pc.sort_indices(words))
        data, offsets = _bytes_of(words)
        bucket = word_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        numbers, starts = np.unique(bucket[order], return_index=True)
        words, ends = words.take(pa.array(order)).to_pylist(), np.append(starts, len(order))
        joined = ["\n".join(words[a:b]).encode() for a, b in zip(ends[:-1], ends[1:])]
        packed = [_packed(x) for x in joined]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(numbers.astype("int64")),
                pa.array([part] * len(packed), pa.int64()),
                pa.array(list(map(len, joined)), pa.int64()),
                pa.array(packed, pa.binary()),
            ],
            names=["bucket", "part", "size", "words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found = None, []
        for batch in batches:
            parts, text = batch.column("part").to_numpy(), batch.column("text")
            for first, last in _runs(parts, _bytes_of(text)[1]):
                if parts[first] != current:
                    if found:
                        yield asked(current, found)
                    current, found = int(parts[first]), []
                found.append(pc.ascii_split_whitespace(text.slice(first, last - first)).flatten().unique())
                if len(found) == 16:
                    found = [pa.chunked_array(found).unique()]
        if found:
            yield asked(current, found)

    return run


def _runs(parts: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of one part with about ``BLOCK_BYTES`` of text, one row at least."""
    first = 0
    while first < len(parts):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        other = np.flatnonzero(parts[first : max(last, first + 1)] != parts[first])
        last = first + int(other[0]) if len(other) else min(max(last, first + 1), len(parts))
        yield first, last
        first = last


def _answers(tokenizer: str, kind: pa.DataType):
    """Requests, sorted by bucket, to the ids of the words asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, table = None, None
        for batch in batches:
            columns = (batch.column(c) for c in ("bucket", "part", "size", "words"))
            for own, part, size, packed in zip(*(c.to_pylist() for c in columns)):
                if own != bucket:
                    bucket, table = own, _WordTable(tokenizer)
                counts, ids = table(bytes(_unpacked(packed, size)).decode().split("\n"))
                sizes = [size, 4 * len(counts), 4 * len(ids)]
                blobs = packed, _packed(counts.astype("<u4").tobytes()), _packed(ids.tobytes())
                yield _row_batch(kind, [(part, ANSWER, own, [], [], sizes, *blobs)])

    return run


def _packed_documents(kind: pa.DataType):
    """Documents to packed blocks of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = batch.column("part").to_numpy(), batch.column("row").to_numpy()
            data, offsets = _bytes_of(batch.column("text"))
            for first, last in _runs(parts, offsets):
                block = _packed(data[offsets[first] : offsets[last]].tobytes())
                yield _row_batch(
                    kind,
                    [(
                        int(parts[first]), DOCUMENTS, int(rows[first]), batch.column("doc_id").slice(first, last - first).to_pylist(),
                        rows[first:last], np.diff(offsets[first : last + 1]), block, None, None,
                    )],
                )

    return run


class _Answers:
    """The words of a part and their ids."""

    def __init__(self, rows: list[tuple]):
        words, counts, ids = [], [], []
        for sizes, *blobs in rows:
            own = [_unpacked(b, n) for b, n in zip(blobs, sizes)]
            words += bytes(own[0]).decode().split("\n")
            counts.append(np.frombuffer(own[1], "<u4"))
            ids.append(np.frombuffer(own[2], "<i4"))
        self.words = pa.array(words, pa.large_string())
        self.counts = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, "<i4")
        self.starts = np.cumsum(self.counts) - self.counts

    def ids_of(self, texts: pa.Array) -> pa.LargeListArray:
        """Ids of the words of every text, joined by their positions."""
        words = pc.ascii_split_whitespace(texts)
        at = pc.index_in(words.flatten(), value_set=self.words).to_numpy(zero_copy_only=False)
        counts = self.counts[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        spread = np.arange(ends[-1]) + np.repeat(self.starts[at] - ends[:-1], counts)
        return pa.LargeListArray.from_arrays(pa.array(ends[words.offsets.to_numpy()]), pa.array(self.ids[spread]))


def _placed(kind: pa.DataType, pieces):
    """Answers and documents of each part, the answers first, to documents with ``ids``, and ``decoded`` if there are
    ``pieces`` (a broadcast list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if pieces is None else _piece_table(pieces.value)
        part, rows, table = None, [], None
        for batch in batches:
            for own, sort, ids, numbers, sizes, *blobs in zip(*(batch.column(c) for c in _NAMES if c != "seq")):
                if own.as_py() != part:
                    part, rows, table = own.as_py(), [], None
                if sort.as_py() == ANSWER:
                    rows.append((sizes.as_py(), *(b.as_py() for b in blobs)))
                    continue
                if table is None:
                    table, rows = _Answers(rows), []
                lengths = np.array(sizes.as_py(), dtype=np.int64)
                found = table.ids_of(_strings(_unpacked(blobs[0].as_py(), int(lengths.sum())), lengths))
                for first, last in _slices(found.offsets.to_numpy()):
                    mine = found.slice(first, last - first)
                    columns = [ids.values.slice(first, last - first), numbers.values.slice(first, last - first), mine.cast(pa.list_(pa.int32()))]
                    names = ["doc_id", "row", "ids"]
                    if known is not None:
                        columns, names = [*columns, _decoded(columns[2], known)], [*names, "decoded"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of lists with some ``BLOCK_ENTRIES`` entries, one list at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_ENTRIES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _pieces(tokenizer: str) -> list[str | None]:
    """The pieces of a tokenizer file by id: as many as it has tokens, whatever the corpus."""
    coder = _tokenizer(tokenizer)
    if coder.decoder is not None:
        raise ValueError("this tokenizer file has a decoder; pieces alone are not its texts")
    return [coder.id_to_token(i) for i in range(1 + max(coder.get_vocab(with_added_tokens=True).values()))]


def _piece_table(pieces: list[str | None]) -> pa.Array:
    return pa.array(["" if p is None else f" {p}" for p in pieces])


def _decoded(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """Pieces of the ids, joined by blanks."""
    flat = ids.flatten()
    inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
    taken = pc.fill_null(pieces.take(pc.if_else(inside, flat, pa.scalar(None, pa.int32()))), "")
    offsets = ids.offsets.to_numpy()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), taken), "")
    return pc.utf8_slice_codeunits(joined, 1)


def _through_words(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, pieces) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    plain = texts(docs, id_col, text_col)
    size = plain.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    total = size["bytes"] or 0
    # documents next to each other, of about PART_BYTES if they are of mean length
    documents = max(1, PART_BYTES * max(size["n"], 1) // max(total, 1))
    place = F.col("row").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    plain = plain.withColumn("part", F.col("row") - place % F.lit(documents))
    id_type = plain.schema["doc_id"].dataType
    kind = _arrow_type(id_type)
    requests = plain.select("part", "text").mapInArrow(
        _requests(1 + total // BUCKET_BYTES), "bucket long, part long, size long, words binary"
    )
    schema = _packed_schema(id_type)
    answers = requests.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answers(tokenizer, kind), schema)
    blocks = plain.mapInArrow(_packed_documents(kind), schema)
    met = answers.unionByName(blocks).repartition("part").sortWithinPartitions("part", "kind", "seq")
    out = T.StructType([T.StructField("doc_id", id_type)]).add("row", T.LongType()).add("ids", T.ArrayType(T.IntegerType()))
    return met.mapInArrow(_placed(kind, pieces), out if pieces is None else out.add("decoded", T.StringType()))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``row`` and ``ids`` of every row of ``docs``, without added special tokens.

    Strings of special tokens in a text are special tokens, as by default in the tokenizers library. The file
    ``tokenizer`` has to be at that path on all workers.
    """
    return _through_words(docs, tokenizer, id_col, text_col, None)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with ``decoded``: the pieces of the ids, special ones too, joined by blanks, which is
    what a tokenizer file without a decoder says. An id that the file does not know is left out; no ids, or null
    for them, are an empty text."""
    ship(encoded.sparkSession)
    pieces = encoded.sparkSession.sparkContext.broadcast(_pieces(tokenizer))
    rows = encoded.select("doc_id", "row", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _piece_table(pieces.value)
        for batch in batches:
            for first, last in _slices(batch.column("ids").offsets.to_numpy()):
                own = batch.slice(first, last - first)
                decoded = _decoded(own.column("ids"), known)
                yield pa.RecordBatch.from_arrays([*own.columns, decoded], names=["doc_id", "row", "ids", "decoded"])

    schema = T.StructType(list(rows.schema.fields)).add("decoded", T.StringType())
    return rows.mapInArrow(run, schema)


def encode_and_decode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """:func:`decode` of :func:`encode`; ids are decoded in the task that has put them in place."""
    pieces = docs.sparkSession.sparkContext.broadcast(_pieces(tokenizer))
    return _through_words(docs, tokenizer, id_col, text_col, pieces)
