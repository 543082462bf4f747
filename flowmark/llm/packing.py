"""Packing of tokenised documents into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows and a rest. Pieces are then dealt
out evenly to groups of a few thousand; in each group the longest piece comes first and goes to the
open window with the least sufficient room, which a segment tree over the rooms finds. A group of that
size leaves about one window in a thousand partly open, and no group grows with the input.

Texts are only read where they lie: tasks turn them into pieces (id, start, length, checksum), and only
pieces are shuffled.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmark.functions.durable import durable
from flowmark.functions.ship import ship
from flowmark.llm.common import texts

WINDOW = 2048
#: Pieces packed together.
GROUP_PIECES = 4096
#: Words whose ids a task remembers at a time.
REMEMBERED = 400_000
#: White space but blanks and line ends.
OTHER_SPACE = re.compile(r"[^\S \n]")
PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file, equal to those of the tokenizers library.

    Where every white-space character stands alone between words, a text is cut before each blank:
    no token crosses such a place. Each distinct stretch is then encoded once and remembered.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # printable stand-ins of the bytes, by the published rule
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        made = [vocab["".join(m)] for m in pairs]
        if made != sorted(made):
            raise ValueError("ids of this file are not in the order of its merges")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding(
            "file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special
        )
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        # strings of special tokens are special, as by default in the tokenizers library
        return np.array(
            self.encoding.encode(text, allowed_special="all"), dtype="<u4"
        ).tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        parts = text.split(" ")
        alone = len(text.split()) == len(parts) + text.count("\n") and not OTHER_SPACE.search(text)
        if not alone:
            return self._encode(text)
        known, out = self.known, []
        for i, part in enumerate(parts):
            part = " " + part if i else part
            ids = known.get(part)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[part] = self._encode(part)
            out.append(ids)
        return b"".join(out)


def cut(ids: bytes, window: int) -> list[tuple[int, int, int]]:
    """``(start, length, crc32)`` of full windows and a rest."""
    step = 4 * window
    pieces = (ids[at : at + step] for at in range(0, len(ids), step))
    return [(i * window, len(p) // 4, zlib.crc32(p)) for i, p in enumerate(pieces)]


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document as pieces of at most ``window`` ids; its ids end with ``end_id``."""
    ship(docs.sparkSession)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = ByteBpe(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text, row in zip(*(batch.column(i) for i in range(3))):
                ids = encode(text.as_py()) + end
                out += [
                    (doc_id.as_py(), row.as_py(), start, length, crc, len(ids) // 4)
                    for start, length, crc in cut(ids, window)
                ]
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return texts(docs, id_col, text_col).mapInArrow(tokenise, PIECES)


class Rooms:
    """Open windows by the room they have left; a segment tree finds the least sufficient room."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.open[node] += change
            node >>= 1

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._count(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Room and number of the window that fits best; it is taken out."""
        open_, node = self.open, need + self.leaves
        while not open_[node]:
            while node & 1:  # a right child: nothing further right below its parent
                node >>= 1
            if not node:
                return None
            node += 1
            if not node & (node - 1):  # past the last node of a level
                return None
        while node < self.leaves:
            node = 2 * node if open_[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """Window and offset of every piece; ``lengths`` come in falling order."""
    rooms, n, out = Rooms(window), 0, []
    for length in lengths:
        found = rooms.tightest(length)
        if found is None:
            found, n = (window, n), n + 1
        room, at = found
        out.append((at, window - room))
        if room > length:
            rooms.add(room - length, at)
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``row``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` and ``offset``.

    A null or empty text has only the end id. Ids of a document lie in one piece each, in order; a
    document with at most ``window`` ids is never cut. Repeated rows are packed each on their own.
    No rows, no pieces. The file ``tokenizer`` has to be at the same path on all workers.
    """
    made = durable(pieces(docs, tokenizer, end_id, window, id_col, text_col))
    groups = max(1, -(-made.count() // group_pieces))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(
            ["length", "row", "start"], ascending=[False, True, True], ignore_index=True
        )
        placed = best_fit(group["length"].tolist(), window)
        number, offset = zip(*placed)
        base = int(group["bucket"].iloc[0]) << 32
        return group.drop(columns="bucket").assign(
            sequence_id=base + np.array(number, dtype="int64"),
            offset=np.array(offset, dtype="int64"),
        )

    bucket = F.pmod(F.xxhash64("row", "start"), F.lit(groups)).cast("int")
    return (
        made.withColumn("bucket", bucket)
        .groupBy("bucket")
        .applyInPandas(fill, f"{PIECES}, sequence_id long, offset long")
    )
