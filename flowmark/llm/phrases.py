"""Removal of repeated passages with Aho-Corasick automata over words.

A window is a number of consecutive words. A window that starts anywhere earlier in the corpus is
repeated, and the words it covers go.

1. Every window has an anchor: the least hash among its short word runs. Equal windows have equal anchors
   and neighbours mostly share one, so only one number per handful of words is shuffled. Anchors found in
   two different texts, or in two equal windows of one text, are the passages that may recur.
2. Stretches of words around such anchors are sent to the shard of their anchor; the rest of the texts
   stays where it is. A shard compiles an automaton of the windows that recur in it and streams its
   stretches through, in the order of the documents, which locates every occurrence.
3. The first occurrence stays, the others are repeats. An anchor with very many occurrences is dealt out to
   several tasks; the first occurrences of each meet in a second round, one window at a time.

Copies of a text are settled by their digest alone: all but the first are repeats throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmark.functions.durable import durable
from flowmark.functions.ship import ship
from flowmark.llm.common import release, settled, texts
from flowmark.llm.hashing import runs_of, text_blocks, word_hashes, word_spans

#: Words of the runs among which a window has its anchor.
RUN = 8
#: Stretches of a shard, and occurrences of an anchor in one task.
SHARD = 8_000
HOT = 4_000
ORDER = ["no_id", "doc_id", "row", "start"]
STRETCH = "shard long, salt int, salted boolean, no_id boolean, doc_id long, row long, start long, words binary"
FOUND = "kind int, no_id boolean, doc_id long, row long, start long, until long, words binary"
REPEAT, FIRST = 0, 1


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` consecutive entries."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class _Block:
    """Words, windows and anchors of a block of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        starts, ends, self.before = word_spans(data, offsets)
        self.words = word_hashes(data, starts, ends)
        run = min(RUN, window)
        counts = np.diff(self.before)
        windows = np.maximum(counts - window + 1, 0)
        self.doc = np.repeat(np.arange(len(counts)), windows)
        ahead = np.cumsum(windows) - windows
        self.start = np.arange(len(self.doc)) - np.repeat(ahead, windows)
        self.at = self.before[self.doc] + self.start
        if len(self.doc):
            self.anchor = _least(runs_of(self.words, run), window - run + 1)[self.at]
        else:
            self.anchor = self.words[:0]

    def stretches(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of every maximal run of chosen windows with one anchor."""
        if not len(chosen):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        change = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(np.concatenate([[True], change]))
        last = np.concatenate([first[1:], [len(chosen)]]) - 1
        keep = chosen[first]
        return first[keep], last[keep]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, checks = batch.column("row").to_numpy(), batch.column("check").to_numpy()
            for base, data, offsets in text_blocks(batch.column("text")):
                b = _Block(data, offsets, window)
                first, last = b.stretches(np.ones(len(b.doc), dtype=bool))
                if not len(first):
                    continue
                # equal windows of one text
                key = runs_of(b.words, window)[b.at] ^ (
                    b.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                )
                order = np.argsort(key)
                same = key[order][1:] == key[order][:-1]
                twice = np.zeros(len(key), dtype=bool)
                twice[order[1:][same]] = True
                twice = np.logical_or.reduceat(twice, first)
                doc = base + b.doc[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.anchor[first].view(np.int64)),
                        pa.array(rows[doc]),
                        pa.array(checks[doc]),
                        pa.array(twice),
                    ],
                    names=["anchor", "row", "check", "twice"],
                )

    return run


def _stretches(window: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_numpy()
            lists = batch.column("anchors")
            bounds, entries = lists.offsets.to_numpy(), lists.values
            wanted = entries.field("anchor").to_numpy().view(np.uint64)
            salts = entries.field("salts").to_numpy()
            for base, data, offsets in text_blocks(batch.column("text")):
                b = _Block(data, offsets, window)
                chosen = np.zeros(len(b.doc), dtype=bool)
                salt = np.ones(len(b.doc), dtype=np.int32)
                edges = np.searchsorted(b.doc, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    lo, hi = edges[i], edges[i + 1]
                    mine = slice(bounds[base + i], bounds[base + i + 1])
                    known, n = wanted[mine], salts[mine]
                    order = np.argsort(known)
                    known, n = known[order], n[order]
                    if hi > lo and len(known):
                        at = np.minimum(np.searchsorted(known, b.anchor[lo:hi]), len(known) - 1)
                        chosen[lo:hi] = known[at] == b.anchor[lo:hi]
                        salt[lo:hi] = n[at]
                first, last = b.stretches(chosen)
                if not len(first):
                    continue
                doc = base + b.doc[first]
                row = rows[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((b.anchor[first] % np.uint64(shards)).astype(np.int64)),
                        pa.array((row % salt[first]).astype(np.int32)),
                        pa.array(salt[first] > 1),
                        pa.array([ids[d] is None for d in doc]),
                        pa.array([ids[d] for d in doc], pa.int64()),
                        pa.array(row),
                        pa.array(b.start[first]),
                        pa.array(
                            [
                                b.words[f : t + window].tobytes()
                                for f, t in zip(b.at[first], b.at[last])
                            ],
                            pa.binary(),
                        ),
                    ],
                    names=["shard", "salt", "salted", "no_id", "doc_id", "row", "start", "words"],
                )

    return run


def _locate(window: int):
    """Function that finds the repeats among the stretches of a shard, and the first occurrences that
    other tasks have to know."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        group = group.sort_values(ORDER, ignore_index=True)
        parts = [np.frombuffer(w, dtype="<u8") for w in group["words"]]
        lengths = np.array([len(p) for p in parts])
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        stream = np.zeros(int(begin[-1] + lengths[-1] + 1), dtype=np.uint64)
        inside = np.ones(len(stream), dtype=bool)
        inside[begin + lengths] = False
        stream[inside] = np.concatenate(parts)
        letters = np.zeros(len(stream), dtype=np.int64)  # 0 stands between stretches
        letters[inside] = np.unique(stream[inside], return_inverse=True)[1] + 1
        counts = lengths - window + 1
        part = np.repeat(np.arange(len(parts)), counts)
        step = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = begin[part] + step
        where = np.full(len(stream), -1)
        where[at] = np.arange(len(at))
        _, index, n = np.unique(
            runs_of(stream, window)[at], return_index=True, return_counts=True
        )
        repeated = np.zeros(len(at), dtype=bool)
        sequence = tuple(letters.tolist())
        recurring = index[n > 1]
        if len(recurring):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for number, a in enumerate(at[recurring].tolist()):
                automaton.add_word(sequence[a : a + window], number)
            automaton.make_automaton()
            seen = bytearray(len(recurring))
            again = []
            for end, number in automaton.iter(sequence):
                if seen[number]:
                    again.append(end - window + 1)
                else:
                    seen[number] = 1
            repeated[where[again]] = True
        # runs of repeated windows
        edge = np.ones(len(at), dtype=bool)
        edge[1:] = (part[1:] != part[:-1]) | (repeated[1:] != repeated[:-1])
        first = np.flatnonzero(edge)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        first, last = first[repeated[first]], last[repeated[first]]
        start = group["start"].to_numpy()
        columns = ["no_id", "doc_id", "row"]
        out = group.loc[part[first], columns].assign(
            kind=REPEAT,
            start=start[part[first]] + step[first],
            until=start[part[first]] + step[last] + window,
            words=None,
        )
        up = np.flatnonzero(~repeated & group["salted"].to_numpy()[part])
        if len(up):
            passed = group.loc[part[up], columns].assign(
                kind=FIRST,
                start=start[part[up]] + step[up],
                until=start[part[up]] + step[up] + window,
                words=[stream[a : a + window].tobytes() for a in at[up]],
            )
            out = pd.concat([out, passed]) if len(out) else passed
        return out[["kind", "no_id", "doc_id", "row", "start", "until", "words"]]

    return run


def repeated_ranges(plain: DataFrame, window: int) -> DataFrame:
    """``row`` and ``ranges`` (word numbers, end exclusive) of the rows of ``plain`` with repeats;
    ``copy`` is true for a text that an earlier row has whole."""
    spark = plain.sparkSession
    key = F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "row")
    hashed = plain.withColumn("check", F.xxhash64("text"))
    digests = durable(
        plain.select("doc_id", "row", F.unhex(F.sha2("text", 256)).alias("digest"))
    )
    # kept first: the join then only shuffles its sides, and Spark can split a text of many copies
    firsts = durable(digests.groupBy("digest").agg(F.min(key).alias("first")))
    copies = durable(
        digests.join(firsts, "digest")
        .filter(F.col("row") != F.col("first.row"))
        .select("row")
    )
    anchors = hashed.select("row", "text", "check").mapInArrow(
        _anchors(window), "anchor long, row long, check long, twice boolean"
    )
    recurring = durable(
        anchors.groupBy("anchor")
        .agg(
            F.min("check").alias("least"),
            F.max("check").alias("most"),
            F.max("twice").alias("twice"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("least <> most OR twice")
        .select("anchor", F.ceil(F.col("n") / HOT).cast("int").alias("salts"), "n")
    )
    total = recurring.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    release(spark)
    wanted = durable(
        anchors.select("anchor", "row")
        .join(recurring.select("anchor", "salts"), "anchor")
        .join(copies, "row", "left_anti")
        .groupBy("row")
        .agg(F.collect_set(F.struct("anchor", "salts")).alias("anchors"))
    )
    release(spark)
    stretches = (
        plain.join(wanted, "row")
        .select("doc_id", "row", "text", "anchors")
        .mapInArrow(_stretches(window, shards), STRETCH)
    )
    found = durable(stretches.groupBy("shard", "salt").applyInPandas(_locate(window), FOUND))
    release(spark)
    second = (
        found.filter(F.col("kind") == FIRST)
        .withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)))
        .withColumn("salted", F.lit(False))
        .groupBy("shard")
        .applyInPandas(_locate(window), FOUND)
    )
    ranges = (
        found.filter(F.col("kind") == REPEAT)
        .unionByName(second)
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "until")).alias("ranges"))
        .withColumn("copy", F.lit(False))
    )
    none = F.array().cast("array<struct<start:bigint,until:bigint>>")
    return ranges.unionByName(copies.select("row", none.alias("ranges"), F.lit(True).alias("copy")))


def without_repeats(
    docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``row``, ``n_words``, ``n_removed`` and ``text``, the kept
    words joined by blanks.

    Words are what stands between ASCII white space. Words covered by a window of ``window`` words that
    also starts earlier (in a row with a smaller id, null ids last, or further ahead in the same
    text) are removed; windows are judged on the texts as they come. A text with fewer words, a null or
    an empty text loses nothing. Of rows with one id the earlier one in the table counts as smaller. No
    rows, no result rows.
    """
    ship(docs.sparkSession)
    plain = texts(settled(docs), id_col, text_col)
    ranges = durable(repeated_ranges(plain, window))
    release(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, found, copy in zip(*(batch.column(c) for c in ("text", "ranges", "copy"))):
                words = text.as_buffer().to_pybytes().split()
                gone = bytearray(len(words))
                if copy.as_py() and len(words) >= window:
                    gone = bytearray(b"\1") * len(words)
                for r in found.as_py() or ():
                    gone[r["start"] : r["until"]] = b"\1" * (r["until"] - r["start"])
                n_words.append(len(words))
                n_removed.append(sum(gone))
                kept.append(b" ".join([w for w, g in zip(words, gone) if not g]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "row", "n_words", "n_removed", "text"],
            )

    return (
        plain.join(ranges, "row", "left")
        .select("doc_id", "row", "text", "ranges", "copy")
        .mapInArrow(keep, "doc_id long, row long, n_words long, n_removed long, text string")
    )
