"""Vectors of many rows as matrices on the executors, and sums of matrices over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmark.functions.ship import ship

#: Numbers of a dense block of rows, and entries of a sparse one.
BLOCK = 1 << 20
SPARSE_BLOCK = 1 << 13
#: Bytes of task results that are collected without adding them up on the executors first.
COLLECT_BYTES = 64 << 20
#: Rows of a state on its way between tasks: matrices by key.
SCHEMA = "key string, columns int, sums binary"


def vector_rows(
    df: DataFrame, group: int | Column = 0, features: str = "features", label: str | None = "label"
) -> DataFrame:
    """Rows in the form that passes read: ``group``, ``label`` and the parts of the vector, dense or sparse."""
    return df.select(
        (F.lit(group) if isinstance(group, int) else group).cast("int").alias("group"),
        (F.lit(0.0) if label is None else F.col(label).cast("double")).alias("label"),
        F.unwrap_udt(features).alias("vector"),
    )


#: Many rows of one group in one: sizes and places of the values are missing if all vectors are dense.
PACKED = "group int, width int, labels binary, counts binary, columns binary, numbers binary"


def packed(rows: DataFrame) -> DataFrame:
    """``vector_rows`` packed into few rows, for many passes: numbers go to the tasks as they are in memory."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, labels, width, counts, columns, numbers in _vectors(batch):
                parts = (labels, counts, columns, numbers)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([group], pa.int32()),
                        pa.array([width], pa.int32()),
                        *[pa.array([None if x is None else x.tobytes()], pa.binary()) for x in parts],
                    ],
                    names=["group", "width", "labels", "counts", "columns", "numbers"],
                )

    ship(rows.sparkSession)
    return rows.mapInArrow(pack, PACKED)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Group, labels, width, values per row, their columns, and all values; no counts and columns if all are dense."""
    groups = batch.column("group").to_numpy()
    labels = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
    for group in np.unique(groups):
        own = np.flatnonzero(groups == group)
        vectors = batch.column("vector") if len(own) == len(groups) else batch.column("vector").take(pa.array(own))
        kind, size, indices, values = vectors.flatten()
        dense = kind.to_numpy(zero_copy_only=False) == 1
        counts = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int32)
        numbers = values.flatten().to_numpy(zero_copy_only=False)
        if dense.all():
            yield int(group), labels[own], int(counts[0]), None, None, numbers
            continue
        width = int(size.drop_null()[0].as_py())
        column = np.empty(len(numbers), dtype=np.int32)
        from_dense = np.repeat(dense, counts)
        column[from_dense] = np.tile(np.arange(width, dtype=np.int32), int(dense.sum()))
        column[~from_dense] = indices.flatten().to_numpy(zero_copy_only=False)
        yield int(group), labels[own], width, counts, column, numbers


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """:func:`_vectors` of packed rows."""
    for i in range(batch.num_rows):
        group, width = batch.column("group")[i].as_py(), batch.column("width")[i].as_py()
        parts = []
        for name, kind in (("labels", "<f8"), ("counts", "<i4"), ("columns", "<i4"), ("numbers", "<f8")):
            data = batch.column(name)[i].as_buffer()
            parts.append(None if data is None else np.frombuffer(data, kind))
        yield group, parts[0], width, *parts[1:]


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | slice]]:
    """Group, labels, values and their columns, for blocks of rows; columns without values are left out."""
    found = _vectors(batch) if "vector" in batch.schema.names else _unpacked(batch)
    for group, labels, width, counts, column, numbers in found:
        if counts is None:
            step, table = max(1, BLOCK // max(width, 1)), numbers.reshape(len(labels), width)
            for first in range(0, len(labels), step):
                yield group, labels[first : first + step], table[first : first + step], slice(None)
            continue
        ends, first = np.cumsum(counts, dtype=np.int64), 0
        while first < len(labels):
            start = ends[first] - counts[first]
            last = max(first + 1, int(np.searchsorted(ends, start + SPARSE_BLOCK, side="right")))
            used, place = np.unique(column[start : ends[last - 1]], return_inverse=True)
            block = np.zeros((last - first, len(used)))
            block[np.repeat(np.arange(last - first), counts[first:last]), place] = numbers[start : ends[last - 1]]
            yield group, labels[first:last], block, used
            first = last


def state_batch(items: Iterable[tuple]) -> pa.RecordBatch:
    """Matrices by key as a record batch of ``SCHEMA``."""
    items = list(items)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([str(key) for key, _ in items], pa.string()),
            pa.array([m.shape[1] for _, m in items], pa.int32()),
            pa.array([m.tobytes() for _, m in items], pa.binary()),
        ],
        names=["key", "columns", "sums"],
    )


def state_items(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    for key, columns, sums in zip(*(c.to_pylist() for c in batch.columns)):
        yield key, np.frombuffer(sums).reshape(-1, columns)


class Sums:
    """Matrices to be added up, by a key."""

    def __init__(self):
        self.of: dict[tuple, np.ndarray] = {}

    def add(self, key: tuple, rows, value: np.ndarray, shape: tuple) -> None:
        if key not in self.of:
            self.of[key] = np.zeros(shape)
        self.of[key][rows] += value

    def batch(self) -> pa.RecordBatch:
        return state_batch(self.of.items())

    def take(self, batch: pa.RecordBatch) -> None:
        for key, matrix in state_items(batch):
            self.add(key, slice(None), matrix, matrix.shape)



def merged(rows: DataFrame, tasks: int, make: Callable, per_block: Callable, result_bytes: int):
    """The state that ``make()`` begins and ``per_block(state, group, labels, block, columns)`` takes all blocks of
    ``rows`` into. States have ``batch()``, a record batch of ``SCHEMA``, and ``take(batch)``, which merges one.

    States of many ``tasks``, or large ones, meet in groups of tasks first.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = make()
        for batch in batches:
            for found in blocks(batch):
                per_block(state, *found)
        yield state.batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = make()
        for batch in batches:
            state.take(batch)
        yield state.batch()

    ship(rows.sparkSession)
    parts = rows.mapInArrow(scan, SCHEMA)
    while tasks > 1 and tasks * result_bytes > COLLECT_BYTES:
        tasks = max(1, min(tasks - 1, round(tasks**0.5)))
        parts = parts.repartition(tasks, F.spark_partition_id()).mapInArrow(merge, SCHEMA)
    total = make()
    for batch in parts.toArrow().to_batches():
        total.take(batch)
    return total


def added(rows: DataFrame, tasks: int, per_block: Callable, result_bytes: int) -> dict[str, np.ndarray]:
    """The sums, by key as text, of the matrices that ``per_block`` adds to a :class:`Sums`."""
    return merged(rows, tasks, Sums, per_block, result_bytes).of
