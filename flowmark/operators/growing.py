"""Samples of tables that grow: new rows are merged into what is kept, old rows are not read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmark.fixed_values import PROTECTED_CLASSES, SEED
from flowmark.functions.durable import durable, null_safe_join, side_table
from flowmark.functions.keys import HASH_BITS, hash_bucket, seeded_hash, stable_key
from flowmark.operators.sampling import class_cap, quota_sample, quotas
from flowmark.sources.versions import Versions

#: Bits of the key hash by which a growing quota sample says how far it reaches.
REACH_BITS = 16


class _Growing:
    """Rows kept of all updates, and rows per class that there were."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        by: Sequence[str],
        key_cols: Sequence[str],
        seed: int = SEED,
        kind: str = "xxhash64",
        tie_cols: Sequence[str] | None = None,
    ) -> None:
        self.store, self.by, self.key_cols = Versions(spark, folder), list(by), list(key_cols)
        self.order = {"seed": seed, "kind": kind, "tie_cols": tie_cols}
        self.hash = seeded_hash(stable_key(key_cols), seed, kind)

    def _rows(self, like: DataFrame, versions: list[int]) -> DataFrame:
        return self.store.read("rows", _ddl(like), versions).drop("version")

    def _count(self, rows: DataFrame, version: int) -> None:
        counted = rows.groupBy(*self.by).agg(F.count(F.lit(1)).alias("n"))
        self.store.write("counts", counted, version)

    def counts(self, like: DataFrame) -> DataFrame:
        """Rows per class of all updates."""
        schema = f"{_ddl(like.select(*self.by))}, n bigint"
        kept = self.store.read("counts", schema, self.store.committed())
        return kept.groupBy(*self.by).agg(F.sum("n").alias("n"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


class GrowingCap(_Growing):
    """The ``cap`` rows of each class with the lowest key hashes, over all updates.

    An update reads the rows kept so far and the new ones; of these only rows up to the last kept hash of a full
    class are moved. The result is that of :func:`class_cap` over all rows.
    """

    def __init__(self, spark: SparkSession, folder: str, by, key_cols, cap: int, **order) -> None:
        super().__init__(spark, folder, by, key_cols, **order)
        self.cap = cap

    def add(self, new: DataFrame) -> DataFrame:
        """Merge new rows, and return the sample."""
        done = self.store.committed()
        kept = self._rows(new, done[-1:])
        last = kept.groupBy(*self.by).agg(F.count(F.lit(1)).alias("__n"), F.max(self.hash).alias("__last"))
        full = side_table(last.filter(F.col("__n") >= self.cap).drop("__n"))
        fitting = null_safe_join(new, full, self.by, "left").filter(
            F.col("__last").isNull() | (self.hash <= F.col("__last"))
        )
        merged = kept.unionByName(fitting.select(*new.columns))
        version = self.store.next()
        self.store.write("rows", class_cap(durable(merged), self.by, self.key_cols, self.cap, **self.order), version)
        self._count(new, version)
        self.store.commit(version)
        return self._rows(new, [version])


class GrowingQuota(_Growing):
    """A quota sample (see :func:`quotas`) whose quotas grow with the table.

    All rows whose key hash lies in the lowest part of the range are kept, a part larger than the share of the sample by
    ``margin``; protected classes are kept whole. The places of a class grow with its rows, so its last hash stays
    near one place of the range, and a class that runs out of kept rows (a key with very many rows may lie
    behind) is completed from the whole table, which is read again for just those rows.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        label: str,
        key_cols,
        reduction: float,
        protected: Sequence[str] = PROTECTED_CLASSES,
        margin: float = 0.25,
        **order,
    ) -> None:
        super().__init__(spark, folder, [label], key_cols, **order)
        self.label, self.reduction, self.protected = label, reduction, list(protected)
        self.reach = min(1.0, (1 - reduction) * (1 + margin))

    def _place(self):
        """Place of a row in the range of hashes, from 0 to 2**REACH_BITS."""
        kind = self.order["kind"]
        low = -(1 << (REACH_BITS - 1)) if HASH_BITS[kind] == 64 else 0
        return hash_bucket(self.hash, REACH_BITS, kind) - F.lit(low)

    def add(self, new: DataFrame) -> None:
        """Keep of the new rows what later samples may take."""
        version = self.store.next()
        near = self._place() < F.lit(int(self.reach * (1 << REACH_BITS)))
        self.store.write("rows", new.filter(near | F.col(self.label).isin(self.protected)), version)
        self._count(new, version)
        self.store.commit(version)

    def sample(self, like: DataFrame, table: DataFrame | None = None) -> DataFrame:
        """The sample of all updates; ``like`` has their columns. ``table``, all rows, is read only for classes whose
        kept rows do not fill their quota; without it such a class is an error."""
        wanted = durable(quotas(self.counts(like), self.reduction, label=self.label, protected=self.protected))
        rows = self._rows(like, self.store.committed())
        there = rows.groupBy(self.label).agg(F.count(F.lit(1)).alias("__there"))
        short = null_safe_join(wanted, there, [self.label], "left").filter(F.coalesce("__there", F.lit(0)) < F.col("quota"))
        names = [r[self.label] for r in short.select(self.label).collect()]  # classes
        if names and table is None:
            raise ValueError(f"classes {names} need rows that were not kept: pass the whole table")
        if names:
            known = [n for n in names if n is not None]
            lacking = F.col(self.label).isin(known) | (F.col(self.label).isNull() if None in names else F.lit(False))
            lacking = F.coalesce(lacking, F.lit(False))
            rows = rows.filter(~lacking).unionByName(table.select(*rows.columns).filter(lacking))
        return quota_sample(rows, wanted, [self.label], self.key_cols, **self.order)
