"""A census that opens each data file once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmark.functions.durable import durable
from flowmark.sources.scan import _decoded, _path_key, scan, schemas_of, stamped_listing
from flowmark.sources.versions import Versions

FILES = "key string, path string, bytes bigint, modified timestamp, schema string, rows bigint"
CLASSES = "key string, label_tactic string, n bigint"
STAMP = ["key", "bytes", "modified"]
#: Files opened by one job.
FILES_AT_ONCE = 20_000


class CensusLedger:
    """Rows, schema and class counts of every file, kept in ``folder`` under its path, size and time.

    :meth:`update` opens only files that are new or have changed. A census joins the ledger with the listing
    of the files that are there now, so what has gone is taken back without being read. Files may be
    listed under several paths with one ledger, as long as they have the label column.
    """

    def __init__(self, spark: SparkSession, folder: str, label_col: str = "label_tactic") -> None:
        self.spark, self.label_col = spark, label_col
        self.store = Versions(spark, folder)

    def _known(self) -> DataFrame:
        return self.store.read("files", FILES, self.store.committed())

    def update(self, path: str | Sequence[str]) -> int:
        """Take up the files under ``path`` that the ledger does not know; returns how many were opened."""
        listed = stamped_listing(self.spark, path).withColumn("key", _path_key(F.col("path")))
        unknown = durable(listed.join(self._known().select(*STAMP), STAMP, "left_anti"))
        opened = unknown.count()
        version = self.store.next()
        names = [r["path"] for r in unknown.select("path").orderBy("path").toLocalIterator()] if opened else []
        for first in range(0, opened, FILES_AT_ONCE):
            chosen = names[first : first + FILES_AT_ONCE]
            place = _path_key(_decoded("__file")).alias("key")
            rows = scan(self.spark, chosen).select(F.col(self.label_col).cast("string").alias("label_tactic"), F.col("_metadata.file_path").alias("__file"))
            classes = durable(rows.groupBy(place, "label_tactic").agg(F.count(F.lit(1)).alias("n")))
            counted = classes.groupBy("key").agg(F.sum("n").alias("rows"))
            own = unknown.filter((F.col("path") >= chosen[0]) & (F.col("path") <= chosen[-1]))
            files = own.join(schemas_of(own.select("path")), "path").join(counted, "key", "left")
            files = files.withColumn("rows", F.coalesce("rows", F.lit(0)).cast("bigint"))
            # files are named after their classes, by one number, and count once both are committed
            self.store.write("classes", classes.select("key", "label_tactic", "n"), version)
            self.store.write("files", files.select("key", "path", "bytes", "modified", "schema", "rows"), version)
            self.store.commit(version)
            version += 1
        return opened

    def files(self, path: str | Sequence[str]) -> DataFrame:
        """Bytes, rows and schema of the files there are now, as far as the ledger knows them."""
        listed = stamped_listing(self.spark, path).select(_path_key(F.col("path")).alias("key"), "bytes", "modified")
        return self._known().join(listed, STAMP, "left_semi")

    def classes(self, path: str | Sequence[str]) -> DataFrame:
        """Rows per class, null included."""
        counts = self.store.read("classes", CLASSES, self.store.committed())
        present = self.files(path).select("key", "version")
        return counts.join(present, ["key", "version"], "left_semi").groupBy("label_tactic").agg(F.sum("n").alias("n"))

    def schemas(self, path: str | Sequence[str]) -> DataFrame:
        """Number of files per distinct schema."""
        return self.files(path).groupBy("schema").agg(F.count(F.lit(1)).alias("files"))

    def totals(self, path: str | Sequence[str], dataset: str) -> DataFrame:
        """Files, rows, bytes and number of schemas, in one row, as the validation of an inventory takes them."""
        return self.files(path).agg(
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
            F.count_distinct("schema").alias("schemas"),
        ).select(F.lit(dataset).alias("dataset"), "*")
