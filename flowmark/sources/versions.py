"""Tables that grow by whole updates: what an update writes counts once it is committed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmark.functions.durable import local_table


class Versions:
    """Parquet tables in ``folder``, on storage that all executors share, one folder for each update.

    An update writes its tables, then its number as committed. One that did not get that far is ignored and its
    number taken again, so a job may end anywhere. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def committed(self) -> list[int]:
        try:
            rows = self.spark.read.schema("version int").parquet(f"{self.folder}/committed/*")
            return sorted(r["version"] for r in rows.distinct().collect())
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def next(self) -> int:
        return max(self.committed(), default=0) + 1

    def write(self, name: str, table: DataFrame, version: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.folder}/{name}/{version}")

    def commit(self, version: int) -> None:
        done = local_table(self.spark, [(version,)], "version int")
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/committed/{version}")

    def read(self, name: str, schema: str, versions: list[int]) -> DataFrame:
        """The rows of these updates, with their ``version``."""
        paths = [f"{self.folder}/{name}/{v}" for v in versions]
        if not paths:
            return local_table(self.spark, [], f"{schema}, version int")
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)/[^/]*$", 1).cast("int")
        return self.spark.read.schema(schema).parquet(*paths).select("*", number.alias("version"))
