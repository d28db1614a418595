"""Parquet tables below one folder, and catalog tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableStore:
    """Named tables kept as Parquet folders below `root`; a write replaces the whole table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, lookup_by: list[str] | None = None) -> None:
        """Replace a table. Columns in `lookup_by` get a Bloom filter per row group, so that a search for one
        value skips nearly all of the table without the table having to be sorted."""
        writer = df.write.mode("overwrite")
        for column in lookup_by or []:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def exists(self, name: str) -> bool:
        try:
            self.read(name)
            return True
        except AnalysisException:
            return False

    def read_optional(self, name: str) -> DataFrame | None:
        return self.read(name) if self.exists(name) else None


def write_table(df: DataFrame, name: str) -> None:
    """Replace a catalog table."""
    df.write.mode("overwrite").saveAsTable(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """Read a database table in `parts` key ranges, one task each."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts)


def reconcile(written: DataFrame, source: DataFrame) -> DataFrame:
    """Compare the row count of what was written with the row count of its source."""
    source_rows = source.agg(F.count(F.lit(1))).scalar()
    return written.agg(F.count(F.lit(1)).alias("rows_written")).select(
        "rows_written",
        source_rows.alias("rows_source"),
        (F.col("rows_written") == source_rows).alias("matches"),
    )
