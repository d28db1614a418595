"""Profiling: overview, missing values, duplicates, domains, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overview(df: DataFrame) -> DataFrame:
    """One line per column: position, name, type, and the table's row and column counts."""
    fields = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"))
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return (
        df.agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("field", F.explode(fields))
        .select("field.*", "rows", F.lit(len(df.columns)).alias("columns"))
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Columns that have NULLs, with count and percentage, from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return (
        counts.unpivot(["_rows"], df.columns, "column", "missing")
        .where(F.col("missing") > 0)
        .select("column", "missing", F.round(F.col("missing") / F.col("_rows") * 100, 2).alias("missing_pct"))
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier row in every column; copies are combined before the shuffle."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))
    )


def categorical_domains(df: DataFrame) -> DataFrame:
    """The distinct values of every string column, as (column, value) rows."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(*texts).unpivot([], texts, "column", "value").distinct()


def null_charge_tenures(df: DataFrame) -> DataFrame:
    return df.where(F.col("total_charges").isNull()).select("tenure").distinct()


def null_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of NULL cells in the given columns."""
    total = F.coalesce(F.count_if(F.col(f"`{columns[0]}`").isNull()), F.lit(0))
    for c in columns[1:]:
        total = total + F.count_if(F.col(f"`{c}`").isNull())
    return df.agg(total.alias("null_cells"))


def preview(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first `n` rows in key order."""
    return df.orderBy(key).limit(n)
