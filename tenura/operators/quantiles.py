"""Exact quantiles by radix selection: no column is sorted, gathered or written.

Rows are first counted per distinct value, combined before the shuffle, so a value held by a third of all rows costs one
row. A double's bits, as a long that sorts like the double, are then looked at 16 at a time. One aggregation counts rows per
leading digit and tells which digit holds a wanted rank; the next counts the following digit among the values that begin
like that. After four the value is known. An aggregation has at most 65,536 cells per group and wanted rank,
whatever the rows and however they are distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions.bits import ordered_bits

#: How far the bits are shifted to leave one, two, three and all four of the digits.
SHIFTS = (48, 32, 16, 0)


def counted_values(df: DataFrame, column: str, by: list[str] | None = None, combine: bool = True) -> DataFrame:
    """Rows per distinct value (`_v`, `_c`) and group; NULL values and NULL groups do not take part.

    Combining equal values costs one more shuffle, of the distinct ones. For a
    column that hardly repeats, such as a key's hash, `combine=False` skips it.
    """
    by = by or []
    values = present(df.select(*by, F.col(column).cast("double").alias("_v")))
    if not combine:
        return values.withColumn("_c", F.lit(1).cast("bigint"))
    return values.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))


def present(df: DataFrame) -> DataFrame:
    """Rows without NULL in any column; tests on columns that cannot be NULL are optimised away."""
    test = F.lit(True)
    for c in df.columns:
        test = test & F.col(c).isNotNull()
    return df.where(test)


def rank_values(
    df: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None, combine: bool = True
) -> DataFrame:
    """For every group and probability: the values around the wanted rank, and how far to go between them."""
    return counted_ranks(counted_values(df, column, by, combine), probabilities, by)


def digit_cells(values: DataFrame, by: list[str], shift: int, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (`_c`) and largest value (`_v`) per group and leading digits (`_at`), of values that begin as wanted (`_prefix`)."""
    keyed = values.select(*by, "_v", "_c", ordered_bits(F.col("_v")).alias("_k"))
    if wanted is not None:
        begun = F.broadcast(wanted.select(*by, "_prefix").distinct())  # a row per group and wanted rank at most
        keyed = keyed.withColumn("_prefix", F.shiftright("_k", shift + 16)).join(begun, [*by, "_prefix"])
    prefix = ["_prefix"] if wanted is not None else []
    return keyed.groupBy(*by, *prefix, F.shiftright("_k", shift).alias("_at")).agg(F.sum("_c").alias("_c"), F.max("_v").alias("_v"))


def counted_ranks(values: DataFrame, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """`rank_values` of values that are already counted."""
    by = by or []
    found = _wanted_ranks(digit_cells(values, by, SHIFTS[0]), by, probabilities)
    slot = [*by, "_p", "_upper"]
    for shift in SHIFTS[1:]:
        cells = digit_cells(values, by, shift, found)
        facts = F.broadcast(found.drop("_v"))
        held = cells.join(facts, [*by, "_prefix"]).withColumn("_before", F.sum("_c").over(_up_to_here(slot, "_at")) - F.col("_c"))
        rank = (F.col("_rank") - F.col("_before")).alias("_rank")
        found = held.where(_holds_rank()).select(*slot, F.col("_at").alias("_prefix"), "_n", rank, "_fraction", "_v")
    at = lambda upper: F.max(F.when(F.col("_upper") == upper, F.col("_v")))
    return found.groupBy(*by, F.col("_p").alias("probability")).agg(
        F.max("_n").alias("n"),
        at(False).alias("lower"),
        at(True).alias("upper"),
        F.max("_fraction").alias("fraction"),
    )


def between(lower: Column, upper: Column, fraction: Column) -> Column:
    """Linear interpolation that returns ties unchanged."""
    return lower + (upper - lower) * fraction


def quantiles(
    df: DataFrame, column: str, probabilities: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """One row per group with one interpolated quantile column per entry of `probabilities`."""
    return counted_quantiles(counted_values(df, column, by), probabilities, by)


def approximate_quantiles(
    df: DataFrame, column: str, probabilities: dict[str, float], by: list[str] | None = None, accuracy: int = 10000
) -> DataFrame:
    """The same shape from one pass of mergeable sketches; ranks are off by at most rows / accuracy."""
    found = F.percentile_approx(F.col(column).cast("double"), [float(p) for p in probabilities.values()], accuracy)
    out = df.groupBy(*(by or [])).agg(found.alias("_q"))
    return out.select(*(by or []), *[F.col("_q")[i].alias(name) for i, name in enumerate(probabilities)])


def counted_quantiles(
    values: DataFrame, probabilities: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """`quantiles` of values that are already counted."""
    by = by or []
    value = between(F.col("lower"), F.col("upper"), F.col("fraction"))
    picked = [
        F.max(F.when(F.col("probability") == F.lit(float(p)), value)).alias(name) for name, p in probabilities.items()
    ]
    ranks = counted_ranks(values, list(dict.fromkeys(probabilities.values())), by)
    return ranks.groupBy(*by).agg(*picked) if by else ranks.agg(*picked)


def _wanted_ranks(cells: DataFrame, by: list[str], probabilities: list[float]) -> DataFrame:
    """Ranks to look for, each with the first digit of its value and its rank among the values that begin with it."""
    counts = cells.withColumn("_n", F.sum("_c").over(Window.partitionBy(*by))).withColumn(
        "_before", F.sum("_c").over(_up_to_here(by, "_at")) - F.col("_c")
    )
    wanted = []
    for p in probabilities:
        place = F.lit(float(p)) * (F.col("_n") - 1)
        for upper in (False, True):
            wanted.append(
                F.struct(
                    F.lit(float(p)).alias("_p"),
                    F.lit(upper).alias("_upper"),
                    (F.ceil(place) if upper else F.floor(place)).alias("_rank"),
                    (place - F.floor(place)).alias("_fraction"),
                )
            )
    return (
        counts.withColumn("_w", F.explode(F.array(*wanted)))
        .select(*by, F.col("_at").alias("_prefix"), "_n", "_c", "_before", "_v", "_w.*")
        .where(_holds_rank())
        .withColumn("_rank", F.col("_rank") - F.col("_before"))
        .drop("_c", "_before")
    )


def _up_to_here(group: list[str], order: str):
    return Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _holds_rank() -> Column:
    return (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c"))
