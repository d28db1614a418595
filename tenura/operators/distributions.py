"""Histograms, density curves, box statistics and binned scatter counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.bins import bin_edge, equal_width_bin
from tenura.operators.quantiles import counted_quantiles, counted_values, present


def histogram(df: DataFrame, column: str, bins: int, by: str | None = None, common: bool = False) -> DataFrame:
    """Equal-width histogram with every bin present, also the empty ones.

    With `by`, each group has its own range, or all share one when `common`. Grouping columns are
    enumerated ones, so the range table sent to all executors has a handful of rows.
    """
    keys = [by] if by else []
    rows = present(df.select(*keys, F.col(column).cast("double").alias("value")))
    ranges = _ranges(rows, keys, common)
    binned = attach(rows, ranges, keys).select(
        *keys, equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")
    )
    counted = binned.groupBy(*keys, "bin").agg(F.count("*").alias("rows"))
    frame = ranges.where(F.col("lo").isNotNull()).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(counted, keys + ["bin"], "left").select(
        *keys,
        "bin",
        bin_edge(F.col("bin"), F.col("lo"), F.col("hi"), bins).alias("left_edge"),
        bin_edge(F.col("bin") + 1, F.col("lo"), F.col("hi"), bins).alias("right_edge"),
        F.coalesce(F.col("rows"), F.lit(0)).alias("rows"),
    )


#: Kernel moments that a cell keeps, and its width in bandwidths. A row's kernel is a series in its distance from the cell's
#: middle; cut here, what is left out is below 2e-13 of the kernel's height, for every row.
MOMENTS, CELL_WIDTH = 12, 0.5
#: Bandwidths beyond which a kernel counts as 0: it is below 1e-17 of its height there.
REACH = 9


def _hermite(orders: int) -> list[list[float]]:
    """Coefficients, lowest power first, of the polynomials He_0 .. He_orders."""
    rows = [[1.0], [0.0, 1.0]]
    for k in range(1, orders):
        shifted = [0.0, *rows[k]]
        rows.append([x - k * y for x, y in zip(shifted, [*rows[k - 1], 0.0, 0.0])])
    return rows[: orders + 1]


def density(df: DataFrame, column: str, by: str | None = None, grid: int = 1000) -> DataFrame:
    """Gaussian kernel density with Scott bandwidth on an even grid that overhangs the data by half its range.

    Rows are first reduced to cells of half a bandwidth, whatever the range: a long tail makes more cells, not wider ones. A cell
    keeps the moments of its rows around its middle, from which its share at a point follows by a series; the curve is
    off by less than 1e-12 of a kernel's height. Only cells, never rows, meet the grid, and only points within `REACH`.
    There are at most as many cells as distinct values, and no more than the range has half bandwidths.
    """
    keys = [by] if by else []
    rows = present(df.select(*keys, F.col(column).cast("double").alias("value")))
    stats = rows.groupBy(*keys).agg(
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.count("*").alias("n"),
        (F.stddev_samp("value") * F.pow(F.count("*"), F.lit(-0.2))).alias("h"),
    )
    stats = stats.where("h > 0")
    at = F.floor((F.col("value") - F.col("lo")) / (F.col("h") * CELL_WIDTH))
    middle = F.col("lo") + (F.col("cell") + 0.5) * (F.col("h") * CELL_WIDTH)
    placed = attach(rows, stats, keys).where("h > 0").withColumn("cell", at)
    placed = placed.withColumn("u", (F.col("value") - middle) / F.col("h"))
    power, sums = F.lit(1.0), []
    for k in range(MOMENTS + 1):
        sums.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("u")
    cells = placed.groupBy(*keys, "lo", "hi", "n", "h", "cell").agg(*sums)
    # The series' coefficients by power of the distance from the cell's middle.
    terms: list[Column] = [F.lit(0.0)] * (MOMENTS + 1)
    for k, row in enumerate(_hermite(MOMENTS)):
        for j, x in enumerate(row):
            if x:
                terms[j] = terms[j] + F.col(f"m{k}") * (x / math.factorial(k))
    step = (F.col("hi") - F.col("lo")) * (2.0 / (grid - 1))
    start = F.col("lo") - (F.col("hi") - F.col("lo")) * 0.5
    cells = cells.select(*keys, "h", "n", start.alias("start"), step.alias("step"), middle.alias("middle"), *[t.alias(f"c{j}") for j, t in enumerate(terms)])
    first = F.greatest(F.ceil((F.col("middle") - REACH * F.col("h") - F.col("start")) / F.col("step")), F.lit(0))
    last = F.least(F.floor((F.col("middle") + REACH * F.col("h") - F.col("start")) / F.col("step")), F.lit(grid - 1))
    near = cells.where(first <= last).withColumn("point", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    z = (F.col("start") + F.col("point") * F.col("step") - F.col("middle")) / F.col("h")
    series = F.col(f"c{MOMENTS}")
    for j in range(MOMENTS - 1, -1, -1):
        series = series * F.col("z") + F.col(f"c{j}")
    share = F.sum(F.exp(-0.5 * F.col("z") * F.col("z")) * series)
    met = near.withColumn("z", z).groupBy(*keys, "point").agg(share.alias("share"))
    frame = stats.withColumns({"start": start, "step": step}).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    height = F.col("n") * F.col("h") * math.sqrt(2.0 * math.pi)
    return frame.join(met, [*keys, "point"], "left").select(
        *keys,
        "point",
        (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        (F.coalesce("share", F.lit(0.0)) / height).alias("density"),
    )


def box_stats(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Box-plot numbers: quartiles, whiskers at the last value within 1.5 IQR, and how many lie beyond."""
    keys = [by] if by else []
    values = counted_values(df, column, keys)
    box = counted_quantiles(values, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col("_v")
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return (
        attach(values, box, keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.sum("_c").alias("n"),
            F.min(F.when(inside, v)).alias("in_low"),
            F.max(F.when(inside, v)).alias("in_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("_c"))).alias("outliers"),
        )
        .select(
            *keys,
            "n",
            F.least("in_low", "q1").alias("whisker_low"),
            "q1",
            "median",
            "q3",
            F.greatest("in_high", "q3").alias("whisker_high"),
            "outliers",
        )
    )


def scatter_bins(df: DataFrame, x: str, y: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """A scatter plot as counts on a bins x bins raster over the common range of all groups."""
    by = by or []
    rows = present(df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    span = rows.agg(
        F.struct(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]).alias("s")
    ).scalar()
    return (
        rows.withColumn("span", span)
        .select(
            *by,
            equal_width_bin(F.col("x"), F.col("span.lo_x"), F.col("span.hi_x"), bins).alias("x_bin"),
            equal_width_bin(F.col("y"), F.col("span.lo_y"), F.col("span.hi_y"), bins).alias("y_bin"),
        )
        .groupBy(*by, "x_bin", "y_bin")
        .agg(F.count("*").alias("rows"))
    )


def attach(rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Give every row the statistics of its group, or of the whole table when there are no keys.

    `stats` has one row per group. Spark sends it to all executors if it turns out small, and else deals both sides
    by key; a single row travels as a subquery result instead.
    """
    if keys:
        return rows.join(stats, keys, how)
    whole = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return rows.withColumn("_s", whole).select(*rows.columns, *[F.col(f"_s.{c}").alias(c) for c in stats.columns])


def _ranges(rows: DataFrame, keys: list[str], common: bool) -> DataFrame:
    if keys and common:
        whole = rows.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("s")).scalar()
        found = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("s", whole)
        found = found.select(*keys, "s.lo", "s.hi")
    else:
        found = rows.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    single = F.col("lo") == F.col("hi")
    return found.select(*keys, _widen(single, "lo", -0.5), _widen(single, "hi", 0.5))


def _widen(single: Column, name: str, by: float) -> Column:
    """A range of one value is given width 1 around it."""
    return F.when(single, F.col(name) + by).otherwise(F.col(name)).alias(name)
