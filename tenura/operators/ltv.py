"""Lifetime-value target, its cap and quartile segments, and the stored customer value table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.functions.bins import capped, quartile_label
from tenura.functions.encoding import projected_months
from tenura.functions.features import total_charges_filled
from tenura.operators.quantiles import approximate_quantiles, between, quantiles, rank_values

QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


def ltv_target(df: DataFrame) -> DataFrame:
    """Historical value, months still expected, and projected value (uncapped)."""
    total = total_charges_filled()
    return df.withColumns(
        {
            "ltv_historical": total,
            "projected_months": projected_months(),
            "ltv_projected": total + F.col("monthly_charges") * projected_months(),
        }
    )


def cap_quantile(
    df: DataFrame, column: str, probability: float = S.LTV_CAP_QUANTILE, accuracy: int | None = None
) -> DataFrame:
    """Clip a column from above at its exact quantile, or at an approximate one of the given accuracy. NULL stays NULL."""
    wanted = {"cap": probability}
    if accuracy is None:
        cap = quantiles(df, column, wanted).scalar()
    else:
        cap = approximate_quantiles(df, column, wanted, accuracy=accuracy).scalar()
    return df.withColumn("_cap", cap).withColumn(column, capped(F.col(column), F.col("_cap"))).drop("_cap")


def quartile_segment(df: DataFrame, column: str = "ltv_projected", name: str = "ltv_segment") -> DataFrame:
    """Low / Medium / High / Premium by exact quartile."""
    edges = quantiles(df, column, QUARTILES).select(F.struct(*QUARTILES).alias("s")).scalar()
    return df.withColumn(name, quartile_label(F.col(column), edges["q1"], edges["q2"], edges["q3"]))


def capped_and_segmented(df: DataFrame) -> DataFrame:
    """Cap the projected value and segment the capped value, from one search for all four quantiles.

    A cap moves no rank, so quartiles of the capped column are found by capping the values around the
    wanted ranks before interpolating.
    """
    probabilities = [*QUARTILES.values(), S.LTV_CAP_QUANTILE]
    ranks = rank_values(df, "ltv_projected", probabilities)
    ends = ranks.agg(
        *[_end(p, side).alias(f"{side}_{i}") for i, p in enumerate(probabilities) for side in ("lower", "upper", "fraction")]
    )
    cap = between(F.col("lower_3"), F.col("upper_3"), F.col("fraction_3"))
    below = lambda name: capped(F.col(name), F.col("cap"))
    edges = (
        ends.withColumn("cap", cap)
        .select(
            F.struct(
                F.col("cap"),
                *[
                    between(below(f"lower_{i}"), below(f"upper_{i}"), F.col(f"fraction_{i}")).alias(name)
                    for i, name in enumerate(QUARTILES)
                ],
            ).alias("s")
        )
        .scalar()
    )
    value = capped(F.col("ltv_projected"), F.col("_edges.cap"))
    segment = quartile_label(value, F.col("_edges.q1"), F.col("_edges.q2"), F.col("_edges.q3"))
    return (
        df.withColumn("_edges", edges)
        .withColumns({"ltv_projected": value, "ltv_segment": segment})
        .drop("_edges")
    )


def customers_ltv(featured: DataFrame, predicted: Column | None = None) -> DataFrame:
    """The stored customer value table; `predicted` may refer to every column of the featured, segmented table."""
    full = capped_and_segmented(ltv_target(featured))
    if predicted is not None:
        full = full.withColumn("ltv_predicted", predicted)
    return full.select(*S.CUSTOMERS_LTV_COLUMNS)


def _end(probability: float, side: str) -> Column:
    return F.max(F.when(F.col("probability") == F.lit(float(probability)), F.col(side)))
