"""Bands, segments and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenura import schema as S


def tenure_group(tenure: str = "tenure") -> Column:
    """Right-closed bands (0,12] (12,24] (24,48] (48,72]; anything outside is NULL."""
    t = F.col(tenure)
    names = S.TENURE_GROUPS
    return (
        F.when(t <= 0, F.lit(None).cast("string"))
        .when(t <= 12, names[0])
        .when(t <= 24, names[1])
        .when(t <= 48, names[2])
        .when(t <= S.MAX_TENURE, names[3])
    )


def tenure_band(tenure: str = "tenure") -> Column:
    """Open-ended bands: zero falls in the first, everything above 48 (and NULL) in the last."""
    t = F.col(tenure)
    return (
        F.when(t <= 12, "0-12 mo").when(t <= 24, "13-24 mo").when(t <= 48, "25-48 mo").otherwise("49-72 mo")
    )


def risk_label(probability: Column) -> Column:
    return (
        F.when(probability < 0.25, "Low")
        .when(probability < 0.5, "Medium")
        .when(probability < 0.75, "High")
        .when(probability.isNotNull(), "Critical")
    )


def ltv_segment(ltv: Column) -> Column:
    low, medium, high, premium = S.LTV_SEGMENTS
    return F.when(ltv < 1000, low).when(ltv < 2000, medium).when(ltv < 3500, high).when(ltv.isNotNull(), premium)


def priority(probability: Column, ltv: Column) -> Column:
    likely, valuable = probability >= 0.5, ltv >= 2000
    return (
        F.when(likely & valuable, "Critical").when(likely, "High").when(valuable, "Medium").otherwise("Low")
    )


def capped(value: Column, cap: Column) -> Column:
    """The value, at most `cap`; NULL stays NULL (`least` would turn it into the cap)."""
    return F.when(value > cap, cap).otherwise(value)


def floored(value: Column) -> Column:
    """The value, at least 0; NULL stays NULL."""
    return F.when(value < 0, 0.0).otherwise(value)


def quartile_label(value: Column, q1: Column, q2: Column, q3: Column) -> Column:
    """Right-closed quartile segment; values equal to an edge stay together in the lower one."""
    low, medium, high, premium = S.LTV_SEGMENTS
    return F.when(value <= q1, low).when(value <= q2, medium).when(value <= q3, high).when(
        value.isNotNull(), premium
    )


def equal_width_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin number 0..bins-1 of equal-width bins over [lo, hi], left-closed, the last one closed.

    The division can land one bin off at an edge, so the result is checked against the edges themselves.
    """
    guess = F.least(F.floor(F.try_divide(value - lo, hi - lo) * bins), F.lit(bins - 1))
    below = value < bin_edge(guess, lo, hi, bins)
    above = (value >= bin_edge(guess + 1, lo, hi, bins)) & (guess < bins - 1)
    placed = F.when(below, guess - 1).when(above, guess + 1).otherwise(guess)
    return F.when(value.isNotNull(), F.when(hi > lo, placed).otherwise(F.lit(0))).cast("int")


def bin_edge(index: Column, lo: Column, hi: Column, bins: int) -> Column:
    return index * ((hi - lo) / bins) + lo
