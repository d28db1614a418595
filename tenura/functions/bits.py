"""Doubles as whole numbers that sort alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_bits(value: Column) -> Column:
    """A double's bits as a long that sorts like the double; -0.0 counts as 0.0, and NaN sorts last."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
