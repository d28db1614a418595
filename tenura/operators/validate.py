"""Input contracts: required columns, record constraints, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.functions.features import number

# Which columns are enumerated, and the numeric ranges (lower, upper).
ENUMERATED = {
    "partner": S.YES_NO,
    "dependents": S.YES_NO,
    "contract": S.CONTRACTS,
    "paperless_billing": S.YES_NO,
    "payment_method": S.PAYMENT_METHODS,
    "phone_service": S.YES_NO,
    "internet_service": S.INTERNET_SERVICES,
}
RANGES = {
    "senior_citizen": (0, 1),
    "tenure": (0, S.MAX_TENURE),
    "monthly_charges": (0, None),
    "total_charges": (0, None),
}
REQUIRED = ["tenure", "monthly_charges"]


def require_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Return the table unchanged, or raise naming the required columns it lacks."""
    missing = [c for c in columns or S.BATCH_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are absent: {missing}")
    return df


def with_reasons(df: DataFrame) -> DataFrame:
    """Add `reasons`: one entry per violated constraint, empty for a valid record."""
    checks = [_reason(F.col(c).isNull(), f"{c}: required") for c in REQUIRED]
    checks += [_reason(~F.col(c).isin(v), f"{c}: not an allowed value") for c, v in ENUMERATED.items()]
    for c, (low, high) in RANGES.items():
        checks.append(_reason(F.col(c) < low, f"{c}: below {low}"))
        if high is not None:
            checks.append(_reason(F.col(c) > high, f"{c}: above {high}"))
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and rejected ones together with their reasons."""
    checked = with_reasons(df)
    ok = checked.where(F.size("reasons") == 0).drop("reasons")
    return ok, checked.where(F.size("reasons") > 0)


def fill_defaults(df: DataFrame) -> DataFrame:
    """Defaults for optional columns that are absent or NULL; numbers are parsed, and 0 where they cannot be."""
    present = set(df.columns)
    out = {}
    for c, default in S.BATCH_TEXT_DEFAULTS.items():
        out[c] = F.coalesce(F.col(c), F.lit(default)) if c in present else F.lit(default)
    for c, kind in S.BATCH_NUMERIC_DEFAULTS.items():
        # A whole number may arrive as text such as "1.0", so integers are parsed as doubles first.
        filled = F.coalesce(number(F.col(c)), F.lit(0.0)) if c in present else F.lit(0.0)
        out[c] = F.coalesce(filled.try_cast(kind), F.lit(0)).cast(kind)
    return df.withColumns(out)


def split_scorable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch rows, filled with defaults, that can be scored, and those with a number below its range, with reasons.

    Scoring is laxer than `split_valid`: unknown categories and long tenures get a score.
    """
    checks = [_reason(F.col(c) < low, f"{c}: below {low}") for c, (low, _) in RANGES.items()]
    checked = fill_defaults(df).withColumn("reasons", F.array_compact(F.array(*checks)))
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def _reason(test: Column, text: str) -> Column:
    return F.when(test, F.lit(text))
