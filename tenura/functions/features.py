"""The five engineered features as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.functions.bins import capped
from tenura.functions.encoding import contract_code, yes


def number(cell: Column) -> Column:
    """The cell as a double; NULL where it is blank, not a number, or NaN."""
    return F.nullif(cell.try_cast("double"), F.lit(float("nan")))


def total_charges_filled() -> Column:
    """Charges billed so far; blank or missing means nothing has been billed yet."""
    return F.coalesce(number(F.col("total_charges")), F.lit(0.0))


def yes_count(columns: list[str]) -> Column:
    total = yes(columns[0])
    for column in columns[1:]:
        total = total + yes(column)
    return total


def service_count() -> Column:
    return yes_count(S.SERVICES)


def support_score() -> Column:
    return yes_count(S.SUPPORT_SERVICES)


def charge_per_tenure() -> Column:
    """NULL for a tenure of -1: a wrong cell must not end the job."""
    return F.try_divide(total_charges_filled(), F.col("tenure") + 1)


def charge_to_value() -> Column:
    return F.col("monthly_charges") / (service_count() + 1)


def contract_risk(tenure_max: Column) -> Column:
    """Training form: tenure relative to the data's maximum; an unknown contract gives NULL."""
    tenure_share = F.try_divide(F.col("tenure"), tenure_max)
    return (1 - tenure_share) * (1 - contract_code() / F.lit(2.0))


def contract_risk_scoring(tenure_max: float = S.MAX_TENURE) -> Column:
    """Scoring form: a stored maximum, clipped at 1; an unknown contract counts as month-to-month, a missing tenure as 0."""
    share = F.try_divide(F.coalesce(F.col("tenure"), F.lit(0)), F.lit(float(tenure_max)))
    tenure_share = capped(share, F.lit(1.0))
    return (1 - tenure_share) * (1 - contract_code(unmapped=0) / F.lit(2.0))
