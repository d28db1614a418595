"""Categorical encodings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenura import schema as S


def is_value(column: str, value: str) -> Column:
    """1 where the column equals the value, else 0; NULL counts as 0."""
    return F.when(F.col(column) == value, 1).otherwise(0)


def yes(column: str) -> Column:
    return is_value(column, "Yes")


def is_male(column: str = "gender") -> Column:
    return is_value(column, "Male")


def collapsed(column: str) -> Column:
    """Service answer with the two "no such service" answers read as "No"."""
    return F.when(F.col(column).isin(S.NO_INTERNET, S.NO_PHONE), "No").otherwise(F.col(column))


def contract_code(column: str = "contract", unmapped: int | None = None) -> Column:
    """Ordinal contract code; an unknown contract gives `unmapped` (NULL in training, 0 at scoring)."""
    return _by_contract(column, S.CONTRACT_CODES, F.lit(unmapped).cast("int"))


def projected_months(column: str = "contract") -> Column:
    return _by_contract(column, S.PROJECTED_MONTHS, F.lit(S.DEFAULT_PROJECTED_MONTHS))


def one_hot(column: str, vocabulary: list[str], prefix: str) -> list[Column]:
    """One 0/1 column per vocabulary entry. The vocabulary is declared, so no pass over the data is needed."""
    return [is_value(column, v).alias(f"{prefix}_{v}") for v in vocabulary]


def internet_one_hot() -> list[Column]:
    return one_hot("internet_service", S.INTERNET_SERVICES, "internet")


def payment_one_hot() -> list[Column]:
    return one_hot("payment_method", S.PAYMENT_METHODS, "payment")


def _by_contract(column: str, mapping: dict[str, int], otherwise: Column) -> Column:
    out = None
    for value, number in mapping.items():
        test = F.col(column) == value
        out = F.when(test, number) if out is None else out.when(test, number)
    return out.otherwise(otherwise)
