"""Encoded, featured and model-ready tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.functions import encoding as E
from tenura.functions import features as X

YES_NO_FLAGS = ["partner", "dependents", "phone_service", "paperless_billing", "churn"]
MATRIX_FLAGS = {
    "gender_enc": "gender",
    "partner_enc": "partner",
    "dependents_enc": "dependents",
    "paperless_enc": "paperless_billing",
}


def fill_total_charges(df: DataFrame) -> DataFrame:
    return df.withColumn("total_charges", X.total_charges_filled())


def encode_binary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({f"{c}_encoded": E.yes(c) for c in columns or YES_NO_FLAGS})


def encode_gender(df: DataFrame) -> DataFrame:
    return df.withColumn("gender_encoded", E.is_male())


def collapse_services(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: E.collapsed(c) for c in columns or S.SERVICES})


def encode_services(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_enc": E.yes(c) for c in S.SERVICES})


def encode_contract(df: DataFrame, name: str = "contract_encoded", unmapped: int | None = None) -> DataFrame:
    return df.withColumn(name, E.contract_code(unmapped=unmapped))


def one_hot_services(df: DataFrame) -> DataFrame:
    """Internet service and payment method become seven 0/1 columns in place of the two text columns."""
    kept = [c for c in df.columns if c not in ("internet_service", "payment_method")]
    return df.select(*kept, *E.internet_one_hot(), *E.payment_one_hot())


def with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("churn_binary", E.yes("churn"))


def processed(df: DataFrame) -> DataFrame:
    """The fully encoded customer table."""
    lines_and_addons = S.INTERNET_ADDONS + ["multiple_lines"]
    out = encode_gender(encode_binary(fill_total_charges(df)))
    out = collapse_services(out, lines_and_addons)
    out = out.withColumns({f"{c}_encoded": E.yes(c) for c in lines_and_addons})
    return one_hot_services(encode_contract(out))


def tenure_maximum(df: DataFrame) -> Column:
    """The data's largest tenure as a one-value subquery."""
    return df.agg(F.max("tenure").cast("double")).scalar()


def features(df: DataFrame, tenure_max: float | None = None) -> DataFrame:
    """Customers with the five engineered features, training form.

    Without `tenure_max` the maximum is read from the data itself.
    """
    top = tenure_maximum(df) if tenure_max is None else F.lit(float(tenure_max))
    return _engineered(fill_total_charges(df), X.contract_risk(top))


def scoring_features(df: DataFrame, tenure_max: float = S.MAX_TENURE) -> DataFrame:
    """The same features as they are built when scoring: fixed maximum, unknown contract as month-to-month."""
    return _engineered(df, X.contract_risk_scoring(tenure_max))


def _engineered(df: DataFrame, risk: Column) -> DataFrame:
    """Collapsed services and the five features, all from the columns as they came, in one projection.

    Counting "Yes" does not depend on the collapsing, so the two are kept out of each other's expressions.
    """
    made = {
        "charge_per_tenure": X.charge_per_tenure(),
        "service_count": X.service_count(),
        "charge_to_value_ratio": X.charge_to_value(),
        "support_dependency_score": X.support_score(),
        "tenure_contract_risk": risk,
    }
    return df.withColumns({c: E.collapsed(c) for c in S.SERVICES} | made)


def model_columns(featured: DataFrame, unmapped: int | None = None) -> DataFrame:
    """Every column either model can ask for, next to the featured table's own."""
    flags = {name: E.is_male(c) if c == "gender" else E.yes(c) for name, c in MATRIX_FLAGS.items()}
    out = featured.withColumns(flags | {"contract_enc": E.contract_code(unmapped=unmapped)})
    return encode_services(out).select("*", *E.internet_one_hot(), *E.payment_one_hot())


def churn_matrix(featured: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 29 columns of the churn model, after the columns to `keep`."""
    return _matrix(featured, S.CHURN_FEATURES, keep)


def ltv_matrix(featured: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 28 columns of the value model; billed charges are left out because the target is built on them."""
    return _matrix(featured, S.LTV_FEATURES, keep)


def align(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Exactly the columns a model was trained on, in its order: absent ones 0, others dropped."""
    present = set(df.columns)
    return df.select(
        *(keep or []), *[F.col(f"`{n}`") if n in present else F.lit(0).alias(n) for n in names]
    )


def _matrix(featured: DataFrame, names: list[str], keep: list[str] | None) -> DataFrame:
    keep = [c for c in keep or [] if c not in names]
    return model_columns(featured).select(*keep, *names)
