"""Data model of the subscriber tables: column names, vocabularies, thresholds.

Everything here is a fixed value that results depend on, so it is stated as plain text.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "customer_id"

# Vocabularies of the enumerated columns.
YES_NO = ["No", "Yes"]
GENDERS = ["Male", "Female"]
CONTRACTS = ["Month-to-month", "One year", "Two year"]
INTERNET_SERVICES = ["DSL", "Fiber optic", "No"]
PAYMENT_METHODS = [
    "Bank transfer (automatic)",
    "Credit card (automatic)",
    "Electronic check",
    "Mailed check",
]
NO_INTERNET = "No internet service"
NO_PHONE = "No phone service"
LTV_SEGMENTS = ["Low", "Medium", "High", "Premium"]
RISK_LABELS = ["Low", "Medium", "High", "Critical"]
TENURE_GROUPS = ["0-12 months", "13-24 months", "25-48 months", "49-72 months"]

# The eight services in feature order, and the four that count as support.
SERVICES = [
    "phone_service",
    "multiple_lines",
    "online_security",
    "online_backup",
    "device_protection",
    "tech_support",
    "streaming_tv",
    "streaming_movies",
]
INTERNET_ADDONS = SERVICES[2:]
SUPPORT_SERVICES = ["online_security", "device_protection", "tech_support", "online_backup"]

# Contract codes, projected months, limits.
CONTRACT_CODES = {"Month-to-month": 0, "One year": 1, "Two year": 2}
PROJECTED_MONTHS = {"Month-to-month": 6, "One year": 12, "Two year": 24}
DEFAULT_PROJECTED_MONTHS = 6
MAX_TENURE = 72
LTV_CAP_QUANTILE = 0.99

# Feature names and their order in the two model matrices.
ENGINEERED = [
    "charge_per_tenure",
    "service_count",
    "charge_to_value_ratio",
    "support_dependency_score",
    "tenure_contract_risk",
]
SERVICE_FLAGS = [f"{c}_enc" for c in SERVICES]
ONE_HOT = [f"internet_{v}" for v in INTERNET_SERVICES] + [f"payment_{v}" for v in PAYMENT_METHODS]
CHURN_FEATURES = (
    ENGINEERED
    + ["tenure", "monthly_charges", "total_charges", "senior_citizen"]
    + SERVICE_FLAGS
    + ["gender_enc", "partner_enc", "dependents_enc", "paperless_enc", "contract_enc"]
    + ONE_HOT
)
LTV_FEATURES = (
    ENGINEERED
    + ["tenure", "monthly_charges", "senior_citizen"]
    + SERVICE_FLAGS
    + ["contract_enc", "gender_enc", "partner_enc", "dependents_enc", "paperless_enc"]
    + ONE_HOT
)

# Raw CSV header -> column name, in file order.
CSV_HEADER = {
    "customerID": "customer_id",
    "gender": "gender",
    "SeniorCitizen": "senior_citizen",
    "Partner": "partner",
    "Dependents": "dependents",
    "tenure": "tenure",
    "PhoneService": "phone_service",
    "MultipleLines": "multiple_lines",
    "InternetService": "internet_service",
    "OnlineSecurity": "online_security",
    "OnlineBackup": "online_backup",
    "DeviceProtection": "device_protection",
    "TechSupport": "tech_support",
    "StreamingTV": "streaming_tv",
    "StreamingMovies": "streaming_movies",
    "Contract": "contract",
    "PaperlessBilling": "paperless_billing",
    "PaymentMethod": "payment_method",
    "MonthlyCharges": "monthly_charges",
    "TotalCharges": "total_charges",
    "Churn": "churn",
}

COLUMN_TYPES = {name: "string" for name in CSV_HEADER.values()} | {
    "senior_citizen": "int",
    "tenure": "int",
    "monthly_charges": "double",
    "total_charges": "double",
}

# Batch contract. Required columns and the defaults of the optional ones.
BATCH_REQUIRED = [
    "tenure",
    "monthly_charges",
    "total_charges",
    "contract",
    "internet_service",
    "payment_method",
]
BATCH_TEXT_DEFAULTS = {"gender": "Male", "partner": "No", "dependents": "No", "paperless_billing": "No"} | {
    c: "No" for c in SERVICES
}
BATCH_NUMERIC_DEFAULTS = {
    "tenure": "double",
    "monthly_charges": "double",
    "total_charges": "double",
    "senior_citizen": "int",
}

# Columns of the stored customer value table.
CUSTOMERS_LTV_COLUMNS = [
    "customer_id",
    "tenure",
    "contract",
    "monthly_charges",
    "total_charges",
    "churn",
    "ltv_historical",
    "ltv_projected",
    "ltv_predicted",
    "ltv_segment",
] + ENGINEERED


def customers_schema() -> T.StructType:
    """Declared schema of the `customers` table."""
    return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in COLUMN_TYPES.items()))


def batch_schema(key: str = KEY) -> T.StructType:
    """Declared schema of scoring input: the customer columns without the label, numbers as at scoring."""
    fields = [(key, "string")] + [
        (c, BATCH_NUMERIC_DEFAULTS.get(c, t)) for c, t in COLUMN_TYPES.items() if c not in (KEY, "churn")
    ]
    return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in fields))
