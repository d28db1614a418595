"""Encodings, features, matrices and targets (survey group C)."""

from pyspark.sql import functions as F

from tenura import schema as S
from tenura.functions.features import contract_risk_scoring
from tenura.operators import encode, validate
from tenura.operators.ltv import ltv_target
from tenura.plans import registry as R
from tenura.plans.registry import query
from tenura.sources.subscribers import customers


def _flag(column: str, value: str, name: str) -> str:
    return f"CASE WHEN {column} = '{value}' THEN 1 ELSE 0 END AS \"{name}\""


def _yes(column: str, name: str) -> str:
    return _flag(column, "Yes", name)


_ONE_HOT = ", ".join(
    [_flag("internet_service", v, f"internet_{v}") for v in S.INTERNET_SERVICES]
    + [_flag("payment_method", v, f"payment_{v}") for v in S.PAYMENT_METHODS]
)
_SERVICE_FLAGS = ", ".join(_yes(s, f"{s}_enc") for s in S.SERVICES)


@query(
    "binary_encoding",
    f"WITH {R.CUSTOMERS_SQL} SELECT k, {', '.join(_yes(c, c + '_encoded') for c in encode.YES_NO_FLAGS)} FROM customers",
)
def binary_encoding(spark, folder):
    rows = encode.encode_binary(customers(spark, folder))
    return rows.select("k", *[f"{c}_encoded" for c in encode.YES_NO_FLAGS])


@query("gender_encoding", f"WITH {R.CUSTOMERS_SQL} SELECT k, {_flag('gender', 'Male', 'gender_encoded')} FROM customers")
def gender_encoding(spark, folder):
    return encode.encode_gender(customers(spark, folder)).select("k", "gender_encoded")


@query(
    "collapsed_services",
    f"WITH {R.CUSTOMERS_SQL} SELECT k, {', '.join(f'{R.collapsed_sql(s)} AS {s}' for s in S.SERVICES)} FROM customers",
)
def collapsed_services(spark, folder):
    return encode.collapse_services(customers(spark, folder)).select("k", *S.SERVICES)


@query("service_flags", f"WITH {R.CUSTOMERS_SQL} SELECT k, {_SERVICE_FLAGS} FROM customers")
def service_flags(spark, folder):
    return encode.encode_services(customers(spark, folder)).select("k", *S.SERVICE_FLAGS)


@query(
    "contract_codes",
    f"""WITH {R.DIRTY_SQL} SELECT k, {R.CONTRACT_CODE_SQL} AS training_code,
    coalesce({R.CONTRACT_CODE_SQL}, 0) AS scoring_code FROM dirty""",
)
def contract_codes(spark, folder):
    rows = encode.encode_contract(R.dirty(spark, folder), "training_code")
    return encode.encode_contract(rows, "scoring_code", unmapped=0).select("k", "training_code", "scoring_code")


@query("one_hot_columns", f"WITH {R.CUSTOMERS_SQL} SELECT k, {_ONE_HOT} FROM customers")
def one_hot_columns(spark, folder):
    return encode.one_hot_services(customers(spark, folder)).select("k", *S.ONE_HOT)


@query("churn_label", f"WITH {R.CUSTOMERS_SQL} SELECT k, {_yes('churn', 'churn_binary')} FROM customers")
def churn_label(spark, folder):
    return encode.with_label(customers(spark, folder)).select("k", "churn_binary")


def _feature_query(name: str):
    @query(name, f"WITH {R.FEATURED_SQL} SELECT k, {name} FROM featured")
    def build(spark, folder):
        return R.featured(spark, folder).select("k", name)


for _name in S.ENGINEERED:
    _feature_query(_name)


@query(
    "scoring_contract_risk",
    f"""WITH {R.DIRTY_SQL} SELECT k, (1 - CASE WHEN tenure > 72 THEN 1 ELSE coalesce(tenure, 0) / CAST(72 AS DOUBLE) END)
    * (1 - coalesce({R.CONTRACT_CODE_SQL}, 0) / CAST(2 AS DOUBLE)) AS risk FROM dirty""",
)
def scoring_contract_risk(spark, folder):
    """Every customer; one without a tenure counts as new."""
    return R.dirty(spark, folder).select("k", contract_risk_scoring().alias("risk"))


_REST = [c for c in S.COLUMN_TYPES if c not in ("internet_service", "payment_method")]
_COLLAPSED = S.INTERNET_ADDONS + ["multiple_lines"]


def _processed_sql() -> str:
    kept = []
    for c in _REST:
        if c in _COLLAPSED:
            kept.append(f"{R.collapsed_sql(c)} AS {c}")
        elif c == "total_charges":
            kept.append("coalesce(total_charges, CAST(0 AS DOUBLE)) AS total_charges")
        else:
            kept.append(c)
    flags = [_yes(c, f"{c}_encoded") for c in encode.YES_NO_FLAGS + _COLLAPSED]
    flags += [_flag("gender", "Male", "gender_encoded"), f"{R.CONTRACT_CODE_SQL} AS contract_encoded", _ONE_HOT]
    return f"WITH {R.CUSTOMERS_SQL} SELECT {', '.join(kept + flags)} FROM customers"


@query("customers_processed", _processed_sql())
def customers_processed(spark, folder):
    return encode.processed(customers(spark, folder).drop("k"))


@query("customers_features", f"WITH {R.FEATURED_SQL} SELECT * EXCLUDE (k) FROM featured")
def customers_features(spark, folder):
    return R.featured(spark, folder).drop("k")


_MODEL_FLAGS = ", ".join(
    [
        _SERVICE_FLAGS,
        _flag("gender", "Male", "gender_enc"),
        _yes("partner", "partner_enc"),
        _yes("dependents", "dependents_enc"),
        _yes("paperless_billing", "paperless_enc"),
        f"{R.CONTRACT_CODE_SQL} AS contract_enc",
        _ONE_HOT,
    ]
)
_ENGINEERED = ", ".join(S.ENGINEERED)


@query(
    "churn_feature_matrix",
    f"""WITH {R.FEATURED_SQL} SELECT k, {_ENGINEERED}, tenure, monthly_charges, total_charges, senior_citizen,
    {_MODEL_FLAGS} FROM featured""",
)
def churn_feature_matrix(spark, folder):
    return encode.churn_matrix(R.featured(spark, folder), ["k"])


@query(
    "ltv_feature_matrix",
    f"WITH {R.FEATURED_SQL} SELECT k, {_ENGINEERED}, tenure, monthly_charges, senior_citizen, {_MODEL_FLAGS} FROM featured",
)
def ltv_feature_matrix(spark, folder):
    return encode.ltv_matrix(R.featured(spark, folder), ["k"])


@query(
    "aligned_matrix",
    f"""WITH {R.FEATURED_SQL} SELECT k, service_count, 0 AS loyalty_points, tenure,
    {_flag('internet_service', 'Fiber optic', 'internet_Fiber optic')} FROM featured""",
)
def aligned_matrix(spark, folder):
    matrix = encode.churn_matrix(R.featured(spark, folder), ["k"])
    return encode.align(matrix, ["service_count", "loyalty_points", "tenure", "internet_Fiber optic"], ["k"])


@query(
    "batch_defaults",
    f"""WITH {R.DIRTY_SQL} SELECT k, CAST(coalesce(tenure, 0) AS DOUBLE) AS tenure, monthly_charges,
    coalesce(total_charges, CAST(0 AS DOUBLE)) AS total_charges, senior_citizen, 'Male' AS gender, partner,
    'No' AS dependents, 'No' AS streaming_tv, paperless_billing FROM dirty""",
)
def batch_defaults(spark, folder):
    partial = R.dirty(spark, folder).drop("gender", "dependents", "streaming_tv")
    return validate.fill_defaults(partial).select(
        "k",
        "tenure",
        "monthly_charges",
        "total_charges",
        "senior_citizen",
        "gender",
        "partner",
        "dependents",
        "streaming_tv",
        "paperless_billing",
    )


@query(
    "ltv_target_with_gaps",
    R.with_gaps(f"WITH {R.TARGET_SQL} SELECT k, ltv_historical, projected_months, ltv_projected FROM target"),
)
def ltv_target_with_gaps(spark, folder):
    rows = ltv_target(encode.features(R.gaps(spark, folder)))
    return rows.select("k", "ltv_historical", "projected_months", "ltv_projected")


@query("ltv_target", f"WITH {R.TARGET_SQL} SELECT k, ltv_historical, projected_months, ltv_projected FROM target")
def ltv_target_columns(spark, folder):
    return ltv_target(R.featured(spark, folder)).select("k", "ltv_historical", "projected_months", "ltv_projected")
