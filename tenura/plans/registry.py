"""Registered queries, each with the SQL it is checked against, and the shared views both sides start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.operators import encode, score
from tenura.operators.ltv import capped_and_segmented, ltv_target
from tenura.operators.split import integer_key_hash
from tenura.session import new_path
from tenura.sources.subscribers import customers
from tenura.sources.tables import TableStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | dict[str, int] | None = None):
    """Register a query. `digits` rounds its double columns on both sides, which hides summation order only."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = build(spark, folder)
            return rounded(out, digits) if digits is not None else out

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round every double column; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def rounded_sql(body: str, columns: str, digits: int = 6) -> str:
    """The same rounding for the named columns of an SQL text."""
    parts = ", ".join(f'round("{c}", {digits}) + CAST(0 AS DOUBLE) AS "{c}"' for c in columns.split())
    return f"SELECT * REPLACE ({parts}) FROM ({body}) AS body"


# Views shared by the queries


def featured(spark: SparkSession, folder: str) -> DataFrame:
    return encode.features(customers(spark, folder))


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with wrong cells planted in some rows."""
    k = F.col("k")
    return customers(spark, folder).withColumns(
        {
            "contract": F.when(k % 97 == 0, "Weekly").otherwise(F.col("contract")),
            "partner": F.when(k % 101 == 0, "Maybe").otherwise(F.col("partner")),
            "tenure": F.when(k % 89 == 0, 80).when(k % 83 == 0, F.lit(None)).otherwise(F.col("tenure")),
            "monthly_charges": F.when(k % 79 == 0, -1.0).otherwise(F.col("monthly_charges")),
            "senior_citizen": F.when(k % 103 == 0, 2).otherwise(F.col("senior_citizen")),
        }
    )


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of whom some have no charges or no tenure."""
    k = F.col("k")
    return customers(spark, folder).withColumns(
        {
            "monthly_charges": F.when(k % 71 != 0, F.col("monthly_charges")),
            "tenure": F.when(k % 83 != 0, F.col("tenure")),
        }
    )


def formula_probability():
    """A score in [0, 1) from contract, tenure and key; it stands in for a model where none is needed."""
    contract = F.col("contract")
    base = (
        F.when(contract == "Two year", 40)
        .when(contract == "One year", 120)
        .when(F.col("tenure") <= 12, 450)
        .otherwise(300)
    )
    return (base + integer_key_hash("k") % 400) / F.lit(1000.0)


def formula_ltv():
    """The projected value moved by up to a tenth, in whole cents."""
    cents = F.round(F.col("ltv_projected") * 100).cast("bigint")
    return F.floor(cents * (900 + integer_key_hash("k") % 201) / 1000) / F.lit(100.0)


def valued(spark: SparkSession, folder: str) -> DataFrame:
    """The customer value table with a formula prediction."""
    full = capped_and_segmented(ltv_target(featured(spark, folder)))
    return full.withColumn("ltv_predicted", formula_ltv()).select("k", *S.CUSTOMERS_LTV_COLUMNS)


def stamp(spark: SparkSession, folder: str) -> tuple:
    """What results kept in a session depend on: the session, the folder, and names, sizes and times of its order files."""
    files = spark.read.format("binaryFile").load([f"{folder}/{t}.parquet" for t in ("orders", "customer", "lineitem")])
    listed = F.hash("path", "length", "modificationTime").cast("long")  # the files themselves are not read
    return spark.sparkContext.applicationId, folder, *files.agg(F.count("*"), F.sum(listed)).first()


_TABLES: dict[tuple, TableStore] = {}


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stored table, written once per session and input folder; the value reports read it."""
    place = stamp(spark, folder)
    if place not in _TABLES:
        store = TableStore(spark, new_path(spark, "tables"))
        store.write(valued(spark, folder), "customers_ltv", lookup_by=["customer_id"])
        _TABLES[place] = store
    return _TABLES[place].read("customers_ltv")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Key, label and formula score of every customer."""
    return customers(spark, folder).select(
        "k", F.when(F.col("churn") == "Yes", 1).otherwise(0).alias("label"), formula_probability().alias("probability")
    )


def regressed(spark: SparkSession, folder: str) -> DataFrame:
    """Key, actual and formula-predicted value of every customer (uncapped target)."""
    target = ltv_target(encode.fill_total_charges(customers(spark, folder)))
    return target.select("k", F.col("ltv_projected").alias("actual"), formula_ltv().alias("predicted"))


def decided(spark: SparkSession, folder: str) -> DataFrame:
    """Scored customers with both formula scores and every derived decision column."""
    return score.decide(valued_inputs(spark, folder), "p", "ltv").select("k", *score.DECISION_COLUMNS)


def valued_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Key, formula probability `p` and formula value `ltv`; every eleventh value is below zero."""
    target = ltv_target(encode.fill_total_charges(customers(spark, folder)))
    ltv = F.when(F.col("k") % 11 == 0, -formula_ltv()).otherwise(formula_ltv())
    return target.select("k", formula_probability().alias("p"), ltv.alias("ltv"))


# SQL of the same views, as common table expressions

_SERVICE_TESTS = ", ".join(f"bool_or(l_partkey % 8 = {i}) AS u{i}" for i in range(8))


def _service_sql(i: int, name: str) -> str:
    answer = f"CASE WHEN coalesce(u{i}, false) THEN 'Yes' ELSE 'No' END"
    if name == "multiple_lines":
        answer = f"CASE WHEN coalesce(u0, false) THEN {answer} ELSE 'No phone service' END"
    elif i >= 2:
        answer = f"CASE WHEN k % 5 = 0 THEN 'No internet service' ELSE {answer} END"
    return f"{answer} AS {name}"


_SERVICE_SQL = {s: _service_sql(i, s) for i, s in enumerate(S.SERVICES)}

CUSTOMERS_SQL = f"""
used AS (SELECT l_orderkey, {_SERVICE_TESTS} FROM lineitem GROUP BY l_orderkey),
newest AS (SELECT max(year(o_orderdate) * 12 + month(o_orderdate)) AS m FROM orders),
subscription AS (
  SELECT o_orderkey AS k, c_custkey, c_nationkey, c_mktsegment,
    CAST(least(72, m - (year(o_orderdate) * 12 + month(o_orderdate))) AS INTEGER) AS tenure,
    1825 + (CAST(round(o_totalprice * 100) AS BIGINT) + 2500) // 5000 AS cents,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'Two year' WHEN o_orderpriority LIKE '2%' THEN 'One year'
         ELSE 'Month-to-month' END AS contract
  FROM orders JOIN customer ON o_custkey = c_custkey, newest),
customers AS (
  SELECT k, CAST(k AS VARCHAR) AS customer_id,
    CASE WHEN c_custkey % 2 = 1 THEN 'Male' ELSE 'Female' END AS gender,
    CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS senior_citizen,
    CASE WHEN c_nationkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS partner,
    CASE WHEN c_nationkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS dependents,
    tenure,
    {_SERVICE_SQL["phone_service"]},
    {_SERVICE_SQL["multiple_lines"]},
    CASE WHEN k % 5 = 0 THEN 'No' WHEN k % 5 <= 2 THEN 'DSL' ELSE 'Fiber optic' END AS internet_service,
    {", ".join(_SERVICE_SQL[s] for s in S.INTERNET_ADDONS)},
    contract,
    CASE WHEN k % 5 < 3 THEN 'Yes' ELSE 'No' END AS paperless_billing,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Bank transfer (automatic)'
         WHEN 'BUILDING' THEN 'Credit card (automatic)' WHEN 'FURNITURE' THEN 'Mailed check'
         ELSE 'Electronic check' END AS payment_method,
    cents / CAST(100 AS DOUBLE) AS monthly_charges,
    CASE WHEN tenure > 0 THEN tenure * cents / CAST(100 AS DOUBLE) END AS total_charges,
    CASE WHEN k * 7919 % 100 < (CASE WHEN contract = 'Two year' THEN 3 WHEN contract = 'One year' THEN 11
         WHEN tenure <= 12 THEN 60 ELSE 38 END) THEN 'Yes' ELSE 'No' END AS churn
  FROM subscription LEFT JOIN used ON k = l_orderkey)"""

_COUNT_YES = " + ".join(f"CASE WHEN {s} = 'Yes' THEN 1 ELSE 0 END" for s in S.SERVICES)
_COUNT_SUPPORT = " + ".join(f"CASE WHEN {s} = 'Yes' THEN 1 ELSE 0 END" for s in S.SUPPORT_SERVICES)
CONTRACT_CODE_SQL = "CASE contract WHEN 'Month-to-month' THEN 0 WHEN 'One year' THEN 1 WHEN 'Two year' THEN 2 END"


def collapsed_sql(column: str) -> str:
    return f"CASE WHEN {column} IN ('No internet service', 'No phone service') THEN 'No' ELSE {column} END"


FEATURED_SQL = f"""{CUSTOMERS_SQL},
counted AS (
  SELECT * REPLACE (coalesce(total_charges, CAST(0 AS DOUBLE)) AS total_charges,
      {", ".join(f"{collapsed_sql(s)} AS {s}" for s in S.SERVICES)}),
    {_COUNT_YES} AS service_count, {_COUNT_SUPPORT} AS support_dependency_score,
    {CONTRACT_CODE_SQL} AS code, (SELECT max(tenure) FROM customers) AS top
  FROM customers),
featured AS (
  SELECT * EXCLUDE (service_count, support_dependency_score, code, top),
    total_charges / (tenure + 1) AS charge_per_tenure,
    CAST(service_count AS INTEGER) AS service_count,
    monthly_charges / (service_count + 1) AS charge_to_value_ratio,
    CAST(support_dependency_score AS INTEGER) AS support_dependency_score,
    (1 - tenure / CAST(top AS DOUBLE)) * (1 - code / CAST(2 AS DOUBLE)) AS tenure_contract_risk
  FROM counted)"""

TARGET_SQL = f"""{FEATURED_SQL},
target AS (
  SELECT *, total_charges AS ltv_historical,
    CASE contract WHEN 'One year' THEN 12 WHEN 'Two year' THEN 24 ELSE 6 END AS projected_months,
    total_charges + monthly_charges
      * CASE contract WHEN 'One year' THEN 12 WHEN 'Two year' THEN 24 ELSE 6 END AS ltv_projected
  FROM featured)"""


def quantile_sql(p: float, value: str = "v") -> str:
    """Interpolated quantile over rows that carry their rank `i` (from 0) and the row count `n`."""
    place = f"(CAST({p} AS DOUBLE) * (n - 1))"
    low = f"max(CASE WHEN i = floor{place} THEN {value} END)"
    high = f"max(CASE WHEN i = ceil{place} THEN {value} END)"
    return f"({low} + ({high} - {low}) * max({place} - floor{place}))"


def half_up(value: str, digits: int = 2) -> str:
    """Round the shortest decimal form of a double, halves away from zero."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


HASH_SQL = "((k % 2147483648) * 2654435761 % 4294967296)"
PROBABILITY_SQL = f"""(CASE WHEN contract = 'Two year' THEN 40 WHEN contract = 'One year' THEN 120
    WHEN tenure <= 12 THEN 450 ELSE 300 END + {HASH_SQL} % 400) / CAST(1000 AS DOUBLE)"""
FORMULA_LTV_SQL = f"""(CAST(round(ltv_projected * 100) AS BIGINT) * (900 + {HASH_SQL} % 201) // 1000) / CAST(100 AS DOUBLE)"""

STORED_SQL = f"""{TARGET_SQL},
ranked AS (SELECT ltv_projected AS v, row_number() OVER (ORDER BY ltv_projected) - 1 AS i, count(*) OVER () AS n
  FROM target WHERE ltv_projected IS NOT NULL),
cap AS (SELECT {quantile_sql(0.99)} AS cap FROM ranked),
capped AS (SELECT CASE WHEN v > cap THEN cap ELSE v END AS v, i, n FROM ranked, cap),
edge AS (SELECT {quantile_sql(0.25)} AS q1, {quantile_sql(0.5)} AS q2, {quantile_sql(0.75)} AS q3 FROM capped),
clipped AS (
  SELECT target.* REPLACE (CASE WHEN ltv_projected > cap THEN cap ELSE ltv_projected END AS ltv_projected) FROM target, cap),
segmented AS (
  SELECT clipped.*, CASE WHEN ltv_projected <= q1 THEN 'Low' WHEN ltv_projected <= q2 THEN 'Medium'
         WHEN ltv_projected <= q3 THEN 'High' WHEN ltv_projected > q3 THEN 'Premium' END AS ltv_segment
  FROM clipped, edge),
stored AS (
  SELECT k, customer_id, tenure, contract, monthly_charges, total_charges, churn, ltv_historical, ltv_projected,
    {FORMULA_LTV_SQL} AS ltv_predicted, ltv_segment, {", ".join(S.ENGINEERED)}
  FROM segmented)"""

# The same views over customers of whom some have no charges or no tenure.
GAPS_SQL = (
    CUSTOMERS_SQL.replace("customers AS (", "whole AS (")
    + """,
customers AS (SELECT * REPLACE (CASE WHEN k % 71 = 0 THEN NULL ELSE monthly_charges END AS monthly_charges,
    CASE WHEN k % 83 = 0 THEN NULL ELSE tenure END AS tenure) FROM whole)"""
)


def with_gaps(sql: str) -> str:
    return sql.replace(CUSTOMERS_SQL, GAPS_SQL)


SCORED_SQL = f"""{CUSTOMERS_SQL},
scored AS (SELECT k, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS label, {PROBABILITY_SQL} AS probability
  FROM customers)"""

REGRESSED_SQL = f"""{TARGET_SQL},
regressed AS (SELECT k, ltv_projected AS actual, {FORMULA_LTV_SQL} AS predicted FROM target)"""

DECIDED_SQL = f"""{TARGET_SQL},
valued AS (SELECT k, {PROBABILITY_SQL} AS p,
    CASE WHEN k % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE {FORMULA_LTV_SQL} END AS ltv FROM target),
decided AS (
  SELECT k, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS churn_prediction, round(p, 4) AS churn_probability,
    CASE WHEN p < 0.25 THEN 'Low' WHEN p < 0.5 THEN 'Medium' WHEN p < 0.75 THEN 'High' ELSE 'Critical' END
      AS churn_risk_label,
    ltv AS ltv_predicted,
    CASE WHEN ltv < 1000 THEN 'Low' WHEN ltv < 2000 THEN 'Medium' WHEN ltv < 3500 THEN 'High' ELSE 'Premium' END
      AS ltv_segment,
    {half_up("ltv * p")} AS revenue_at_risk,
    CASE WHEN p >= 0.5 AND ltv >= 2000 THEN 'Critical' WHEN p >= 0.5 THEN 'High' WHEN ltv >= 2000 THEN 'Medium'
         ELSE 'Low' END AS priority_score
  FROM valued)"""

DIRTY_SQL = f"""{CUSTOMERS_SQL},
dirty AS (
  SELECT * REPLACE (
    CASE WHEN k % 97 = 0 THEN 'Weekly' ELSE contract END AS contract,
    CASE WHEN k % 101 = 0 THEN 'Maybe' ELSE partner END AS partner,
    CASE WHEN k % 89 = 0 THEN 80 WHEN k % 83 = 0 THEN NULL ELSE tenure END AS tenure,
    CASE WHEN k % 79 = 0 THEN CAST(-1 AS DOUBLE) ELSE monthly_charges END AS monthly_charges,
    CASE WHEN k % 103 = 0 THEN 2 ELSE senior_citizen END AS senior_citizen)
  FROM customers)"""
