"""The `customers` table derived from order data: one order is one subscription.

All rules use integer arithmetic, or one correctly rounded division, so any engine gives the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tenura import schema as S


_SCHEMAS: dict[str, StructType] = {}


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Read a table; its schema is looked up in the files once per process, not once per query."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the numeric key `k` in front of the 21 columns.

    The largest input, the line items, is reduced by key before it meets the orders. No side is
    forced to be broadcast: all three inputs grow with the data, so adaptive execution decides by size
    and splits a customer who holds very many orders.
    """
    orders, people, lines = (_read(spark, f"{folder}/{t}.parquet") for t in ("orders", "customer", "lineitem"))

    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    newest = orders.agg(F.max(month)).scalar()

    used = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        *[F.max(F.col("l_partkey") % 8 == i).alias(f"has_{s}") for i, s in enumerate(S.SERVICES)]
    )

    key = F.col("o_orderkey")
    subscription = (
        orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("tenure", F.least(F.lit(S.MAX_TENURE), newest - month).cast("int"))
        .withColumn("cents", 1825 + F.floor((F.round(F.col("o_totalprice") * 100).cast("bigint") + 2500) / 5000))
        .withColumn(
            "contract",
            F.when(F.col("o_orderpriority").startswith("1"), "Two year")
            .when(F.col("o_orderpriority").startswith("2"), "One year")
            .otherwise("Month-to-month"),
        )
    )

    threshold = (
        F.when(F.col("contract") == "Two year", 3)
        .when(F.col("contract") == "One year", 11)
        .when(F.col("tenure") <= 12, 60)
        .otherwise(38)
    )
    segment = F.col("c_mktsegment")
    payment = (
        F.when(segment == "AUTOMOBILE", "Bank transfer (automatic)")
        .when(segment == "BUILDING", "Credit card (automatic)")
        .when(segment == "FURNITURE", "Mailed check")
        .otherwise("Electronic check")
    )
    internet = F.when(key % 5 == 0, "No").when(key % 5 <= 2, "DSL").otherwise("Fiber optic")
    columns = {
        "customer_id": key.cast("string"),
        "gender": F.when(F.col("c_custkey") % 2 == 1, "Male").otherwise("Female"),
        "senior_citizen": F.when(F.col("c_custkey") % 6 == 0, 1).otherwise(0),
        "partner": _yes_no(F.col("c_nationkey") % 2 == 0),
        "dependents": _yes_no(F.col("c_nationkey") % 3 == 0),
        "tenure": F.col("tenure"),
        "internet_service": internet,
        "contract": F.col("contract"),
        "paperless_billing": _yes_no(key % 5 < 3),
        "payment_method": payment,
        "monthly_charges": F.col("cents") / F.lit(100.0),
        "total_charges": F.when(F.col("tenure") > 0, F.col("tenure") * F.col("cents") / F.lit(100.0)),
        "churn": _yes_no(key * 7919 % 100 < threshold),
    }
    for service in S.SERVICES:
        answer = _yes_no(F.coalesce(F.col(f"has_{service}"), F.lit(False)))
        if service == "multiple_lines":
            answer = F.when(F.coalesce(F.col("has_phone_service"), F.lit(False)), answer).otherwise(S.NO_PHONE)
        elif service in S.INTERNET_ADDONS:
            answer = F.when(key % 5 == 0, S.NO_INTERNET).otherwise(answer)
        columns[service] = answer

    return subscription.join(used, "o_orderkey", "left").select(
        key.alias("k"), *[columns[c].alias(c) for c in S.COLUMN_TYPES]
    )


def _yes_no(test):
    return F.when(test, "Yes").otherwise("No")
