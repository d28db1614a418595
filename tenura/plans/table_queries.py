"""Sources, sinks, validation and profiling (survey groups A and B)."""

from pyspark.sql import functions as F

from tenura import schema as S
from tenura.operators import encode, profile, score, validate
from tenura.plans import registry as R
from tenura.plans.registry import query
from tenura.session import new_path
from tenura.sources import customers_csv
from tenura.sources.subscribers import customers
from tenura.sources.tables import TableStore, reconcile

ALL_COLUMNS = ", ".join(S.COLUMN_TYPES)
TEXT_COLUMNS = [c for c, t in S.COLUMN_TYPES.items() if t == "string"]


@query("customer_csv_load", f"WITH {R.CUSTOMERS_SQL} SELECT {ALL_COLUMNS} FROM customers")
def customer_csv_load(spark, folder):
    path = new_path(spark, "customers-csv")
    customers_csv.write_customers_csv(customers(spark, folder), path)
    return customers_csv.read_customers_csv(spark, path)


@query("customer_csv_reordered", f"WITH {R.CUSTOMERS_SQL} SELECT {ALL_COLUMNS} FROM customers")
def customer_csv_reordered(spark, folder):
    """A file with its columns in reverse, names in capitals, and a column of its own."""
    path = new_path(spark, "customers-csv")
    customers_csv.write_customers_csv(customers(spark, folder), path)
    raw = spark.read.csv(path, header=True)
    turned = [F.col(c).alias(c.upper()) for c in reversed(raw.columns)]
    customers_csv.export_csv(raw.select(F.lit("x").alias("Remark"), *turned), path + "-turned")
    return customers_csv.read_customers_csv(spark, path + "-turned")


@query(
    "batch_mixed_headers",
    f"""WITH {R.CUSTOMERS_SQL} SELECT k, CAST(tenure AS DOUBLE) AS tenure, monthly_charges, contract,
    CASE WHEN k % 2 = 0 THEN gender ELSE 'Male' END AS gender FROM customers""",
)
def batch_mixed_headers(spark, folder):
    """A folder of files in two column orders, one of them without a column."""
    path = new_path(spark, "batch")
    rows = customers(spark, folder).drop("churn")
    customers_csv.export_csv(rows.where("k % 2 = 0"), path + "/a")
    rest = rows.where("k % 2 = 1")
    customers_csv.export_csv(rest.select(*[c for c in reversed(rest.columns) if c != "gender"]), path + "/b")
    filled = validate.fill_defaults(customers_csv.read_batch_csv(spark, path + "/*"))
    return filled.select(F.col("k").cast("bigint").alias("k"), "tenure", "monthly_charges", "contract", "gender")


@query(
    "score_batch_rejects",
    f"""WITH {R.DIRTY_SQL} SELECT k, 'monthly_charges: below 0' AS reasons FROM dirty WHERE monthly_charges < 0""",
)
def score_batch_rejects(spark, folder):
    """Batch rows that cannot be scored, next to the scores."""
    path = new_path(spark, "batch")
    customers_csv.export_csv(R.dirty(spark, folder).drop("churn"), path)
    _, rejects = score.read_batch(spark, path, "customer_id")
    return rejects.select(F.col("k").cast("bigint").alias("k"), F.concat_ws("; ", "reasons").alias("reasons"))


@query(
    "batch_row_index",
    f"WITH {R.CUSTOMERS_SQL} SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS row_index, k FROM customers",
)
def batch_row_index(spark, folder):
    """Rows of many files numbered in the order of the files and of the rows in them."""
    path = new_path(spark, "batch")
    customers_csv.export_csv(customers(spark, folder).drop("churn").repartitionByRange(16, "k").sortWithinPartitions("k"), path)
    rows, _ = score.read_batch(spark, path)
    return rows.select("row_index", F.col("k").cast("bigint").alias("k"))


@query("table_write_and_read", f"WITH {R.CUSTOMERS_SQL} SELECT * FROM customers")
def table_write_and_read(spark, folder):
    store = TableStore(spark, new_path(spark, "tables"))
    store.write(customers(spark, folder), "customers")
    return store.read("customers")


@query(
    "write_reconciliation",
    f"""WITH {R.CUSTOMERS_SQL}
    SELECT count(*) AS rows_written, count(*) AS rows_source, true AS matches FROM customers""",
)
def write_reconciliation(spark, folder):
    store = TableStore(spark, new_path(spark, "tables"))
    source = customers(spark, folder)
    store.write(encode.processed(source), "customers_processed")
    return reconcile(store.read("customers_processed"), source)


@query(
    "required_columns",
    f"WITH {R.CUSTOMERS_SQL} SELECT customer_id, {', '.join(S.BATCH_REQUIRED)} FROM customers",
)
def required_columns(spark, folder):
    return validate.require_columns(customers(spark, folder)).select("customer_id", *S.BATCH_REQUIRED)


_BAD = " OR ".join(
    [
        "tenure IS NULL OR monthly_charges IS NULL",
        "senior_citizen NOT IN (0, 1) OR tenure < 0 OR tenure > 72 OR monthly_charges < 0 OR total_charges < 0",
        "partner NOT IN ('Yes', 'No') OR contract NOT IN ('Month-to-month', 'One year', 'Two year')",
    ]
)


@query(
    "valid_records",
    f"""WITH {R.DIRTY_SQL} SELECT k, contract, partner, tenure, monthly_charges, senior_citizen
    FROM dirty WHERE NOT coalesce({_BAD}, false)""",
)
def valid_records(spark, folder):
    ok, _ = validate.split_valid(R.dirty(spark, folder))
    return ok.select("k", "contract", "partner", "tenure", "monthly_charges", "senior_citizen")


@query(
    "rejected_records",
    f"""WITH {R.DIRTY_SQL} SELECT k, concat_ws('; ',
      CASE WHEN tenure IS NULL THEN 'tenure: required' END,
      CASE WHEN partner NOT IN ('Yes', 'No') THEN 'partner: not an allowed value' END,
      CASE WHEN contract NOT IN ('Month-to-month', 'One year', 'Two year') THEN 'contract: not an allowed value' END,
      CASE WHEN senior_citizen > 1 THEN 'senior_citizen: above 1' END,
      CASE WHEN tenure > 72 THEN 'tenure: above 72' END,
      CASE WHEN monthly_charges < 0 THEN 'monthly_charges: below 0' END) AS reasons
    FROM dirty WHERE coalesce({_BAD}, false)""",
)
def rejected_records(spark, folder):
    _, rejects = validate.split_valid(R.dirty(spark, folder))
    return rejects.select("k", F.concat_ws("; ", "reasons").alias("reasons"))


@query("result_csv_export", f"WITH {R.DECIDED_SQL} SELECT k, churn_risk_label, ltv_predicted, ltv_segment FROM decided")
def result_csv_export(spark, folder):
    path = new_path(spark, "result-csv")
    result = R.decided(spark, folder).select("k", "churn_risk_label", "ltv_predicted", "ltv_segment")
    customers_csv.export_csv(result, path)
    return spark.read.csv(path, header=True, schema=result.schema)


@query("customer_preview", f"WITH {R.CUSTOMERS_SQL} SELECT * FROM customers ORDER BY k LIMIT 5")
def customer_preview(spark, folder):
    return profile.preview(customers(spark, folder), 5, "k")


_SPARK_TYPES = ["bigint"] + list(S.COLUMN_TYPES.values())
_FIELDS = ", ".join(
    f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(zip(["k", *S.COLUMN_TYPES], _SPARK_TYPES))
)


@query(
    "table_overview",
    f"""WITH {R.CUSTOMERS_SQL} SELECT position, name, type, (SELECT count(*) FROM customers) AS rows, 22 AS columns
    FROM (VALUES {_FIELDS}) AS f(position, name, type)""",
)
def table_overview(spark, folder):
    return profile.overview(customers(spark, folder))


@query(
    "missing_values",
    f"""WITH {R.DIRTY_SQL}, counted AS (
      SELECT 'tenure' AS "column", count(*) - count(tenure) AS missing, count(*) AS n FROM dirty
      UNION ALL SELECT 'total_charges', count(*) - count(total_charges), count(*) FROM dirty)
    SELECT "column", missing, round(missing / CAST(n AS DOUBLE) * 100, 2) AS missing_pct FROM counted WHERE missing > 0""",
)
def missing_values(spark, folder):
    return profile.missing_report(R.dirty(spark, folder))


@query(
    "duplicate_rows",
    f"""WITH {R.CUSTOMERS_SQL}, doubled AS (
      SELECT * FROM customers UNION ALL SELECT * FROM customers WHERE contract = 'Two year')
    SELECT CAST((SELECT count(*) FROM doubled) - (SELECT count(*) FROM (SELECT DISTINCT * FROM doubled) AS d) AS BIGINT)
      AS duplicates""",
)
def duplicate_rows(spark, folder):
    rows = customers(spark, folder)
    return profile.duplicate_count(rows.unionAll(rows.where(F.col("contract") == "Two year")))


@query(
    "categorical_domains",
    f"WITH {R.CUSTOMERS_SQL} "
    + " UNION ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM customers" for c in TEXT_COLUMNS),
)
def categorical_domains(spark, folder):
    return profile.categorical_domains(customers(spark, folder))


@query(
    "filled_total_charges",
    f"WITH {R.CUSTOMERS_SQL} SELECT k, coalesce(total_charges, CAST(0 AS DOUBLE)) AS total_charges FROM customers",
)
def filled_total_charges(spark, folder):
    return encode.fill_total_charges(customers(spark, folder)).select("k", "total_charges")


@query("null_charge_tenures", f"WITH {R.CUSTOMERS_SQL} SELECT DISTINCT tenure FROM customers WHERE total_charges IS NULL")
def null_charge_tenures(spark, folder):
    return profile.null_charge_tenures(customers(spark, folder))


@query(
    "null_matrix_cells",
    f"""WITH {R.DIRTY_SQL} SELECT CAST(sum(
      CASE WHEN tenure IS NULL THEN 3 ELSE 0 END
      + CASE WHEN contract = 'Weekly' THEN 1 ELSE 0 END
      + CASE WHEN contract = 'Weekly' AND tenure IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_cells FROM dirty""",
)
def null_matrix_cells(spark, folder):
    matrix = encode.churn_matrix(encode.features(R.dirty(spark, folder)))
    return profile.null_cells(matrix, S.CHURN_FEATURES)
