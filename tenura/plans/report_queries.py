"""Filters, joins, reports and top-k (survey groups D, E, F and H)."""

from pyspark.sql import functions as F

from tenura import schema as S
from tenura.operators import encode, reports
from tenura.operators.ltv import cap_quantile, capped_and_segmented, ltv_target
from tenura.operators.models import top_features
from tenura.plans import registry as R
from tenura.plans.registry import query
from tenura.sources.subscribers import customers

D = "CAST(100 AS DOUBLE)"


def _case(test: str, value: str, other: str = "NULL") -> str:
    return f"CASE WHEN {test} THEN {value} ELSE {other} END"


_HIT = _case("churn = 'Yes'", D, "0")
_LABEL = _case("churn = 'Yes'", "1", "0")
_LOST = _case("churn = 'Yes'", "ltv_predicted", "CAST(0 AS DOUBLE)")


# Filters


@query("churned_customers", f"WITH {R.CUSTOMERS_SQL} SELECT * FROM customers WHERE churn = 'Yes'")
def churned_customers(spark, folder):
    return reports.where_churn(customers(spark, folder), "Yes")


@query(
    "high_risk_segment",
    R.rounded_sql(
        f"""WITH {R.CUSTOMERS_SQL} SELECT count(*) AS customers, avg({_HIT}) AS churn_pct
        FROM customers WHERE contract = 'Month-to-month' AND tenure <= 12""",
        "churn_pct",
    ),
    digits=6,
)
def high_risk_segment(spark, folder):
    return reports.high_risk_segment(customers(spark, folder))


@query(
    "customer_lookup",
    f"""WITH {R.STORED_SQL} SELECT customer_id, contract, tenure, monthly_charges, churn AS churn_status,
    ltv_historical, ltv_projected, ltv_predicted, ltv_segment FROM stored WHERE customer_id = '1042'""",
)
def customer_lookup(spark, folder):
    return reports.lookup(R.stored(spark, folder), "1042")


# Joins


@query(
    "scores_with_labels",
    f"WITH {R.SCORED_SQL} SELECT k, probability, label FROM scored",
)
def scores_with_labels(spark, folder):
    rows = R.scored(spark, folder)
    labels = customers(spark, folder).select("k", F.when(F.col("churn") == "Yes", 1).otherwise(0).alias("label"))
    return reports.attach(rows.select("k", "probability"), labels, "k")


# Churn by category


@query(
    "churn_distribution",
    f"""WITH {R.CUSTOMERS_SQL} SELECT churn, count(*) AS customers,
    round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 2) AS pct FROM customers GROUP BY churn""",
)
def churn_distribution(spark, folder):
    return reports.churn_distribution(customers(spark, folder))


def _crosstab_sql(view: str, table: str, category: str) -> str:
    return R.rounded_sql(
        f"""WITH {view} SELECT {category}, count(*) FILTER (WHERE churn = 'No') AS no_count,
        count(*) FILTER (WHERE churn = 'Yes') AS yes_count,
        count(*) FILTER (WHERE churn = 'No') / CAST(count(*) AS DOUBLE) * 100 AS no_pct,
        count(*) FILTER (WHERE churn = 'Yes') / CAST(count(*) AS DOUBLE) * 100 AS yes_pct
        FROM {table} WHERE {category} IS NOT NULL GROUP BY {category}""",
        "no_pct yes_pct",
    )


def _crosstab_query(category: str):
    engineered = category in S.ENGINEERED
    view, table = (R.FEATURED_SQL, "featured") if engineered else (R.CUSTOMERS_SQL, "customers")

    @query(f"crosstab_{category}", _crosstab_sql(view, table, category), digits=6)
    def build(spark, folder):
        rows = R.featured(spark, folder) if engineered else customers(spark, folder)
        return reports.crosstab_pct(rows, category)


for _category in (
    "contract",
    "internet_service",
    "payment_method",
    "paperless_billing",
    "partner",
    "senior_citizen",
    "service_count",
    "support_dependency_score",
):
    _crosstab_query(_category)

GROUP_SQL = """CASE WHEN tenure <= 0 THEN NULL WHEN tenure <= 12 THEN '0-12 months' WHEN tenure <= 24 THEN '13-24 months'
    WHEN tenure <= 48 THEN '25-48 months' WHEN tenure <= 72 THEN '49-72 months' END"""
_GROUPED = f"{R.CUSTOMERS_SQL}, grouped AS (SELECT *, {GROUP_SQL} AS tenure_group FROM customers)"


@query("crosstab_tenure_group", _crosstab_sql(_GROUPED, "grouped", "tenure_group"), digits=6)
def crosstab_tenure_group(spark, folder):
    return reports.tenure_group_crosstab(customers(spark, folder))


def _describe_sql(column: str) -> str:
    q = ", ".join(f"{R.quantile_sql(p)} AS {n}" for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
    return R.rounded_sql(
        f"""WITH {R.CUSTOMERS_SQL}, ranked AS (
          SELECT churn, CAST({column} AS DOUBLE) AS v,
            row_number() OVER (PARTITION BY churn ORDER BY {column}) - 1 AS i,
            count(*) OVER (PARTITION BY churn) AS n FROM customers WHERE {column} IS NOT NULL)
        SELECT churn, count(*) AS "count", avg(v) AS mean, stddev_samp(v) AS std, min(v) AS "min", {q}, max(v) AS "max"
        FROM ranked GROUP BY churn""",
        "mean std min q25 q50 q75 max",
    )


@query("describe_tenure", _describe_sql("tenure"), digits=6)
def describe_tenure(spark, folder):
    return reports.describe_by(customers(spark, folder), "tenure", "churn")


@query("describe_monthly_charges", _describe_sql("monthly_charges"), digits=6)
def describe_monthly_charges(spark, folder):
    return reports.describe_by(customers(spark, folder), "monthly_charges", "churn")


_HEAT = ", ".join(f"avg({_HIT}) FILTER (WHERE tenure_group = '{g}') AS \"{g}\"" for g in S.TENURE_GROUPS)
_HEAT_ROUND = ", ".join(f'round("{g}", 6) + CAST(0 AS DOUBLE) AS "{g}"' for g in S.TENURE_GROUPS)


@query(
    "churn_heatmap",
    f"""SELECT * REPLACE ({_HEAT_ROUND}) FROM (WITH {_GROUPED} SELECT contract, {_HEAT} FROM grouped
    WHERE tenure_group IS NOT NULL GROUP BY contract) AS body""",
    digits=6,
)
def churn_heatmap(spark, folder):
    return reports.churn_heatmap(customers(spark, folder))


NUMERIC = ["tenure", "monthly_charges", "total_charges", "senior_citizen", "churn_binary"]


@query(
    "correlation_matrix",
    R.rounded_sql(
        f"WITH {R.CUSTOMERS_SQL}, labelled AS (SELECT *, {_LABEL} AS churn_binary FROM customers) "
        + " UNION ALL ".join(
            f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS corr FROM labelled"
            for a in NUMERIC
            for b in NUMERIC
        ),
        "corr",
    ),
    digits=6,
)
def correlation_matrix(spark, folder):
    rows = customers(spark, folder).withColumn("churn_binary", F.when(F.col("churn") == "Yes", 1).otherwise(0))
    return reports.corr_matrix(rows, NUMERIC)


@query(
    "feature_correlation",
    R.rounded_sql(
        f"WITH {R.FEATURED_SQL} "
        + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, corr({f}, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END) AS corr FROM featured"
            for f in S.ENGINEERED
        ),
        "corr",
    ),
    digits=6,
)
def feature_correlation(spark, folder):
    return reports.feature_corr(R.featured(spark, folder))


@query(
    "feature_summary",
    R.rounded_sql(
        f"WITH {R.FEATURED_SQL} "
        + " UNION ALL ".join(
            f"""SELECT '{f}' AS feature, CAST(min({f}) AS DOUBLE) AS "min", CAST(max({f}) AS DOUBLE) AS "max",
            avg({f}) FILTER (WHERE churn = 'Yes') AS mean_churned, avg({f}) FILTER (WHERE churn = 'No') AS mean_retained
            FROM featured"""
            for f in S.ENGINEERED
        ),
        "min max mean_churned mean_retained",
    ),
    digits=6,
)
def feature_summary(spark, folder):
    return reports.feature_summary(R.featured(spark, folder))


@query(
    "baseline_kpis",
    R.rounded_sql(
        f"""WITH {R.CUSTOMERS_SQL} SELECT avg({_HIT}) AS churn_rate, 100 - avg({_HIT}) AS retention_rate,
        avg(tenure) FILTER (WHERE churn = 'Yes') AS avg_tenure_churned,
        avg(tenure) FILTER (WHERE churn = 'No') AS avg_tenure_retained,
        sum(monthly_charges) AS monthly_revenue, sum(monthly_charges) FILTER (WHERE churn = 'Yes') AS revenue_lost,
        sum(monthly_charges) FILTER (WHERE churn = 'Yes') / sum(monthly_charges) * 100 AS pct_at_risk FROM customers""",
        "churn_rate retention_rate avg_tenure_churned avg_tenure_retained monthly_revenue revenue_lost pct_at_risk",
        5,
    ),
    digits=5,
)
def baseline_kpis(spark, folder):
    return reports.baseline_kpis(customers(spark, folder))


@query(
    "senior_churn",
    R.rounded_sql(
        f"""WITH {R.CUSTOMERS_SQL} SELECT avg({_HIT}) FILTER (WHERE senior_citizen = 1) AS senior_pct,
        avg({_HIT}) FILTER (WHERE senior_citizen = 0) AS non_senior_pct FROM customers""",
        "senior_pct non_senior_pct",
    ),
    digits=6,
)
def senior_churn(spark, folder):
    return reports.senior_churn(customers(spark, folder))


@query(
    "churn_by_contract",
    f"""WITH {R.CUSTOMERS_SQL} SELECT contract, count(*) AS total, count(*) FILTER (WHERE churn = 'Yes') AS churned,
    round(count(*) FILTER (WHERE churn = 'Yes') * {D} / count(*), 1) AS churn_rate FROM customers GROUP BY contract""",
)
def churn_by_contract(spark, folder):
    return reports.churn_by_contract(customers(spark, folder))


@query(
    "eda_summary",
    R.rounded_sql(
        f"""WITH {R.CUSTOMERS_SQL} SELECT avg({_HIT}) AS overall_pct,
        avg({_HIT}) FILTER (WHERE contract = 'Month-to-month') AS month_to_month_pct,
        avg({_HIT}) FILTER (WHERE contract = 'Two year') AS two_year_pct,
        avg(tenure) FILTER (WHERE churn = 'Yes') AS tenure_churned,
        avg(tenure) FILTER (WHERE churn = 'No') AS tenure_retained,
        avg(monthly_charges) FILTER (WHERE churn = 'Yes') AS charges_churned,
        avg(monthly_charges) FILTER (WHERE churn = 'No') AS charges_retained FROM customers""",
        "overall_pct month_to_month_pct two_year_pct tenure_churned tenure_retained charges_churned charges_retained",
    ),
    digits=6,
)
def eda_summary(spark, folder):
    return reports.eda_summary(customers(spark, folder))


# Lifetime value

_LTV_STATS = ", ".join(
    f"{f}({c}) AS {n}_{c}"
    for c in ("ltv_historical", "ltv_projected")
    for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"))
)


@query(
    "ltv_stats",
    R.rounded_sql(
        f"WITH {R.STORED_SQL} SELECT {_LTV_STATS} FROM stored",
        "mean_ltv_historical std_ltv_historical max_ltv_historical mean_ltv_projected std_ltv_projected max_ltv_projected",
        5,
    ),
    digits=5,
)
def ltv_stats(spark, folder):
    return reports.ltv_stats(R.stored(spark, folder))


@query(
    "predicted_ltv_stats",
    R.rounded_sql(
        f"""WITH {R.STORED_SQL}, placed AS (
          SELECT ltv_predicted AS v, row_number() OVER (ORDER BY ltv_predicted) - 1 AS i, count(*) OVER () AS n
          FROM stored)
        SELECT avg(v) AS mean, {R.quantile_sql(0.5)} AS median, min(v) AS "min", max(v) AS "max" FROM placed""",
        "mean median min max",
        5,
    ),
    digits=5,
)
def predicted_ltv_stats(spark, folder):
    return reports.pred_stats(R.stored(spark, folder))


@query(
    "ltv_by_contract",
    R.rounded_sql(
        f"WITH {R.STORED_SQL} SELECT contract, avg(ltv_projected) AS avg_ltv FROM stored GROUP BY contract", "avg_ltv", 5
    ),
    digits=5,
)
def ltv_by_contract(spark, folder):
    return reports.ltv_by_contract(R.stored(spark, folder))


def _pred_by_query(column: str):
    @query(
        f"predicted_ltv_by_{column}",
        R.rounded_sql(
            f"WITH {R.STORED_SQL} SELECT {column}, avg(ltv_predicted) AS avg_predicted FROM stored GROUP BY {column}",
            "avg_predicted",
            5,
        ),
        digits=5,
    )
    def build(spark, folder):
        return reports.pred_by(R.stored(spark, folder), column)


for _column in ("churn", "contract"):
    _pred_by_query(_column)


@query(
    "segment_distribution",
    f"""WITH {R.STORED_SQL} SELECT ltv_segment, count(*) AS customers, round(avg(ltv_predicted), 2) AS avg_ltv
    FROM stored GROUP BY ltv_segment""",
)
def segment_distribution(spark, folder):
    return reports.segment_distribution(R.stored(spark, folder))


@query("segment_churn", _crosstab_sql(R.STORED_SQL, "stored", "ltv_segment"), digits=6)
def segment_churn(spark, folder):
    return reports.segment_churn(R.stored(spark, folder))


@query(
    "revenue_at_risk",
    f"""WITH {R.STORED_SQL} SELECT round(sum(ltv_predicted), 2) AS total_portfolio_ltv,
    round(sum({_LOST}), 2) AS revenue_at_risk, round(sum({_LOST}) * {D} / sum(ltv_predicted), 2) AS pct_at_risk
    FROM stored""",
)
def revenue_at_risk(spark, folder):
    return reports.revenue_at_risk(R.stored(spark, folder))


@query(
    "ltv_three_by_contract",
    f"""WITH {R.STORED_SQL} SELECT contract, round(avg(ltv_historical), 2) AS hist_ltv,
    round(avg(ltv_projected), 2) AS proj_ltv, round(avg(ltv_predicted), 2) AS pred_ltv FROM stored GROUP BY contract""",
)
def ltv_three_by_contract(spark, folder):
    return reports.ltv_three_by_contract(R.stored(spark, folder))


@query(
    "churn_by_tenure_band",
    f"""WITH {R.CUSTOMERS_SQL} SELECT CASE WHEN tenure <= 12 THEN '0-12 mo' WHEN tenure <= 24 THEN '13-24 mo'
      WHEN tenure <= 48 THEN '25-48 mo' ELSE '49-72 mo' END AS tenure_band,
    count(*) AS total, round(avg({_HIT}), 1) AS churn_pct FROM customers GROUP BY 1""",
)
def churn_by_tenure_band(spark, folder):
    return reports.churn_by_band(customers(spark, folder))


_SUMMARY_SQL = f"""SELECT count(*) AS total_customers, count(*) FILTER (WHERE churn = 'Yes') AS churned_customers,
    round(count(*) FILTER (WHERE churn = 'Yes') / CAST(count(*) AS DOUBLE) * 100, 2) AS churn_rate_pct,
    round(avg(ltv_predicted), 2) AS avg_predicted_ltv, round(sum({_LOST}), 2) AS total_revenue_at_risk,
    {", ".join(f"count(*) FILTER (WHERE ltv_segment = '{s}') AS {s.lower()}_customers" for s in S.LTV_SEGMENTS)}
    FROM stored"""


@query("business_summary", f"WITH {R.STORED_SQL} {_SUMMARY_SQL}")
def business_summary(spark, folder):
    return reports.business_summary(R.stored(spark, folder))


@query(
    "revenue_split",
    R.rounded_sql(
        f"""WITH {R.STORED_SQL}, summary AS ({_SUMMARY_SQL})
        SELECT greatest(avg_predicted_ltv * total_customers - total_revenue_at_risk, 0) AS safe_revenue,
        total_revenue_at_risk AS revenue_at_risk FROM summary""",
        "safe_revenue revenue_at_risk",
        4,
    ),
    digits=4,
)
def revenue_split(spark, folder):
    return reports.revenue_split(R.stored(spark, folder))


# Scored customers


@query(
    "batch_summary",
    f"""WITH {R.DECIDED_SQL} SELECT count(*) AS total_customers, CAST(sum(churn_prediction) AS BIGINT) AS churners_predicted,
    round(sum(churn_prediction) / CAST(count(*) AS DOUBLE), 4) AS churn_rate,
    round(sum(revenue_at_risk), 2) AS total_revenue_at_risk FROM decided""",
)
def batch_summary(spark, folder):
    return reports.batch_summary(R.decided(spark, folder))


@query("empty_batch_summary", """SELECT CAST(0 AS BIGINT) AS total_customers, CAST(0 AS BIGINT) AS churners_predicted,
    CAST(0 AS DOUBLE) AS churn_rate, CAST(0 AS DOUBLE) AS total_revenue_at_risk""")
def empty_batch_summary(spark, folder):
    return reports.batch_summary(R.decided(spark, folder).where(F.col("churn_probability") > 2))


def _label_query(column: str):
    @query(f"count_by_{column}", f"WITH {R.DECIDED_SQL} SELECT {column}, count(*) AS rows FROM decided GROUP BY {column}")
    def build(spark, folder):
        return reports.label_counts(R.decided(spark, folder), column)


for _column in ("churn_risk_label", "ltv_segment"):
    _label_query(_column)


@query(
    "high_risk_premium_customers",
    f"""WITH {R.STORED_SQL} SELECT customer_id, contract, tenure, round(monthly_charges, 2) AS monthly_charges,
    round(ltv_predicted, 2) AS ltv_predicted, ltv_segment FROM stored
    WHERE churn = 'Yes' AND ltv_segment IN ('Premium', 'High') ORDER BY stored.ltv_predicted DESC, customer_id LIMIT 20""",
)
def high_risk_premium_customers(spark, folder):
    return reports.high_risk_premium(R.stored(spark, folder))


def _extreme_query(name: str, label: int, order: str):
    @query(
        name,
        f"WITH {R.SCORED_SQL} SELECT * FROM scored WHERE label = {label} ORDER BY probability {order}, k LIMIT 1",
    )
    def build(spark, folder):
        return reports.extreme_customer(R.scored(spark, folder), label, "k")


_extreme_query("riskiest_churner", 1, "DESC")
_extreme_query("safest_retained", 0, "ASC")


@query(
    "display_strings",
    f"""WITH {R.DECIDED_SQL} SELECT k, regexp_replace(printf('%.2f', round(churn_probability * 100, 2)), '0$', '') || '%'
      AS churn_probability,
    '$' || regexp_replace(printf('%.2f', ltv_predicted), '0$', '') AS ltv_predicted,
    '$' || regexp_replace(printf('%.2f', revenue_at_risk), '0$', '') AS revenue_at_risk FROM decided""",
)
def display_strings(spark, folder):
    return reports.display(R.decided(spark, folder)).select("k", "churn_probability", "ltv_predicted", "revenue_at_risk")


@query(
    "capped_ltv",
    f"""WITH {R.TARGET_SQL}, ranked AS (SELECT ltv_projected AS v, row_number() OVER (ORDER BY ltv_projected) - 1 AS i,
      count(*) OVER () AS n FROM target), cap AS (SELECT {R.quantile_sql(0.99)} AS cap FROM ranked)
    SELECT k, CASE WHEN ltv_projected > cap THEN cap ELSE ltv_projected END AS ltv_projected FROM target, cap""",
)
def capped_ltv(spark, folder):
    return cap_quantile(ltv_target(R.featured(spark, folder)), "ltv_projected").select("k", "ltv_projected")


@query("quartile_segments", f"WITH {R.STORED_SQL} SELECT k, ltv_projected, ltv_segment FROM segmented")
def quartile_segments(spark, folder):
    rows = capped_and_segmented(ltv_target(R.featured(spark, folder)))
    return rows.select("k", "ltv_projected", "ltv_segment")


def _gap_segments(spark, folder):
    return capped_and_segmented(ltv_target(encode.features(R.gaps(spark, folder))))


@query(
    "capped_ltv_with_gaps",
    R.with_gaps(
        f"""WITH {R.TARGET_SQL}, ranked AS (SELECT ltv_projected AS v, row_number() OVER (ORDER BY ltv_projected) - 1 AS i,
      count(*) OVER () AS n FROM target WHERE ltv_projected IS NOT NULL),
      cap AS (SELECT {R.quantile_sql(0.99)} AS cap FROM ranked)
    SELECT k, CASE WHEN ltv_projected > cap THEN cap ELSE ltv_projected END AS ltv_projected FROM target, cap"""
    ),
)
def capped_ltv_with_gaps(spark, folder):
    """A customer without charges has no projected value, not the cap."""
    return cap_quantile(ltv_target(encode.features(R.gaps(spark, folder))), "ltv_projected").select("k", "ltv_projected")


@query("quartile_segments_with_gaps", R.with_gaps(f"WITH {R.STORED_SQL} SELECT k, ltv_projected, ltv_segment FROM segmented"))
def quartile_segments_with_gaps(spark, folder):
    return _gap_segments(spark, folder).select("k", "ltv_projected", "ltv_segment")


@query("customers_ltv_with_gaps", R.with_gaps(f"WITH {R.STORED_SQL} SELECT * EXCLUDE (k) FROM stored"))
def customers_ltv_with_gaps(spark, folder):
    full = _gap_segments(spark, folder).withColumn("ltv_predicted", R.formula_ltv())
    return full.select(*S.CUSTOMERS_LTV_COLUMNS)


@query("customers_ltv", f"WITH {R.STORED_SQL} SELECT * EXCLUDE (k) FROM stored")
def customers_ltv(spark, folder):
    return R.valued(spark, folder).drop("k")


@query(
    "top_correlated_features",
    R.rounded_sql(
        f"WITH {R.FEATURED_SQL}, c AS ("
        + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, abs(corr({f}, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END)) AS size FROM featured"
            for f in S.ENGINEERED
        )
        + """) SELECT feature, size, CAST(row_number() OVER (ORDER BY size DESC, feature) AS INTEGER) AS rank FROM c
        ORDER BY size DESC, feature LIMIT 3""",
        "size",
    ),
    digits=6,
)
def top_correlated_features(spark, folder):
    table = reports.feature_corr(R.featured(spark, folder)).select("feature", F.abs("corr").alias("size"))
    return top_features(reports.ranked(table, "size"), 3, "size")
