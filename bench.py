"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query is run twice to completion
in one session: the first run counts as cold, the second as warm. `value` is the sum of the warm runs.
Apart from the queries stand the times to fit the two boosted models, with their full settings, to attribute all customers, and to
build the stored value table; queries then read what these made.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from tenura.plans import model_queries, registry
from tenura.plans.catalog import QUERIES
from tenura.session import build_session

HEADLINE = [
    "churn_by_contract",
    "churn_distribution",
    "churn_by_tenure_band",
    "crosstab_contract",
    "crosstab_service_count",
    "baseline_kpis",
    "eda_summary",
    "correlation_matrix",
    "feature_correlation",
    "feature_summary",
    "describe_monthly_charges",
    "box_charge_per_tenure",
    "histogram_monthly_charges",
    "density_tenure",
    "missing_values",
    "duplicate_rows",
    "customers_processed",
    "customers_features",
    "churn_feature_matrix",
    "customers_ltv",
    "revenue_at_risk",
    "business_summary",
    "high_risk_premium_customers",
    "customer_lookup",
    "stratified_split",
    "roc_auc",
    "regression_metrics",
    "score_customers",
    "shap_importance",
]


def time_of(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        app="bench",
        master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")

    start = time.perf_counter()
    registry.stored(spark, folder)
    stored = time.perf_counter() - start
    start = time.perf_counter()
    fits = model_queries.trained(spark, folder)
    fitted = {f"{name}_gbt": time_of(lambda own=own: own["gbt"]) for name, own in (("churn", fits.churn), ("ltv", fits.ltv))}
    training = time.perf_counter() - start
    explaining = time_of(lambda: model_queries.explained(spark, folder))

    cold, warm = {}, {}
    for times in (cold, warm):
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "cold_total": round(sum(cold.values()), 3),
        "stored_table_sec": round(stored, 3),
        "training_sec": round(training, 3),
        "fits_sec": fitted,
        "explaining_sec": explaining,
        "sf": os.path.basename(folder.rstrip("/")),
        "cpus": int(cpus),
        "shuffle_partitions": int(cpus),
    }
    spark.stop()
    sys.stdout.write(json.dumps(line) + "\n")


if __name__ == "__main__":
    main()
