"""The whole way from a raw CSV to the nine stored tables, and reports over them."""

from tenura import schema as S
from tenura.operators import models, reports, score
from tenura.plans.build import build_all
from tenura.sources.customers_csv import write_customers_csv
from tenura.sources.subscribers import customers
from tenura.sources.tables import TableStore


def test_all_tables_from_a_csv(spark, folder, tmp_path):
    csv, root = str(tmp_path / "raw"), str(tmp_path / "tables")
    write_customers_csv(customers(spark, folder), csv)
    churn = {"rf": {"numTrees": 5, "maxDepth": 4}, "gbt": {"maxIter": 4, "maxDepth": 3}}
    ltv = {"lr": {}, "gbt": {"maxIter": 5, "maxDepth": 4, "stepSize": 0.4}}
    build_all(spark, csv, root, churn, ltv, explained_rows=200)

    store = TableStore(spark, root)
    sizes = {
        "customers": 1500,
        "customers_processed": 1500,
        "customers_features": 1500,
        "customers_ltv": 1500,
        "model_metrics": 2,
        "ltv_model_metrics": 2,
        "shap_feature_importance": 29,
        "shap_customer_values": 200,
    }
    assert {n: store.read(n).count() for n in sizes} == sizes
    assert 290 <= store.read("model_predictions").count() <= 310
    assert store.read("customers_ltv").columns == S.CUSTOMERS_LTV_COLUMNS
    assert all(not isinstance(t, str) for t in models.stored_metrics(store).values())

    stored = store.read("customers_ltv")
    summary = reports.business_summary(stored).first()
    assert summary["total_customers"] == 1500
    assert sum(summary[f"{s.lower()}_customers"] for s in S.LTV_SEGMENTS) == 1500
    assert reports.high_risk_premium(stored).count() == 20
    bundle = models.load_bundle(spark, store.path("bundle"))
    assert bundle.tenure_max == 72.0
    assert score.score(store.read("customers").drop("churn"), bundle, "customer_id").count() == 1500
