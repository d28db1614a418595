"""From the raw customer export to all nine stored tables and a model bundle.

Every step reads the table the step before it wrote, so no step carries a long lineage and a rerun can start
from any stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.operators import encode, evaluate, explain, models, split
from tenura.sources.customers_csv import read_customers_csv
from tenura.sources.tables import TableStore, reconcile

Settings = dict[str, dict]


def build_all(
    spark: SparkSession,
    csv_path: str,
    root: str,
    churn_settings: Settings | None = None,
    ltv_settings: Settings | None = None,
    explained_rows: int | None = None,
) -> models.Bundle:
    """Build every table below `root` and save the models in `root/bundle`: the boosted ones, or else the first given.

    Attributions need the boosted classifier; without it their two tables are not written.

    All customers are explained; `explained_rows` limits the per-customer table to a repeatable sample of that size,
    while the global importance always rests on all of them.
    """
    store = TableStore(spark, root)
    prepare_tables(store, csv_path)
    churn = build_churn_tables(store, churn_settings or {k: {} for k in models.KINDS})
    ltv = build_ltv_tables(store, ltv_settings or {k: {} for k in models.KINDS})
    shown = "gbt" if "gbt" in churn else next(iter(churn))
    if shown == "gbt":
        build_explanations(store, churn[shown], explained_rows)
    tenure_max = store.read("customers").agg(F.max("tenure")).first()[0]
    valued = "gbt" if "gbt" in ltv else next(iter(ltv))
    bundle = models.Bundle(churn[shown], ltv[valued], float(tenure_max))
    models.save_bundle(bundle, store.path("bundle"))
    return bundle


def prepare_tables(store: TableStore, csv_path: str) -> None:
    """customers, customers_processed and customers_features, each reconciled with its source."""
    _write(store, read_customers_csv(store.spark, csv_path), "customers")
    customers = store.read("customers")
    _write(store, encode.processed(customers), "customers_processed", customers)
    _write(store, encode.features(customers), "customers_features", customers)


def build_churn_tables(store: TableStore, settings: Settings) -> dict:
    """Train the classifiers; write model_metrics, and model_predictions of the best by F1."""
    hashed = split.key_hash(S.KEY)
    store.write(models.churn_training_rows(store.read("customers"), S.KEY, hashed), "churn_training")
    rows = store.read("churn_training")
    train = models.weighted(rows.where("not is_test")).persist()
    fitted = {k: models.train_churn(k, train, **v) for k, v in settings.items()}
    train.unpersist()
    scored = {k: models.churn_scores(m, rows.where("is_test")) for k, m in fitted.items()}
    store.write(models.churn_metrics_table({models.NAMES[k]: s for k, s in scored.items()}), "model_metrics")
    best = evaluate.best_by(store.read("model_metrics"), "f1_score").first()["model"]
    store.write(models.predictions_table(_named(scored, models.NAMES, best), S.KEY), "model_predictions")
    return fitted


def build_ltv_tables(store: TableStore, settings: Settings) -> dict:
    """Train the regressors; write ltv_model_metrics, and customers_ltv with the best by R2."""
    hashed = split.key_hash(S.KEY)
    store.write(models.ltv_training_rows(store.read("customers"), S.KEY, hashed), "ltv_training")
    rows = store.read("ltv_training")
    train = rows.where("not is_test").persist()
    fitted = {k: models.train_ltv(k, train, **v) for k, v in settings.items()}
    train.unpersist()
    predicted = {models.LTV_NAMES[k]: models.ltv_values(m, rows.where("is_test")) for k, m in fitted.items()}
    store.write(models.ltv_metrics_table(predicted), "ltv_model_metrics")
    best = evaluate.best_by(store.read("ltv_model_metrics"), "r2").first()["model"]
    featured = store.read("customers_features")
    valued = models.customers_ltv_predicted(_named(fitted, models.LTV_NAMES, best), featured)
    _write(store, valued, "customers_ltv", featured, lookup_by=[S.KEY])
    return fitted


def build_explanations(store: TableStore, model, explained_rows: int | None) -> None:
    """shap_feature_importance and shap_customer_values."""
    store.write(explain.shap_values(model, store.read("churn_training"), [S.KEY, "label"]), "shap_explained")
    explained = store.read("shap_explained")
    store.write(explain.shap_importance(explained), "shap_feature_importance")
    if explained_rows is not None:
        explained = explain.explain_sample(explained, split.key_hash(S.KEY), S.KEY, explained_rows)
    store.write(explain.shap_customer(explained, S.KEY), "shap_customer_values")


def _write(
    store: TableStore, df: DataFrame, name: str, source: DataFrame | None = None, lookup_by: list[str] | None = None
) -> None:
    store.write(df, name, lookup_by)
    if source is not None:
        counts = reconcile(store.read(name), source).first()
        if not counts["matches"]:
            raise RuntimeError(f"{name}: wrote {counts['rows_written']} of {counts['rows_source']} rows")


def _named(values: dict, names: dict[str, str], name: str):
    return next(v for k, v in values.items() if names[k] == name)
