"""Queries that check by SQL what trained models alone cannot be checked by.

Operators behind the model queries are fed formula scores and formula attributions here, whose results SQL can state;
and what must hold for any trained model is counted over all customers.
"""

from pyspark.sql import functions as F

from tenura import schema as S
from tenura.operators import encode, explain, models, score
from tenura.plans import model_queries as M
from tenura.plans import registry as R
from tenura.plans.encoding_queries import _ENGINEERED, _MODEL_FLAGS
from tenura.plans.registry import query

_AUC = """SELECT sum(pos * (below + neg / CAST(2 AS DOUBLE))) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM (
    SELECT *, sum(neg) OVER (ORDER BY probability) - neg AS below FROM (SELECT probability,
      count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY probability))"""


@query(
    "churn_metrics_of_scores",
    f"""WITH {R.SCORED_SQL}, c AS (SELECT count(*) FILTER (WHERE label = 1 AND probability >= 0.5) AS tp,
      count(*) FILTER (WHERE label = 0 AND probability >= 0.5) AS fp,
      count(*) FILTER (WHERE label = 1 AND probability < 0.5) AS fn FROM scored), auc AS ({_AUC})
    SELECT 'Formula' AS model, round(tp / CAST(tp + fp AS DOUBLE), 4) AS "precision",
      round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 4) AS f1_score,
      round(auc, 4) AS roc_auc FROM c, auc""",
)
def churn_metrics_of_scores(spark, folder):
    return models.churn_metrics_table({"Formula": R.scored(spark, folder)})


@query(
    "ltv_metrics_of_values",
    f"""WITH {R.REGRESSED_SQL} SELECT 'Formula' AS model, round(avg(abs(actual - predicted)), 2) AS mae,
      round(sqrt(avg((actual - predicted) ** 2)), 2) AS rmse,
      round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 4) AS r2,
      round(avg(abs((actual - predicted) / (actual + 1))) * 100, 2) AS mape FROM regressed""",
)
def ltv_metrics_of_values(spark, folder):
    rows = R.regressed(spark, folder).select(F.col("actual").alias("label"), F.col("predicted").alias("ltv_raw"))
    return models.ltv_metrics_table({"Formula": rows})


@query(
    "predictions_of_scores",
    f"""WITH {R.FEATURED_SQL} SELECT k, {_ENGINEERED}, tenure, monthly_charges, total_charges, senior_citizen,
      {_MODEL_FLAGS}, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS actual_churn,
      CASE WHEN {R.PROBABILITY_SQL} >= 0.5 THEN 1 ELSE 0 END AS predicted_churn,
      round({R.PROBABILITY_SQL}, 4) AS churn_probability FROM featured""",
)
def predictions_of_scores(spark, folder):
    rows = encode.churn_matrix(encode.with_label(R.featured(spark, folder)), ["k", "contract", "churn_binary"])
    p = R.formula_probability()
    scored = rows.withColumns({"label": F.col("churn_binary"), "probability": p, "churn_class": F.when(p >= 0.5, 1.0).otherwise(0.0)})
    return models.predictions_table(scored, "k")


# Attributions from a formula: value i of customer k is ((k * (i + 3)) % 1000 - 500) * (i + 1) / 1000.

_NAMES = ", ".join(f"({i}, '{f}', {str(f in S.ENGINEERED).lower()})" for i, f in enumerate(S.CHURN_FEATURES))
_VALUES_SQL = f"""{R.FEATURED_SQL}, name AS (SELECT * FROM (VALUES {_NAMES}) AS t(i, feature, is_engineered)),
  attributed AS (SELECT k, i, feature, is_engineered, ((k * (i + 3)) % 1000 - 500) * (i + 1) / CAST(1000 AS DOUBLE) AS v
    FROM customers, name),
  mean AS (SELECT feature, is_engineered, avg(abs(v)) AS m FROM attributed GROUP BY ALL),
  importance AS (SELECT feature, round(m, 6) AS mean_abs_shap, is_engineered,
    CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS global_rank FROM mean)"""


def attributed(spark, folder):
    rows = encode.churn_matrix(encode.with_label(R.featured(spark, folder)), ["k", "contract", "churn_binary"])
    values = F.array(*[((F.col("k") * (i + 3)) % 1000 - 500) * (i + 1) / F.lit(1000.0) for i in range(len(S.CHURN_FEATURES))])
    return rows.withColumns(
        {"values": values, "base_value": F.lit(0.25), "probability": R.formula_probability(), "label": F.col("churn_binary")}
    )


@query("importance_of_attributions", f"WITH {_VALUES_SQL} SELECT * FROM importance")
def importance_of_attributions(spark, folder):
    return explain.shap_importance(attributed(spark, folder))


@query("engineered_attributions", f"WITH {_VALUES_SQL} SELECT * FROM importance WHERE is_engineered")
def engineered_attributions(spark, folder):
    return models.engineered_only(explain.shap_importance(attributed(spark, folder)))


@query(
    "top_attributions",
    f"WITH {_VALUES_SQL} SELECT * REPLACE (round(mean_abs_shap, 4) AS mean_abs_shap) FROM importance WHERE global_rank <= 10",
)
def top_attributions(spark, folder):
    table = explain.shap_importance(attributed(spark, folder))
    return models.top_features(table, 10, "mean_abs_shap").withColumn("mean_abs_shap", F.round("mean_abs_shap", 4))


@query(
    "findings_of_attributions",
    f"""WITH {_VALUES_SQL} SELECT (SELECT feature FROM importance WHERE global_rank = 1) AS top_driver,
      (SELECT min_by(feature, global_rank) FROM importance WHERE is_engineered) AS top_engineered,
      (SELECT count(*) FROM importance WHERE is_engineered AND global_rank <= 5) AS engineered_in_top5""",
)
def findings_of_attributions(spark, folder):
    return explain.findings(explain.shap_importance(attributed(spark, folder)))


_PIVOTED = ", ".join(f"max(v) FILTER (WHERE i = {i}) AS \"{f}\"" for i, f in enumerate(S.CHURN_FEATURES))


@query(
    "customer_attributions",
    f"""WITH {_VALUES_SQL}, wide AS (SELECT k, {_PIVOTED} FROM attributed GROUP BY k)
    SELECT wide.*, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS churn_actual,
      round({R.PROBABILITY_SQL.replace("(k %", "(wide.k %").replace("tenure", "featured.tenure").replace("contract =", "featured.contract =")}, 4) AS churn_probability
    FROM wide JOIN featured ON featured.k = wide.k""",
)
def customer_attributions(spark, folder):
    return explain.shap_customer(attributed(spark, folder), "k")


@query(
    "contributions_of_attributions",
    f"""WITH {_VALUES_SQL}, one AS (SELECT k, tenure, service_count FROM featured ORDER BY k DESC LIMIT 1)
    SELECT feature, v AS contribution, CAST(0.25 AS DOUBLE) AS base_value FROM attributed
    WHERE k = (SELECT k FROM one) ORDER BY abs(v) DESC, feature LIMIT 12""",
)
def contributions_of_attributions(spark, folder):
    one = attributed(spark, folder).orderBy(F.desc("k")).limit(1)
    return explain.contributions(one, 12).select("feature", "contribution", "base_value")


@query(
    "dependence_of_attributions",
    f"""WITH {_VALUES_SQL} SELECT a.k, a.feature,
      CASE a.feature WHEN 'tenure' THEN CAST(f.tenure AS DOUBLE) ELSE f.charge_to_value_ratio END AS feature_value, a.v AS shap
    FROM attributed AS a JOIN featured AS f ON a.k = f.k WHERE a.feature IN ('tenure', 'charge_to_value_ratio')""",
)
def dependence_of_attributions(spark, folder):
    return explain.dependence(attributed(spark, folder), ["tenure", "charge_to_value_ratio"], "k")


# What holds for any trained model, counted over all customers.

_NONE = f"WITH {R.CUSTOMERS_SQL} SELECT count(*) AS customers, CAST(0 AS BIGINT) AS wrong FROM customers"


def _counted(rows, wrong):
    return rows.agg(F.count("*").alias("customers"), F.count_if(wrong).alias("wrong"))


@query("attribution_gaps", _NONE)
def attribution_gaps(spark, folder):
    """Customers whose attributions do not add up to the model's log-odds."""
    return _counted(M.shap_values(spark, folder), F.abs("gap") > 1e-6)


@query("importance_order", f"WITH {R.CUSTOMERS_SQL} SELECT 29 AS features, CAST(0 AS BIGINT) AS wrong FROM customers LIMIT 1")
def importance_order(spark, folder):
    """Features whose rank does not follow from their own importance, over all customers of the trained model."""
    table = explain.shap_importance(M.explained(spark, folder))
    better = table.select(F.col("mean_abs_shap").alias("m"), F.col("global_rank").alias("r"))
    worse = F.expr("exists(all, o -> o.m > mean_abs_shap and o.r > global_rank)")
    both = table.withColumn("all", better.agg(F.collect_list(F.struct("m", "r"))).scalar())
    return both.agg(F.count("*").cast("int").alias("features"), F.count_if(worse).alias("wrong"))


def _differences(a, b, key):
    columns = [c for c in a.columns if c != key]
    other = b.select(key, *[F.col(c).alias(f"{c}_2") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_2"))
    return _counted(a.join(other, key, "full"), ~same)


@query("bundle_differences", _NONE)
def bundle_differences(spark, folder):
    """Customers whom a saved and reloaded bundle scores differently."""
    return _differences(M.score_customers(spark, folder), M.bundle_round_trip(spark, folder), "k")


@query("stream_differences", _NONE)
def stream_differences(spark, folder):
    """Customers whom the stream scores differently from the batch."""
    rows = M.arrivals(spark, folder).drop("k").select([f.name for f in S.batch_schema()]).to(S.batch_schema())
    batch = score.score(rows, M.bundle(spark, folder), "customer_id")
    return _differences(batch, M.score_stream(spark, folder), "customer_id")


@query("single_score_differences", _NONE)
def single_score_differences(spark, folder):
    """Customers for whom churn and value, scored apart, differ from the joint score."""
    apart = M.score_churn(spark, folder).join(M.score_ltv(spark, folder), "k")
    joint = M.score_customers(spark, folder).select(*apart.columns)
    return _differences(joint, apart, "k")


@query("batch_file_differences", _NONE)
def batch_file_differences(spark, folder):
    """Customers whom a CSV file scores differently from the table it was written from."""
    rows = M.arrivals(spark, folder).drop("k", "gender", "streaming_tv")
    direct = score.score(rows, M.bundle(spark, folder), "customer_id")
    return _differences(direct, M.score_batch_file(spark, folder), "customer_id")


@query(
    "predictions_per_label",
    f"""WITH {R.CUSTOMERS_SQL}, hashed AS (SELECT churn, count(*) OVER (PARTITION BY churn) AS n,
      row_number() OVER (PARTITION BY churn ORDER BY {R.HASH_SQL}) - 1 AS i FROM customers)
    SELECT CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS actual_churn, count(*) AS rows, CAST(0 AS BIGINT) AS wrong
    FROM hashed WHERE i <= floor(CAST(0.2 AS DOUBLE) * (n - 1)) GROUP BY churn""",
)
def predictions_per_label(spark, folder):
    """Test rows per true label, and those whose class does not follow from their probability."""
    rows = M.model_predictions(spark, folder)
    clear = F.abs(F.col("churn_probability") - 0.5) > 1e-4
    wrong = clear & ((F.col("churn_probability") > 0.5) != (F.col("predicted_churn") == 1))
    return rows.groupBy("actual_churn").agg(F.count("*").alias("rows"), F.count_if(wrong).alias("wrong"))


@query(
    "stored_metrics_complete",
    f"""WITH {R.CUSTOMERS_SQL} SELECT model, CAST(n AS BIGINT) AS metrics, CAST(0 AS BIGINT) AS out_of_range FROM (
      VALUES ('Logistic Regression', 4), ('Random Forest', 8), ('Gradient Boosting', 8), ('Linear Regression', 4)) AS t(model, n)
    WHERE (SELECT count(*) FROM customers) > 0""",
)
def stored_metrics_complete(spark, folder):
    """Metrics of the six trained models through the store, and those outside their range."""
    rows = M.stored_model_metrics(spark, folder)
    share = F.col("metric").isin("precision", "recall", "f1_score", "roc_auc")
    out = F.col("score").isNull() | (share & ~F.col("score").between(0, 1)) | (~share & (F.col("metric") != "r2") & (F.col("score") < 0))
    return rows.groupBy("model").agg(F.count("*").alias("metrics"), F.count_if(out).alias("out_of_range"))


@query(
    "importances_complete",
    f"""WITH {R.CUSTOMERS_SQL} SELECT model, CAST(29 AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total,
      CAST(5 AS BIGINT) AS engineered FROM (VALUES ('Random Forest'), ('Gradient Boosting')) AS t(model)
    WHERE (SELECT count(*) FROM customers) > 0""",
)
def importances_complete(spark, folder):
    rows = M.feature_importances(spark, folder)
    return rows.groupBy("model").agg(
        F.count("*").alias("features"),
        F.round(F.sum("importance"), 9).alias("total"),
        F.count_if("is_engineered").alias("engineered"),
    )


@query(
    "scored_rows_in_range",
    f"""WITH {R.CUSTOMERS_SQL} SELECT count(*) AS customers, CAST(0 AS BIGINT) AS wrong FROM customers""",
)
def scored_rows_in_range(spark, folder):
    """Scored customers whose labels, floor or revenue at risk do not follow from probability and value."""
    rows = M.score_customers(spark, folder)
    p, v = F.col("churn_probability"), F.col("ltv_predicted")
    risk = F.abs(F.col("revenue_at_risk") - p * v) > 0.01 + 1e-4 * v
    edge = F.abs(p * 4 - F.round(p * 4)) <= 4e-4
    label = F.when(p < 0.25, "Low").when(p < 0.5, "Medium").when(p < 0.75, "High").otherwise("Critical")
    wrong = ~p.between(0, 1) | (v < 0) | risk | (~edge & (label != F.col("churn_risk_label")))
    return _counted(rows, wrong)


@query(
    "confusion_of_models",
    f"""WITH {R.CUSTOMERS_SQL}, hashed AS (SELECT churn, count(*) OVER (PARTITION BY churn) AS n,
      row_number() OVER (PARTITION BY churn ORDER BY {R.HASH_SQL}) - 1 AS i FROM customers)
    SELECT model, count(*) AS rows, count(*) FILTER (WHERE churn = 'Yes') AS churned FROM hashed,
      (VALUES ('Logistic Regression'), ('Random Forest'), ('Gradient Boosting')) AS t(model)
    WHERE i <= floor(CAST(0.2 AS DOUBLE) * (n - 1)) GROUP BY model""",
)
def confusion_of_models(spark, folder):
    """Rows and churned rows in the confusion matrix of every trained classifier."""
    t, parts = M.trained(spark, folder), []
    for kind in t.churn:
        table = M.V.confusion(t.test_scores(kind)).withColumn("model", F.lit(models.NAMES[kind]))
        parts.append(
            table.groupBy("model").agg(
                F.sum("rows").alias("rows"), F.sum(F.when(F.col("label") == 1, F.col("rows")).otherwise(0)).alias("churned")
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Reports of each trained classifier.


def _model_report(name, build):
    @query(name)
    def run(spark, folder):
        t = M.trained(spark, folder)
        parts = [build(t.test_scores(k)).withColumn("model", F.lit(models.NAMES[k])) for k in t.churn]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])


_model_report("model_confusion_matrices", lambda rows: M.V.confusion(rows))
_model_report("model_classification_reports", lambda rows: M.V.cls_report(rows))
_model_report("model_roc_curves", lambda rows: M.V.roc_curve(rows.select("label", "probability"), bins=1000))


@query("top_importances_of_models")
def top_importances_of_models(spark, folder):
    """The fifteen most important features of the forest and of the boosted model."""
    t = M.trained(spark, folder)
    parts = [
        models.top_features(models.importances(t.churn[k], S.CHURN_FEATURES), 15).withColumn("model", F.lit(models.NAMES[k]))
        for k in ("rf", "gbt")
    ]
    return parts[0].unionByName(parts[1])
