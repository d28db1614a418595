"""Splits, weights and metrics on formula scores (the model-free part of survey group I)."""

from pyspark.sql import functions as F

from tenura.operators import distributions as D
from tenura.operators import evaluate as V
from tenura.operators import split as P
from tenura.plans import registry as R
from tenura.plans.distribution_queries import histogram_sql
from tenura.plans.registry import query
from tenura.sources.subscribers import customers


@query(
    "stratified_split",
    f"""WITH {R.CUSTOMERS_SQL}, hashed AS (SELECT k, churn, {R.HASH_SQL} AS h,
      count(*) OVER (PARTITION BY churn) AS n, row_number() OVER (PARTITION BY churn ORDER BY {R.HASH_SQL}) - 1 AS i
      FROM customers)
    SELECT k, churn, i <= floor(CAST(0.2 AS DOUBLE) * (n - 1)) AS is_test FROM hashed""",
)
def stratified_split(spark, folder):
    rows = customers(spark, folder)
    return P.stratified_split(rows, P.integer_key_hash("k")).select("k", "churn", "is_test")


@query(
    "split_with_missing_labels",
    f"""WITH {R.CUSTOMERS_SQL}, partly AS (SELECT k, CASE WHEN k % 7 <> 0 THEN churn END AS churn FROM customers),
      hashed AS (SELECT k, churn, {R.HASH_SQL} AS h, count(*) OVER (PARTITION BY churn) AS n,
        row_number() OVER (PARTITION BY churn ORDER BY {R.HASH_SQL}) - 1 AS i FROM partly)
    SELECT k, churn, churn IS NOT NULL AND i <= floor(CAST(0.2 AS DOUBLE) * (n - 1)) AS is_test FROM hashed""",
)
def split_with_missing_labels(spark, folder):
    """Customers without a label stay, as train rows."""
    rows = customers(spark, folder).withColumn("churn", F.when(F.col("k") % 7 != 0, F.col("churn")))
    return P.stratified_split(rows, P.integer_key_hash("k")).select("k", "churn", "is_test")


@query(
    "stratified_fold_numbers",
    f"""WITH {R.CUSTOMERS_SQL}, hashed AS (SELECT k, churn, count(*) OVER (PARTITION BY churn) AS n,
        row_number() OVER (PARTITION BY churn ORDER BY {R.HASH_SQL}) - 1 AS i FROM customers)
    SELECT k, churn, CAST({" + ".join(f"CASE WHEN i > floor(CAST({j / 5} AS DOUBLE) * (n - 1)) THEN 1 ELSE 0 END" for j in range(1, 5))}
      AS INTEGER) AS fold FROM hashed""",
)
def stratified_fold_numbers(spark, folder):
    return P.stratified_folds(customers(spark, folder), P.integer_key_hash("k")).select("k", "churn", "fold")


@query(
    "stratified_fold_balance",
    f"""WITH {R.CUSTOMERS_SQL} SELECT churn, CAST(count(*) AS BIGINT) AS customers,
    CAST(5 AS BIGINT) AS folds, true AS balanced FROM customers GROUP BY churn""",
)
def stratified_fold_balance(spark, folder):
    """Whether the folds of each class differ by two rows at most."""
    rows = P.stratified_folds(customers(spark, folder), P.integer_key_hash("k")).groupBy("churn", "fold").count()
    spread = F.max("count") - F.min("count") <= 2
    return rows.groupBy("churn").agg(F.sum("count").alias("customers"), F.count("*").alias("folds"), spread.alias("balanced"))


@query("plain_split", f"WITH {R.CUSTOMERS_SQL} SELECT k, {R.HASH_SQL} % 10 >= 8 AS is_test FROM customers")
def plain_split(spark, folder):
    return P.split(customers(spark, folder), P.integer_key_hash("k")).select("k", "is_test")


@query("fold_numbers", f"WITH {R.CUSTOMERS_SQL} SELECT k, CAST({R.HASH_SQL} // 10 % 5 AS INTEGER) AS fold FROM customers")
def fold_numbers(spark, folder):
    return P.folds(customers(spark, folder), P.integer_key_hash("k")).select("k", "fold")


_COUNTS = f"""{R.SCORED_SQL}, counted AS (SELECT count(*) FILTER (WHERE label = 1) AS positives,
    count(*) FILTER (WHERE label = 0) AS negatives FROM scored)"""


@query(
    "class_weights",
    R.rounded_sql(
        f"""WITH {_COUNTS} SELECT positives, negatives,
        (positives + negatives) / CAST(2 * negatives AS DOUBLE) AS weight_negative,
        (positives + negatives) / CAST(2 * positives AS DOUBLE) AS weight_positive,
        negatives / CAST(positives AS DOUBLE) AS positive_weight FROM counted""",
        "weight_negative weight_positive positive_weight",
        9,
    ),
    digits=9,
)
def class_weights(spark, folder):
    return P.class_weights(R.scored(spark, folder), "label")


@query(
    "weighted_rows",
    R.rounded_sql(
        f"""WITH {_COUNTS} SELECT k, label,
        (positives + negatives) / CAST(2 * CASE WHEN label = 1 THEN positives ELSE negatives END AS DOUBLE) AS balanced,
        CASE WHEN label = 1 THEN negatives / CAST(positives AS DOUBLE) ELSE 1 END AS boosted FROM scored, counted""",
        "balanced boosted",
        9,
    ),
    digits=9,
)
def weighted_rows(spark, folder):
    rows = R.scored(spark, folder).select("k", "label")
    return P.pos_weight(P.balanced_weight(rows, name="balanced"), name="boosted")


_CELLS = """SELECT count(*) FILTER (WHERE label = 1 AND probability >= t) AS tp,
    count(*) FILTER (WHERE label = 0 AND probability >= t) AS fp,
    count(*) FILTER (WHERE label = 1 AND probability < t) AS fn,
    count(*) FILTER (WHERE label = 0 AND probability < t) AS tn FROM scored, (SELECT CAST(0.5 AS DOUBLE) AS t) AS c"""


@query(
    "classification_metrics",
    R.rounded_sql(
        f"""WITH {R.SCORED_SQL}, c AS ({_CELLS}) SELECT tp / CAST(tp + fp AS DOUBLE) AS "precision",
        tp / CAST(tp + fn AS DOUBLE) AS recall, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1 FROM c""",
        "precision recall f1",
        9,
    ),
    digits=9,
)
def classification_metrics(spark, folder):
    return V.cls_metrics(R.scored(spark, folder))


@query(
    "roc_auc",
    R.rounded_sql(
        f"""WITH {R.SCORED_SQL}, g AS (SELECT probability, count(*) FILTER (WHERE label = 1) AS pos,
          count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY probability),
        c AS (SELECT *, sum(neg) OVER (ORDER BY probability) - neg AS below FROM g)
        SELECT sum(pos * (below + neg / CAST(2 AS DOUBLE))) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc,
        CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM c""",
        "roc_auc",
        9,
    ),
    digits=9,
)
def roc_auc(spark, folder):
    return V.roc_auc(R.scored(spark, folder))


@query(
    "confusion_matrix",
    f"""WITH {R.SCORED_SQL} SELECT label, CASE WHEN probability >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS predicted,
    count(*) AS rows FROM scored GROUP BY ALL""",
)
def confusion_matrix(spark, folder):
    return V.confusion(R.scored(spark, folder))


@query(
    "classification_report",
    R.rounded_sql(
        f"""WITH {R.SCORED_SQL}, c AS ({_CELLS}), line AS (
          SELECT 'Not Churned' AS class, tn / CAST(tn + fn AS DOUBLE) AS p, tn / CAST(tn + fp AS DOUBLE) AS r,
            2 * tn / CAST(2 * tn + fn + fp AS DOUBLE) AS f, tn + fp AS s FROM c
          UNION ALL SELECT 'Churned', tp / CAST(tp + fp AS DOUBLE), tp / CAST(tp + fn AS DOUBLE),
            2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), tp + fn FROM c),
        accuracy AS (SELECT (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS a, tp + tn + fp + fn AS n FROM c)
        SELECT class, p AS "precision", r AS recall, f AS f1, s AS support FROM line
        UNION ALL SELECT 'accuracy', a, a, a, n FROM accuracy
        UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(s) AS BIGINT) FROM line
        UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s),
          CAST(sum(s) AS BIGINT) FROM line""",
        "precision recall f1",
        9,
    ),
    digits=9,
)
def classification_report(spark, folder):
    return V.cls_report(R.scored(spark, folder))


def _curve_sql(score: str) -> str:
    return R.rounded_sql(
        f"""WITH {R.SCORED_SQL}, g AS (SELECT {score} AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
          count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY 1)
        SELECT threshold, sum(neg) OVER w / CAST(sum(neg) OVER () AS DOUBLE) AS fpr,
          sum(pos) OVER w / CAST(sum(pos) OVER () AS DOUBLE) AS tpr FROM g WINDOW w AS (ORDER BY threshold DESC)
        UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0, 0""",
        "fpr tpr",
        9,
    )


def _rates(curve):
    return curve.withColumns({c: F.round(c, 9) for c in ("fpr", "tpr")})


@query("roc_curve", _curve_sql("probability"))
def roc_curve(spark, folder):
    return _rates(V.roc_curve(R.scored(spark, folder)))


@query(
    "roc_curve_corners",
    R.rounded_sql(
        f"""WITH {R.SCORED_SQL}, g AS (SELECT probability AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
          count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY 1),
        c AS (SELECT threshold, sum(neg) OVER w / CAST(sum(neg) OVER () AS DOUBLE) AS fpr, sum(pos) OVER w / CAST(sum(pos) OVER () AS DOUBLE) AS tpr,
          row_number() OVER w AS i, lead(pos) OVER w AS below_pos, lead(neg) OVER w AS below_neg, pos, neg FROM g WINDOW w AS (ORDER BY threshold DESC))
        SELECT threshold, fpr, tpr FROM c WHERE i = 1 OR below_pos IS NULL OR below_pos <> pos OR below_neg <> neg
        UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0, 0""",
        "fpr tpr",
        9,
    ),
)
def roc_curve_corners(spark, folder):
    """The curve without the points between equal steps."""
    return _rates(V.roc_curve(R.scored(spark, folder), drop_between=True))


@query("roc_curve_binned", _curve_sql("least(floor(probability * 100), 99) / CAST(100 AS DOUBLE)"))
def roc_curve_binned(spark, folder):
    return _rates(V.roc_curve(R.scored(spark, folder), bins=100))


_REG = """SELECT avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
    1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) AS r2,
    avg(abs((actual - predicted) / (actual + 1))) * 100 AS mape FROM regressed"""


@query(
    "regression_metrics",
    R.rounded_sql(f"WITH {R.REGRESSED_SQL} {_REG}", "mae rmse r2 mape"),
    digits=6,
)
def regression_metrics(spark, folder):
    return V.reg_metrics(R.regressed(spark, folder))


@query(
    "residuals",
    R.rounded_sql(
        f"WITH {R.REGRESSED_SQL} SELECT k, actual, predicted, actual - predicted AS residual FROM regressed",
        "actual predicted residual",
    ),
    digits=6,
)
def residuals(spark, folder):
    return V.residuals(R.regressed(spark, folder))


_RESIDUAL = f"{R.REGRESSED_SQL}, r0 AS (SELECT 0 AS one, actual - predicted AS residual FROM regressed)"


@query(
    "histogram_residuals",
    f"SELECT * EXCLUDE (one) FROM ({histogram_sql(_RESIDUAL, 'r0', 'residual', 50, 'one')}) AS h",
    digits=6,
)
def histogram_residuals(spark, folder):
    return D.histogram(V.residuals(R.regressed(spark, folder)), "residual", 50)


@query("histogram_probability", histogram_sql(R.SCORED_SQL, "scored", "probability", 30, "label"), digits=6)
def histogram_probability(spark, folder):
    return D.histogram(R.scored(spark, folder), "probability", 30, "label")


@query(
    "metrics_long",
    R.rounded_sql(
        f"""WITH {R.REGRESSED_SQL}, m AS ({_REG}) SELECT 'formula' AS model, 'mae' AS metric, mae AS score FROM m
        UNION ALL SELECT 'formula', 'rmse', rmse FROM m UNION ALL SELECT 'formula', 'r2', r2 FROM m
        UNION ALL SELECT 'formula', 'mape', mape FROM m""",
        "score",
    ),
    digits=6,
)
def metrics_long(spark, folder):
    metrics = V.reg_metrics(R.regressed(spark, folder)).select(F.lit("formula").alias("model"), "*")
    return V.metrics_long(metrics)


def _two_models(spark, folder):
    """Two formula predictions of the same target, evaluated side by side."""
    rows = R.regressed(spark, folder)
    flat = rows.withColumn("predicted", F.floor("actual").cast("double"))
    named = [(m, V.reg_metrics(r)) for m, r in (("formula", rows), ("floor", flat))]
    tables = [t.select(F.lit(m).alias("model"), "*") for m, t in named]
    return tables[0].unionByName(tables[1])


@query(
    "best_model",
    R.rounded_sql(
        f"""WITH {R.REGRESSED_SQL}, floored AS (SELECT k, actual, floor(actual) AS predicted FROM regressed),
        m AS (SELECT 'formula' AS model, * FROM ({_REG}) AS a
          UNION ALL SELECT 'floor', * FROM ({_REG.replace("FROM regressed", "FROM floored")}) AS b)
        SELECT * FROM m ORDER BY r2 DESC, model LIMIT 1""",
        "mae rmse r2 mape",
    ),
    digits=6,
)
def best_model(spark, folder):
    return V.best_by(_two_models(spark, folder), "r2")
