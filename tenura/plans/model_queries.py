"""Training, explanation and scoring (survey groups I, J and K).

All learners have their own settings, the full ones. A model is trained on the whole training part of the tables in the given
folder when a query first needs it, once per session and folder.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.operators import encode, explain, models, reports, score
from tenura.operators import evaluate as V
from tenura.operators import split as P
from tenura.plans import registry as R
from tenura.plans.registry import query
from tenura.session import new_path
from tenura.sources import customers_csv
from tenura.sources.subscribers import customers
from tenura.sources.tables import TableStore
from tenura.streaming import scoring

KINDS = ["lr", "rf", "gbt"]


class Fits(Mapping):
    """Models by kind, each fitted when it is first asked for and then kept."""

    def __init__(self, fit):
        self._fit, self._done = fit, {}

    def __getitem__(self, kind: str):
        if kind not in KINDS:
            raise KeyError(kind)
        if kind not in self._done:
            self._done[kind] = self._fit(kind)
        return self._done[kind]

    def __iter__(self):
        return iter(KINDS)

    def __len__(self):
        return len(KINDS)


@dataclass(frozen=True)
class Trained:
    churn_rows: DataFrame
    ltv_rows: DataFrame
    churn: Mapping
    ltv: Mapping
    tenure_max: float

    def test_scores(self, kind: str) -> DataFrame:
        return models.churn_scores(self.churn[kind], self.churn_rows.where("is_test"))

    def test_values(self, kind: str) -> DataFrame:
        return models.ltv_values(self.ltv[kind], self.ltv_rows.where("is_test"))

    def bundle(self, churn: bool = True, ltv: bool = True) -> models.Bundle:
        """The models that scoring uses; one that is not wanted is not fitted."""
        return models.Bundle(self.churn["gbt"] if churn else None, self.ltv["gbt"] if ltv else None, self.tenure_max)


_ROWS: dict[tuple, tuple[DataFrame, DataFrame]] = {}
_TRAINED: dict[tuple, Trained] = {}


def training_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both training tables, written once to the shared folder: fitting reads them many times."""
    place = R.stamp(spark, folder)
    if place not in _ROWS:
        store = TableStore(spark, new_path(spark, "training"))
        store.write(customers(spark, folder), "customers")
        rows, hashed = store.read("customers"), P.integer_key_hash("k")
        store.write(models.churn_training_rows(rows, "k", hashed), "churn")
        store.write(models.ltv_training_rows(rows, "k", hashed), "ltv")
        _ROWS[place] = store.read("churn"), store.read("ltv")
    return _ROWS[place]


def trained(spark: SparkSession, folder: str) -> Trained:
    """The training tables with all six models, of which only those that are asked for are fitted."""
    place = R.stamp(spark, folder)
    if place not in _TRAINED:
        churn_rows, ltv_rows = training_rows(spark, folder)
        churn_train, ltv_train = models.weighted(churn_rows.where("not is_test")), ltv_rows.where("not is_test")
        _TRAINED[place] = Trained(
            churn_rows,
            ltv_rows,
            Fits(lambda kind: models.train_churn(kind, churn_train)),
            Fits(lambda kind: models.train_ltv(kind, ltv_train)),
            float(churn_rows.agg(F.max("tenure")).first()[0]),
        )
    return _TRAINED[place]


def bundle(spark: SparkSession, folder: str) -> models.Bundle:
    return trained(spark, folder).bundle()


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as scoring input: no label."""
    return customers(spark, folder).drop("churn")


# Training and evaluation


@query(
    "scaled_features",
    R.rounded_sql(
        f"""WITH {R.CUSTOMERS_SQL}, s AS (SELECT avg(tenure) AS mt, stddev_samp(tenure) AS st,
          avg(monthly_charges) AS mm, stddev_samp(monthly_charges) AS sm FROM customers
          WHERE {R.HASH_SQL} % 10 < 8)
        SELECT k, (tenure - mt) / st AS tenure_scaled, (monthly_charges - mm) / sm AS charges_scaled FROM customers, s""",
        "tenure_scaled charges_scaled",
        8,
    ),
    digits=8,
)
def scaled_features(spark, folder):
    """Standardised by mean and sample deviation of the training rows only."""
    rows = P.split(customers(spark, folder), P.integer_key_hash("k"))
    vectors = VectorAssembler(inputCols=["tenure", "monthly_charges"], outputCol="raw").transform(rows)
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    fitted = scaler.fit(vectors.where("not is_test"))
    values = vector_to_array("scaled")
    return fitted.transform(vectors).select(
        "k", values[0].alias("tenure_scaled"), values[1].alias("charges_scaled")
    )


@query("churn_model_metrics")
def churn_model_metrics(spark, folder):
    t = trained(spark, folder)
    return models.churn_metrics_table({models.NAMES[k]: t.test_scores(k) for k in t.churn})


@query("ltv_model_metrics")
def ltv_model_metrics(spark, folder):
    t = trained(spark, folder)
    return models.ltv_metrics_table({models.LTV_NAMES[k]: t.test_values(k) for k in t.ltv})


@query("stored_model_metrics")
def stored_model_metrics(spark, folder):
    """Both metric tables through the store, in long form."""
    store = TableStore(spark, new_path(spark, "metrics"))
    store.write(churn_model_metrics(spark, folder), "model_metrics")
    store.write(ltv_model_metrics(spark, folder), "ltv_model_metrics")
    tables = models.stored_metrics(store)
    return V.metrics_long(tables["model_metrics"]).unionByName(V.metrics_long(tables["ltv_model_metrics"]))


@query("best_churn_model")
def best_churn_model(spark, folder):
    return V.best_by(churn_model_metrics(spark, folder), "f1_score")


@query("churn_cross_validation")
def churn_cross_validation(spark, folder):
    """All three classifiers over five stratified folds."""
    return models.cv_churn(KINDS, training_rows(spark, folder)[0].where("not is_test"))


@query("ltv_cross_validation")
def ltv_cross_validation(spark, folder):
    """All three regressors over five folds."""
    return models.cv_ltv(KINDS, training_rows(spark, folder)[1].where("not is_test"))


@query("feature_importances")
def feature_importances(spark, folder):
    t = trained(spark, folder)
    tables = [
        models.importances(t.churn[k], S.CHURN_FEATURES).withColumn("model", F.lit(models.NAMES[k])) for k in ("rf", "gbt")
    ]
    return tables[0].unionByName(tables[1])


@query("top_importances")
def top_importances(spark, folder):
    return models.top_features(models.importances(trained(spark, folder).churn["gbt"], S.CHURN_FEATURES), 15)


@query("engineered_importances")
def engineered_importances(spark, folder):
    return models.engineered_only(feature_importances(spark, folder))


@query("model_predictions")
def model_predictions(spark, folder):
    return models.predictions_table(trained(spark, folder).test_scores("gbt"), "k")


@query("model_roc_curve")
def model_roc_curve(spark, folder):
    return V.roc_curve(trained(spark, folder).test_scores("gbt").select("label", "probability"), drop_between=True)


@query("customers_ltv_predicted")
def customers_ltv_predicted(spark, folder):
    return models.customers_ltv_predicted(trained(spark, folder).ltv["gbt"], R.featured(spark, folder))


# Explanation


_EXPLAINED: dict[tuple, DataFrame] = {}


def explained(spark: SparkSession, folder: str) -> DataFrame:
    """Attributions of every customer, computed once per session and folder, and stored."""
    place = R.stamp(spark, folder)
    if place not in _EXPLAINED:
        t = trained(spark, folder)
        store = TableStore(spark, new_path(spark, "explained"))
        store.write(explain.shap_values(t.churn["gbt"], t.churn_rows, ["k", "label"]), "shap")
        _EXPLAINED[place] = store.read("shap")
    return _EXPLAINED[place]


@query(
    "explained_sample",
    f"""WITH {R.CUSTOMERS_SQL} SELECT k, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS label FROM customers
    ORDER BY ({R.HASH_SQL} % 65536 * 40503 * 65537 + {R.HASH_SQL} // 65536 * 2246822519) % 4294967296, k LIMIT 1000""",
)
def explained_sample(spark, folder):
    rows = encode.with_label(customers(spark, folder)).withColumnRenamed("churn_binary", "label")
    return explain.explain_sample(rows, P.integer_key_hash("k"), "k").select("k", "label")


@query("shap_values")
def shap_values(spark, folder):
    """Attributions of every customer with the check that they add up to the model's log-odds."""
    total = F.aggregate("values", F.col("base_value"), lambda a, v: a + v)
    odds = F.log(F.col("probability") / (1 - F.col("probability")))
    return explained(spark, folder).select("k", "values", "base_value", (total - odds).alias("gap"))


@query("shap_importance")
def shap_importance(spark, folder):
    return explain.shap_importance(explained(spark, folder))


@query("top_shap_features")
def top_shap_features(spark, folder):
    table = explain.shap_importance(explained(spark, folder))
    return table.withColumn("mean_abs_shap", F.round("mean_abs_shap", 4)).orderBy("global_rank").limit(10)


@query("engineered_shap")
def engineered_shap(spark, folder):
    return models.engineered_only(explain.shap_importance(explained(spark, folder)))


@query("shap_customer_values")
def shap_customer_values(spark, folder):
    """Attributions of every customer."""
    return explain.shap_customer(explained(spark, folder), "k")


def _contribution_query(name: str, label: int, n: int):
    @query(name)
    def build(spark, folder):
        t = trained(spark, folder)
        scores = models.churn_scores(t.churn["gbt"], t.churn_rows)
        one = reports.extreme_customer(scores, label, "k").select(*t.churn_rows.columns)
        return explain.contributions(explain.shap_values(t.churn["gbt"], one, ["k", "label"]), n)


_contribution_query("riskiest_churner_contributions", 1, 12)
_contribution_query("safest_retained_contributions", 0, 12)


@query("shap_dependence")
def shap_dependence(spark, folder):
    """Pairs for the three engineered features that matter most."""
    rows = explained(spark, folder)
    ranked = models.engineered_only(explain.shap_importance(rows)).orderBy("global_rank").limit(3)
    top = [r["feature"] for r in ranked.collect()]  # three names
    return explain.dependence(rows, top, "k")


@query("shap_findings")
def shap_findings(spark, folder):
    return explain.findings(explain.shap_importance(explained(spark, folder)))


# Scoring


@query("score_churn")
def score_churn(spark, folder):
    return score.score_churn(arrivals(spark, folder), trained(spark, folder).bundle(ltv=False), "k")


@query("score_ltv")
def score_ltv(spark, folder):
    return score.score_ltv(arrivals(spark, folder), trained(spark, folder).bundle(churn=False), "k")


@query("score_customers")
def score_customers(spark, folder):
    return score.score(arrivals(spark, folder), bundle(spark, folder), "k")


@query("score_batch_file")
def score_batch_file(spark, folder):
    """Score a CSV that lacks several optional columns."""
    path = new_path(spark, "batch")
    customers_csv.export_csv(arrivals(spark, folder).drop("k", "gender", "streaming_tv"), path)
    return score.score_batch(spark, path, bundle(spark, folder), "customer_id")


@query("score_batch_summary")
def score_batch_summary(spark, folder):
    return score.summarize(score_customers(spark, folder))


@query("bundle_round_trip")
def bundle_round_trip(spark, folder):
    """Scores of a saved and reloaded bundle."""
    path = new_path(spark, "bundle")
    models.save_bundle(bundle(spark, folder), path)
    return score.score(arrivals(spark, folder), models.load_bundle(spark, path), "k")


def _arrived(spark: SparkSession, rows: DataFrame) -> str:
    path = new_path(spark, "arrivals")
    rows.write.parquet(path)
    return path


@query("score_stream")
def score_stream(spark, folder):
    """Customers arriving as files, scored by a stream that runs until all are processed."""
    source = _arrived(spark, arrivals(spark, folder).drop("k").select([f.name for f in S.batch_schema()]).to(S.batch_schema()))
    scored = scoring.score_stream(scoring.read_arrivals(spark, source), bundle(spark, folder))
    out = new_path(spark, "scored")
    scoring.write_stream(scored, out, new_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out)


@query("stream_decisions", f"WITH {R.DECIDED_SQL} SELECT * FROM decided")
def stream_decisions(spark, folder):
    """Decision columns added by a stream to rows that carry formula scores."""
    rows = R.valued_inputs(spark, folder)
    source = _arrived(spark, rows)
    out = new_path(spark, "decided")
    stream = score.decide(scoring.read_arrivals(spark, source, rows.schema), "p", "ltv")
    scoring.write_stream(stream, out, new_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select("k", *score.DECISION_COLUMNS)
