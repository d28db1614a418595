"""Churn classifiers and lifetime-value regressors as ML pipelines, with the full settings as defaults."""

from __future__ import annotations

import hashlib
import json
import warnings
from dataclasses import dataclass
from statistics import fmean, pstdev

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.functions.bins import floored
from tenura.operators import encode, evaluate, split, trees
from tenura.operators.ltv import capped_and_segmented, ltv_target
from tenura.operators.trees import TreeModel
from tenura.session import enable_checkpoints, new_path
from tenura.sources.tables import TableStore

SEED = 42
NAMES = {"lr": "Logistic Regression", "rf": "Random Forest", "gbt": "Gradient Boosting"}
LTV_NAMES = {"lr": "Linear Regression", "rf": "Random Forest", "gbt": "Gradient Boosting"}

# Default settings of the six learners. `weightCol` names the column that balances the classes; trees balance them alike.
CHURN_SETTINGS = {
    "lr": {"maxIter": 1000, "elasticNetParam": 0.0, "standardization": False, "weightCol": "balanced"},
    "rf": {
        "numTrees": 200,
        "maxDepth": 10,
        "minSamplesSplit": 5,
        "minInstancesPerNode": 2,
        "featureSubsetStrategy": "sqrt",
        "seed": SEED,
    },
    "gbt": {
        "maxIter": 200,
        "maxDepth": 5,
        "stepSize": 0.1,
        "subsamplingRate": 0.8,
        "colsampleByTree": 0.8,
        "minChildWeight": 1.0,
        "regAlpha": 0.0,
        "regLambda": 1.0,
        "seed": SEED,
    },
}
LTV_SETTINGS = {
    "lr": {"regParam": 0.0},
    "rf": {
        "numTrees": 200,
        "maxDepth": 12,
        "minSamplesSplit": 5,
        "minInstancesPerNode": 2,
        "featureSubsetStrategy": "all",
        "seed": SEED,
    },
    "gbt": {
        "maxIter": 300,
        "maxDepth": 6,
        "stepSize": 0.05,
        "subsamplingRate": 0.8,
        "colsampleByTree": 0.8,
        "minChildWeight": 3.0,
        "regAlpha": 0.1,
        "regLambda": 1.0,
        "seed": SEED,
    },
}
KINDS = ("lr", "rf", "gbt")
Model = PipelineModel | TreeModel


@dataclass(frozen=True)
class Bundle:
    """Both models with what scoring needs to rebuild their inputs; a missing model is None."""

    churn: Model | None
    ltv: Model | None
    tenure_max: float = S.MAX_TENURE


def churn_training_rows(customers: DataFrame, key: str, hashed) -> DataFrame:
    """Key, label, the 29 features, `is_test` and `fold` of every customer, spread evenly by key.

    Classes have equal shares in the test rows, and in every fold of the others.
    Fitting reads these rows many times, so the one shuffle that evens them out pays for itself.
    """
    rows = encode.churn_matrix(
        encode.with_label(encode.features(customers)).withColumnRenamed("churn_binary", "label"),
        list(dict.fromkeys([key, "churn", "label"])),
    )
    rows = rows.withColumn("label", F.when(F.col("churn").isNotNull(), F.col("label")))
    # Cuts are searched in several passes over the rows: both steps read what the one before has stored.
    marked = _stored(split.stratified_split(_stored(rows), hashed, "churn"))
    part = F.concat_ws(" ", F.coalesce("churn", F.lit("?")), F.col("is_test").cast("string"))
    folded = split.stratified_folds(marked.withColumn("_part", part), split.remixed(hashed), strata="_part")
    return folded.drop("churn", "_part").repartition(key)


def _stored(rows: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder."""
    path = new_path(rows.sparkSession, "step")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ltv_training_rows(customers: DataFrame, key: str, hashed) -> DataFrame:
    """Key, target, the 28 features, `is_test` and `fold` of every customer."""
    valued = capped_and_segmented(ltv_target(encode.features(customers)))
    rows = encode.ltv_matrix(valued, [key, "ltv_projected"]).withColumnRenamed("ltv_projected", "label")
    return split.split(split.folds(rows, hashed), hashed).repartition(key)


def weighted(train: DataFrame) -> DataFrame:
    """Both class weightings, taken from the training rows."""
    return split.pos_weight(split.balanced_weight(train, name="balanced"), name="boosted")


def churn_pipeline(rows: int | None = None, **settings) -> Pipeline:
    """Unfitted linear classifier with its scaler inside the pipeline and, given the row count, a unit L2 penalty."""
    learner = LogisticRegression(featuresCol="churn_vector", labelCol="label", predictionCol="churn_class")
    learner.setProbabilityCol("churn_probabilities").setRawPredictionCol("churn_margin")
    chosen = CHURN_SETTINGS["lr"] | settings
    if rows and "regParam" not in chosen:
        chosen["regParam"] = 1.0 / rows
    return _pipeline(S.CHURN_FEATURES, "churn_vector", learner, chosen)


def ltv_pipeline(**settings) -> Pipeline:
    learner = LinearRegression(featuresCol="ltv_vector", labelCol="label", predictionCol="ltv_raw")
    return _pipeline(S.LTV_FEATURES, "ltv_vector", learner, LTV_SETTINGS["lr"] | settings)


def _pipeline(names: list[str], vector: str, learner, settings: dict) -> Pipeline:
    learner = learner.copy({learner.getParam(k): v for k, v in settings.items()})
    # A missing cell gets the median of the training rows, in training and in scoring.
    known = [f"{n}_known" for n in names]
    stages = [
        Imputer(strategy="median", inputCols=names, outputCols=known),
        VectorAssembler(inputCols=known, outputCol=f"{vector}_raw"),
        StandardScaler(inputCol=f"{vector}_raw", outputCol=vector, withMean=True, withStd=True),
    ]
    return Pipeline(stages=[*stages, learner])


def train_churn(kind: str, train: DataFrame, **settings) -> Model:
    """Fit one churn classifier on weighted training rows; rows without a label are not learned from.

    Trees find the key for their samples in the first column; they balance the classes by the rows they get.
    """
    train = train.where("label is not null")
    if kind == "lr":
        enable_checkpoints(train.sparkSession)
        return churn_pipeline(train.count(), **settings).fit(train)
    return trees.train(train, S.CHURN_FEATURES, train.columns[0], CHURN_SETTINGS[kind] | settings, kind, True)[0]


def train_ltv(kind: str, train: DataFrame, **settings) -> Model:
    train = train.where("label is not null")
    if kind == "lr":
        enable_checkpoints(train.sparkSession)
        return ltv_pipeline(**settings).fit(train)
    return trees.train(train, S.LTV_FEATURES, train.columns[0], LTV_SETTINGS[kind] | settings, kind, False)[0]


def churn_scores(model: Model, rows: DataFrame) -> DataFrame:
    """Rows with the probability of churning and the class that follows from it."""
    if isinstance(model, TreeModel):
        scored = model.transform(rows).withColumn("probability", model.probability())
        return scored.withColumn("churn_class", F.when(F.col("probability") >= 0.5, 1.0).otherwise(0.0))
    return model.transform(rows).withColumn("probability", vector_to_array("churn_probabilities")[1])


def ltv_values(model: Model, rows: DataFrame) -> DataFrame:
    """Rows with `ltv_raw`, the predicted value."""
    if isinstance(model, TreeModel):
        return model.transform(rows).withColumnRenamed("tree_margin", "ltv_raw").drop("tree_vector")
    return model.transform(rows)


def churn_metrics_table(scored: dict[str, DataFrame]) -> DataFrame:
    """Precision, recall, F1 and ROC-AUC per model, to 4 digits."""
    lines = []
    for name, rows in scored.items():
        auc = evaluate.roc_auc(rows.select("label", "probability")).select("roc_auc").scalar()
        metrics = evaluate.cls_metrics(rows).withColumn("roc_auc", auc)
        lines.append(
            metrics.select(
                F.lit(name).alias("model"),
                F.round("precision", 4).alias("precision"),
                F.round("recall", 4).alias("recall"),
                F.round("f1", 4).alias("f1_score"),
                F.round("roc_auc", 4).alias("roc_auc"),
            )
        )
    return _union(lines)


def ltv_metrics_table(predicted: dict[str, DataFrame]) -> DataFrame:
    """MAE, RMSE, R2 and MAPE per model, rounded for storing."""
    digits = {"mae": 2, "rmse": 2, "r2": 4, "mape": 2}
    lines = []
    for name, rows in predicted.items():
        metrics = evaluate.reg_metrics(rows.select(F.col("label").alias("actual"), F.col("ltv_raw").alias("predicted")))
        lines.append(metrics.select(F.lit(name).alias("model"), *[F.round(c, d).alias(c) for c, d in digits.items()]))
    return _union(lines)


def cv_churn(kinds: list[str], train: DataFrame, settings: dict[str, dict] | None = None) -> DataFrame:
    """Five-fold F1 of the positive class per model; each fold has its own scaler, class weights and penalty."""
    tp, fp, fn = (F.count_if((F.col("churn_class") == c) & (F.col("label") == y)) for c, y in ((1, 1), (1, 0), (0, 1)))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)

    def linear(rest: DataFrame, own: dict) -> Model:
        return churn_pipeline(rest.count(), **own).fit(weighted(rest))

    return _cross_validate(kinds, train, settings, "f1", f1, S.CHURN_FEATURES, CHURN_SETTINGS, NAMES, True, linear, churn_scores)


def cv_ltv(kinds: list[str], train: DataFrame, settings: dict[str, dict] | None = None) -> DataFrame:
    """Five-fold R2 per model."""
    r2 = 1 - F.sum((F.col("label") - F.col("ltv_raw")) ** 2) / (F.var_pop("label") * F.count("*"))

    def linear(rest: DataFrame, own: dict) -> Model:
        return ltv_pipeline(**own).fit(rest)

    return _cross_validate(kinds, train, settings, "r2", r2, S.LTV_FEATURES, LTV_SETTINGS, LTV_NAMES, False, linear, ltv_values)


def _cross_validate(kinds, train, settings, metric, score, names, defaults, shown, classes, linear, predict) -> DataFrame:
    """Mean and deviation over the values of `fold`: each is scored by a model of the other folds' rows alone.

    The folds of a tree learner are masks over one table of bins and grow in the same passes.
    """
    enable_checkpoints(train.sparkSession)
    train = train.where("label is not null").persist()
    folds = sorted(r[0] for r in train.select("fold").distinct().collect())  # a handful
    found = []
    for kind in kinds:
        own = (settings or {}).get(kind, {})
        if kind == "lr":
            fitted = []
            for fold in folds:
                rest = train.where(F.col("fold") != fold)
                fitted.append(linear(rest, own))
        else:
            fitted = trees.train(train, names, train.columns[0], defaults[kind] | own, kind, classes, folds, fold="fold")
        values = [predict(m, train.where(F.col("fold") == f)).agg(score).first()[0] for m, f in zip(fitted, folds)]
        found.append((shown[kind], metric, fmean(map(float, values)), pstdev(map(float, values))))
    train.unpersist()
    return train.sparkSession.createDataFrame(found, "model string, metric string, mean double, std double")


def stored_metrics(store: TableStore) -> dict[str, DataFrame | str]:
    """Both stored metric tables; one that was never written is reported by name."""
    found = {n: store.read_optional(n) for n in ("model_metrics", "ltv_model_metrics")}
    return {n: f"no table {n} has been written yet" if t is None else t for n, t in found.items()}


def importances(model: TreeModel, names: list[str]) -> DataFrame:
    """Feature importances of a tree model, largest first, with the engineered ones marked."""
    values = model.importances()
    rows = [(n, float(v), n in S.ENGINEERED) for n, v in zip(names, values)]
    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame(rows, "feature string, importance double, is_engineered boolean")
    return table.orderBy(F.desc("importance"), "feature")


def top_features(table: DataFrame, n: int, by: str = "importance") -> DataFrame:
    return table.orderBy(F.desc(by), "feature").limit(n)


def engineered_only(table: DataFrame) -> DataFrame:
    return table.where("is_engineered")


def predictions_table(scored: DataFrame, key: str) -> DataFrame:
    """Test rows with features, actual and predicted class, and probability to 4 digits."""
    return scored.select(
        key,
        *S.CHURN_FEATURES,
        F.col("label").alias("actual_churn"),
        F.col("churn_class").cast("int").alias("predicted_churn"),
        F.round("probability", 4).alias("churn_probability"),
    )


def predict_ltv_all(model: Model, featured: DataFrame) -> DataFrame:
    """Featured customers with `ltv_predicted`: rounded to cents, then not below 0."""
    scored = ltv_values(model, encode.model_columns(featured))
    return scored.select(*featured.columns, floored(F.round("ltv_raw", 2)).alias("ltv_predicted"))


def customers_ltv_predicted(model: Model, featured: DataFrame) -> DataFrame:
    """The stored customer value table with model predictions."""
    full = capped_and_segmented(ltv_target(predict_ltv_all(model, featured)))
    return full.select(*S.CUSTOMERS_LTV_COLUMNS)


#: What a model asks for, in its order.
BUNDLE_FEATURES = {"churn": S.CHURN_FEATURES, "ltv": S.LTV_FEATURES}
META = (
    "name string, kind string, features array<string>, settings map<string,string>, tenure_max double, schema_hash string, signature string"
)


def model_features(model: Model) -> list[str]:
    """The feature names a fitted model reads, in its order."""
    if isinstance(model, TreeModel):
        return list(model.names)
    return list(model.stages[0].getInputCols())


def _signature(line: dict) -> str:
    """SHA-256 over everything a meta row says; a row that was changed by hand does not match its own."""
    plain = {k: line[k] for k in ("name", "kind", "features", "settings", "tenure_max", "schema_hash")}
    return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()


def _schema_hash(features: list[str]) -> str:
    return hashlib.sha256("\n".join(features).encode()).hexdigest()


def save_bundle(bundle: Bundle, path: str) -> None:
    """Both models and one signed meta row each: ordered features, settings, the training maximum of tenure, a hash of the features."""
    spark = SparkSession.getActiveSession()
    lines = []
    for name in ("churn", "ltv"):
        model = getattr(bundle, name)
        if model is None:
            continue
        if isinstance(model, TreeModel):
            kind, settings = "trees", {"trees": len(model.roots), "depth": model.depth, "average": model.average, "logistic": model.logistic}
            model.save(f"{path}/{name}")
        else:
            kind, last = "pipeline", model.stages[-1]
            settings = {p.name: v for p, v in last.extractParamMap().items() if isinstance(v, (bool, int, float, str))}
            model.write().overwrite().save(f"{path}/{name}")
        features = model_features(model)
        line = {
            "name": name,
            "kind": kind,
            "features": features,
            "settings": {k: str(v) for k, v in sorted(settings.items())},
            "tenure_max": float(bundle.tenure_max),
            "schema_hash": _schema_hash(features),
        }
        lines.append(line | {"signature": _signature(line)})
    names = [f.split()[0] for f in META.split(", ")]
    spark.createDataFrame([tuple(x[n] for n in names) for x in lines], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def bundle_meta(spark: SparkSession, path: str) -> dict[str, dict]:
    """The meta rows by model name; a row whose signature or feature hash does not fit is refused by name."""
    found = {}
    for row in spark.read.parquet(f"{path}/meta").collect():  # two rows at most
        line = row.asDict()
        if line["signature"] != _signature(line) or line["schema_hash"] != _schema_hash(line["features"]):
            raise ValueError(f"bundle {path}: the meta row of model {line['name']!r} was changed after it was saved")
        found[line["name"]] = line
    return found


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """Load what is there; a model that is not gets a warning naming it.

    The features that the meta row lists must be those the stored model reads, in any order, and only known ones; else the
    features in question are named. Scoring then hands a model its features by name, so their order may differ.
    """
    meta = bundle_meta(spark, path)
    found: dict[str, Model | None] = {}
    for name in ("churn", "ltv"):
        if name not in meta:
            warnings.warn(f"model {name!r} not found below {path}", stacklevel=2)
            found[name] = None
            continue
        if meta[name]["kind"] == "trees":
            found[name] = TreeModel.load(spark, f"{path}/{name}")
        else:
            found[name] = PipelineModel.load(f"{path}/{name}")
        listed, read = meta[name]["features"], model_features(found[name])
        unknown = sorted(set(listed) - set(BUNDLE_FEATURES[name]))
        differing = sorted(set(listed) ^ set(read))
        if unknown or differing:
            raise ValueError(f"model {name!r} below {path}: unknown features {unknown}, listed or read but not both {differing}")
    tenure = {m["tenure_max"] for m in meta.values()} or {float(S.MAX_TENURE)}
    if len(tenure) > 1:
        raise ValueError(f"bundle {path}: its models know different training maxima of tenure: {sorted(tenure)}")
    return Bundle(found["churn"], found["ltv"], tenure.pop())


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
