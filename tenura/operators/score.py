"""Scoring: churn probability, lifetime value and the decisions derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenura.functions import bins
from tenura.operators import encode, models, reports, validate
from tenura.operators.models import Bundle
from tenura.sources.customers_csv import read_batch_csv

CHURN_COLUMNS = ["churn_prediction", "churn_probability", "churn_risk_label"]
LTV_COLUMNS = ["ltv_predicted", "ltv_segment"]
DECISION_COLUMNS = CHURN_COLUMNS + LTV_COLUMNS + ["revenue_at_risk", "priority_score"]


def decision_columns(probability: Column, ltv: Column) -> dict[str, Column]:
    """Everything that follows from a probability and an unrounded value: labels first, rounding last."""
    value = bins.floored(ltv)
    return {
        "churn_prediction": F.when(probability >= 0.5, 1).otherwise(0),
        "churn_probability": F.round(probability, 4),
        "churn_risk_label": bins.risk_label(probability),
        "ltv_predicted": F.round(value, 2),
        "ltv_segment": bins.ltv_segment(value),
        "revenue_at_risk": F.round(value * probability, 2),
        "priority_score": bins.priority(probability, value),
    }


def decide(df: DataFrame, probability: str, ltv: str) -> DataFrame:
    """Add the decision columns to rows that already carry a probability and a value."""
    return df.select("*", *[c.alias(n) for n, c in decision_columns(F.col(probability), F.col(ltv)).items()])


def score_churn(df: DataFrame, bundle: Bundle, key: str) -> DataFrame:
    return _score(df, bundle, key, CHURN_COLUMNS)


def score_ltv(df: DataFrame, bundle: Bundle, key: str) -> DataFrame:
    return _score(df, bundle, key, LTV_COLUMNS)


def score(df: DataFrame, bundle: Bundle, key: str) -> DataFrame:
    """Both scores, revenue at risk and retention priority; works on static and streaming rows alike."""
    return _score(df, bundle, key, DECISION_COLUMNS)


def numbered(rows: DataFrame, name: str = "row_index") -> DataFrame:
    """Number rows 0..n-1 by file, in order of the paths, and by place in the file.

    A file may be read in several blocks, and Spark packs small ones together in tasks as it likes; a block's path and first byte tell
    where its rows belong. Rows are read twice, once to count them per block; only those counts, one per block, meet in
    one place. `rows` must come straight from files, without a shuffle.
    """
    block = ["_file", "_byte"]
    placed = rows.withColumns({"_file": F.input_file_name(), "_byte": F.input_file_block_start(), "_at": F.monotonically_increasing_id()})
    counts = placed.groupBy(*block).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy(*block)) - F.col("_n")
    starts = counts.select(*block, "_first", before.alias("_start"))
    out = placed.join(starts, block).withColumn(name, F.col("_start") + F.col("_at") - F.col("_first"))
    return out.select(name, *rows.columns)


def read_batch(spark: SparkSession, path: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scorable rows of CSV files and the rejected ones with their reasons; without a key, rows get a `row_index`."""
    rows = validate.require_columns(read_batch_csv(spark, path))
    return validate.split_scorable(numbered(rows) if key is None else rows)


def score_batch(spark: SparkSession, path: str, bundle: Bundle, key: str | None = None) -> DataFrame:
    """Score CSV files of any size. Rows that cannot be scored are left to `read_batch`."""
    rows, _ = read_batch(spark, path, key)
    return score(rows, bundle, key or "row_index")


def summarize(scored: DataFrame) -> DataFrame:
    return reports.batch_summary(scored)


def _score(df: DataFrame, bundle: Bundle, key: str, columns: list[str]) -> DataFrame:
    probability = ltv = F.lit(None).cast("double")
    rows = encode.scoring_features(validate.fill_defaults(df), bundle.tenure_max)
    rows = encode.model_columns(rows, unmapped=0)
    if set(columns) & set(CHURN_COLUMNS):
        rows = models.churn_scores(_loaded(bundle.churn, "churn"), rows).drop("tree_vector", "tree_margin")
        probability = F.col("probability")
    if set(columns) & set(LTV_COLUMNS):
        rows = models.ltv_values(_loaded(bundle.ltv, "ltv"), rows)
        ltv = F.col("ltv_raw")
    made = decision_columns(F.col("_p"), F.col("_ltv"))
    rows = rows.select(key, probability.alias("_p"), ltv.alias("_ltv"))
    return rows.select(key, *[made[c].alias(c) for c in columns])


def _loaded(model, name: str):
    if model is None:
        raise ValueError(f"model {name!r} is not loaded")
    return model
