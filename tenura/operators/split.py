"""Repeatable train/test splits, folds and class weights, all derived from a hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.operators.distributions import attach
from tenura.operators.quantiles import rank_values


def key_hash(key: str) -> Column:
    """A number in [0, 2^32) that depends on the key alone, so a lost task or another partitioning changes nothing."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 32))


def integer_key_hash(key: str) -> Column:
    """The same for integer keys, in arithmetic any SQL engine can repeat."""
    return (F.pmod(F.col(key), F.lit(1 << 31)) * F.lit(2654435761)) % F.lit(1 << 32)


def remixed(hashed: Column) -> Column:
    """Another number in [0, 2^32) from one in that range, for a second, independent choice from the same key."""
    return (hashed % 65536 * F.lit(40503) * F.lit(65537) + F.floor(hashed / 65536) * F.lit(2246822519)) % F.lit(1 << 32)


def split(df: DataFrame, hashed: Column, test_tenths: int = 2) -> DataFrame:
    """Mark each row train or test (`is_test`) by the last digit of its hash."""
    return df.withColumn("is_test", hashed % 10 >= 10 - test_tenths)


def stratified_split(df: DataFrame, hashed: Column, strata: str = "churn", test_share: float = 0.2) -> DataFrame:
    """Mark the same share of every class as test rows.

    The cut in each class is the exact quantile of the hash, so shares are met to within one row. Rows without a class
    stay, as train rows.
    """
    rows = df.withColumn("_hash", hashed.cast("double"))
    cuts = rank_values(rows, "_hash", [test_share], [strata], combine=False).select(strata, F.col("lower").alias("_cut"))
    marked = attach(rows, cuts, [strata], "left")
    return marked.withColumn("is_test", F.coalesce(F.col("_hash") <= F.col("_cut"), F.lit(False))).drop("_hash", "_cut")


def stratified_folds(df: DataFrame, hashed: Column, k: int = 5, strata: str = "churn", name: str = "fold") -> DataFrame:
    """Fold number 0..k-1 with the same share of every class in each fold, to within one row; 0 without a class."""
    rows = df.withColumn("_hash", hashed.cast("double"))
    shares = [i / k for i in range(1, k)]
    cuts = rank_values(rows, "_hash", shares, [strata], combine=False)
    cuts = cuts.groupBy(strata).agg(F.sort_array(F.collect_list("lower")).alias("_cuts"))
    marked = attach(rows, cuts, [strata], "left")
    fold = F.aggregate("_cuts", F.lit(0), lambda seen, cut: seen + F.when(F.col("_hash") > cut, 1).otherwise(0))
    return marked.withColumn(name, F.coalesce(fold, F.lit(0))).drop("_hash", "_cuts")


def folds(df: DataFrame, hashed: Column, k: int = 5, name: str = "fold") -> DataFrame:
    """Fold number 0..k-1, independent of the digit that `split` uses."""
    return df.withColumn(name, (F.floor(hashed / 10) % k).cast("int"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (2 n_c) of both classes, and negatives / positives."""
    p, n = F.col("positives"), F.col("negatives")
    return class_counts(df, label).select(
        "positives",
        "negatives",
        F.try_divide(p + n, 2 * n).alias("weight_negative"),
        F.try_divide(p + n, 2 * p).alias("weight_positive"),
        F.try_divide(n, p).alias("positive_weight"),
    )


def balanced_weight(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Weight rows so that both classes count the same."""
    w = class_weights(df, label).select(F.struct("weight_negative", "weight_positive").alias("s")).scalar()
    return df.withColumn(name, F.when(F.col(label) == 1, w["weight_positive"]).otherwise(w["weight_negative"]))


def pos_weight(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Weight positive rows by negatives / positives, others by 1."""
    w = class_weights(df, label).select("positive_weight").scalar()
    return df.withColumn(name, F.when(F.col(label) == 1, w).otherwise(F.lit(1.0)))
