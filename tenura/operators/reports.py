"""Churn, revenue and value reports. Each is one aggregation over the rows, then small work on its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.functions.bins import tenure_band, tenure_group
from tenura.operators.quantiles import quantiles


def _rows() -> Column:
    return F.count(F.lit(1))


def _churned(column: str = "churn") -> Column:
    return F.col(column) == "Yes"


def _rate(label: Column | None = None) -> Column:
    """Percentage of rows where the label holds."""
    return F.avg(F.when(_churned() if label is None else label, 1.0).otherwise(0.0)) * 100


def _where(test: Column, value: Column) -> Column:
    return F.when(test, value)


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


# Churn by category


def churn_distribution(df: DataFrame) -> DataFrame:
    """Customers per churn value and their share; the window runs over the grouped result only."""
    grouped = df.groupBy("churn").agg(_rows().alias("customers"))
    share = F.col("customers") / F.sum("customers").over(Window.partitionBy())
    return grouped.select("churn", "customers", F.round(share * 100, 2).alias("pct"))


def crosstab_pct(df: DataFrame, category: str, by: str = "churn", values: list[str] | None = None) -> DataFrame:
    """Counts and row percentages of `by` within each category, 0 where a combination does not occur."""
    values = values or S.YES_NO
    counts = df.where(F.col(category).isNotNull()).groupBy(category).pivot(by, values).agg(_rows())
    total = sum((F.coalesce(F.col(v), F.lit(0)) for v in values[1:]), F.coalesce(F.col(values[0]), F.lit(0)))
    cells = [F.coalesce(F.col(v), F.lit(0)).alias(f"{v.lower()}_count") for v in values]
    shares = [(F.coalesce(F.col(v), F.lit(0)) / total * 100).alias(f"{v.lower()}_pct") for v in values]
    return counts.select(category, *cells, *shares)


def tenure_group_crosstab(df: DataFrame) -> DataFrame:
    return crosstab_pct(df.withColumn("tenure_group", tenure_group()), "tenure_group")


def churn_by_contract(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("contract")
        .agg(_rows().alias("total"), F.count_if(_churned()).alias("churned"))
        .withColumn("churn_rate", F.round(F.col("churned") * F.lit(100.0) / F.col("total"), 1))
        .orderBy(F.desc("churn_rate"), "contract")
    )


def churn_by_band(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(tenure_band().alias("tenure_band"))
        .agg(_rows().alias("total"), F.round(_rate(), 1).alias("churn_pct"))
        .orderBy("tenure_band")
    )


def churn_heatmap(df: DataFrame) -> DataFrame:
    """Churn rate of every contract (rows) in every tenure band (columns); NULL where nobody is."""
    return (
        df.withColumn("tenure_group", tenure_group())
        .where(F.col("tenure_group").isNotNull())
        .groupBy("contract")
        .pivot("tenure_group", S.TENURE_GROUPS)
        .agg(_rate())
    )


def senior_churn(df: DataFrame) -> DataFrame:
    senior = F.col("senior_citizen") == 1
    hit = F.when(_churned(), 100.0).otherwise(0.0)
    return df.agg(
        F.avg(_where(senior, hit)).alias("senior_pct"),
        F.avg(_where(F.col("senior_citizen") == 0, hit)).alias("non_senior_pct"),
    )


# Filters


def where_churn(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col("churn") == value)


def high_risk_customers(df: DataFrame) -> DataFrame:
    return df.where((F.col("contract") == "Month-to-month") & (F.col("tenure") <= 12))


def high_risk_segment(df: DataFrame) -> DataFrame:
    """Size and churn rate of month-to-month customers in their first year."""
    return high_risk_customers(df).agg(_rows().alias("customers"), _rate().alias("churn_pct"))


def lookup(stored: DataFrame, customer_id: str) -> DataFrame:
    """The stored record of one customer; empty when there is none."""
    return (
        stored.where(F.col("customer_id") == F.lit(customer_id))
        .select(
            "customer_id",
            "contract",
            "tenure",
            "monthly_charges",
            F.col("churn").alias("churn_status"),
            "ltv_historical",
            "ltv_projected",
            "ltv_predicted",
            "ltv_segment",
        )
        .limit(1)
    )


# Numeric summaries


def describe_by(df: DataFrame, column: str, by: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per group."""
    rows = df.select(by, column).where(F.col(by).isNotNull())
    v = F.col(column)
    quartiles = quantiles(rows, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, [by])
    moments = rows.groupBy(by).agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).cast("double").alias("min"),
        F.max(v).cast("double").alias("max"),
    )
    return moments.join(quartiles, by, "left").select(by, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, each over the rows where both are present, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = [
        F.struct(F.lit(x).alias("left"), F.lit(y).alias("right"), F.col(f"`{a}|{b}`").alias("corr"))
        for a, b in pairs
        for x, y in dict.fromkeys([(a, b), (b, a)])
    ]
    return sums.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def feature_corr(featured: DataFrame) -> DataFrame:
    """Engineered features by the size of their correlation with churn."""
    label = F.when(_churned(), 1).otherwise(0)
    sums = featured.agg(*[F.corr(F.col(f), label).alias(f) for f in S.ENGINEERED])
    return sums.unpivot([], S.ENGINEERED, "feature", "corr").orderBy(F.abs("corr").desc(), "feature")


def feature_summary(featured: DataFrame) -> DataFrame:
    """Minimum, maximum, and mean by churn status of each engineered feature."""
    stats = {
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
        "mean_churned": lambda c: F.avg(_where(_churned(), c)),
        "mean_retained": lambda c: F.avg(_where(F.col("churn") == "No", c)),
    }
    sums = featured.agg(
        *[
            F.struct(F.lit(f).alias("feature"), *[s(F.col(f).cast("double")).alias(n) for n, s in stats.items()]).alias(f)
            for f in S.ENGINEERED
        ]
    )
    return sums.select(F.explode(F.array(*S.ENGINEERED)).alias("e")).select("e.*")


def baseline_kpis(df: DataFrame) -> DataFrame:
    """Rates, mean tenure by status, monthly revenue and the part of it that churned."""
    kept = F.col("churn") == "No"
    return (
        df.agg(
            _rate().alias("churn_rate"),
            F.avg(_where(_churned(), F.col("tenure"))).alias("avg_tenure_churned"),
            F.avg(_where(kept, F.col("tenure"))).alias("avg_tenure_retained"),
            F.sum("monthly_charges").alias("monthly_revenue"),
            _zero(F.sum(_where(_churned(), F.col("monthly_charges")))).alias("revenue_lost"),
        )
        .withColumn("retention_rate", 100 - F.col("churn_rate"))
        .withColumn("pct_at_risk", F.try_divide("revenue_lost", "monthly_revenue") * 100)
    )


def eda_summary(df: DataFrame) -> DataFrame:
    kept = F.col("churn") == "No"
    hit = F.when(_churned(), 100.0).otherwise(0.0)
    return df.agg(
        _rate().alias("overall_pct"),
        F.avg(_where(F.col("contract") == "Month-to-month", hit)).alias("month_to_month_pct"),
        F.avg(_where(F.col("contract") == "Two year", hit)).alias("two_year_pct"),
        F.avg(_where(_churned(), F.col("tenure"))).alias("tenure_churned"),
        F.avg(_where(kept, F.col("tenure"))).alias("tenure_retained"),
        F.avg(_where(_churned(), F.col("monthly_charges"))).alias("charges_churned"),
        F.avg(_where(kept, F.col("monthly_charges"))).alias("charges_retained"),
    )


# Lifetime value


def ltv_stats(target: DataFrame) -> DataFrame:
    """Mean, sample deviation and maximum of historical and projected value."""
    return target.agg(
        *[
            f(c).alias(f"{name}_{c}")
            for c in ("ltv_historical", "ltv_projected")
            for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max))
        ]
    )


def pred_stats(stored: DataFrame) -> DataFrame:
    """Mean, exact median, minimum and maximum predicted value."""
    median = quantiles(stored, "ltv_predicted", {"median": 0.5}).scalar()
    return stored.agg(
        F.avg("ltv_predicted").alias("mean"), F.min("ltv_predicted").alias("min"), F.max("ltv_predicted").alias("max")
    ).select("mean", median.alias("median"), "min", "max")


def ltv_by_contract(target: DataFrame) -> DataFrame:
    return target.groupBy("contract").agg(F.avg("ltv_projected").alias("avg_ltv")).orderBy("avg_ltv", "contract")


def pred_by(stored: DataFrame, column: str) -> DataFrame:
    return stored.groupBy(column).agg(F.avg("ltv_predicted").alias("avg_predicted"))


def segment_distribution(stored: DataFrame) -> DataFrame:
    return (
        stored.groupBy("ltv_segment")
        .agg(_rows().alias("customers"), F.round(F.avg("ltv_predicted"), 2).alias("avg_ltv"))
        .orderBy(F.desc("avg_ltv"), "ltv_segment")
    )


def segment_churn(stored: DataFrame) -> DataFrame:
    return crosstab_pct(stored, "ltv_segment")


def revenue_at_risk(stored: DataFrame) -> DataFrame:
    lost = F.sum(F.when(_churned(), F.col("ltv_predicted")).otherwise(0.0))
    total = F.sum("ltv_predicted")
    return stored.agg(
        F.round(total, 2).alias("total_portfolio_ltv"),
        F.round(lost, 2).alias("revenue_at_risk"),
        F.round(F.try_divide(lost * F.lit(100.0), total), 2).alias("pct_at_risk"),
    )


def ltv_three_by_contract(stored: DataFrame) -> DataFrame:
    return (
        stored.groupBy("contract")
        .agg(
            F.round(F.avg("ltv_historical"), 2).alias("hist_ltv"),
            F.round(F.avg("ltv_projected"), 2).alias("proj_ltv"),
            F.round(F.avg("ltv_predicted"), 2).alias("pred_ltv"),
        )
        .orderBy(F.desc("pred_ltv"), "contract")
    )


def business_summary(stored: DataFrame) -> DataFrame:
    """Portfolio totals with one column per value segment."""
    return (
        stored.agg(
            _rows().alias("total_customers"),
            F.count_if(_churned()).alias("churned_customers"),
            F.round(F.avg("ltv_predicted"), 2).alias("avg_predicted_ltv"),
            F.round(_zero(F.sum(_where(_churned(), F.col("ltv_predicted")))), 2).alias("total_revenue_at_risk"),
            *[F.count_if(F.col("ltv_segment") == s).alias(f"{s.lower()}_customers") for s in S.LTV_SEGMENTS],
        )
        .withColumn(
            "churn_rate_pct", F.round(F.try_divide("churned_customers", "total_customers") * 100, 2)
        )
    )


def revenue_split(stored: DataFrame) -> DataFrame:
    """Safe and at-risk revenue as the dashboard shows them, from the rounded summary figures."""
    at_risk = F.col("total_revenue_at_risk")
    total = F.col("avg_predicted_ltv") * F.col("total_customers")
    return business_summary(stored).select(
        F.greatest(total - at_risk, F.lit(0.0)).alias("safe_revenue"), at_risk.alias("revenue_at_risk")
    )


# Scored customers


def batch_summary(scored: DataFrame) -> DataFrame:
    """Totals of a scored batch; the rate of an empty batch is 0."""
    return (
        scored.agg(
            _rows().alias("total_customers"),
            F.coalesce(F.sum("churn_prediction"), F.lit(0)).alias("churners_predicted"),
            F.round(_zero(F.sum("revenue_at_risk")), 2).alias("total_revenue_at_risk"),
        )
        .withColumn(
            "churn_rate",
            F.round(F.coalesce(F.try_divide("churners_predicted", "total_customers"), F.lit(0.0)), 4),
        )
    )


def label_counts(scored: DataFrame, column: str) -> DataFrame:
    return scored.groupBy(column).agg(_rows().alias("rows")).orderBy(F.desc("rows"), column)


def high_risk_premium(stored: DataFrame, n: int = 20) -> DataFrame:
    """The most valuable customers of the two upper segments who churned; ties go by id."""
    return (
        stored.where(_churned() & F.col("ltv_segment").isin("Premium", "High"))
        .orderBy(F.desc("ltv_predicted"), "customer_id")
        .limit(n)
        .select(
            "customer_id",
            "contract",
            "tenure",
            F.round("monthly_charges", 2).alias("monthly_charges"),
            F.round("ltv_predicted", 2).alias("ltv_predicted"),
            "ltv_segment",
        )
    )


def extreme_customer(scored: DataFrame, label: int, key: str, probability: str = "probability") -> DataFrame:
    """The churner with the highest score (label 1) or the retained customer with the lowest (label 0).

    Where nobody carries the label, the extreme of all customers is returned.
    """
    order = F.desc(probability) if label == 1 else F.asc(probability)
    other = F.when(F.col("label") == label, 0).otherwise(1)
    return scored.orderBy(other, order, key).limit(1)


def attach(scores: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Bring scores and labels together by key."""
    return scores.join(labels, key)


def ranked(table: DataFrame, by: str, name: str = "rank", label: str = "feature") -> DataFrame:
    """Number the rows of a small table (one row per feature) from the largest down."""
    order = Window.orderBy(F.desc(by), label)
    return table.withColumn(name, F.row_number().over(order))


def display(scored: DataFrame) -> DataFrame:
    """Percent and dollar strings of the scored columns, without padding zeros."""
    dollars = lambda c: F.concat(F.lit("$"), _plain(F.round(c, 2)))
    return scored.withColumns(
        {
            "churn_probability": F.concat(_plain(F.round(F.col("churn_probability") * 100, 2)), F.lit("%")),
            "ltv_predicted": dollars("ltv_predicted"),
            "revenue_at_risk": dollars("revenue_at_risk"),
        }
    )


def _plain(number: Column) -> Column:
    """Shortest decimal text with at least one decimal: 12.0, 12.3, 12.34."""
    fixed = F.format_string("%.2f", number)
    return F.regexp_replace(fixed, "0$", "")
