"""Model evaluation as aggregations over scored rows (`label` 0/1, `probability`; or `actual`, `predicted`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranking scores goes through cells of cells: a window never covers more than CELLS cells, and the last
# windows hold only the distinct scores inside one cell of the finest level, a billionth of the score range.
CELLS = 1024
CELL_COLUMNS = ["cell0", "cell1", "cell2"]


def predicted(threshold: float = 0.5) -> Column:
    return F.when(F.col("probability") >= threshold, 1).otherwise(0)


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.groupBy("label", predicted(threshold).alias("predicted")).agg(F.count("*").alias("rows"))


def _cells(scored: DataFrame, threshold: float) -> DataFrame:
    """The four counts of the confusion matrix in one row."""
    hit, truth = predicted(threshold) == 1, F.col("label") == 1
    return scored.agg(
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & truth).alias("fn"),
        F.count_if(~hit & ~truth).alias("tn"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """A ratio that is 0 where its denominator is."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def cls_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of the positive class."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _cells(scored, threshold).select(
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def cls_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted means."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rows = tp + fp + fn + tn
    per_class = [
        _report_line("Not Churned", _ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp), tn + fp),
        _report_line("Churned", _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn), tp + fn),
    ]
    lines = _cells(scored, threshold).withColumn("c", F.array(*per_class))
    c0, c1 = F.col("c")[0], F.col("c")[1]
    mean = lambda f: (c0[f] + c1[f]) / 2
    weighted = lambda f: _ratio(c0[f] * c0["support"] + c1[f] * c1["support"], rows)
    accuracy = _ratio(tp + tn, rows)
    summary = [
        _report_line("accuracy", accuracy, accuracy, accuracy, rows),
        _report_line("macro avg", *[mean(f) for f in ("precision", "recall", "f1")], rows),
        _report_line("weighted avg", *[weighted(f) for f in ("precision", "recall", "f1")], rows),
    ]
    return lines.select(F.explode(F.concat("c", F.array(*summary))).alias("line")).select("line.*")


def _report_line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
    return F.struct(
        F.lit(name).alias("class"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        support.alias("support"),
    )


def _by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score, with the score's cell on every level.

    Equal scores are combined before the shuffle, so a score held by very many rows costs one row.
    """
    out = scored.where("probability is not null").groupBy("probability").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    rest = F.col("probability") * CELLS
    for name in CELL_COLUMNS:
        out = out.withColumn(name, F.least(F.floor(rest), F.lit(CELLS - 1)).cast("int"))
        rest = (rest - F.col(name)) * CELLS
    return out


def _below(column: str, group: list[str], order: str) -> Column:
    """Sum over the rows of the group that come strictly before this one."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _above(column: str, group: list[str], order: str) -> Column:
    window = Window.partitionBy(*group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs ranked rightly, ties half.

    Pairs are never formed. Each positive counts the negatives below it: first inside its finest cell, then,
    level by level, in the lower cells of the cell around it.
    """
    scores = _by_score(scored)
    pairs = F.col("pos").cast("double") * (_below("neg", CELL_COLUMNS, "probability") + F.col("neg") / 2)
    level = scores.withColumn("pairs", pairs)
    for depth in range(len(CELL_COLUMNS), 0, -1):
        keys = CELL_COLUMNS[:depth]
        order = keys[-1]
        level = level.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "pairs")])
        lower = F.col("pos").cast("double") * _below("neg", keys[:-1], order)
        level = level.withColumn("pairs", F.col("pairs") + lower)
    area = F.try_divide(F.sum("pairs"), F.sum("pos").cast("double") * F.sum("neg"))
    return level.agg(area.alias("roc_auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def roc_curve(scored: DataFrame, bins: int | None = None, drop_between: bool = False) -> DataFrame:
    """False and true positive rate at each threshold, from (0, 0) at an unreachable one.

    Without `bins` there is a point for every distinct score; with it, one per equal-width threshold,
    which bounds the output. `drop_between` leaves out the points on a straight line between their neighbours, those whose step
    from the score above equals the step to the score below; the curve and its area stay the same.
    """
    if bins is None:
        scores = _by_score(scored)
        points = _counts_at_or_above(scores)
        if drop_between:
            points = points.join(_corners(scores), "probability", "left_semi")
    else:
        grid = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)) / bins
        binned = (
            scored.groupBy(grid.alias("probability"))
            .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
        )
        points = binned.select(
            "probability",
            (_above("pos", [], "probability") + F.col("pos")).alias("tp"),
            (_above("neg", [], "probability") + F.col("neg")).alias("fp"),
        )
    start = scored.agg(
        F.lit(float("inf")).alias("probability"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp")
    )
    totals = scored.agg(
        F.struct(
            F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
        ).alias("s")
    ).scalar()
    return (
        points.unionByName(start)
        .withColumn("t", totals)
        .select(
            F.col("probability").alias("threshold"),
            F.try_divide("fp", F.col("t.neg")).alias("fpr"),
            F.try_divide("tp", F.col("t.pos")).alias("tpr"),
        )
    )


def _corners(scores: DataFrame) -> DataFrame:
    """The scores at which the curve turns, and the highest and the lowest.

    The next score below is in the same finest cell, or it is the highest of the next cell that holds any: inside the parent, or else
    the one that follows the parent. So each window covers the cells of one parent, and no order of all scores is made.
    """
    step = F.struct("pos", "neg")
    after = None
    for depth in range(1, len(CELL_COLUMNS) + 1):
        keys = CELL_COLUMNS[:depth]
        level = scores.groupBy(*keys).agg(F.max_by(step, "probability").alias("top"))
        down = Window.partitionBy(*keys[:-1]).orderBy(F.desc(keys[-1]))
        level = level.withColumn("inside", F.lead("top").over(down))
        if after is None:
            after = level.select(*keys, F.col("inside").alias("after"))
        else:
            after = level.join(after, keys[:-1]).select(*keys, F.coalesce("inside", "after").alias("after"))
    down = Window.partitionBy(*CELL_COLUMNS).orderBy(F.desc("probability"))
    both = scores.withColumn("inside", F.lead(step).over(down)).join(after, CELL_COLUMNS)
    below = F.coalesce("inside", "after")
    turns = below.isNull() | (below["pos"] != F.col("pos")) | (below["neg"] != F.col("neg"))
    top = scores.agg(F.max("probability")).scalar()
    return both.where(turns | (F.col("probability") == top)).select("probability")


def _counts_at_or_above(scores: DataFrame) -> DataFrame:
    """Per distinct score, positives and negatives scored at least as high.

    Going down the levels, each cell adds what lies above it inside its parent to what lies above the parent.
    """
    sums = [F.sum(c).alias(c) for c in ("pos", "neg")]
    above = None
    for depth in range(1, len(CELL_COLUMNS) + 1):
        keys = CELL_COLUMNS[:depth]
        level = _add_above(scores.groupBy(*keys).agg(*sums), above, keys[:-1], keys[-1])
        above = level.select(*keys, "pos_above", "neg_above")
    totals = [(F.col(c) + F.col(f"{c}_above")).alias(n) for c, n in (("pos", "tp"), ("neg", "fp"))]
    return _add_above(scores, above, CELL_COLUMNS, "probability").select("probability", *totals)


def _add_above(level: DataFrame, parents: DataFrame | None, group: list[str], order: str) -> DataFrame:
    inside = {f"{c}_inside": _above(c, group, order) for c in ("pos", "neg")}
    level = level.withColumns(inside)
    if parents is None:
        return level.withColumns({f"{c}_above": F.col(f"{c}_inside") for c in ("pos", "neg")})
    joined = level.join(parents, group)
    return joined.withColumns({f"{c}_above": F.col(f"{c}_above") + F.col(f"{c}_inside") for c in ("pos", "neg")})


def reg_metrics(scored: DataFrame) -> DataFrame:
    """MAE, RMSE, R2 and the shifted MAPE in one pass; an actual value of -1 has no share in the MAPE."""
    y, p = F.col("actual"), F.col("predicted")
    total = F.var_pop(y) * F.count(y)
    return scored.agg(
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (1 - F.try_divide(F.sum((y - p) * (y - p)), total)).alias("r2"),
        (F.avg(F.abs(F.try_divide(y - p, y + 1))) * 100).alias("mape"),
    )


def residuals(scored: DataFrame) -> DataFrame:
    return scored.withColumn("residual", F.col("actual") - F.col("predicted"))


def metrics_long(metrics: DataFrame, model: str = "model") -> DataFrame:
    """One row per model and metric."""
    values = [c for c in metrics.columns if c != model]
    return metrics.unpivot([model], values, "metric", "score")


def best_by(metrics: DataFrame, metric: str) -> DataFrame:
    """The row with the largest value of a metric; among equals the first by name."""
    return metrics.orderBy(F.desc(metric), "model").limit(1)
