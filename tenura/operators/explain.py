"""Tree attributions of the boosted churn model, computed where the rows are.

The model's trees are turned into one small table of leaves, sent to every executor: for each feature on a leaf's path the
interval that leads to it and the share of training weight that follows it, 32 bytes per leaf and level. Values
are the path-dependent attributions of Lundberg et al., "Consistent Individualized Feature Attribution for Tree
Ensembles". What a tree attributes depends on the outcomes of its tests alone, so a batch of rows is first grouped, tree by
tree, by these outcomes, and every pattern that occurs is worked out once, however many rows share it. What a leaf attributes depends
on the outcomes on its own path, so all of them are worked out on the driver and looked up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.operators.reports import ranked
from tenura.operators.split import remixed
from tenura.operators.trees import TreeModel, matrix

#: Rows that share their patterns of outcomes.
JOINED_ROWS = 1 << 16


@dataclass(frozen=True)
class LeafTable:
    """One row per leaf of the ensemble, padded to the deepest path."""

    feature: np.ndarray  # leaves x depth, -1 where the path is shorter
    above: np.ndarray  # leaves x depth: the feature must exceed this
    upto: np.ndarray  # leaves x depth: and not exceed this
    share: np.ndarray  # leaves x depth: training weight that follows the path at this feature
    value: np.ndarray  # leaves
    base_value: float


def tree_tables(model: TreeModel) -> list[LeafTable]:
    """One attribution table per tree, on the log-odds scale.

    Their size is set by the model alone: at most 2^depth leaves each. The base value of the first includes the model's.
    """
    ends = [*model.roots[1:].tolist(), len(model.left)]
    tables = []
    for start, end in zip(model.roots.tolist(), ends):
        nodes = {
            i - start: {
                "left": int(model.left[i]) - start if model.left[i] != i else -1,
                "right": int(model.left[i]) + 1 - start,
                "feature": int(model.feature[i]),
                "threshold": float(model.threshold[i]),
                "value": float(model.value[i]),
                "cover": float(model.cover[i]),
            }
            for i in range(start, end)
        }
        tables.append(tabulate(leaf_paths(nodes, 1.0), 0.0 if tables else model.base))
    return tables


def leaf_paths(nodes: dict[int, dict], scale: float) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """(value, {feature: (above, upto, share)}) for every leaf of one tree."""
    found = []
    todo = [(0, {})]
    while todo:
        at, path = todo.pop()
        node = nodes[at]
        if node["left"] < 0:
            found.append((scale * node["value"], path))
            continue
        f, cut = node["feature"], node["threshold"]
        above, upto, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, interval in ((node["left"], (above, min(upto, cut))), (node["right"], (max(above, cut), upto))):
            followed = share * nodes[child]["cover"] / node["cover"]
            todo.append((child, path | {f: (*interval, followed)}))
    return found


def tabulate(leaves: list[tuple[float, dict[int, tuple[float, float, float]]]], base: float = 0.0) -> LeafTable:
    depth = max(1, max(len(path) for _, path in leaves))
    n = len(leaves)
    feature = np.full((n, depth), -1, dtype=np.int32)
    above = np.full((n, depth), -np.inf)
    upto = np.full((n, depth), np.inf)
    share = np.ones((n, depth))
    value = np.array([v for v, _ in leaves])
    for i, (_, path) in enumerate(leaves):
        for d, (f, (a, u, s)) in enumerate(path.items()):
            feature[i, d], above[i, d], upto[i, d], share[i, d] = f, a, u, s
    return LeafTable(feature, above, upto, share, value, base + float(np.sum(value * np.prod(share, axis=1))))


def size_weights(depth: int) -> np.ndarray:
    """Weight of a coalition of k other features, for k = 0 .. depth - 1."""
    return np.array([factorial(k) * factorial(depth - k - 1) / factorial(depth) for k in range(depth)])


def attributions(table: LeafTable, x: np.ndarray) -> np.ndarray:
    """Shapley values of a block of rows (rows x features), in depth^2 steps per leaf, each over all rows.

    A coalition that knows a feature of the path contributes whether the row satisfies it (0 or 1), one that does not
    the training share. Summed by coalition size this is a product of linear polynomials, one per feature. For
    each feature its own factor is divided out again: by a share where the row fails it, else from the highest
    power down, where the recursion only multiplies by shares, which are at most 1.
    """
    columns = np.ascontiguousarray(x.T)
    out = np.zeros_like(columns)
    for feature, above, upto, share, value in zip(table.feature, table.above, table.upto, table.share, table.value):
        used = np.flatnonzero(feature >= 0)
        known = np.array([(columns[feature[d]] > above[d]) & (columns[feature[d]] <= upto[d]) for d in used], bool)
        for d, own in zip(used, leaf_values(known, share[used], value)):
            out[feature[d]] += own
    return out.T


def leaf_values(known: np.ndarray, share: np.ndarray, value: float) -> np.ndarray:
    """What a leaf attributes to the features of its path (features x rows), by whether a row satisfies each (features x rows)."""
    depth = len(known)
    if not depth:
        return np.zeros(known.shape)
    n = known.shape[1]
    out = np.empty((depth, n))
    sums = np.zeros((depth + 1, n))
    sums[0] = 1.0
    for i in range(depth):
        sums[1 : i + 2] = sums[1 : i + 2] * share[i] + np.where(known[i], sums[: i + 1], 0.0)
        sums[0] *= share[i]
    weights = size_weights(depth)
    for i in range(depth):
        inside = known[i]
        # Without the feature, for rows that satisfy it: from the top power down.
        rest = sums[depth].copy()
        total = rest * weights[depth - 1]
        for k in range(depth - 1, 0, -1):
            rest = sums[k] - share[i] * rest
            total += rest * weights[k - 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            failed = (weights[:, None] * sums[:depth]).sum(0) / share[i] if not inside.all() else total
            out[i] = value * np.where(inside, (1.0 - share[i]) * total, -share[i] * failed)
    return out


class Ranks:
    """Where values stand among the thresholds of a model, feature by feature."""

    def __init__(self, tables: list[LeafTable]):
        ends = np.concatenate([np.column_stack([t.feature[u], cut[u]]) for t in tables for u in (t.feature >= 0,) for cut in (t.above, t.upto)])
        ends = np.unique(ends[np.isfinite(ends[:, 1])], axis=0)
        self.cuts = {int(f): ends[ends[:, 0] == f, 1] for f in np.unique(ends[:, 0])}

    def of(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """Of rows (rows x features) per feature the number of thresholds below the value; a value that is no number is below all."""
        found = {}
        for f, cuts in self.cuts.items():
            rank = np.searchsorted(cuts, x[:, f]).astype(np.uint8 if len(cuts) < 256 else np.int32)
            rank[np.isnan(x[:, f])] = 0
            found[f] = rank
        return found


#: Features on a path whose outcomes are all worked out before any row is seen.
SHORT_PATH = 8


class TreePatterns:
    """What a tree attributes by the outcomes of its tests; of short paths every outcome is worked out once and then looked up."""

    def __init__(self, table: LeafTable, ranks: Ranks):
        self.table = table
        used = table.feature >= 0
        self.features = np.unique(table.feature[used]).tolist()
        ends = np.concatenate([np.column_stack([table.feature[used], cut[used]]) for cut in (table.above, table.upto)])
        tests = [(int(f), int(np.searchsorted(ranks.cuts[int(f)], cut))) for f, cut in np.unique(ends[np.isfinite(ends[:, 1])], axis=0)]
        self.tests = tests
        self.leaves: list[tuple] | None = None if used.sum(axis=1).max() > SHORT_PATH else []
        if self.leaves is None:
            return
        for i, value in enumerate(table.value):
            own = np.flatnonzero(used[i])
            named = table.feature[i, own].tolist()
            test = lambda f, cut: tests.index((f, int(np.searchsorted(ranks.cuts[f], cut)))) if np.isfinite(cut) else None
            bounds = [(test(f, table.above[i, d]), test(f, table.upto[i, d])) for f, d in zip(named, own)]
            outcomes = (np.arange(1 << len(own)) >> np.arange(len(own))[:, None] & 1).astype(bool)
            self.leaves.append(([self.features.index(f) for f in named], bounds, leaf_values(outcomes, table.share[i, own], value)))

    def grouped(self, ranks: dict[int, np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The first row of each pattern of test outcomes, and the pattern of every row."""
        codes = []
        for a in range(0, max(1, len(self.tests)), 60):
            code = np.zeros(rows, np.int32 if len(self.tests) - a <= 31 else np.int64)
            for f, at in self.tests[a : a + 60]:
                np.left_shift(code, 1, out=code)
                code |= ranks[f] > at
            codes.append(code)
        if len(codes) > 1:
            codes = [np.unique(np.column_stack(codes), axis=0, return_inverse=True)[1].ravel()]
        pattern, kinds = pd.factorize(codes[0])
        first = np.empty(len(kinds), np.int64)
        first[pattern[::-1]] = np.arange(rows - 1, -1, -1)
        return first, pattern

    def add(self, out: np.ndarray, ranks: dict[int, np.ndarray], x: np.ndarray) -> None:
        """Add the attributions of rows (rows x features) to `out` (features x rows); each pattern is worked out once."""
        first, pattern = self.grouped(ranks, len(x))
        if self.leaves is None:
            values = attributions(self.table, x[first]).T[self.features]
        else:
            values = np.zeros((len(self.features), len(first)))
            over = [ranks[f].take(first) > at for f, at in self.tests]
            under = [~o for o in over]
            for features, bounds, found in self.leaves:
                outcome = np.zeros(len(first), np.uint8)
                for i, (above, upto) in enumerate(bounds):
                    known = under[upto] if above is None else over[above] if upto is None else over[above] & under[upto]
                    outcome |= known.view(np.uint8) << np.uint8(i)
                outcome = outcome.astype(np.intp)
                for f, own in zip(features, found):
                    values[f] += own.take(outcome)
        for f, own in zip(self.features, values):
            out[f] += own.take(pattern)


class Attributions:
    """Attributions of blocks of rows by all trees of a model."""

    def __init__(self, tables: list[LeafTable]):
        self.ranks = Ranks(tables)
        self.trees = [TreePatterns(t, self.ranks) for t in tables]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Of rows (rows x features), in the same shape."""
        ranks, out = self.ranks.of(x), np.zeros(x.shape[::-1])
        for tree in self.trees:
            tree.add(out, ranks, x)
        return out.T


def patterns(table: LeafTable, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (rows x features): the first row of each pattern of test outcomes, and the pattern of every row."""
    ranks = Ranks([table])
    return TreePatterns(table, ranks).grouped(ranks.of(x), len(x))


def ensemble_attributions(tables: list[LeafTable], x: np.ndarray) -> np.ndarray:
    """Attributions of a block of rows by all trees; each pattern of a tree's outcomes is worked out once."""
    return Attributions(tables).of(x)


def joined(batches: Iterable[pa.Array | pd.Series], rows: int) -> Iterator[np.ndarray]:
    """Batches of vectors as blocks of at least so many rows, the last as it comes."""
    held: list[np.ndarray] = []
    for batch in batches:
        if len(batch):
            held.append(matrix(batch) if isinstance(batch, pa.Array) else np.stack(batch.to_numpy()).astype(float))
        if sum(map(len, held)) >= rows:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def shap_values(model: TreeModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns, `values` (one per feature, on the log-odds scale), `base_value` and `probability`.

    Only the feature vector crosses into Python, in Arrow batches.
    """
    tables = tree_tables(model)
    spark = SparkSession.getActiveSession()
    shared = spark.sparkContext.broadcast(Attributions(tables))

    @F.arrow_udf("array<double>")
    def explain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in joined(batches, JOINED_ROWS):
            ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.ListArray.from_arrays(ends, np.ascontiguousarray(shared.value.of(x)).ravel())

    scored = model.transform(rows).withColumn("probability", model.probability())
    return scored.select(
        *keep,
        explain("tree_vector").alias("values"),
        F.lit(sum(t.base_value for t in tables)).alias("base_value"),
        "probability",
        *[F.col(f"`{c}`") for c in S.CHURN_FEATURES if c not in keep],
    )


def explain_sample(rows: DataFrame, hashed: Column, key: str, n: int = 1000) -> DataFrame:
    """A repeatable sample of n rows, each with its own label and key: those with the lowest mixed key hashes.

    The hash is mixed once more, since splits cut the same hash: its lowest values are all test rows.
    """
    return rows.orderBy(remixed(hashed), key).limit(n)



def shap_importance(explained: DataFrame) -> DataFrame:
    """Mean absolute value per feature to 6 digits, engineered flag and rank; one pass, no exploded rows."""
    means = explained.agg(
        *[F.avg(F.abs(F.col("values")[i])).alias(f"f{i}") for i in range(len(S.CHURN_FEATURES))]
    )
    entries = [
        F.struct(
            F.lit(f).alias("feature"), F.col(f"f{i}").alias("mean"), F.lit(f in S.ENGINEERED).alias("is_engineered")
        )
        for i, f in enumerate(S.CHURN_FEATURES)
    ]
    long = means.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return ranked(long, "mean", "global_rank").select(
        "feature", F.round("mean", 6).alias("mean_abs_shap"), "is_engineered", "global_rank"
    )


def shap_customer(explained: DataFrame, key: str) -> DataFrame:
    """One column of attributions per feature, with the actual label and the probability."""
    return explained.select(
        key,
        *[F.col("values")[i].alias(f) for i, f in enumerate(S.CHURN_FEATURES)],
        F.col("label").alias("churn_actual"),
        F.round("probability", 4).alias("churn_probability"),
    )


def contributions(explained: DataFrame, n: int) -> DataFrame:
    """The n largest attributions of the given customer(s) with the feature's value."""
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"`{f}`").cast("double").alias("feature_value"),
            F.col("values")[i].alias("contribution"),
        )
        for i, f in enumerate(S.CHURN_FEATURES)
    ]
    long = explained.select("base_value", "probability", F.explode(F.array(*entries)).alias("e"))
    return long.select("e.*", "base_value", "probability").orderBy(F.abs("contribution").desc(), "feature").limit(n)


def dependence(explained: DataFrame, features: list[str], key: str) -> DataFrame:
    """Feature value and attribution pairs."""
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"`{f}`").cast("double").alias("feature_value"),
            F.col("values")[S.CHURN_FEATURES.index(f)].alias("shap"),
        )
        for f in features
    ]
    return explained.select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.*")


def findings(importance: DataFrame) -> DataFrame:
    """Top driver, top engineered driver, and how many engineered features are among the top five."""
    first = lambda test: F.min_by(F.when(test, F.col("feature")), F.when(test, F.col("global_rank")))
    return importance.agg(
        first(F.lit(True)).alias("top_driver"),
        first(F.col("is_engineered")).alias("top_engineered"),
        F.count_if(F.col("is_engineered") & (F.col("global_rank") <= 5)).alias("engineered_in_top5"),
    )
