"""Histogram trees: boosted trees and forests grown by aggregation over a binned table.

Features are cut once into at most `BINS` bins, one byte each, at borders that depend on the values alone. Rows are packed into
blocks; growing a level of trees is one pass in which every block sums gradients and weights per node, feature and bin. Only these
sums, whose size is set by the model, leave the tasks. Sums are whole numbers of a fixed unit, so they are exact and a model
does not depend on how rows are partitioned. Of two siblings only the smaller is summed, the other is the rest of the parent.

Boosting takes second-order steps with L1 and L2 penalties on the leaves, and draws rows by a hash of the key and the round, columns by
one of the tree. Several fits that differ in the rows they leave out, as the folds of a cross validation do, grow together in
the same passes. A forest grows all its trees at once: nodes with many rows level by level like this, and as soon as a
node is small its rows go to one task that grows the rest; both ways choose the same splits.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.session import enable_checkpoints, local_folder, new_path, slots

BINS = 64
#: Rows of a block, and of a task; few rows train in few tasks.
BLOCK_ROWS = 1 << 13
#: Nodes of at most so many rows are grown to the end in one task.
LOCAL_ROWS = 1 << 16
#: Whole numbers are counted in units of 2 ** -SHIFT of a value of order 1.
SHIFT = 30
#: Blocks of a boosting task, where there are cores enough; with few blocks one task keeps them all.
TASK_BLOCKS = 4
ONE_TASK_BLOCKS = 16
#: Rounds after which boosted margins are stored in the shared folder.
FRESH = 25
#: Bytes of rows that a task may keep for a whole fit.
KEPT_BYTES = 1 << 29
#: Rows that a task looks at together.
CHUNK_ROWS = 1 << 17
#: Combinations of bins that several features may be counted by at once.
JOINT_CELLS = 1 << 11


def mix(x: np.ndarray, *salts: int) -> np.ndarray:
    """64 bits that depend on a 64-bit number and the salts alone."""
    x = np.asarray(x).astype(np.uint64)
    for salt in (*salts, 0):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x


# Binning


def double_of(ordered: np.ndarray) -> np.ndarray:
    bits = np.asarray(ordered, np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits).view(np.float64)


def ordered_cells(x: np.ndarray) -> np.ndarray:
    """The 20 leading bits of doubles, as `ordered_bits` orders them; zeros are alike, and so are all that are no numbers."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits) >> 44


@dataclass(frozen=True)
class Binning:
    """For every feature the upper ends of its bins but the last, and the value of a missing cell."""

    names: list[str]
    borders: list[np.ndarray]
    fill: list[float]

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(b) + 1 for b in self.borders])


def binning(rows: DataFrame, names: list[str], bins: int = BINS) -> Binning:
    """Borders with about equal row counts between them, from one aggregation.

    Values are counted in cells of 20 leading bits, less than 0.4 % wide, so what comes back is bounded whatever the rows; small
    whole numbers have cells of their own. A missing cell later reads as the lower end of the cell of the median.
    """
    vectors = rows.select(F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("x"))

    def count(batches):
        for batch in batches:
            x = batch.column("x").flatten()
            known = x.is_valid().to_numpy(zero_copy_only=False).reshape(-1, len(names))
            counts = []
            cells = ordered_cells(x.fill_null(0.0).to_numpy(zero_copy_only=False)).reshape(-1, len(names))
            for i, (own, test) in enumerate(zip(cells.T, known.T)):
                cell, n = np.unique(own[test], return_counts=True)
                counts.append((np.full(len(cell), i, np.int32), cell, n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*counts)], ["i", "cell", "n"])

    found = vectors.mapInArrow(count, "i int, cell long, n long").groupBy("i", "cell").agg(F.sum("n").alias("count")).toPandas()
    borders, fill = [], []
    for i in range(len(names)):
        own = found[found["i"] == i].sort_values("cell")
        cell, n = own["cell"].to_numpy(np.int64), own["count"].to_numpy(np.int64)
        if not len(cell):
            borders.append(np.zeros(0))
            fill.append(0.0)
            continue
        total = np.cumsum(n)
        # A border falls behind the cell with which a multiple of the bin's share is reached.
        wanted = total[-1] * np.arange(1, bins) / bins
        last = np.unique(np.searchsorted(total, wanted)) if len(cell) > bins else np.arange(len(cell))
        borders.append(double_of(((cell[last[last < len(cell) - 1]] + 1) << 44) - 1))
        fill.append(float(double_of(cell[np.searchsorted(total, total[-1] / 2)] << 44)))
    return Binning(names, borders, fill)


@dataclass
class Block:
    """Some rows: bins per feature and row, label, fold, key hash, class, and one margin per fit."""

    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    key: np.ndarray
    margin: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


BLOCK = "bins binary, label binary, fold binary, key binary"


def blocks(rows: DataFrame, grid: Binning, key: str, label: str, fold: str | None) -> DataFrame:
    """Rows with a label as packed blocks, spread by key over as many tasks as they fill."""
    count = rows.count()
    parts = max(1, math.ceil(count / BLOCK_ROWS))
    cells = [F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(x)) for n, x in zip(grid.names, grid.fill)]
    slim = rows.select(
        F.array(*cells).alias("x"),
        F.col(label).cast("double").alias("y"),
        (F.col(fold).cast("int") if fold else F.lit(-1)).alias("f"),
        F.xxhash64(key).alias("k"),
    )

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, len(grid.names))
            bins = np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(grid.borders)]).astype(np.uint8)
            columns = [
                bins.tobytes(),
                batch.column("y").to_numpy(zero_copy_only=False).astype("<f8").tobytes(),
                batch.column("f").to_numpy(zero_copy_only=False).astype("<i4").tobytes(),
                batch.column("k").to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["bins", "label", "fold", "key"])

    return slim.repartition(parts, "k").mapInArrow(run, BLOCK)


def unpacked(row, features: int) -> Block:
    label = np.frombuffer(row["label"], "<f8")
    return Block(
        np.frombuffer(row["bins"], np.uint8).reshape(features, len(label)),
        label,
        np.frombuffer(row["fold"], "<i4"),
        np.frombuffer(row["key"], "<i8"),
    )


def _blocks_of(batches: Iterable[pa.RecordBatch], features: int) -> Iterable[Block]:
    """Packed blocks one by one, as they come."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield unpacked(batch.slice(i, 1).to_pylist()[0], features)


def _chunked(parts: Iterable[Block], rows: int) -> Iterable[Block]:
    """Blocks joined to about so many rows each."""
    held, n = [], 0

    def joined() -> Block:
        return Block(
            np.ascontiguousarray(np.concatenate([p.bins for p in held], axis=1)),
            *[np.concatenate([getattr(p, name) for p in held]) for name in ("label", "fold", "key")],
        )

    for part in parts:
        if held and n + len(part.label) > rows:
            yield joined()
            held, n = [], 0
        held.append(part)
        n += len(part.label)
    if held:
        yield joined()


# Trees


@dataclass
class Tree:
    """Nodes of one tree; a leaf has feature -1, the right child stands behind the left one."""

    feature: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    place: np.ndarray  # 1 for the root, 2 p and 2 p + 1 for the children of p

    @staticmethod
    def stump() -> "Tree":
        return Tree(np.array([-1]), np.zeros(1, int), np.array([-1]), np.zeros(1), np.zeros(1), np.zeros(1), np.ones(1, np.int64))

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row has come to; bins are per feature and row."""
        at = np.zeros(bins.shape[1], np.int64)
        rows = np.arange(bins.shape[1])
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            down = self.left[at] + (bins[f, rows] > self.cut[at])
            at = np.where(inner, down, at)

    def split(self, at: int, feature: int, cut: int, gain: float) -> int:
        """Turn a leaf into a node with two leaves; the number of the left one."""
        left = len(self.feature)
        self.feature[at], self.cut[at], self.left[at], self.gain[at] = feature, cut, left, gain
        place = 2 * self.place[at]
        for name, new in {"feature": [-1, -1], "cut": [0, 0], "left": [-1, -1], "value": [0, 0], "cover": [0, 0], "gain": [0, 0], "place": [place, place + 1]}.items():
            setattr(self, name, np.concatenate([getattr(self, name), np.array(new, getattr(self, name).dtype)]))
        return left


@dataclass(frozen=True)
class Rules:
    """What makes a split good, for boosting and forests alike: sums g and h of a node are worth T(g)^2 / (h + l2)."""

    depth: int
    l1: float = 0.0
    l2: float = 0.0
    least_weight: float = 0.0
    least_leaf: int = 1
    least_split: int = 2

    def worth(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        t = np.maximum(np.abs(g) - self.l1, 0.0) if self.l1 else g
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(h + self.l2 > 0, t * t / (h + self.l2), 0.0)

    def value(self, g: float, h: float) -> float:
        t = math.copysign(max(abs(g) - self.l1, 0.0), g)
        return t / (h + self.l2) if h + self.l2 > 0 else 0.0


def best_splits(sums: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rules: Rules, unit: float, total: np.ndarray | None = None):
    """(feature, cut, gain, left sums, totals) of each node from its histogram; feature -1 where no split is good.

    `sums` is nodes x cells x (g, h, rows) in whole numbers, the features' cells side by side; `allowed` nodes x features. Ties go to the
    first feature and the lowest bin. Without `total` the nodes' totals are those of the first feature.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    run = np.cumsum(sums, axis=1)
    before = np.where((starts > 0)[None, :, None], run[:, starts - 1], 0)
    left = run - before[:, owner]
    total = run[:, sizes[0] - 1][:, None] if total is None else total[:, None]
    right = total - left
    gl, hl, gr, hr, gt, ht = (x[..., i] * unit for x in (left, right, total) for i in (0, 1))
    gain = rules.worth(gl, hl) + rules.worth(gr, hr) - rules.worth(gt, ht)
    fine = allowed[:, owner] & (left[..., 2] >= rules.least_leaf) & (right[..., 2] >= rules.least_leaf)
    fine &= (hl >= rules.least_weight) & (hr >= rules.least_weight) & (total[..., 2] >= rules.least_split)
    gain = np.where(fine, gain, -np.inf)
    cell = np.argmax(gain, axis=1)
    node = np.arange(len(sums))
    best = gain[node, cell]
    feature = np.where(best > 1e-9, owner[cell], -1)
    return feature, cell - starts[owner[cell]], best, left[node, cell], total[:, 0]


def summed(bins: np.ndarray, slot: np.ndarray, slots: int, sizes: np.ndarray, stats: Iterable[np.ndarray]) -> np.ndarray:
    """Histograms, slots x cells x statistics, of rows whose slot is not negative. Statistics are whole numbers below 2 ** 36."""
    rows = np.flatnonzero(slot >= 0)
    own = slot[rows]
    stats = [s[rows] for s in stats]
    out = np.zeros((slots, int(sizes.sum()), len(stats) + 1), np.int64)
    at = 0
    for f, size in enumerate(sizes.tolist()):
        place = own * size + bins[f, rows]
        for i, s in enumerate(stats):
            out[:, at : at + size, i] = np.bincount(place, s, slots * size).reshape(slots, size)
        out[:, at : at + size, -1] = np.bincount(place, minlength=slots * size).reshape(slots, size)
        at += size
    return out


def bundled(sizes: np.ndarray, cells: int) -> list[list[int]]:
    """Features in groups whose bins together have at most so many combinations; a larger feature stands alone."""
    groups: list[tuple[int, list[int]]] = []
    for f in np.argsort(-sizes, kind="stable").tolist():
        for i, (n, own) in enumerate(groups):
            if n * int(sizes[f]) <= cells:
                groups[i] = n * int(sizes[f]), [*own, f]
                break
        else:
            groups.append((int(sizes[f]), [f]))
    return [own for _, own in groups]


def joint_bins(bins: np.ndarray, sizes: np.ndarray, group: list[int]) -> np.ndarray:
    """One number per row for its bins of a group's features."""
    code = np.zeros(bins.shape[1], np.int16)
    for f in group:
        code = code * np.int16(sizes[f]) + bins[f]
    return code


class _JointSums:
    """Histograms of the used features, summed over joint bins group by group.

    Rows are counted once per group; a feature's own sums are those over the other features of its group.
    """

    def __init__(self, slots: int, sizes: np.ndarray, groups: list[list[int]], used: np.ndarray, width: int):
        self.slots, self.sizes, self.used = slots, sizes, used
        self.groups = {i: own for i, own in enumerate(groups) if np.isin(own, used).any()}
        self.cells = {i: int(np.prod(sizes[own])) for i, own in self.groups.items()}
        self.tables = {i: np.zeros((width, slots * n), np.int64) for i, n in self.cells.items()}

    def add(self, code_of: Callable, slot: np.ndarray, stats: list[np.ndarray], counted: bool, whole: Callable = lambda sums: sums) -> None:
        """More rows: their joint bins by the group's number, nodes and statistics, the last of which with `counted` is 1.

        `whole` turns the sums of statistics that are summed as one number into those that are wanted.
        """
        for i, table in self.tables.items():
            place = slot * self.cells[i] + code_of(i) if self.slots > 1 else code_of(i)
            found = [np.bincount(place, s, table.shape[1]).astype(np.int64) for s in stats]
            if counted:
                found.append(np.bincount(place, minlength=table.shape[1]))
            for own, part in zip(table, whole(found)):
                own += part

    def sums(self) -> np.ndarray:
        """Slots x cells x statistics."""
        starts = dict(zip(self.used.tolist(), np.concatenate([[0], np.cumsum(self.sizes[self.used])]).tolist()))
        width = next(iter(self.tables.values())).shape[0] if self.tables else 0
        out = np.zeros((self.slots, int(self.sizes[self.used].sum()), width), np.int64)
        for i, group in self.groups.items():
            table = self.tables[i]
            for f in group:  # feature by feature the table loses the one that is done
                table = table.reshape(width, self.slots, int(self.sizes[f]), -1)
                if f in starts:
                    out[:, starts[f] : starts[f] + int(self.sizes[f])] = table.sum(axis=3).transpose(1, 2, 0)
                table = table.sum(axis=2)
        return out


def summed_jointly(pieces, slots: int, sizes: np.ndarray, groups: list[list[int]], used: np.ndarray, counted: bool) -> np.ndarray:
    """Histograms of the used features, slots x cells x statistics, of pieces (joint bins per group, slots, statistics).

    With `counted` the rows are the last statistic.
    """
    held = _JointSums(slots, sizes, groups, used, len(pieces[0][2]) + counted if pieces else 0)
    for codes, own, stats in pieces:
        held.add(codes.__getitem__, own, stats, counted)
    return held.sums()


def drawn_columns(places: np.ndarray, features: int, take: int, *salts: int) -> np.ndarray:
    """For each node `take` features, by a hash: nodes x features."""
    order = mix(places.astype(np.uint64)[:, None] * np.uint64(1 << 12) + np.arange(features, dtype=np.uint64)[None, :], *salts)
    rank = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1, kind="stable")
    return rank < take


# Boosting


@dataclass(frozen=True)
class Fit:
    """One of the models that grow together: the fold it leaves out, the weight of label 1, and where margins start."""

    left_out: int | None = None
    positive_weight: float = 1.0
    base: float = 0.0


@dataclass(frozen=True)
class Boosting:
    rounds: int
    rules: Rules
    rate: float
    rows: float
    columns: float
    logistic: bool
    scale: float = 1.0  # labels are divided by it; a power of two
    seed: int = 42


def _gradients(block: Block | np.ndarray, margin: np.ndarray, fit: Fit, boost: Boosting) -> tuple[np.ndarray, np.ndarray]:
    label = block.label if isinstance(block, Block) else block
    if boost.logistic:
        p = 1.0 / (1.0 + np.exp(-margin))
        w = np.where(label == 1, fit.positive_weight, 1.0)
        return (label - p) * w, np.maximum(p * (1 - p), 1e-16) * w
    return label / boost.scale - margin, np.ones(len(margin))


@dataclass
class _Chunk:
    """Rows of a task by their joint bins, groups x rows, with one margin per fit."""

    codes: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    key: np.ndarray
    margin: np.ndarray


@dataclass(frozen=True)
class _Layout:
    """Where the bins of a feature are in the joint bins of its group."""

    sizes: np.ndarray
    groups: list[list[int]]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each feature the group, and how many combinations of the features behind it there are."""
        group, after = np.zeros(len(self.sizes), int), np.ones(len(self.sizes), int)
        for i, own in enumerate(self.groups):
            for at, f in enumerate(own):
                group[f], after[f] = i, int(np.prod(self.sizes[own[at + 1 :]]))
        return group, after

    def nodes_of(self, tree: Tree, codes: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        group, after = self.places()
        n = codes.shape[1]
        at, rows = np.zeros(n, np.int32), np.arange(n)
        f = tree.feature
        place, after, size = group[f] * n, after[f].astype(np.int32), self.sizes[f].astype(np.int32)
        for _ in range(int(tree.place.max()).bit_length() - 1):
            if len(rows) < n or (f[at] < 0).any():
                rows = rows[f[at[rows]] >= 0]
            own = at[rows]
            cell = codes.ravel().take(place[own] + rows) // after[own] % size[own]
            at[rows] = tree.left[own] + (cell > tree.cut[own])
        return at


def _begun(parts: list[Block], layout: _Layout, fits: list[Fit], step: int) -> Iterable[_Chunk]:
    base = np.array([f.base for f in fits])[:, None]
    for block in _chunked(parts, step):
        codes = np.stack([joint_bins(block.bins, layout.sizes, g) for g in layout.groups])
        yield _Chunk(codes, block.label, block.fold, block.key, np.repeat(base, len(block.label), axis=1))


def _advanced(chunks: Iterable[_Chunk], layout: _Layout, trees: list[Tree]) -> Iterable[_Chunk]:
    """The rows with the margins that follow from one more tree per fit."""
    for c in chunks:
        margin = np.stack([own + tree.value[layout.nodes_of(tree, c.codes)] for own, tree in zip(c.margin, trees)])
        yield _Chunk(c.codes, c.label, c.fold, c.key, margin)


def _level(chunks: Iterable[_Chunk], layout: _Layout, fits: list[Fit], boost: Boosting, trees: list[Tree], wanted: list[list[int]], used: np.ndarray, t: int) -> np.ndarray:
    """Fit after fit the histograms of the wanted nodes over the used features, in one row of numbers."""
    cells = int(layout.sizes[used].sum())
    total = np.zeros(sum(map(len, wanted)) * cells * _stats(boost), np.int64)
    for c in chunks:
        drawn = mix(c.key, boost.seed, t, 1) < np.uint64(int(boost.rows * float(1 << 63)) * 2 - 1)
        sums = []
        for m, (tree, nodes, fit) in enumerate(zip(trees, wanted, fits)):
            if not nodes:
                continue
            slots = np.full(len(tree.feature), -1)
            slots[nodes] = np.arange(len(nodes))
            slot = slots[layout.nodes_of(tree, c.codes)]
            rows = np.flatnonzero((slot >= 0) & drawn & (c.fold != fit.left_out) if fit.left_out is not None else (slot >= 0) & drawn)
            g, h = _gradients(c.label[rows], c.margin[m, rows], fit, boost)
            whole = [np.rint(x * (1 << SHIFT)) for x in ((g, h) if boost.logistic else (g,))]
            piece = (c.codes[:, rows], slot[rows], whole)
            sums.append(summed_jointly([piece], len(nodes), layout.sizes, layout.groups, used, _counted(boost)).ravel())
        total += np.concatenate(sums)
    return total


def _counted(boost: Boosting) -> bool:
    """Rows need no sums of their own where those of h imply them: a split's least weight leaves a row on either side."""
    return not boost.logistic or boost.rules.least_weight <= 0 or boost.rules.least_leaf > 1 or boost.rules.least_split > 2


def _stats(boost: Boosting) -> int:
    return 1 + boost.logistic + _counted(boost)


def _split_all(tree: Tree, nodes: list[int], found: tuple, rules: Rules, unit: float, rate: float) -> list[tuple[int, int, int]]:
    """Split nodes by what `best_splits` found; of each split (node, rows of its left child, rows of its right one)."""
    feature, cut, gain, left, total = found
    done = []
    for i, node in enumerate(nodes):
        tree.value[node] = rate * rules.value(total[i, 0] * unit, total[i, 1] * unit)
        tree.cover[node] = total[i, 1] * unit
        if feature[i] < 0:
            continue
        at = tree.split(node, int(feature[i]), int(cut[i]), float(gain[i]))
        for child, part in ((at, left[i]), (at + 1, total[i] - left[i])):
            tree.value[child] = rate * rules.value(part[0] * unit, part[1] * unit)
            tree.cover[child] = part[1] * unit
        done.append((node, int(left[i, 2]), int(total[i, 2] - left[i, 2])))
    return done


def _rounds(sizes: np.ndarray, fits: list[Fit], boost: Boosting, level, advance) -> list[list[Tree]]:
    """The trees of every fit; `level` sums wanted nodes over all rows, `advance` adds a round's trees to the margins."""
    rules, unit, features = boost.rules, 1.0 / (1 << SHIFT), len(sizes)
    grown: list[list[Tree]] = [[] for _ in fits]
    take = max(1, int(boost.columns * features))
    for t in range(boost.rounds):
        trees = [Tree.stump() for _ in fits]
        used = np.flatnonzero(drawn_columns(np.array([t]), features, take, boost.seed, 2)[0])
        shape = int(sizes[used].sum()), _stats(boost)
        # Per fit (wanted node, its sibling, the parent's histogram); the root has no sibling.
        todo: list[list[tuple]] = [[(0, None, None)] for _ in fits]
        for _ in range(rules.depth):
            flat = level(trees, [[one for one, _, _ in own] for own in todo], used, t)
            for m, tree in enumerate(trees):
                if not todo[m]:
                    continue
                n = len(todo[m]) * shape[0] * shape[1]
                own, flat = flat[:n].reshape(-1, *shape), flat[n:]
                if not boost.logistic:  # h is 1 a row
                    own = np.stack([own[..., 0], own[..., 1] << SHIFT, own[..., 1]], axis=-1)
                elif not _counted(boost):
                    own = own[..., [0, 1, 1]]
                known = {}
                for (one, other, parent), x in zip(todo[m], own):
                    known[one] = x
                    if other is not None:
                        known[other] = parent - x
                todo[m] = []
                nodes = sorted(known)
                feature, *rest = best_splits(np.stack([known[n] for n in nodes]), sizes[used], np.ones((len(nodes), len(used)), bool), rules, unit)
                for node, a, b in _split_all(tree, nodes, (np.where(feature < 0, -1, used[feature]), *rest), rules, unit, boost.rate):
                    at = int(tree.left[node])
                    todo[m].append((at, at + 1, known[node]) if a <= b else (at + 1, at, known[node]))
            if not any(todo):
                break
        for m, tree in enumerate(trees):
            grown[m].append(tree)
        if t + 1 < boost.rounds:
            advance(trees, t)
    return grown


#: Trees as rows: numbers of the fit and the tree, or of a group of rows, and the arrays as bytes.
TREE_COLUMNS = "feature binary, cut binary, left binary, value binary, cover binary, gain binary, place binary"
_KINDS = {"value": np.float64, "cover": np.float64, "gain": np.float64, "place": np.int64}


def _packed_tree(tree: Tree) -> dict[str, bytes]:
    return {n: getattr(tree, n).astype(_KINDS.get(n, np.int32)).tobytes() for n in Tree.__dataclass_fields__}


def _unpacked_tree(row) -> Tree:
    return Tree(**{n: np.frombuffer(row[n], _KINDS.get(n, np.int32)).astype(_KINDS.get(n, np.int64)) for n in Tree.__dataclass_fields__})


def boosted(packed: DataFrame, sizes: np.ndarray, fits: list[Fit], boost: Boosting) -> list[list[Tree]]:
    """The trees of every fit, in order. Each level of all fits' trees is one job over the blocks.

    The loop runs on an RDD of numpy arrays: a job is a plain map over what is in memory, without a query to plan, which would be most
    of the time of a small job. There are no more tasks than cores, each adds up what it holds, and only sums of the drawn features leave
    it, so that what the driver gets does not grow with the rows. Margins are stored anew every round, in the job of the next
    one's first level; every `FRESH` rounds they go to the shared folder, which ends their lineage. Few rows are one task's, and grow
    there in one job.
    """
    spark, features = packed.sparkSession, len(sizes)
    count = packed.count()
    tasks = 1 if count <= ONE_TASK_BLOCKS else min(spark.sparkContext.defaultParallelism, math.ceil(count / TASK_BLOCKS))
    heaviest = max(1.0, *(f.positive_weight for f in fits)) if boost.logistic else 1.0
    step = min(CHUNK_ROWS, max(BLOCK_ROWS, int((1 << 21) / heaviest)))  # sums within a chunk stay below 2 ** 53
    layout = _Layout(sizes, bundled(sizes, min(JOINT_CELLS, count * BLOCK_ROWS // tasks // 8)))
    if tasks == 1:
        return _boosted_by_one(packed, layout, fits, boost, step)

    def begin(rows):
        return _begun([unpacked(row, features) for row in rows], layout, fits, step)

    enable_checkpoints(spark)
    data = packed.repartition(tasks).rdd.mapPartitions(begin).persist(StorageLevel.MEMORY_AND_DISK)
    old = []

    def level(trees, wanted, used, t):
        parts = data.mapPartitions(lambda chunks: [_level(chunks, layout, fits, boost, trees, wanted, used, t)])
        found = parts.treeReduce(np.add) if len(fits) > 1 or tasks > 16 else sum(parts.collect())
        while old:
            old.pop().unpersist()
        return found

    def advance(trees, t):
        nonlocal data
        old.append(data)
        data = data.mapPartitions(lambda chunks: _advanced(chunks, layout, trees)).persist(StorageLevel.MEMORY_AND_DISK)
        if (t + 1) % FRESH == 0:
            data.checkpoint()

    grown = _rounds(sizes, fits, boost, level, advance)
    data.unpersist()
    return grown


class _Step:
    """What a level's splits do to rows, by node: the group whose joint bin tells, and by node and joint bin whether a row goes right."""

    def __init__(self, tree: Tree, layout: _Layout, bin_of: np.ndarray):
        inner = tree.feature >= 0
        f = np.where(inner, tree.feature, 0)
        self.group = layout.places()[0][f]
        self.cells = bin_of.shape[1]
        self.right = ((bin_of[f] > tree.cut[:, None]) & inner[:, None]).ravel()
        self.child = np.where(inner, tree.left, np.arange(len(f))).astype(np.int16)


class _Kept:
    """Rows that stay in their task for a whole fit, with the margins of every fit and, in a round, gradients and nodes."""

    def __init__(self, block: Block, layout: _Layout, fits: list[Fit], boost: Boosting):
        n = len(block.label)
        self.label, self.fold, self.key, self.fits, self.boost, self.round = block.label, block.fold, block.key, fits, boost, -1
        self.codes = np.concatenate([joint_bins(block.bins, layout.sizes, g) for g in layout.groups])
        self.n, self.order = n, np.arange(n)
        self.margin = [np.full(n, f.base, float) for f in fits]
        self.nodes: list[np.ndarray] = []

    def begin(self, t: int) -> None:
        """All rows stand at the roots of round t."""
        boost, self.round = self.boost, t
        drawn = mix(self.key, boost.seed, t, 1) < np.uint64(int(boost.rows * float(1 << 63)) * 2 - 1)
        self.drawn = [drawn & (self.fold != f.left_out) if f.left_out is not None else drawn for f in self.fits]
        self.stats = []
        for margin, fit in zip(self.margin, self.fits):
            g, h = _gradients(self.label, margin, fit, boost)
            self.stats.append([np.rint(x * (1 << SHIFT)) for x in ((g, h) if boost.logistic else (g,))])
        self.nodes = [np.zeros(self.n, np.int16) for _ in self.fits]

    def descend(self, m: int, step: _Step) -> np.ndarray:
        """The node that each row has come to by the last level's splits."""
        at = self.nodes[m]
        went = self.codes.take((step.group * self.n).take(at) + self.order)
        self.nodes[m] = step.child.take(at) + step.right.take(at.astype(np.int64) * step.cells + went)
        return self.nodes[m]


def _grown_here(parts: Iterable[Block], layout: _Layout, fits: list[Fit], boost: Boosting, step: int, total: Callable) -> list[list[Tree]]:
    """The trees of every fit, from this task's rows; `total` adds up what tasks have summed."""
    chunks = [_Kept(block, layout, fits, boost) for block in _chunked(parts, step)]
    group, after = layout.places()
    most = max(int(np.prod(layout.sizes[own])) for own in layout.groups)
    bin_of = (np.arange(most) // after[:, None] % layout.sizes[:, None]).astype(np.uint8)  # of each feature by joint bin

    def level(trees, wanted, used, t):
        out = []
        for m, (tree, nodes) in enumerate(zip(trees, wanted)):
            if not nodes:
                continue
            moved = _Step(tree, layout, bin_of) if len(tree.feature) > 1 else None
            slots = np.full(len(tree.feature), -1, np.int16)
            slots[nodes] = np.arange(len(nodes))
            held = _JointSums(len(nodes), layout.sizes, layout.groups, used, _stats(boost))
            for c in chunks:
                if c.round != t:
                    c.begin(t)
                if moved:
                    slot = slots.take(c.descend(m, moved))
                    rows = np.flatnonzero((slot >= 0) & c.drawn[m])
                    slot = slot.take(rows).astype(np.int64)
                else:
                    rows = np.flatnonzero(c.drawn[m])
                    slot = np.zeros(len(rows), np.int64)
                held.add(lambda i: c.codes[i * c.n : (i + 1) * c.n].take(rows), slot, [s.take(rows) for s in c.stats[m]], _counted(boost))  # noqa: B023
            out.append(held.sums().ravel())
        return total(np.concatenate(out))

    def advance(trees, t):
        for m, tree in enumerate(trees):
            moved = _Step(tree, layout, bin_of)
            for c in chunks:
                c.margin[m] += tree.value.take(c.descend(m, moved))

    return _rounds(layout.sizes, fits, boost, level, advance)


def _totals(folder: str, me: int, tasks: int) -> Callable:
    """Adds up what the tasks of a barrier job have summed: each writes its part to the shared folder and reads those of the others.

    Spark's own exchange between barrier tasks looks for answers once a second, which is many times what a level takes.
    """
    asked = 0

    def file(i: int, n: int) -> str:
        return f"{folder}/{n}-{i}"

    def total(part: np.ndarray) -> np.ndarray:
        nonlocal asked
        part.tofile(f"{file(me, asked)}.part")
        os.replace(f"{file(me, asked)}.part", file(me, asked))
        out, others = part, [i for i in range(tasks) if i != me]
        while others:
            waiting = []
            for i in others:
                try:
                    out = out + np.fromfile(file(i, asked), np.int64)
                except FileNotFoundError:
                    waiting.append(i)
            if others := waiting:
                time.sleep(0.0005)
        # All tasks have written this part, so all have read the one before.
        if asked:
            os.remove(file(me, asked - 1))
        asked += 1
        return out

    return total


_TREES = pa.schema([("fit", pa.int32()), *[(n, pa.binary()) for n in Tree.__dataclass_fields__]])


def _packed_trees(grown: list[list[Tree]]) -> Iterable[pa.RecordBatch]:
    for m, trees in enumerate(grown):
        yield pa.RecordBatch.from_pylist([{"fit": m, **_packed_tree(t)} for t in trees], _TREES)


def _unpacked_trees(rows: DataFrame, fits: int) -> list[list[Tree]]:
    grown: list[list[Tree]] = [[] for _ in range(fits)]
    for row in rows.collect():  # the models
        grown[row["fit"]].append(_unpacked_tree(row))
    return grown


def _boosted_by_one(packed: DataFrame, layout: _Layout, fits: list[Fit], boost: Boosting, step: int) -> list[list[Tree]]:
    def run(batches):
        parts = _blocks_of(batches, len(layout.sizes))
        yield from _packed_trees(_grown_here(parts, layout, fits, boost, step, lambda sums: sums))

    return _unpacked_trees(packed.coalesce(1).mapInArrow(run, f"fit int, {TREE_COLUMNS}"), len(fits))


def boosted_together(packed: DataFrame, sizes: np.ndarray, fits: list[Fit], boost: Boosting) -> list[list[Tree]]:
    """The same trees as those of `boosted`, grown by one barrier job whose tasks keep their rows for the whole fit.

    A level is then one pass over rows at hand and an exchange of sums, without a job to start. This needs a shared
    folder that tasks open as files, free cores for all tasks at once, and rows that fit there; else each level is a job.
    """
    spark, features = packed.sparkSession, len(sizes)
    count = packed.count()
    folder = local_folder(spark, "sums")
    tasks = min(slots(spark), math.ceil(count / TASK_BLOCKS))
    if count <= ONE_TASK_BLOCKS or tasks < 2 or folder is None:
        return boosted(packed, sizes, fits, boost)
    least = 28 + 2 * len(bundled(sizes, min(JOINT_CELLS, count * BLOCK_ROWS // tasks // 8)))  # of a row's bytes, those that all fits share
    at_once = int((tasks * KEPT_BYTES / (count * BLOCK_ROWS) - least) // 27)
    if at_once < 1:
        return boosted(packed, sizes, fits, boost)
    if at_once < len(fits):  # fits do not depend on each other
        return [trees for a in range(0, len(fits), at_once) for trees in boosted_together(packed, sizes, fits[a : a + at_once], boost)]
    heaviest = max(1.0, *(f.positive_weight for f in fits)) if boost.logistic else 1.0
    step = min(CHUNK_ROWS, max(BLOCK_ROWS, int((1 << 21) / heaviest)))  # as in `boosted`
    layout = _Layout(sizes, bundled(sizes, min(JOINT_CELLS, count * BLOCK_ROWS // tasks // 8)))

    def run(batches):
        context = BarrierTaskContext.get()
        me = context.partitionId()
        place = f"{folder}/{context.allGather(uuid.uuid4().hex)[0]}"  # another one when the job is tried again
        os.makedirs(place, exist_ok=True)
        parts = _blocks_of(batches, features)
        grown = _grown_here(parts, layout, fits, boost, step, _totals(place, me, tasks))
        if me == 0:
            yield from _packed_trees(grown)

    return _unpacked_trees(packed.repartition(tasks).mapInArrow(run, f"fit int, {TREE_COLUMNS}", barrier=True), len(fits))


# Forests


@dataclass(frozen=True)
class Bagging:
    trees: int
    rules: Rules
    take: int  # features that a node may split by
    scale: float = 1.0
    seed: int = 42


#: Chances that a row is drawn at most 0, 1, 2, ... times when as many rows are drawn as there are.
DRAWN = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


#: Keys that are mixed together, so that what comes between stays in the processor's cache.
MIXED_ROWS = 1 << 14


def _bag(block: Block, fit: Fit, bagging: Bagging, m: int, j: int) -> np.ndarray:
    """How often each row is in the sample of a tree."""
    bag = np.zeros(len(block.key), np.uint8)
    for a in range(0, len(bag), MIXED_ROWS):
        u = (mix(block.key[a : a + MIXED_ROWS], bagging.seed, m, j) >> np.uint64(11)).astype(float) / float(1 << 53)
        for chance in DRAWN:
            bag[a : a + MIXED_ROWS] += u >= chance
    if fit.left_out is not None:
        bag[block.fold == fit.left_out] = 0
    return bag


def _weighed(label: np.ndarray, bag: np.ndarray, fit: Fit, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number g and h of the drawn rows: weight times label, and weight."""
    w = bag * np.where(label == 1, fit.positive_weight, 1.0)
    return np.rint(w * (label / scale) * (1 << SHIFT)), np.rint(w * (1 << SHIFT))


def _forest_sums(parts: list[Block], tree: Tree, nodes: np.ndarray, bags: list[np.ndarray], fit: Fit, sizes, allowed: np.ndarray, bagging: Bagging, codes: list[np.ndarray] | None, groups: list[list[int]]) -> np.ndarray:
    """Histograms of a tree's wanted nodes; features that a node may not be split by are left at 0 where nodes differ in them.

    `codes` are the parts' joint bins, for nodes that may use all features.
    """
    slots = np.full(len(tree.feature), -1)
    slots[nodes] = np.arange(len(nodes))
    starts, cells = np.cumsum(sizes) - sizes, int(np.sum(sizes))
    drawn = np.nonzero(allowed)[1].reshape(len(nodes), -1)
    out = np.zeros((len(nodes), cells, 3), np.int64)
    for k, (block, bag) in enumerate(zip(parts, bags)):
        slot = np.where(bag > 0, slots[tree.nodes_of(block.bins)], -1)
        rows = np.flatnonzero(slot >= 0)
        own = slot[rows]
        if codes:
            out += _whole_sums(codes[k], groups, *_weighed(block.label, bag, fit, bagging.scale), rows, own, len(nodes), np.asarray(sizes)).transpose(1, 2, 0)
            continue
        stats = [x[rows] for x in _weighed(block.label, bag, fit, bagging.scale)]
        flat, n = block.bins.ravel(), block.bins.shape[1]
        cell = np.concatenate([own * cells + starts[f] + flat.take(f * n + rows) for f in (d[own] for d in drawn.T)])
        for i, x in enumerate([*[np.tile(x, len(drawn.T)) for x in stats], None]):
            out[:, :, i] += np.bincount(cell, x, len(nodes) * cells).astype(np.int64).reshape(-1, cells)
    return out


def _drawn_sums(bins: np.ndarray, g: np.ndarray, h: np.ndarray, live: np.ndarray, slot: np.ndarray, drawn: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of g, h and rows per node, feature and bin, in one row of cells; each node has features of its own (nodes x features)."""
    width = sizes[drawn]
    ends = np.cumsum(width.ravel())
    starts = (ends - width.ravel()).reshape(drawn.shape)
    own = np.concatenate([starts[:, c][slot] + bins.ravel().take(drawn[:, c][slot] * bins.shape[1] + live) for c in range(drawn.shape[1])])
    out = [np.bincount(own, np.tile(x[live], drawn.shape[1]), ends[-1]) for x in (g, h)]
    return np.stack([*out, np.bincount(own, minlength=ends[-1])]).astype(np.int64)


#: Bits that the draws of a small node's rows fit in.
DRAWS = 20


def _whole_sums(codes: np.ndarray, groups: list[list[int]], g: np.ndarray, h: np.ndarray, rows: np.ndarray, slot: np.ndarray, slots: int, sizes: np.ndarray) -> np.ndarray:
    """Sums of g, h and rows, statistics x nodes x cells, of some rows over all features. Where h counts draws, draws and rows are summed as one number."""
    draws = h[rows] / (1 << SHIFT)
    counting = bool((draws == np.rint(draws)).all()) and draws.sum() < 1 << DRAWS
    stats = [g[rows], draws + (1 << DRAWS) if counting else h[rows]]
    out = summed_jointly([(codes[:, rows], slot, stats)], slots, sizes, groups, np.arange(len(sizes)), not counting).transpose(2, 0, 1)
    if counting:
        out = np.stack([out[0], (out[1] & ((1 << DRAWS) - 1)) << SHIFT, out[1] >> DRAWS])
    return out


def _searched(sums: np.ndarray, drawn: np.ndarray, sizes: np.ndarray, rules: Rules) -> tuple:
    """(gain, feature, cut, left sums, totals) of each node's best split, from sums of g, h and rows in one row of cells."""
    unit = 1.0 / (1 << SHIFT)
    k, take = drawn.shape
    width = sizes[drawn].ravel()
    starts = np.cumsum(width) - width
    run = np.cumsum(sums, axis=1)
    before = np.where(starts > 0, run[:, starts - 1], 0)
    left = run - np.repeat(before, width, axis=1)
    first = starts[::take]
    totals = left[:, first + width[::take] - 1]
    part = np.repeat(np.arange(k * take), width)
    node = part // take
    gl, hl, nl = left[0] * unit, left[1] * unit, left[2]
    gr, hr, nr = (x * f for x, f in zip(totals[:, node] - left, (unit, unit, 1)))
    gain = rules.worth(gl, hl) + rules.worth(gr, hr) - rules.worth(totals[0] * unit, totals[1] * unit)[node]
    fine = (nl >= rules.least_leaf) & (nr >= rules.least_leaf) & (totals[2] >= rules.least_split)[node]
    fine &= (hl >= rules.least_weight) & (hr >= rules.least_weight)
    gain = np.where(fine, gain, -np.inf)
    best = np.maximum.reduceat(gain, first)
    tops = np.flatnonzero(gain == best[node])
    at_best = tops[np.searchsorted(tops, first)]  # ties go to the first feature and the lowest bin
    return best, drawn.ravel()[part[at_best]], at_best - starts[part[at_best]], left[:, at_best], totals


def _split_here(out: dict[str, list], nodes: np.ndarray, found: tuple, rules: Rules) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Split nodes of a tree of lists: the nodes that were split, for each node the first of its children among the new ones or -1, and these."""
    unit = 1.0 / (1 << SHIFT)
    best, split, cut, left, totals = found
    lefts, sums_of = left.astype(float), totals.astype(float)
    new, below = [], np.full(len(nodes), -1)
    chosen = np.flatnonzero(best > 1e-9)
    for i in chosen.tolist():
        one, at = int(nodes[i]), len(out["feature"])
        out["feature"][one], out["cut"][one], out["left"][one], out["gain"][one] = int(split[i]), int(cut[i]), at, float(best[i])
        for half in (lefts[:, i], sums_of[:, i] - lefts[:, i]):
            values = (-1, 0, -1, rules.value(half[0] * unit, half[1] * unit), half[1] * unit, 0.0, 2 * out["place"][one] + len(out["feature"]) - at)
            for name, x in zip(out, values):
                out[name].append(x)
        below[i] = len(new)
        new += [at, at + 1]
    return chosen, below, new


def _with_siblings(found: np.ndarray, parents: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Sums of both children of each node from those of the smaller one, which `smaller` tells: 1 for the right one."""
    pair = np.stack([found, parents - found], axis=2)  # the smaller one first
    turned = np.where(smaller[None, :, None, None] == 1, pair[:, :, ::-1], pair)
    return turned.reshape(3, 2 * len(smaller), -1)


def _tree_of(out: dict[str, list]) -> Tree:
    kinds = {"value": float, "cover": float, "gain": float}
    return Tree(**{name: np.array(x, kinds.get(name, np.int64)) for name, x in out.items()})


def grown_here(bins: np.ndarray, g: np.ndarray, h: np.ndarray, sizes, place: int, depth: int, bagging: Bagging, m: int, j: int) -> Tree:
    """The subtree below a node from its rows, split for split as the passes over blocks would grow it.

    Where nodes may use all features, only the smaller of two siblings is summed, over joint bins of few cells.
    """
    rules, unit, sizes = bagging.rules, 1.0 / (1 << SHIFT), np.asarray(sizes)
    features = len(sizes)
    out = {"feature": [-1], "cut": [0], "left": [-1], "value": [0.0], "cover": [0.0], "gain": [0.0], "place": [place]}
    out["value"][0], out["cover"][0] = rules.value(g.sum() * unit, h.sum() * unit), h.sum() * unit
    nodes = np.array([0])
    live, slot = np.arange(len(g)), np.zeros(len(g), np.int64)
    all_used = bagging.take >= features
    if all_used:
        groups = bundled(sizes, BINS)
        codes = np.stack([joint_bins(bins, sizes, own) for own in groups])
        known = _whole_sums(codes, groups, g, h, live, slot, 1, sizes)
    for level in range(depth):
        k = len(nodes)
        if all_used:
            drawn = np.tile(np.arange(features), (k, 1))
            sums = known.reshape(3, -1)
        else:
            places = np.array([out["place"][n] for n in nodes])
            allowed = drawn_columns(places, features, bagging.take, bagging.seed, m, j, 3)
            drawn = np.nonzero(allowed)[1].reshape(k, -1)
            sums = _drawn_sums(bins, g, h, live, slot, drawn, sizes)
        found = _searched(sums, drawn, sizes, rules)
        best, split, cut, left, totals = found
        chosen, below, new = _split_here(out, nodes, found, rules)
        if not new or level + 1 == depth:
            break
        inside = np.flatnonzero(below[slot] >= 0)
        live, own = live[inside], slot[inside]
        slot = below[own] + (bins.ravel().take(split[own] * bins.shape[1] + live) > cut[own])
        nodes = np.array(new)
        if all_used:
            smaller = (totals[2, chosen] < 2 * left[2, chosen]).astype(np.int64)  # 1 where the right child has fewer rows
            rows = np.flatnonzero(smaller[slot // 2] == slot % 2)
            known = _with_siblings(_whole_sums(codes, groups, g, h, live[rows], slot[rows] // 2, len(chosen), sizes), known[:, chosen], smaller)
    return _tree_of(out)


def _attached(tree: Tree, node: int, below: Tree) -> None:
    """Replace a leaf by a subtree."""
    offset = len(tree.feature) - 1  # its root takes the leaf's place, the others go behind
    for name in ("feature", "cut", "value", "cover", "gain"):
        getattr(tree, name)[node] = getattr(below, name)[0]
    left = np.where(below.left >= 0, below.left + offset, -1)
    tree.left[node] = left[0]
    for name in ("feature", "cut", "value", "cover", "gain", "place"):
        setattr(tree, name, np.concatenate([getattr(tree, name), getattr(below, name)[1:]]))
    tree.left = np.concatenate([tree.left, left[1:]])


def forest(packed: DataFrame, sizes: np.ndarray, fits: list[Fit], bagging: Bagging, local_rows: int = LOCAL_ROWS) -> list[list[Tree]]:
    """The trees of every fit. Nodes of more than `local_rows` rows are split by passes over the blocks.

    In a pass a task sums what it reads, tree by tree; a tree's sums meet in one task, which finds the splits. Only these come to the driver.
    """
    rules = bagging.rules
    folds = packed.select("fold").mapInArrow(_fold_counts, "fold int, n long").groupBy("fold").agg(F.sum("n").alias("n")).collect()  # a handful
    rows = [sum(r["n"] for r in folds if r["fold"] != fit.left_out) for fit in fits]
    trees = [[Tree.stump() for _ in range(bagging.trees)] for _ in fits]
    large = [(m, j, [0]) for m in range(len(fits)) for j in range(bagging.trees) if rows[m] > local_rows]
    small = [(m, j, 0) for m in range(len(fits)) for j in range(bagging.trees) if rows[m] <= local_rows]
    for depth in range(rules.depth):
        if not large:
            break
        after = []
        todo = [(m, j, trees[m][j], np.array(nodes)) for m, j, nodes in large]
        for i, *found in _forest_splits(packed, sizes, fits, bagging, todo):
            m, j, tree, nodes = todo[i]
            again = []
            for node, a, b in _split_all(tree, nodes.tolist(), found, rules, 1.0 / (1 << SHIFT), 1.0):
                for child, n in ((int(tree.left[node]), a), (int(tree.left[node]) + 1, b)):
                    if n > local_rows:
                        again.append(child)
                    elif n >= rules.least_split and depth + 1 < rules.depth:
                        small.append((m, j, child))
            if again:
                after.append((m, j, again))
        large = after
    if small:
        _grow_small(packed, sizes, fits, bagging, trees, small)
    return trees


def _fold_counts(batches):
    for batch in batches:
        for fold in batch.column("fold").to_pylist():
            values, n = np.unique(np.frombuffer(fold, "<i4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), pa.array(n.astype(np.int64))], ["fold", "n"])


def _forest_splits(packed: DataFrame, sizes: np.ndarray, fits: list[Fit], bagging: Bagging, todo: list[tuple]) -> Iterable[tuple]:
    """Of trees (fit, tree number, tree, nodes) the number in the list and what `best_splits` finds for the nodes."""
    spark, features, unit = packed.sparkSession, len(sizes), 1.0 / (1 << SHIFT)
    shared = spark.sparkContext.broadcast(todo)
    groups = bundled(np.asarray(sizes), JOINT_CELLS // 8) if bagging.take >= features else []

    def columns(i: int) -> np.ndarray:
        m, j, tree, nodes = shared.value[i]
        return drawn_columns(tree.place[nodes], features, bagging.take, bagging.seed, m, j, 3)

    def add(batches):
        parts = list(_chunked([unpacked(row, features) for batch in batches for row in batch.to_pylist()], CHUNK_ROWS // 8))
        codes = [np.stack([joint_bins(block.bins, sizes, own) for own in groups]) for block in parts] if groups else None
        for i, (m, j, tree, nodes) in enumerate(shared.value) if parts else ():
            bags = [_bag(block, fits[m], bagging, m, j) for block in parts]
            sums = _forest_sums(parts, tree, nodes, bags, fits[m], sizes, columns(i), bagging, codes, groups)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["tree", "sums"])

    def choose(key, frame: pd.DataFrame) -> pd.DataFrame:
        i = int(key[0])
        allowed = columns(i)
        sums = sum(np.frombuffer(x, np.int64) for x in frame["sums"]).reshape(len(allowed), -1, 3)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # Where nodes differ in their features, a node's first feature may have no sums: its rows are those of one that it may use.
        first = [starts[np.flatnonzero(a)[0]] for a in allowed]
        total = np.stack([sums[n, s : s + sizes[np.searchsorted(starts, s)]].sum(0) for n, s in enumerate(first)])
        feature, cut, gain, left, _ = best_splits(sums, sizes, allowed, bagging.rules, unit, total)
        found = [feature.astype(np.int64), cut.astype(np.int64), gain.astype(float), left.astype(np.int64), total.astype(np.int64)]
        return pd.DataFrame({"tree": [i], **{f"found{k}": [x.tobytes()] for k, x in enumerate(found)}})

    partial_sums = packed.mapInArrow(add, "tree int, sums binary")
    chosen = partial_sums.groupBy("tree").applyInPandas(choose, ", ".join(["tree int", *[f"found{k} binary" for k in range(5)]]))
    for row in chosen.collect():  # the splits of a level
        feature, cut, gain, left, total = (np.frombuffer(row[f"found{k}"], float if k == 2 else np.int64) for k in range(5))
        yield row["tree"], feature, cut, gain, left.reshape(-1, 3), total.reshape(-1, 3)


def _grow_small(packed: DataFrame, sizes, fits: list[Fit], bagging: Bagging, trees, small: list[tuple[int, int, int]]) -> None:
    """Bring the rows of each small node to one task, which grows the rest of its tree."""
    features, rules = len(sizes), bagging.rules
    by_tree: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for group, (m, j, node) in enumerate(small):
        by_tree.setdefault((m, j), []).append((group, node))
    model = packed.sparkSession.sparkContext.broadcast([(m, j, trees[m][j], own) for (m, j), own in by_tree.items()])
    places = [int(trees[m][j].place[node]) for m, j, node in small]

    def ship(batches):
        for block in _chunked([unpacked(row, features) for batch in batches for row in batch.to_pylist()], CHUNK_ROWS):
            for m, j, tree, own in model.value:
                bag = _bag(block, fits[m], bagging, m, j)
                # The tree's groups have numbers of their own here; rows are sorted by them.
                number = np.full(len(tree.feature), len(own), np.int16)
                number[[node for _, node in own]] = np.arange(len(own))
                mine = np.where(bag > 0, number[tree.nodes_of(block.bins)], np.int16(len(own)))
                order = np.argsort(mine, kind="stable")
                ends = np.cumsum(np.bincount(mine, minlength=len(own) + 1)[:-1])
                order = order[: ends[-1]]
                bins, label, drawn = block.bins[:, order], block.label[order], bag[order].astype(np.uint8)
                parts = [
                    (group, bins[:, a:b].tobytes(), label[a:b].tobytes(), drawn[a:b].tobytes())
                    for (group, _), a, b in zip(own, [0, *ends[:-1].tolist()], ends.tolist())
                    if b > a
                ]
                if parts:
                    columns = [pa.array(c, k) for c, k in zip(zip(*parts), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, ["group", "bins", "label", "bag"])

    def grow(key, frame: pd.DataFrame) -> pd.DataFrame:
        m, j, _ = small[key[0]]
        bins = np.concatenate([np.frombuffer(b, np.uint8).reshape(features, -1) for b in frame["bins"]], axis=1)
        label = np.concatenate([np.frombuffer(b, "<f8") for b in frame["label"]])
        bag = np.concatenate([np.frombuffer(b, np.uint8) for b in frame["bag"]])
        g, h = _weighed(label, bag, fits[m], bagging.scale)
        place = places[key[0]]
        below = grown_here(bins, g, h, sizes, place, rules.depth - (place.bit_length() - 1), bagging, m, j)
        return pd.DataFrame({"group": [key[0]], **{n: [x] for n, x in _packed_tree(below).items()}})

    shipped = packed.mapInArrow(ship, "group int, bins binary, label binary, bag binary").repartition(max(1, len(small) // 4), "group")
    for row in shipped.groupBy("group").applyInPandas(grow, f"group int, {TREE_COLUMNS}").collect():  # the model
        m, j, node = small[row["group"]]
        _attached(trees[m][j], node, _unpacked_tree(row))


# Forests over files


#: Rows of a file that trees are grown from, where nodes may use all features; joint bins there fit in a byte.
FILE_ROWS = 1 << 19
BYTE = 1 << 8


@dataclass(frozen=True)
class _RowFile:
    """Some rows as plain arrays in a file that every task can open: keys, labels, folds, and joint bins per group."""

    path: str
    rows: int
    classes: bool  # all labels are 0 or 1

    @staticmethod
    def write(folder: str, block: Block, layout: _Layout) -> "_RowFile":
        path, n = f"{folder}/{uuid.uuid4().hex}", len(block.label)
        with open(path, "wb") as out:
            for column in (block.key, block.label, block.fold, *(joint_bins(block.bins, layout.sizes, g).astype(np.uint8) for g in layout.groups)):
                column.tofile(out)
        return _RowFile(path, n, bool(((block.label == 0) | (block.label == 1)).all()))

    def keys(self) -> Block:
        """Keys and folds alone."""
        none = np.zeros(0)
        return Block(none, none, np.fromfile(self.path, "<i4", self.rows, offset=16 * self.rows), np.fromfile(self.path, "<i8", self.rows))

    def labels(self) -> np.ndarray:
        return np.fromfile(self.path, "<f8", self.rows, offset=8 * self.rows)

    def codes(self) -> np.ndarray:
        """Group after group the joint bins of all rows."""
        return np.fromfile(self.path, np.uint8, offset=20 * self.rows)


class _Rests:
    """Per file the drawn rows of a tree that are not in a leaf yet, with their nodes and draws; in files where they are many."""

    def __init__(self, rows: int):
        self.folder = tempfile.TemporaryDirectory(prefix="rests-") if rows * 7 > KEPT_BYTES else None
        self.held: dict[int, tuple] = {}

    def put(self, i: int, *columns: np.ndarray) -> None:
        if self.folder:
            np.savez(f"{self.folder.name}/{i}.npz", *columns)
        else:
            self.held[i] = columns

    def take(self, i: int) -> tuple:
        if not self.folder:
            return self.held[i]
        with np.load(f"{self.folder.name}/{i}.npz") as found:
            return tuple(found[n] for n in found.files)


def _file_stats(file: _RowFile, label: np.ndarray, bag: np.ndarray, fit: Fit, scale: float) -> tuple[list[np.ndarray], Callable]:
    """Statistics of some drawn rows, and how sums of g, h and rows follow from sums of these; draws and rows are summed as one number."""
    bits = 26  # a file's rows and their draws stay below 2 ** 53 together
    if fit.positive_weight == 1.0:
        draws, g = bag, np.rint(bag * (label * ((1 << SHIFT) / scale)))
        whole = lambda s: (s[0], s[1] >> bits << SHIFT, s[1] & ((1 << bits) - 1))
    elif file.classes and scale == 1.0:
        draws, g = bag * (label == 0), np.rint(np.arange(len(DRAWN) + 1) * fit.positive_weight * (1 << SHIFT)).take(bag) * label
        whole = lambda s: (s[0], s[0] + (s[1] >> bits << SHIFT), s[1] & ((1 << bits) - 1))
    else:
        return [*_weighed(label, bag, fit, scale), np.ones(len(bag))], lambda s: s
    return [g, draws * float(1 << bits) + 1.0], whole


def _tree_from_files(files: list[_RowFile], layout: _Layout, fit: Fit, bagging: Bagging, m: int, j: int) -> Tree:
    """A tree of a forest, split for split as `forest` grows it, level by level over the files; what is kept per row is its node and draws."""
    rules, sizes, groups, features = bagging.rules, layout.sizes, layout.groups, len(layout.sizes)
    out = {"feature": [-1], "cut": [0], "left": [-1], "value": [0.0], "cover": [0.0], "gain": [0.0], "place": [1]}
    all_used = bagging.take >= features
    group, after = layout.places()
    bin_of = (np.arange(BYTE) // after[:, None] % sizes[:, None]).astype(np.uint8)  # of each feature by joint bin
    rests = _Rests(sum(f.rows for f in files))
    nodes, wanted = np.array([0]), np.zeros(1, np.int16)
    for level in range(rules.depth):
        k = len(nodes)
        if all_used:
            drawn, slots = np.arange(features)[None, :], int(wanted.max()) + 1
            held = _JointSums(slots, sizes, groups, drawn[0], 3)
        else:
            places = np.array([out["place"][n] for n in nodes])
            drawn = np.nonzero(drawn_columns(places, features, bagging.take, bagging.seed, m, j, 3))[1].reshape(k, -1)
            width = sizes[drawn]
            starts = (np.cumsum(width.ravel()) - width.ravel()).reshape(drawn.shape)
            sums = np.zeros((3, int(width.sum())), np.int64)
        for i, file in enumerate(files):
            codes, label, n = file.codes(), file.labels(), file.rows
            if level:
                rows, slot, bag = rests.take(i)
                went = codes.take((group[split] * n).take(slot) + rows)
                slot = children.take(slot) + right.take(slot.astype(np.int32) * BYTE + went)
                rest = np.flatnonzero(slot >= 0)
                if len(rest) < len(slot):
                    rows, slot, bag = rows.take(rest), slot.take(rest), bag.take(rest)
            else:
                bag = _bag(file.keys(), fit, bagging, m, j)
                rows = np.flatnonzero(bag).astype(np.int32)
                slot, bag = np.zeros(len(rows), np.int16), bag.take(rows)
            rests.put(i, rows, slot, bag)
            if all_used:  # of two siblings the smaller alone
                slot = wanted.take(slot)
                own = np.flatnonzero(slot >= 0)
                rows, slot, bag = rows.take(own), slot.take(own).astype(np.int64), bag.take(own)
            stats, whole = _file_stats(file, label.take(rows), bag, fit, bagging.scale)
            if all_used:
                held.add(lambda g: codes[g * n : (g + 1) * n].take(rows), slot, stats, False, whole)  # noqa: B023
            else:
                for c in range(bagging.take):
                    place = starts[:, c].take(slot) + codes.take((drawn[:, c] * n).take(slot) + rows)
                    sums += whole([np.bincount(place, x, sums.shape[1]).astype(np.int64) for x in stats])
        if not all_used:
            found = _searched(sums, drawn, sizes, rules)
        else:
            sums = held.sums().transpose(2, 0, 1)
            known = _with_siblings(sums, known[:, chosen], smaller) if level else sums
            step = 1 << 8  # nodes whose sums stay in the processor's cache
            parts = [_searched(known[:, a : a + step].reshape(3, -1), np.tile(drawn, (min(step, k - a), 1)), sizes, rules) for a in range(0, k, step)]
            found = tuple(np.concatenate(x, axis=-1) for x in zip(*parts))
        best, split, cut, left, totals = found
        if not level:
            g, h = totals[0, 0] / (1 << SHIFT), totals[1, 0] / (1 << SHIFT)
            out["value"][0], out["cover"][0] = rules.value(g, h), h
        chosen, below, new = _split_here(out, nodes, found, rules)
        if not new:
            break
        children = np.where(below < 0, -2, below).astype(np.int16)
        right = ((bin_of[split] > cut[:, None]) & (below >= 0)[:, None]).astype(np.int16).ravel()
        if all_used:
            smaller = (totals[2, chosen] < 2 * left[2, chosen]).astype(np.int64)  # 1 where the right child has fewer rows
            wanted = np.full(len(new), -1, np.int16)
            wanted[2 * np.arange(len(chosen)) + smaller] = np.arange(len(chosen))
        nodes = np.array(new)
    return _tree_of(out)


def forest_by_tree(packed: DataFrame, sizes: np.ndarray, fits: list[Fit], bagging: Bagging) -> list[list[Tree]]:
    """The same trees as those of `forest`; each grows in one task, which reads all rows from files of the shared folder, a level at a time.

    No row is shuffled and no sums leave a task. This needs a shared folder that tasks open as files, and nodes that 16 bits can number.
    """
    spark, features = packed.sparkSession, len(sizes)
    folder = local_folder(spark, "rows")
    if folder is None or bagging.rules.depth > 14:
        return forest(packed, sizes, fits, bagging)
    heaviest = max(1.0, *(f.positive_weight for f in fits))
    all_used = bagging.take >= features
    step = min(FILE_ROWS if all_used else CHUNK_ROWS, max(BLOCK_ROWS, int((1 << 21) / heaviest)))  # sums within a file stay below 2 ** 53
    layout = _Layout(np.asarray(sizes), bundled(np.asarray(sizes), BINS) if all_used else [[f] for f in range(features)])

    def write(batches):
        os.makedirs(folder, exist_ok=True)
        parts = _blocks_of(batches, features)
        for file in (_RowFile.write(folder, block, layout) for block in _chunked(parts, step)):
            yield pa.RecordBatch.from_pylist([{"path": file.path, "rows": file.rows, "classes": file.classes}])

    tasks = max(1, math.ceil(packed.count() * BLOCK_ROWS / step))
    files = [_RowFile(**r.asDict()) for r in packed.repartition(tasks).mapInArrow(write, "path string, rows long, classes boolean").collect()]

    def grow(batches):
        for batch in batches:
            for number in batch.column("id").to_pylist():
                m, j = divmod(number, bagging.trees)
                tree = _tree_from_files(files, layout, fits[m], bagging, m, j)
                yield pa.RecordBatch.from_pylist([{"number": number, **_packed_tree(tree)}], pa.schema([("number", pa.int64()), *list(_TREES)[1:]]))

    trees = [[Tree.stump() for _ in range(bagging.trees)] for _ in fits]
    n = len(fits) * bagging.trees
    for row in spark.range(0, n, 1, n).mapInArrow(grow, f"number long, {TREE_COLUMNS}").collect():  # the model
        m, j = divmod(row["number"], bagging.trees)
        trees[m][j] = _unpacked_tree(row)
    shutil.rmtree(folder, ignore_errors=True)
    return trees


# Models


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


@dataclass
class TreeModel:
    """Trees as one flat table of nodes; a leaf leads to itself, so every row takes the same number of steps."""

    names: list[str]
    fill: list[float]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    average: bool
    logistic: bool

    @staticmethod
    def of(trees: list[Tree], grid: Binning, base: float, scale: float, average: bool, logistic: bool) -> "TreeModel":
        offsets = np.concatenate([[0], np.cumsum([len(t.feature) for t in trees])])
        parts = []
        for tree, at in zip(trees, offsets):
            leaf = tree.feature < 0
            cuts = [math.inf if f < 0 else grid.borders[f][c] for f, c in zip(tree.feature.tolist(), tree.cut.tolist())]
            here = np.arange(len(leaf)) + at
            parts.append((np.where(leaf, 0, tree.feature), np.array(cuts), np.where(leaf, here, tree.left + at), tree.value * scale, tree.cover, tree.gain))
        feature, threshold, left, value, cover, gain = (np.concatenate(x) for x in zip(*parts))
        depth = max(int(t.place.max()).bit_length() - 1 for t in trees)
        return TreeModel(
            list(grid.names), [float(x) for x in grid.fill], feature.astype(np.int32), threshold.astype(float), left.astype(np.int32), value.astype(float),
            cover.astype(float), gain.astype(float), offsets[:-1].astype(np.int32), depth, base * scale, average, logistic,
        )

    def margins(self, x: np.ndarray, step: int = 1024) -> np.ndarray:
        """The trees' answer to rows x features: a sum on the log-odds or label scale, or the forest's mean."""
        out = np.empty(len(x))
        for a in range(0, len(x), step):
            part = np.ascontiguousarray(x[a : a + step])
            flat, rows = part.reshape(-1), np.arange(len(part))[:, None] * part.shape[1]
            at = np.repeat(self.roots[None, :], len(part), axis=0)
            for _ in range(self.depth):
                at = self.left[at] + (flat[rows + self.feature[at]] > self.threshold[at])
            out[a : a + step] = self.value[at].mean(axis=1) if self.average else self.value[at].sum(axis=1)
        return out + self.base

    def vector(self) -> Column:
        return F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(x)) for n, x in zip(self.names, self.fill)])

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds `tree_vector`, the model's inputs, and `tree_margin`."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def answer(x: pa.Array) -> pa.Array:
            return pa.array(shared.value.margins(matrix(x)) if len(x) else [], pa.float64())

        return rows.withColumn("tree_vector", self.vector()).withColumn("tree_margin", answer("tree_vector"))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-F.col("tree_margin"))) if self.logistic else F.col("tree_margin")

    def importances(self) -> np.ndarray:
        """Shares of the features: of a boosted model the mean gain of a split, of a forest each tree's gains as shares."""
        inner = self.left != np.arange(len(self.left))
        if self.average:
            tree = np.searchsorted(self.roots, np.arange(len(self.left)), side="right") - 1
            total = np.bincount(tree, self.gain * inner, len(self.roots))
            share = np.where(inner, self.gain / np.where(total > 0, total, 1)[tree], 0.0)
            found = np.bincount(self.feature[inner], share[inner], len(self.names))
        else:
            found = np.bincount(self.feature[inner], self.gain[inner], len(self.names))
            found /= np.maximum(np.bincount(self.feature[inner], minlength=len(self.names)), 1)
        return found / found.sum() if found.sum() else found

    def save(self, path: str) -> None:
        """One Parquet row: the model is as large as its settings allow, whatever the data."""
        spark = SparkSession.getActiveSession()
        plain = {k: v for k, v in self.__dict__.items() if not isinstance(v, np.ndarray)}
        arrays = {k: v.tobytes() for k, v in self.__dict__.items() if isinstance(v, np.ndarray)}
        frame = spark.createDataFrame([(json.dumps(plain), *map(bytearray, arrays.values()))], ", ".join(["meta string", *[f"{k} binary" for k in arrays]]))
        frame.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TreeModel":
        row = spark.read.parquet(path).first().asDict()
        meta = json.loads(row.pop("meta"))
        kinds = {"feature": np.int32, "left": np.int32, "roots": np.int32}
        return TreeModel(**meta, **{k: np.frombuffer(v, kinds.get(k, np.float64)) for k, v in row.items()})


# Training


def power_above(x: float) -> float:
    """The smallest power of two that is not below x."""
    return 2.0 ** math.ceil(math.log2(x)) if x > 0 else 1.0


def label_facts(rows: DataFrame, label: str, fold: str | None, folds: list[int | None], classes: bool) -> list[dict]:
    """Per left-out fold the rows, the mean label, and negatives over positives, from one aggregation per fold value."""
    own = F.col(fold) if fold else F.lit(-1)
    # Whole-number sums, so that the mean does not depend on partitioning.
    top = rows.agg(F.max(F.abs(label))).first()[0] or 1.0
    unit = power_above(top) / (1 << SHIFT)
    got = rows.groupBy(own.alias("f")).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"), F.sum(F.rint(F.col(label) / F.lit(unit)).cast("long")).alias("s")
    ).collect()  # a handful of folds
    out = []
    for left_out in folds:
        n, p, s = (sum(r[c] for r in got if left_out is None or r["f"] != left_out) for c in ("n", "p", "s"))
        out.append({"n": n, "mean": s * unit / max(n, 1), "positives": p, "ratio": (n - p) / p if classes and p else 1.0, "top": top})
    return out


def train(rows: DataFrame, names: list[str], key: str, settings: dict, kind: str, classes: bool, left_out: list[int | None] | None = None, label: str = "label", fold: str | None = None) -> list[TreeModel]:
    """One model per entry of `left_out`: fitted to the labelled rows of the other folds, or to all for None.

    All of them share one table of bins. `kind` is "gbt" or "rf"; `classes` tells a 0/1 label, whose classes are
    balanced, from a number.
    """
    folds = left_out or [None]
    grid = binning(rows, names, settings.get("maxBins", BINS))
    place = new_path(rows.sparkSession, "binned")
    blocks(rows, grid, key, label, fold).write.parquet(place)
    packed = rows.sparkSession.read.schema(BLOCK).parquet(place)
    facts = label_facts(rows, label, fold, folds, classes)
    scale = 1.0 if classes else power_above(2 * facts[0]["top"])
    least = {"least_leaf": settings.get("minInstancesPerNode", 1), "least_split": settings.get("minSamplesSplit", 2)}
    if kind == "gbt":
        rules = Rules(settings["maxDepth"], settings.get("regAlpha", 0.0) / scale, settings.get("regLambda", 1.0), settings.get("minChildWeight", 1.0), **least)
        fits = [Fit(o, f["ratio"], 0.0 if classes else f["mean"] / scale) for o, f in zip(folds, facts)]
        boost = Boosting(settings["maxIter"], rules, settings["stepSize"], settings["subsamplingRate"], settings["colsampleByTree"], classes, scale, settings.get("seed", 42))
        grown = boosted_together(packed, grid.sizes, fits, boost)
        return [TreeModel.of(t, grid, f.base, scale, False, classes) for t, f in zip(grown, fits)]
    strategy = settings.get("featureSubsetStrategy", "sqrt" if classes else "all")
    take = {"sqrt": max(1, int(math.sqrt(len(names)))), "all": len(names)}[strategy]
    fits = [Fit(o, f["ratio"]) for o, f in zip(folds, facts)]
    bagging = Bagging(settings["numTrees"], Rules(settings["maxDepth"], **least), take, scale, settings.get("seed", 42))
    grown = forest(packed, grid.sizes, fits, bagging, settings["localRows"]) if "localRows" in settings else forest_by_tree(packed, grid.sizes, fits, bagging)
    return [TreeModel.of(t, grid, 0.0, scale, True, False) for t in grown]
