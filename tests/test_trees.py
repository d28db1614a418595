"""Histogram trees against plain loops, and independence of how rows are partitioned."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.functions.bits import ordered_bits
from tenura.operators import trees as T

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows with a numeric, a binary and a heavy-tailed feature, some of them missing, and both kinds of label."""
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 40, 600), rng.integers(0, 2, 600), np.exp(rng.normal(0, 3, 600))
    z = (a > 20) * 1.5 - b + (c > 1) * 0.7 + rng.normal(0, 0.5, 600)
    data = [
        (i, float(a[i]), int(b[i]), None if i % 50 == 7 else float(c[i]), float(z[i] > 0.5), float(10 * z[i]), int(i % 5)) for i in range(600)
    ]
    return spark.createDataFrame(data, "k long, a double, b int, c double, label double, value double, fold int").persist()


def packed(rows, label="label", fold=None):
    grid = T.binning(rows, NAMES)
    frame = T.blocks(rows, grid, "k", label, fold).persist()
    frame.count()
    return grid, frame


def whole(frame, features=3):
    """All blocks as one, in the order of the key."""
    parts = [T.unpacked(r, features) for r in frame.collect()]
    order = np.argsort(np.concatenate([p.key for p in parts]))
    return T.Block(
        np.concatenate([p.bins for p in parts], axis=1)[:, order],
        *[np.concatenate([getattr(p, n) for p in parts])[order] for n in ("label", "fold", "key")],
    )


def test_bits_sort_like_doubles(spark):
    values = [-math.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 72.0, math.inf]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(ordered_bits(F.col("x"))).collect()
    bits = [r[0] for r in got]
    assert bits == sorted(bits) and bits[4] == bits[5] and len(set(bits)) == len(values) - 1
    assert T.double_of(np.array(bits)).tolist() == [abs(v) if v == 0 else v for v in values]


def test_borders_are_those_of_the_values(rows):
    grid = T.binning(rows, NAMES)
    a = sorted({r[0] for r in rows.select("a").collect()})
    assert np.searchsorted(grid.borders[0], a).tolist() == list(range(len(a)))  # few values: a bin each
    assert len(grid.borders[1]) == 1 and 0 <= grid.borders[1][0] < 1
    c = np.array([r[0] for r in rows.select("c").where("c is not null").collect()])
    counts = np.bincount(np.searchsorted(grid.borders[2], c))
    assert 50 <= len(counts) <= T.BINS and counts.max() <= 3 * len(c) / T.BINS
    assert abs(grid.fill[2] / np.median(c) - 1) < 0.01
    other = T.binning(rows.repartition(7), NAMES)
    assert all((x == y).all() for x, y in zip(grid.borders, other.borders)) and grid.fill == other.fill


def same(one, two):
    assert len(one) == len(two)
    for x, y in zip(one, two):
        for name in T.Tree.__dataclass_fields__:
            assert np.array_equal(getattr(x, name), getattr(y, name)), name


BOOST = {"maxIter": 6, "maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 0.8, "colsampleByTree": 0.7, "regAlpha": 0.1, "regLambda": 1.0}


@pytest.mark.parametrize("kind, settings", [("gbt", BOOST), ("rf", {"numTrees": 5, "maxDepth": 5, "minSamplesSplit": 5, "minInstancesPerNode": 2, "localRows": 100})])
@pytest.mark.parametrize("classes", [True, False])
def test_models_do_not_depend_on_partitioning(rows, monkeypatch, kind, settings, classes):
    models = []
    for n in (30, 300, 1 << 13):  # 20 blocks, 2, and 1
        monkeypatch.setattr(T, "BLOCK_ROWS", n)
        label = "label" if classes else "value"
        models.append(T.train(rows.repartition(3), NAMES, "k", settings, kind, classes, label=label)[0])
    for other in models[1:]:
        for name in ("feature", "threshold", "left", "value", "cover", "gain", "roots"):
            assert np.array_equal(getattr(models[0], name), getattr(other, name))


def plain_tree(block, g, h, sizes, rules, rate, allowed, depth, rows, place=1, drawn=None):
    """(feature, cut, value, left, right) by trying every cut of every feature."""
    unit = 1.0 / (1 << T.SHIFT)
    gt, ht = g[rows].sum() * unit, h[rows].sum() * unit
    value = rate * rules.value(gt, ht)
    best = (1e-9, None)
    for f in range(len(sizes)) if depth and len(rows) >= rules.least_split else ():
        if not allowed(place)[f]:
            continue
        for cut in range(sizes[f] - 1):
            left = rows[block.bins[f, rows] <= cut]
            right = rows[block.bins[f, rows] > cut]
            if min(len(left), len(right)) < rules.least_leaf:
                continue
            gl, hl, gr, hr = (x[r].sum() * unit for r in (left, right) for x in (g, h))
            if min(hl, hr) < rules.least_weight:
                continue
            gain = float(rules.worth(np.array(gl), np.array(hl)) + rules.worth(np.array(gr), np.array(hr)) - rules.worth(np.array(gt), np.array(ht)))
            if gain > best[0]:
                best = (gain, (f, cut, left, right))
    if best[1] is None:
        return value
    f, cut, left, right = best[1]
    deeper = [plain_tree(block, g, h, sizes, rules, rate, allowed, depth - 1, r, 2 * place + i) for i, r in enumerate((left, right))]
    return f, cut, deeper


def nested(tree, at=0):
    if tree.feature[at] < 0:
        return tree.value[at]
    return int(tree.feature[at]), int(tree.cut[at]), [nested(tree, tree.left[at]), nested(tree, tree.left[at] + 1)]


def equal(x, y):
    if isinstance(x, tuple) and isinstance(y, tuple):
        return x[:2] == y[:2] and all(equal(a, b) for a, b in zip(x[2], y[2]))
    return not isinstance(x, tuple) and not isinstance(y, tuple) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("logistic", [True, False])
def test_boosting_matches_plain_loops(rows, logistic):
    grid, frame = packed(rows, "label" if logistic else "value")
    block = whole(frame)
    rules = T.Rules(3, 0.05, 1.0, 1.0)
    boost = T.Boosting(4, rules, 0.3, 0.8, 0.7, logistic, 1.0 if logistic else 64.0)
    fit = T.Fit(None, 1.7 if logistic else 1.0, 0.1)
    (grown,) = T.boosted(frame, grid.sizes, [fit], boost)
    margin = np.full(len(block.label), 0.1)
    for t, tree in enumerate(grown):
        g, h = (np.rint(x * (1 << T.SHIFT)) for x in T._gradients(block, margin, fit, boost))
        drawn = np.flatnonzero(T.mix(block.key, 42, t, 1) < np.uint64(int(0.8 * float(1 << 63)) * 2 - 1))
        assert 0.7 < len(drawn) / 600 < 0.9
        columns = T.drawn_columns(np.array([t]), 3, 2, 42, 2)[0]
        want = plain_tree(block, g, h, grid.sizes, rules, 0.3, lambda p: columns, 3, drawn)
        assert equal(nested(tree), want)
        margin += tree.value[tree.nodes_of(block.bins)]


def test_a_forest_matches_plain_loops_however_it_is_grown(rows):
    grid, frame = packed(rows)
    block = whole(frame)
    rules = T.Rules(6, least_leaf=2, least_split=5)
    bagging = T.Bagging(4, rules, 2)
    fit = T.Fit(None, 1.7)
    forests = [T.forest(frame, grid.sizes, [fit], bagging, n)[0] for n in (1 << 16, 150, 0)]
    for j in range(4):
        bag = T._bag(block, fit, bagging, 0, j)
        g, h = T._weighed(block.label, bag, fit, 1.0)
        want = plain_tree(block, g, h, grid.sizes, rules, 1.0, lambda p: T.drawn_columns(np.array([p]), 3, 2, 42, 0, j, 3)[0], 6, np.flatnonzero(bag))
        assert all(equal(nested(f[j]), want) for f in forests)
    assert 0.9 < np.mean([T._bag(block, fit, bagging, 0, j).mean() for j in range(4)]) < 1.1


def test_fits_that_grow_together_are_those_that_grow_alone(rows):
    grid, frame = packed(rows, fold="fold")
    boost = T.Boosting(5, T.Rules(3, 0.0, 1.0, 1.0), 0.2, 0.9, 1.0, True)
    fits = [T.Fit(f, 1.3) for f in range(5)]
    together = T.boosted(frame, grid.sizes, fits, boost)
    alone = T.boosted(T.blocks(rows.where("fold <> 3"), grid, "k", "label", "fold"), grid.sizes, [T.Fit(None, 1.3)], boost)[0]
    same(together[3], alone)


def test_leaves_shrink_with_the_penalties():
    free, lasso, ridge = T.Rules(3), T.Rules(3, l1=2.0), T.Rules(3, l2=5.0)
    assert free.value(-6.0, 3.0) == -2.0 and lasso.value(-6.0, 3.0) == -4.0 / 3 and ridge.value(-6.0, 3.0) == -0.75
    assert lasso.value(1.5, 3.0) == 0.0 and T.Rules(1).value(1.0, 0.0) == 0.0


def test_saved_models_answer_alike(spark, rows, tmp_path):
    for kind, settings in (("gbt", BOOST), ("rf", {"numTrees": 3, "maxDepth": 4})):
        model = T.train(rows, NAMES, "k", settings, kind, True)[0]
        model.save(str(tmp_path / kind))
        again = T.TreeModel.load(spark, str(tmp_path / kind))
        x = np.array([[a, b, c] for a in (0.0, 20.0, 39.0) for b in (0.0, 1.0) for c in (0.01, 5.0)])
        assert (model.margins(x) == again.margins(x)).all() and again.names == NAMES and again.fill == model.fill
        got = model.transform(rows).select(model.probability().alias("p")).agg(F.min("p"), F.max("p"), F.count("*")).first()
        assert 0 <= got[0] < 0.3 and 0.7 < got[1] <= 1 and got[2] == 600
        shares = model.importances()
        assert math.isclose(shares.sum(), 1.0) and (shares > 0).all()


def test_one_class_and_no_variety(spark):
    flat = spark.createDataFrame([(i, 1.0, 0, None, 1.0, 0) for i in range(20)], "k long, a double, b int, c double, label double, fold int")
    for kind, settings in (("gbt", BOOST), ("rf", {"numTrees": 2, "maxDepth": 3})):
        model = T.train(flat, NAMES, "k", settings, kind, True)[0]
        assert (model.left == np.arange(len(model.left))).all()


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    out = work()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("rest", "rest")
    return out, found


def test_boosting_takes_one_job_a_level_and_sends_sums_of_a_few_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_ROWS", 30)
    grid, frame = packed(rows)
    boost = T.Boosting(12, T.Rules(3, 0.0, 1.0, 1.0), 0.2, 0.9, 1.0, True)
    grown = []
    for few, fresh, least, most in ((1 << 10, 25, 1, 4), (4, 25, 36, 40), (4, 5, 36, 42)):  # one task; several, stored anew or not
        monkeypatch.setattr(T, "ONE_TASK_BLOCKS", few)
        monkeypatch.setattr(T, "FRESH", fresh)
        (trees,), jobs = jobs_of(spark, f"boost {few} {fresh}", lambda: T.boosted(frame, grid.sizes, [T.Fit(None, 1.3)], boost))
        assert least <= jobs <= most and len(trees) == 12
        grown.append(trees)
    same(grown[0], grown[1])
    same(grown[0], grown[2])


@pytest.mark.parametrize("logistic", [True, False])
def test_boosting_together_takes_one_job_and_grows_the_same_trees(spark, rows, monkeypatch, logistic):
    monkeypatch.setattr(T, "BLOCK_ROWS", 30)
    grid, frame = packed(rows, "label" if logistic else "value", "fold")
    boost = T.Boosting(12, T.Rules(3, 0.0, 1.0, 1.0), 0.2, 0.9, 0.7, logistic, 1.0 if logistic else 64.0)
    fits = [T.Fit(None, 1.3), T.Fit(2, 1.1, 0.1)]
    by_level = T.boosted(frame, grid.sizes, fits, boost)
    monkeypatch.setattr(T, "ONE_TASK_BLOCKS", 4)
    together, jobs = jobs_of(spark, f"together {logistic}", lambda: T.boosted_together(frame, grid.sizes, fits, boost))
    assert jobs <= 5 and len(together[0]) == 12
    monkeypatch.setattr(T, "KEPT_BYTES", 1)  # rows that tasks can't keep: a job for each level
    apart, jobs = jobs_of(spark, f"apart {logistic}", lambda: T.boosted_together(frame, grid.sizes, fits, boost))
    assert jobs >= 36
    for one, two, three in zip(by_level, together, apart):
        same(one, two)
        same(one, three)


@pytest.mark.parametrize("take", [3, 9])
@pytest.mark.parametrize("weight", [1.0, 2.7])
def test_joint_and_own_sums_grow_the_subtree_of_plain_loops(take, weight):
    rng = np.random.default_rng(8)
    sizes = np.array([30, 2, 2, 2, 2, 7, 2, 2, 1])
    bins = np.stack([rng.integers(0, s, 400) for s in sizes]).astype(np.uint8)
    label = (bins[0] / 30 + bins[2] * 0.4 + rng.normal(0, 0.2, 400) > 0.8).astype(float)
    block = T.Block(bins, label, np.zeros(400, np.int32), np.arange(400))
    fit, bagging = T.Fit(None, weight), T.Bagging(3, T.Rules(6, least_leaf=2, least_split=5), take)
    bag = rng.integers(1, 4, 400)
    g, h = T._weighed(label, bag, fit, 1.0)
    allowed = lambda p: T.drawn_columns(np.array([p]), 9, take, 42, 0, 1, 3)[0]
    got = T.grown_here(bins, g, h, sizes, 1, 6, bagging, 0, 1)
    assert equal(nested(got), plain_tree(block, g, h, sizes, bagging.rules, 1.0, allowed, 6, np.arange(400)))
    if take == 9:
        groups = T.bundled(sizes, T.BINS)
        codes = np.stack([T.joint_bins(bins, sizes, own) for own in groups])
        slot = rng.integers(0, 3, 400)
        sums = T._whole_sums(codes, groups, g, h, np.arange(400), slot, 3, sizes)
        assert len(groups) < len(sizes) and np.array_equal(sums.transpose(1, 2, 0), T.summed(bins, slot, 3, sizes, [g, h]))


def test_small_nodes_of_a_forest_grow_in_few_jobs(spark, rows):
    grid, frame = packed(rows)
    grow = lambda: T.forest(frame, grid.sizes, [T.Fit(None, 1.7)], T.Bagging(40, T.Rules(4), 2), 1000)
    (trees,), jobs = jobs_of(spark, "forest", grow)
    assert jobs <= 9 and len(trees) == 40  # one for each of ten groups of trees before


@pytest.mark.parametrize("cells", [1, 7, 64, 2048])
def test_joint_histograms_are_those_of_each_feature(cells):
    rng = np.random.default_rng(3)
    sizes, used = np.array([5, 2, 1, 40, 2, 2, 9]), np.array([0, 1, 3, 5, 6])
    bins = np.stack([rng.integers(0, s, 500) for s in sizes]).astype(np.uint8)
    slot, g = rng.integers(-1, 3, 500), rng.integers(-(1 << 34), 1 << 34, 500).astype(float)
    groups = T.bundled(sizes, cells)
    assert sorted(f for group in groups for f in group) == list(range(7))
    assert all(len(group) == 1 or np.prod(sizes[group]) <= cells for group in groups)
    pieces = []
    for part in (slice(0, 300), slice(300, 500)):
        inside = np.flatnonzero(slot[part] >= 0)
        codes = [T.joint_bins(bins[:, part], sizes, group)[inside] for group in groups]
        pieces.append((codes, slot[part][inside], [g[part][inside]]))
    got = T.summed_jointly(pieces, 3, sizes, groups, used, True)
    assert np.array_equal(got, T.summed(bins[used], slot, 3, sizes[used], [g]))


@pytest.mark.parametrize("label, weight, scale", [("label", 1.7, 1.0), ("value", 1.0, 64.0), ("value", 1.7, 64.0)])
@pytest.mark.parametrize("take", [2, 3])
def test_trees_grown_from_files_are_those_of_passes(spark, rows, monkeypatch, label, weight, scale, take):
    monkeypatch.setattr(T, "BLOCK_ROWS", 30)
    monkeypatch.setattr(T, "FILE_ROWS", 90)
    monkeypatch.setattr(T, "CHUNK_ROWS", 70)
    grid, frame = packed(rows, label, "fold")
    fits, bagging = [T.Fit(None, weight), T.Fit(2, weight)], T.Bagging(3, T.Rules(6, least_leaf=2, least_split=5), take, scale)
    want = T.forest(frame, grid.sizes, fits, bagging, 100)
    for kept in (T.KEPT_BYTES, 1):  # rows at hand, and in files where they are many
        monkeypatch.setattr(T, "KEPT_BYTES", kept)
        got, jobs = jobs_of(spark, f"files {label} {weight} {take} {kept}", lambda: T.forest_by_tree(frame, grid.sizes, fits, bagging))
        assert jobs <= 6
        for one, two in zip(want, got):
            assert [nested(t) for t in one] == [nested(t) for t in two]
            assert [sorted(zip(t.place, t.cover, t.gain)) for t in one] == [sorted(zip(t.place, t.cover, t.gain)) for t in two]


def test_a_forest_brings_no_rows_together(rows, monkeypatch):
    monkeypatch.setattr(T, "_grow_small", None)
    model = T.train(rows, NAMES, "k", {"numTrees": 3, "maxDepth": 4}, "rf", True)[0]
    assert len(model.roots) == 3 and model.depth == 4


def test_a_forest_of_no_rows_and_folders_of_other_kinds(spark, rows, monkeypatch):
    grid, frame = packed(rows)
    fits, bagging = [T.Fit(None, 1.7)], T.Bagging(2, T.Rules(4), 2)
    (empty,) = T.forest_by_tree(frame.where("false"), grid.sizes, fits, bagging)
    assert [nested(t) for t in empty] == [0.0, 0.0]
    want = T.forest_by_tree(frame, grid.sizes, fits, bagging)[0]
    monkeypatch.setattr(T, "local_folder", lambda spark, label: None)
    assert [nested(t) for t in want] == [nested(t) for t in T.forest_by_tree(frame, grid.sizes, fits, bagging)[0]]


def test_fits_that_do_not_fit_at_once_grow_in_turn(spark, rows, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_ROWS", 30)
    monkeypatch.setattr(T, "ONE_TASK_BLOCKS", 4)
    grid, frame = packed(rows, fold="fold")
    boost = T.Boosting(12, T.Rules(3, 0.0, 1.0, 1.0), 0.2, 0.9, 1.0, True)
    fits = [T.Fit(f, 1.3) for f in range(5)]
    want = T.boosted_together(frame, grid.sizes, fits, boost)
    tasks = min(T.slots(spark), math.ceil(frame.count() / T.TASK_BLOCKS))
    for bytes_of_a_row, most in ((100, 20), (65, 30)):  # two at once, one at a time; a job for each level before
        monkeypatch.setattr(T, "KEPT_BYTES", frame.count() * 30 * bytes_of_a_row / tasks)
        got, jobs = jobs_of(spark, f"in turn {bytes_of_a_row}", lambda: T.boosted_together(frame, grid.sizes, fits, boost))
        assert jobs <= most
        for one, two in zip(want, got):
            same(one, two)


def test_blocks_are_joined_as_they_come():
    seen = []

    def parts():
        for n in (3, 4, 5, 0, 9, 1):
            seen.append(n)
            yield T.Block(np.full((2, n), n, np.uint8), np.full(n, float(n)), np.zeros(n, np.int32), np.arange(n))

    got = []
    for block in T._chunked(parts(), 8):
        got.append((block.label.tolist(), len(seen)))
    assert [len(x) for x, _ in got] == [7, 5, 9, 1] and [n for _, n in got] == [3, 5, 6, 6]


def test_cells_are_those_of_the_ordered_bits(spark, rows, monkeypatch):
    values = [-math.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 72.0, math.inf, math.nan, None]
    table = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i int")
    want = [r[0] for r in table.where("x is not null").select(F.shiftright(ordered_bits(F.col("x")), 44)).collect()]
    assert T.ordered_cells(np.array(values[:-1])).tolist() == want
    plan = []
    explode = F.explode
    monkeypatch.setattr(T.F, "explode", lambda c: plan.append(c) or explode(c))
    grid = T.binning(table, ["x", "i"])
    assert not plan  # a row per feature before
    assert len(grid.borders[0]) == len(set(want)) - 1 and len(grid.borders[1]) == 12
    assert T.binning(table.where("x is null"), ["x"]).fill == [0.0]
