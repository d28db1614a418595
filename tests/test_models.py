"""Training, attribution and scoring on the small tables, with few trees."""

import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.operators import evaluate, explain, models, score
from tenura.plans import model_queries as M
from tenura.sources.customers_csv import export_csv
from tenura.streaming import scoring


@pytest.fixture(scope="module")
def trained(spark, folder):
    return M.trained(spark, folder)


def test_train_and_test_are_disjoint_and_complete(trained):
    counts = trained.churn_rows.groupBy("is_test").count().collect()
    assert sum(r["count"] for r in counts) == trained.churn_rows.select("k").distinct().count() == 1500


def test_models_find_the_signal(trained):
    for kind in ("lr", "rf", "gbt"):
        scored = trained.test_scores(kind)
        auc = evaluate.roc_auc(scored.select("label", "probability")).first()["roc_auc"]
        want = BinaryClassificationEvaluator(rawPredictionCol="probability", numBins=0).evaluate(scored)
        assert abs(auc - want) < 1e-9 and auc > 0.65
    metrics = M.models.ltv_metrics_table({k: trained.test_values(k) for k in trained.ltv}).collect()
    assert all(r["r2"] > 0.85 for r in metrics)


def test_linear_model_scales_inside_the_pipeline(trained):
    names = [type(s).__name__ for s in trained.churn["lr"].stages]
    assert names == ["ImputerModel", "VectorAssembler", "StandardScalerModel", "LogisticRegressionModel"]


def test_full_settings_are_the_defaults():
    assert models.CHURN_SETTINGS["gbt"]["maxIter"] == 200 and models.LTV_SETTINGS["gbt"]["maxIter"] == 300
    assert models.CHURN_SETTINGS["rf"]["numTrees"] == models.LTV_SETTINGS["rf"]["numTrees"] == 200


def test_registered_queries_train_with_the_full_settings(spark, folder, monkeypatch):
    used = []

    def fit(kind, rows, **settings):
        used.append((kind, settings))

    def validate(kinds, rows, settings=None):
        used.extend((kind, (settings or {}).get(kind, {})) for kind in kinds)

    monkeypatch.setattr(M, "_TRAINED", {})
    for name, made in {"train_churn": fit, "train_ltv": fit, "cv_churn": validate, "cv_ltv": validate}.items():
        monkeypatch.setattr(models, name, made)
    found = M.trained(spark, folder)
    assert used == []  # nothing is fitted before it is asked for
    for fits in (found.churn, found.ltv):
        for kind in fits:
            assert fits[kind] is fits[kind]
    M.churn_cross_validation(spark, folder)
    M.ltv_cross_validation(spark, folder)
    assert used == [(kind, {}) for kind in ("lr", "rf", "gbt")] * 4


def test_queries_fit_only_the_models_they_need(spark, folder, monkeypatch):
    used = []
    monkeypatch.setattr(M, "_TRAINED", {})
    small = {"maxIter": 2, "maxDepth": 2, "numTrees": 2}
    for name, defaults in (("train_churn", models.CHURN_SETTINGS), ("train_ltv", models.LTV_SETTINGS)):
        real = getattr(models, name)

        def fit(kind, rows, real=real, name=name, defaults=defaults):
            used.append((name, kind))
            return real(kind, rows, **{k: v for k, v in small.items() if k in defaults[kind]})

        monkeypatch.setattr(models, name, fit)
    M.model_predictions(spark, folder)
    M.top_importances(spark, folder)
    assert used == [("train_churn", "gbt")]
    M.score_ltv(spark, folder)
    assert used == [("train_churn", "gbt"), ("train_ltv", "gbt")]


def test_attributions_add_up(spark, folder, trained):
    gap = M.shap_values(spark, folder).agg(F.max(F.abs("gap")), F.count("*")).first()
    assert gap[0] < 1e-6 and gap[1] == 1500


def _conditional(nodes, at, x, known):
    node = nodes[at]
    if node["left"] < 0:
        return node["value"]
    if node["feature"] in known:
        down = node["left"] if x[node["feature"]] <= node["threshold"] else node["right"]
        return _conditional(nodes, down, x, known)
    return sum(
        nodes[c]["cover"] / node["cover"] * _conditional(nodes, c, x, known) for c in (node["left"], node["right"])
    )


def test_attributions_match_brute_force_shapley():
    leaf = lambda v, c: {"left": -1, "right": -1, "value": v, "cover": c}
    inner = lambda f, t, a, b, c: {"feature": f, "threshold": t, "left": a, "right": b, "cover": c, "value": 0.0}
    tree = {
        0: inner(0, 0.5, 1, 2, 100.0),
        1: inner(1, 1.5, 3, 4, 60.0),
        2: inner(0, 2.5, 5, 6, 40.0),
        3: leaf(1.0, 25.0),
        4: inner(2, 0.0, 7, 8, 35.0),
        5: leaf(-2.0, 10.0),
        6: leaf(4.0, 30.0),
        7: leaf(3.0, 5.0),
        8: leaf(-1.5, 30.0),
    }
    table = explain.tabulate(explain.leaf_paths(tree, 2.0))
    rows = np.array(list(itertools.product((0.0, 0.5, 1.0, 3.0), (1.0, 2.0), (-1.0, 1.0), (9.0,))))
    got = explain.attributions(table, rows)
    features = range(4)
    for x, phi in zip(rows, got):
        for j in features:
            others = [f for f in features if f != j]
            want = 0.0
            for size in range(4):
                for s in itertools.combinations(others, size):
                    weight = factorial(size) * factorial(3 - size) / factorial(4)
                    want += weight * (_conditional(tree, 0, x, {*s, j}) - _conditional(tree, 0, x, set(s)))
            assert abs(phi[j] - 2.0 * want) < 1e-12
        assert abs(table.base_value + phi.sum() - 2.0 * _conditional(tree, 0, x, set(features))) < 1e-12


def test_attributions_of_a_deep_path_match_brute_force():
    depth, rng = 12, np.random.default_rng(4)
    nodes, cover = {}, 1000.0
    for d in range(depth):  # one long path; every left child is a leaf
        share = rng.uniform(0.1, 0.9)
        nodes[2 * d] = {"feature": d, "threshold": 0.0, "left": 2 * d + 1, "right": 2 * d + 2, "cover": cover, "value": 0.0}
        nodes[2 * d + 1] = {"left": -1, "right": -1, "value": rng.normal(), "cover": cover * (1 - share)}
        cover *= share
    nodes[2 * depth] = {"left": -1, "right": -1, "value": 5.0, "cover": cover}
    table = explain.tabulate(explain.leaf_paths(nodes, 1.0))
    assert sum(x.nbytes for x in (table.feature, table.above, table.upto, table.share)) < 13 * depth * 32
    x = np.array([[1.0] * depth, [1.0, -1.0] * (depth // 2), [1.0] * 7 + [-1.0] * 5])
    got = explain.attributions(table, x)
    for row, phi in zip(x, got):
        values = {s: _conditional(nodes, 0, row, set(s)) for k in range(depth + 1) for s in itertools.combinations(range(depth), k)}
        for j in (0, 5, 11):
            want = sum(
                factorial(len(s)) * factorial(depth - len(s) - 1) / factorial(depth) * (values[tuple(sorted({*s, j}))] - v)
                for s, v in values.items()
                if j not in s
            )
            assert abs(phi[j] - want) < 1e-9


def test_rows_that_share_a_pattern_share_their_attributions(trained):
    """All rows by way of their patterns, and each row by itself, over trees of the trained model and over a deep one."""
    names = S.CHURN_FEATURES
    rows = trained.churn_rows.select(*names).limit(300).fillna(0).toPandas().to_numpy(float)
    tables = explain.tree_tables(trained.churn["gbt"])
    some = tables[:3] + tables[-2:]
    want = sum(explain.attributions(t, rows) for t in some)
    assert np.allclose(explain.ensemble_attributions(some, rows), want, rtol=0, atol=1e-12)
    first, pattern = explain.patterns(tables[0], rows)
    assert len(first) < len(rows) and (first[pattern] <= np.arange(len(rows))).all()
    rng = np.random.default_rng(1)
    wide = {i: {"feature": i % 29, "threshold": rng.normal(), "left": 2 * i + 1, "right": 2 * i + 2, "cover": 128.0 / 2 ** ((i + 1).bit_length() - 1), "value": 0.0} for i in range(127)}
    wide |= {i: {"left": -1, "right": -1, "value": rng.normal(), "cover": 1.0} for i in range(127, 255)}
    deep = explain.tabulate(explain.leaf_paths(wide, 1.0))  # more tests than bits in a number
    x = rng.normal(size=(200, 29))
    assert np.allclose(explain.ensemble_attributions([deep], np.repeat(x, 3, axis=0)), np.repeat(explain.attributions(deep, x), 3, axis=0), atol=1e-12)


def test_training_survives_missing_cells_and_labels(spark, folder):
    from tenura.operators import split
    from tenura.plans import registry as R

    rows = R.dirty(spark, folder).withColumn("churn", F.when(F.col("k") % 9 != 0, F.col("churn")))
    marked = models.churn_training_rows(rows, "k", split.integer_key_hash("k"))
    assert marked.count() == 1500 and marked.where("label is null").where("is_test").count() == 0
    model = models.train_churn("gbt", models.weighted(marked.where("not is_test")), maxIter=2, maxDepth=2)
    assert models.churn_scores(model, marked).where("probability between 0 and 1").count() == 1500


def test_importance_table(spark, folder, trained):
    table = M.shap_importance(spark, folder).orderBy("global_rank").toPandas()
    assert list(table.global_rank) == list(range(1, 30))
    assert table.mean_abs_shap.is_monotonic_decreasing
    assert set(table[table.is_engineered].feature) == set(S.ENGINEERED)
    found = M.shap_findings(spark, folder).first()
    assert found["top_driver"] == table.feature[0]
    assert found["engineered_in_top5"] == table.is_engineered[:5].sum()


def test_sample_rows_carry_their_own_label(spark, folder, trained):
    sample = M.shap_customer_values(spark, folder)
    joined = sample.join(trained.churn_rows.select("k", "label"), "k")
    assert joined.where("label != churn_actual").count() == 0 and joined.count() == 1500


def test_contributions_are_ordered(spark, folder, trained):
    from tenura.plans.catalog import QUERIES

    rows = QUERIES["riskiest_churner_contributions"](spark, folder).collect()
    sizes = [abs(r["contribution"]) for r in rows]
    assert len(rows) == 12 and sizes == sorted(sizes, reverse=True)


def test_bundle_round_trip_and_missing_model(spark, folder, trained, tmp_path):
    whole = trained.bundle()
    models.save_bundle(whole, str(tmp_path / "b"))
    again = models.load_bundle(spark, str(tmp_path / "b"))
    rows = M.arrivals(spark, folder)
    a, b = (score.score(rows, x, "k").toPandas().sort_values("k", ignore_index=True) for x in (whole, again))
    assert a.equals(b)
    models.save_bundle(models.Bundle(whole.churn, None, 72.0), str(tmp_path / "half"))
    with pytest.warns(UserWarning, match="ltv"):
        half = models.load_bundle(spark, str(tmp_path / "half"))
    assert score.score_churn(rows, half, "k").count() == 1500
    with pytest.raises(ValueError, match="ltv"):
        score.score_ltv(rows, half, "k")


def rewritten(spark, path, change):
    """The bundle's meta rows, changed and signed again if they should be."""
    rows = [r.asDict() for r in spark.read.parquet(f"{path}/meta").collect()]
    for row in rows:
        change(row)
    names = [f.split()[0] for f in models.META.split(", ")]
    spark.createDataFrame([tuple(r[n] for n in names) for r in rows], models.META).write.mode("overwrite").parquet(f"{path}/meta")


def signed(row):
    row["schema_hash"] = models._schema_hash(row["features"])
    row["signature"] = models._signature(row)


def test_a_bundle_lists_its_features_and_refuses_others(spark, folder, trained, tmp_path):
    path = str(tmp_path / "b")
    models.save_bundle(trained.bundle(), path)
    meta = models.bundle_meta(spark, path)
    assert meta["churn"]["features"] == S.CHURN_FEATURES and meta["ltv"]["features"] == S.LTV_FEATURES
    assert meta["churn"]["settings"]["trees"] == "200" and meta["ltv"]["settings"]["trees"] == "300"
    rows = M.arrivals(spark, folder)
    want = score.score(rows, trained.bundle(), "k").toPandas().sort_values("k", ignore_index=True)

    def permuted(row):
        row["features"] = row["features"][::-1]
        signed(row)

    rewritten(spark, path, permuted)
    got = score.score(rows, models.load_bundle(spark, path), "k").toPandas().sort_values("k", ignore_index=True)
    assert got.equals(want)

    def shortened(row):
        row["features"] = [f for f in row["features"] if f != "contract_enc"]
        signed(row)

    rewritten(spark, path, shortened)
    with pytest.raises(ValueError, match="contract_enc"):
        models.load_bundle(spark, path)

    def tampered(row):
        row["tenure_max"] = 1.0

    models.save_bundle(trained.bundle(), path)
    rewritten(spark, path, tampered)
    with pytest.raises(ValueError, match="churn|ltv"):
        models.load_bundle(spark, path)


def test_stream_equals_batch(spark, folder, trained, tmp_path):
    rows = M.arrivals(spark, folder).drop("k").select(S.batch_schema().names).to(S.batch_schema())
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = scoring.score_stream(scoring.read_arrivals(spark, str(tmp_path / "in"), files_per_batch=1), trained.bundle())
    scoring.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values("customer_id", ignore_index=True)
    want = score.score(rows, trained.bundle(), "customer_id").toPandas().sort_values("customer_id", ignore_index=True)
    assert got.equals(want)


def test_batch_file_without_key_and_options(spark, folder, trained, tmp_path):
    sample = spark.createDataFrame(
        [(12, 65.5, 786.0, "Month-to-month", "Fiber optic", "Electronic check"), (48, 45.2, 2169.6, "Weekly", "DSL", None)],
        "tenure int, monthly_charges double, total_charges double, contract string, internet_service string, payment_method string",
    )
    export_csv(sample.coalesce(1), str(tmp_path / "in"))
    got = score.score_batch(spark, str(tmp_path / "in"), trained.bundle()).orderBy("row_index").collect()
    assert [r["row_index"] for r in got] == [0, 1]
    assert all(0 <= r["churn_probability"] <= 1 and r["ltv_predicted"] >= 0 for r in got)
    export_csv(sample.drop("contract"), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="contract"):
        score.score_batch(spark, str(tmp_path / "bad"), trained.bundle())


def test_stored_metrics_report_an_absent_table(spark, tmp_path):
    from tenura.sources.tables import TableStore

    assert models.stored_metrics(TableStore(spark, str(tmp_path)))["model_metrics"] == "no table model_metrics has been written yet"


def test_cross_validation_lines(trained):
    train = trained.churn_rows.where("not is_test")
    counts = train.groupBy("fold", "label").count().toPandas().pivot(index="fold", columns="label", values="count")
    assert len(counts) == 5 and (counts.max() - counts.min()).max() <= 2
    line = models.cv_churn(["rf"], train, {"rf": {"numTrees": 3, "maxDepth": 3}}).first()
    assert line["metric"] == "f1" and 0.3 < line["mean"] < 1 and line["std"] >= 0


def test_batches_are_explained_together():
    import pandas as pd

    batches = [pd.Series([[float(i + j)] for i in range(n)], dtype=object) for j, n in enumerate((3, 0, 2, 4, 1))]
    got = list(explain.joined(iter(batches), 5))
    assert [len(x) for x in got] == [5, 5]  # a call per batch before
    assert np.concatenate(got)[:, 0].tolist() == [v[0] for b in batches for v in b]
    assert list(explain.joined([batches[1]], 5)) == []


def test_attributions_of_short_paths_are_looked_up(monkeypatch):
    rng = np.random.default_rng(3)
    tables = []
    for tree in range(4):
        nodes = {i: {"feature": int(rng.integers(0, 4)), "threshold": float(rng.integers(0, 6)), "left": 2 * i + 1, "right": 2 * i + 2, "value": 0.0} for i in range(15)}
        nodes |= {i: {"left": -1, "right": -1, "value": rng.normal(), "cover": float(rng.integers(1, 9))} for i in range(15, 31)}
        for i in reversed(range(15)):
            nodes[i]["cover"] = nodes[2 * i + 1]["cover"] + nodes[2 * i + 2]["cover"]
        tables.append(explain.tabulate(explain.leaf_paths(nodes, 1.0)))
    tables.append(explain.tabulate([(0.7, {})]))  # a tree without a split
    x = rng.integers(-1, 7, (500, 5)).astype(float)
    want = np.zeros_like(x)
    for table in tables:
        want += explain.attributions(table, x)
    monkeypatch.setattr(explain, "attributions", None)  # worked out anew for every block before
    assert np.array_equal(explain.ensemble_attributions(tables, x), want)
    monkeypatch.undo()
    assert np.array_equal(explain.ensemble_attributions(tables[-1:], x), np.zeros_like(x))
