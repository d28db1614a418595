"""Hand cases: edges of bands and labels, NULLs, unknown values, empty and one-class inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura import schema as S
from tenura import session
from tenura.functions import bins
from tenura.functions.features import contract_risk_scoring
from tenura.operators import encode, evaluate, ltv, profile, reports, score, split, validate
from tenura.sources.customers_csv import export_csv, read_batch_csv, read_customers_csv
from tenura.sources.tables import TableStore, read_table, reconcile, write_table


def test_bands_at_their_edges(spark):
    df = spark.createDataFrame([(t,) for t in (0, 1, 12, 13, 24, 25, 48, 49, 72, 73)], "tenure int")
    got = df.select("tenure", bins.tenure_group().alias("g"), bins.tenure_band().alias("b")).collect()
    assert [r["g"] for r in got] == [
        None, "0-12 months", "0-12 months", "13-24 months", "13-24 months", "25-48 months", "25-48 months",
        "49-72 months", "49-72 months", None,
    ]
    assert [r["b"] for r in got][0] == "0-12 mo"
    assert [r["b"] for r in got][-1] == "49-72 mo"


def test_decisions_on_every_threshold(spark):
    rows = [(p, v) for p in (0.0, 0.2499, 0.25, 0.4999, 0.5, 0.7499, 0.75, 1.0) for v in (-5.0, 0.0, 999.99, 1000.0)]
    rows += [(0.5, v) for v in (1999.99, 2000.0, 3499.99, 3500.0)]
    df = score.decide(spark.createDataFrame(rows, "p double, ltv double"), "p", "ltv")
    for r in df.collect():
        p, v = r["p"], max(r["ltv"], 0.0)
        assert r["churn_risk_label"] == S.RISK_LABELS[(p >= 0.25) + (p >= 0.5) + (p >= 0.75)]
        assert r["ltv_segment"] == S.LTV_SEGMENTS[(v >= 1000) + (v >= 2000) + (v >= 3500)]
        want = {(1, 1): "Critical", (1, 0): "High", (0, 1): "Medium", (0, 0): "Low"}[(p >= 0.5, v >= 2000)]
        assert r["priority_score"] == want
        assert r["churn_prediction"] == int(p >= 0.5)
        assert r["ltv_predicted"] == round(v, 2)


def test_label_comes_from_the_unrounded_value(spark):
    df = score.decide(spark.createDataFrame([(0.49999, 999.999)], "p double, ltv double"), "p", "ltv")
    r = df.first()
    assert (r["churn_probability"], r["churn_prediction"]) == (0.5, 0)
    assert (r["ltv_predicted"], r["ltv_segment"]) == (1000.0, "Low")


def test_unknown_contract(make_customers):
    rows = make_customers({"contract": "Weekly", "tenure": 72}, {"tenure": 36})
    got = encode.model_columns(encode.features(rows)).orderBy("customer_id").collect()
    assert got[0]["contract_enc"] is None and got[0]["tenure_contract_risk"] is None
    assert got[1]["tenure_contract_risk"] == 0.5
    assert encode.encode_contract(rows, "c", 0).first()["c"] == 0
    assert ltv.ltv_target(rows).first()["projected_months"] == 6


def test_scoring_risk_is_clipped(make_customers):
    rows = make_customers({"tenure": 80}, {"tenure": 36, "contract": "Two year"}, {"tenure": 0})
    got = [r[0] for r in rows.orderBy("customer_id").select(contract_risk_scoring()).collect()]
    assert got == [0.0, 0.0, 1.0]


def test_null_charges_and_null_answers(make_customers):
    rows = make_customers({"total_charges": None, "tenure": 0, "partner": None, "gender": None, "tech_support": None})
    r = encode.processed(rows).first()
    assert (r["total_charges"], r["partner_encoded"], r["gender_encoded"], r["tech_support_encoded"]) == (0.0, 0, 0, 0)
    f = encode.features(rows, tenure_max=72).first()
    assert (f["charge_per_tenure"], f["service_count"], f["charge_to_value_ratio"]) == (0.0, 0, 50.0)


def test_all_tenures_zero_gives_no_risk_and_no_error(make_customers):
    assert encode.features(make_customers({"tenure": 0})).first()["tenure_contract_risk"] is None


def test_matrices_have_the_documented_columns(make_customers):
    featured = encode.features(make_customers({}))
    assert encode.churn_matrix(featured).columns == S.CHURN_FEATURES
    assert encode.ltv_matrix(featured).columns == S.LTV_FEATURES
    assert (len(S.CHURN_FEATURES), len(S.LTV_FEATURES)) == (29, 28)
    assert "total_charges" not in S.LTV_FEATURES


def test_required_columns_are_named(make_customers):
    rows = make_customers({})
    assert validate.require_columns(rows) is rows
    with pytest.raises(ValueError, match="payment_method"):
        validate.require_columns(rows.drop("payment_method"))


def test_records_are_split_with_reasons(make_customers):
    rows = make_customers(
        {}, {"tenure": 73}, {"tenure": None}, {"contract": "Weekly", "partner": "?"}, {"monthly_charges": -0.01},
        {"tenure": 0, "total_charges": None}, {"tenure": 72, "senior_citizen": 1},
    )
    ok, bad = validate.split_valid(rows)
    assert sorted(r["customer_id"] for r in ok.collect()) == ["0", "5", "6"]
    reasons = {r["customer_id"]: r["reasons"] for r in bad.collect()}
    assert reasons["1"] == ["tenure: above 72"] and reasons["2"] == ["tenure: required"]
    assert len(reasons["3"]) == 2 and reasons["4"] == ["monthly_charges: below 0"]


def test_defaults_for_absent_and_null_cells(spark):
    df = spark.createDataFrame([("5", None, "x", None)], "tenure string, monthly_charges string, total_charges string, gender string")
    r = validate.fill_defaults(df).first()
    assert (r["tenure"], r["monthly_charges"], r["total_charges"], r["gender"]) == (5.0, 0.0, 0.0, "Male")
    assert (r["senior_citizen"], r["streaming_tv"]) == (0, "No")


def test_align_fills_and_drops(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert encode.align(df, ["b", "c"]).first().asDict() == {"b": 2, "c": 0}


def test_csv_with_blank_charges(spark, tmp_path):
    header = ",".join(S.CSV_HEADER)
    line = "7590-VHVEG,Female,0,Yes,No,{t},No,No phone service,DSL,No,Yes,No,No,No,No,Month-to-month,Yes,Electronic check,29.85,{c},No"
    (tmp_path / "c.csv").write_text("\n".join([header, line.format(t=1, c="29.85"), line.format(t=0, c=" "), line.format(t=2, c="NaN")]))
    rows = read_customers_csv(spark, str(tmp_path / "c.csv"))
    assert rows.dtypes == list(S.COLUMN_TYPES.items())
    assert [r["total_charges"] for r in rows.orderBy("tenure").collect()] == [None, 29.85, None]


def test_export_and_batch_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b")], "x int, y string")
    export_csv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in read_batch_csv(spark, str(tmp_path / "out")).collect()] == [("1", "a,b")]


def test_table_store_replaces(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write(spark.range(5), "t")
    store.write(spark.range(3), "t")
    assert store.read("t").count() == 3
    assert store.read_optional("absent") is None
    assert reconcile(store.read("t"), spark.range(4)).first().asDict() == {
        "rows_written": 3, "rows_source": 4, "matches": False,
    }


def test_catalog_table_is_replaced(spark):
    write_table(spark.range(5), "numbers")
    write_table(spark.range(2), "numbers")
    assert read_table(spark, "numbers").count() == 2


def test_shared_folder_follows_the_session_setting(spark):
    class Session:
        def __init__(self, configured, master):
            self.conf = {"spark.checkpoint.dir": configured} if configured else {}
            self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})

    assert session.shared_dir(spark) == session.shared_dir(spark)
    assert session.new_path(Session("hdfs://shared/", "yarn"), "x").startswith("hdfs://shared/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(None, "yarn"))


def test_one_customer_with_a_third_of_all_orders(spark, folder, tmp_path):
    """A hot customer changes no count; every order is still one subscription."""
    from tenura.sources.subscribers import customers

    orders = spark.read.parquet(f"{folder}/orders.parquet")
    hot = F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(F.col("o_custkey")).cast("bigint")
    orders.withColumn("o_custkey", hot).write.parquet(f"{tmp_path}/orders.parquet")
    for t in ("customer", "lineitem"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = customers(spark, str(tmp_path))
    assert rows.count() == rows.select("k").distinct().count() == orders.count()
    assert reports.describe_by(rows, "monthly_charges", "gender").agg(F.sum("count")).first()[0] == orders.count()


def test_profile_by_hand(make_customers):
    rows = make_customers({"total_charges": None, "tenure": 0}, {}, {"partner": "Yes"})
    assert [tuple(r) for r in profile.missing_report(rows).collect()] == [("total_charges", 1, 33.33)]
    same = rows.drop("customer_id")
    assert profile.duplicate_count(same.unionAll(same)).first()[0] == 3
    assert [r["tenure"] for r in profile.null_charge_tenures(rows).collect()] == [0]
    partner = profile.categorical_domains(rows).where("column = 'partner'").collect()
    assert {r["value"] for r in partner} == {"Yes", "No"}
    assert profile.preview(rows, 2, "customer_id").count() == 2


def test_reports_on_empty_input(make_customers):
    none = make_customers({}).limit(0)
    assert reports.churn_distribution(none).count() == 0
    assert reports.baseline_kpis(none).first()["churn_rate"] is None
    assert reports.describe_by(none, "tenure", "churn").count() == 0


def test_crosstab_fills_missing_combinations(make_customers):
    r = reports.crosstab_pct(make_customers({}, {}), "contract").first()
    assert (r["no_count"], r["yes_count"], r["no_pct"], r["yes_pct"]) == (2, 0, 100.0, 0.0)


def test_correlation_skips_missing_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.0), (4.0, 7.0)], "a double, b double")
    got = {(r["left"], r["right"]): r["corr"] for r in reports.corr_matrix(df, ["a", "b"]).collect()}
    assert len(got) == 4 and got["a", "b"] == got["b", "a"]
    assert abs(got["a", "b"] - 0.9897433186107870) < 1e-12


def test_lookup_takes_the_id_as_a_value(spark, folder):
    from tenura.plans import registry

    stored = registry.stored(spark, folder)
    assert reports.lookup(stored, "7").count() == 1
    assert reports.lookup(stored, "x' OR '1'='1").count() == 0


def test_lookup_filter_reaches_the_scan(spark, folder):
    from tenura.plans import registry

    plan = reports.lookup(registry.stored(spark, folder), "7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(customer_id,7)" in plan and "charge_per_tenure" not in plan


def test_display_strings(spark):
    df = spark.createDataFrame([(0.1234, 12.3, 5.0), (1.0, 0.0, 1.25)], "churn_probability double, ltv_predicted double, revenue_at_risk double")
    assert [tuple(r) for r in reports.display(df).collect()] == [("12.34%", "$12.3", "$5.0"), ("100.0%", "$0.0", "$1.25")]


def test_metrics_of_one_class_and_of_nothing(spark):
    only = spark.createDataFrame([(1, 0.9), (1, 0.2)], "label int, probability double")
    assert evaluate.roc_auc(only).first()["roc_auc"] is None
    assert evaluate.cls_metrics(only).first().asDict() == {"precision": 1.0, "recall": 0.5, "f1": 2 / 3}
    assert evaluate.cls_metrics(only.limit(0)).first()["f1"] == 0.0


def test_auc_matches_the_library_on_hot_and_crowded_scores(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    n = F.col("id")
    p = F.when(n % 3 == 0, 0.5).when(n % 3 == 1, F.rand(3) * 1e-7).otherwise(F.rand(4))
    df = spark.range(6000).select((F.rand(5) < p).cast("int").alias("label"), p.alias("probability")).persist()
    want = BinaryClassificationEvaluator(rawPredictionCol="probability", numBins=0).evaluate(df)
    assert abs(evaluate.roc_auc(df).first()["roc_auc"] - want) < 1e-12
    curve = evaluate.roc_curve(df).orderBy("fpr", "tpr").toPandas()
    area = ((curve.tpr[1:].values + curve.tpr[:-1].values) / 2 * curve.fpr.diff()[1:].values).sum()
    assert abs(area - want) < 1e-12


def test_splits_do_not_depend_on_partitioning(spark, folder):
    from tenura.sources.subscribers import customers

    rows = customers(spark, folder).select("k", "customer_id", "churn")
    for hashed in (split.integer_key_hash("k"), split.key_hash("customer_id")):
        a = split.stratified_split(rows, hashed).select("k", "churn", "is_test").toPandas().sort_values("k")
        b = split.stratified_split(rows.repartition(17, "churn"), hashed).select("k", "is_test").toPandas().sort_values("k")
        assert list(a.is_test) == list(b.is_test)
        share = a.groupby("churn").is_test.mean()
        assert ((share - 0.2).abs() < 0.005).all()
        folds = split.folds(rows, hashed).groupBy("fold").count().collect()
        assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4]


def test_extreme_customer_without_the_label(spark):
    df = spark.createDataFrame([("a", 0, 0.2), ("b", 0, 0.7)], "k string, label int, probability double")
    assert reports.extreme_customer(df, 1, "k").first()["k"] == "b"
    assert reports.extreme_customer(df, 0, "k").first()["k"] == "a"


def test_reports_need_no_line_items_when_services_are_unused(spark, folder):
    from tenura.plans.catalog import QUERIES

    for name in ("churn_by_contract", "baseline_kpis"):
        assert "l_partkey" not in QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(4))
def test_roc_corners_match_a_plain_loop(spark, seed):
    """Scores on and off the borders of cells, in runs of one label and with ties."""
    rng = np.random.default_rng(seed)
    scores = rng.choice([0.0, 1.0, 1 / 1024, 0.5, 0.5 + 1e-12, *rng.random(60), *(0.25 + rng.random(40) * 1e-9)], 400)
    labels = (rng.random(400) < np.where(scores > 0.4, 0.9, 0.1)).astype(int)
    df = spark.createDataFrame([(int(y), float(p)) for y, p in zip(labels, scores)], "label int, probability double")
    order = sorted(set(scores.tolist()), reverse=True)
    steps = [(int(((scores == p) & (labels == 0)).sum()), int(((scores == p) & (labels == 1)).sum())) for p in order]
    kept = [i for i in range(len(order)) if i in (0, len(order) - 1) or steps[i + 1] != steps[i]]
    upto = np.cumsum(steps, axis=0)
    want = [(np.inf, 0.0, 0.0)] + [(order[i], upto[i][0] / (labels == 0).sum(), upto[i][1] / labels.sum()) for i in kept]
    got = [tuple(r) for r in evaluate.roc_curve(df, drop_between=True).orderBy(F.desc("threshold")).collect()]
    assert len(got) == len(want) and np.allclose(np.array(got)[1:], np.array(want)[1:])
    full = evaluate.roc_curve(df).orderBy(F.desc("threshold")).toPandas()
    area = lambda x, y: float(np.trapezoid(y, x))
    assert abs(area(full.fpr, full.tpr) - area([g[1] for g in got], [g[2] for g in got])) < 1e-12
    assert len(got) < len(full)


def test_rows_are_numbered_by_file_and_place(spark, tmp_path):
    """Many files of different sizes, read in blocks far smaller than a file."""
    from tenura.operators import score

    sizes = [1, 700, 3, 0, 2500, 40]
    spark.range(1).write.csv(str(tmp_path / "in"))  # makes the folder
    for old in (tmp_path / "in").iterdir():
        old.unlink()
    n = 0
    for i, size in enumerate(sizes):
        lines = ["v,pad"] + [f"{k},{'x' * (k % 37)}" for k in range(n, n + size)]
        (tmp_path / "in" / f"part-{i:03d}.csv").write_text("\n".join(lines) + "\n")
        n += size
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        rows = spark.read.option("header", True).schema("v long, pad string").csv(str(tmp_path / "in"))
        assert rows.rdd.getNumPartitions() > 20
        found = score.numbered(rows).orderBy("row_index").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r.row_index, r.v) for r in found] == [(i, i) for i in range(n)]
