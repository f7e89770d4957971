"""Sources, composite pipelines and evaluation on a small fixture."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater import sources
from tidewater.ml import features, training
from tidewater.plans import pipelines
from tidewater.streaming import hour_statistics_stream


@pytest.fixture(scope="module")
def three_tables(spark):
    rnd = random.Random(1)
    airports = spark.createDataFrame([(10397, "3011", -5), (11298, "3012", -6), (12266, "03013", -8)], sources.AIRPORTS)
    days = [dt.date(2012, 1, 1) + dt.timedelta(days=k) for k in range(6)]
    flights = []
    for day in days:
        for n in range(60):
            o, d = rnd.sample([10397, 11298, 12266], 2)
            late = rnd.choice([0.0, 0.0, 75.0])
            flights.append((day.isoformat(), 1, n, o, d, rnd.randrange(6, 23) * 100 + rnd.randrange(60), late, 0.0, 0.0, float(rnd.randrange(60, 240)), late if late else None, 0.0, None))
    flights = spark.createDataFrame(flights, sources.FLIGHTS).withColumn("FL_DATE", F.to_date("FL_DATE")).drop("UNUSED_COL")
    names = sources.WEATHER.fieldNames()
    weather = []
    for w in ("3011", "03012", "3013"):
        for day in [*days, days[-1] + dt.timedelta(days=1)]:
            for h in range(24):
                row = dict.fromkeys(names) | {"WBAN": w, "Date": day.strftime("%Y%m%d"), "Time": f"{h:02d}15", "SkyCondition": rnd.choice(["CLR", "OVC005", "FEW025"]), "Visibility": rnd.choice(["10.00", "0.50", "M"]), "DryBulbCelsius": rnd.uniform(-10, 10), "DewPointCelsius": -5.0, "HourlyPrecip": rnd.choice(["T", " ", "0.02"])}
                weather.append(tuple(row[c] for c in names))
    weather = spark.createDataFrame(weather, sources.WEATHER).withColumn("Date", F.to_date("Date", "yyyyMMdd"))
    return flights, weather, airports


def test_to_holdout_metrics(spark, three_tables, tmp_path):
    e = pipelines.Experiment("x", {"dep_hour": "None", "distance_score": "StandardScaler", "route_id": "StringIndexer"}, ["visibility_miles", "ceiling"], {"ceiling": "min"}, origin_depth=2, dest_depth=1, params={"numTrees": 4, "maxDepth": 3}, grid={"maxDepth": [2, 3]}, folds=2)
    f, w = pipelines.data_pipeline(*three_tables, [e])
    assert {"unique_id", "utc_hour_number", "D2_60"} <= set(f.columns) and f.count() > 300
    train, test = pipelines.feature_pipeline(f, w, e)
    assert "origin_weather_visibility_miles_h2" in train.columns and "origin_weather_ceiling_Min" in train.columns and "D2_60" in train.columns
    assert {r["label_is_delayed"] for r in train.select("label_is_delayed").distinct().collect()} == {0, 1}
    done = pipelines.ml_pipeline(train, test, e, str(tmp_path / "run"))
    parts = {r["part"]: r for r in done.measures.collect()}
    for part, df in (("train", train), ("test", test)):
        m = parts[part]
        assert m["tp"] + m["tn"] + m["fp"] + m["fn"] == df.count() and 0 <= m["auc_roc"] <= 1
    assert done.candidates.count() == 4 and done.best["maxDepth"] in (2, 3) and done.best["numTrees"] == 4 and not done.artefacts.kept
    want = training.areas(done.predictions.filter("part = 'test'").withColumn("rawPrediction", training.F.col("p1")))
    assert parts["test"]["auc_roc"] == pytest.approx(want["auc_roc"], abs=0.01)

    steps = set(done.artefacts.made)
    again = pipelines.ml_pipeline(train.repartition(5), test, e, str(tmp_path / "run"))  # nothing is made twice, whatever the partitions
    assert not again.artefacts.made and set(again.artefacts.kept) == steps
    assert sorted(map(tuple, again.predictions.collect())) == sorted(map(tuple, done.predictions.collect()))

    key, path = done.artefacts.place("predictions", "x")
    broken = next(p for p in (tmp_path / "run").iterdir() if p.name.startswith("predictions-"))
    (broken / "_DONE").unlink()  # broke off while it was written
    assert set(pipelines.ml_pipeline(train, test, e, str(tmp_path / "run")).artefacts.made) == {"predictions"}
    e.params = {**e.params, "numTrees": 3}  # only what depends on it
    assert set(pipelines.ml_pipeline(train, test, e, str(tmp_path / "run")).artefacts.kept) == {"features", "points", "held-out-points"}
    fast = pipelines.ml_pipeline(train, test, e, str(tmp_path / "run"), fast=True)
    assert fast.candidates.count() == 0 and fast.cv.count() == 0 and fast.measures.count() == 2
    e.reduce = "pca"
    reduced = pipelines.ml_pipeline(train, test, e, str(tmp_path / "run"), fast=True)
    assert "vectors" in reduced.artefacts.made and reduced.predictions.count() == train.count() + test.count()
    reduced.artefacts.rest()
    assert not (tmp_path / "run").exists()


def test_counts_on_demand(spark, three_tables):
    flights, weather, airports = three_tables
    whole = pipelines.preprocess_flights(flights, airports, weather)
    made = ["flights_on_route", "carrier_flights", "origin_traffic", "route_popularity", "carrier_size"]
    for wanted, there in (({"route_popularity"}, {"flights_on_route", "route_popularity"}), ({"origin_traffic", "carrier_size"}, {"origin_traffic", "carrier_flights", "carrier_size"}), ({"dep_hour"}, set())):
        some = pipelines.preprocess_flights(flights, airports, weather, wanted)
        assert set(whole.columns) - set(some.columns) == set(made) - there
        assert sorted(map(tuple, some.select("unique_id", *sorted(there)).collect())) == sorted(map(tuple, whole.select("unique_id", *sorted(there)).collect()))


def test_models_refuse_other_schemas(spark, tmp_path):
    df = spark.range(40).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 3 AS STRING) AS s", "id % 2 AS y")
    model = features.feature_stages(df, features.FeatureSpec({"x": "None", "s": "StringIndexer"}, "y")).fit(df)
    sources.save_model(model, str(tmp_path / "m"), df)
    back = sources.load_model(str(tmp_path / "m"), inputs=df.select("y", "s", "x", training.F.lit(1).alias("more")))
    assert back.transform(df).select("features").collect() == model.transform(df).select("features").collect()
    for wrong in (df.drop("s"), df.withColumn("x", training.F.col("x").cast("int"))):
        with pytest.raises(sources.SchemaMismatch):
            sources.load_model(str(tmp_path / "m"), inputs=wrong)
    sources.save_model(model, str(tmp_path / "plain"))
    with pytest.raises(sources.SchemaMismatch):
        sources.load_model(str(tmp_path / "plain"), inputs=df)


def test_folds_and_splits_by_hash(spark):
    df = spark.range(300).selectExpr("id", "CAST(id % 3 = 0 OR id % 7 = 0 AS DOUBLE) AS label", "array(CAST(id % 3 AS DOUBLE), CAST(id % 7 AS DOUBLE)) AS a").select("id", "label", features.array_to_vector("a").alias("features"))
    for found in (lambda x: training.cross_validate(x, "rf", {"maxDepth": [1, 4], "numTrees": [3]}, 3, ["id"]), lambda x: training.validate_once(x, "rf", {"maxDepth": [1, 4], "numTrees": [3]}, 0.7, ["id"])):
        (best, one), (best2, two) = found(df), found(df.repartition(7))
        cells = lambda x: sorted((r["candidate"], r["fold"], r["tp"] + r["fn"], r["tn"] + r["fp"]) for r in x.collect())
        assert best == best2 and best["numTrees"] == 3 and cells(one) == cells(two)
    assert 60 <= sum(r[2] + r[3] for r in cells(one)) / 2 <= 120
    assert training.grid_maps({}) == [{}] and len(training.grid_maps({"a": [1, 2], "b": [3, 4, 5]})) == 6


def test_components(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 60)) @ rnd.normal(size=(60, 60))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "a array<double>").select(features.array_to_vector("a").alias("features"))
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    found = features.VariancePCA(variance=0.9999999).fit(df)
    assert found.k > 50 and found.shares == pytest.approx((values / values.sum()).tolist(), abs=1e-9)
    few = features.VariancePCA(variance=0.5).fit(df)
    assert few.k == int(np.searchsorted(np.cumsum(values / values.sum()), 0.5)) + 1 and few.transform(df).first()["pca_features"].size == few.k
    assert features.VariancePCA(k=3).fit(df).k == 3
    none = features.VariancePCA(variance=0.9).fit(df.limit(0))
    assert none.k == 0 and none.variance_table(spark).count() == 0 and none.transform(df).first()["pca_features"].size == 0 and none.loadings(spark, []).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("AirportID,WBAN,TimeZone\n10397,3011,-5\nx, 3012,-6\n")
    got = sources.read_airports(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in got.collect()] == [(10397, "3011", -5), (None, "3012", -6)]
    back = sources.read_table(spark, str(tmp_path / "a.csv"), str(tmp_path / "stored"), sources.read_airports, ["WBAN"])
    assert back.count() == 2 and sources.read_table(spark, None, str(tmp_path / "stored")).count() == 2
    with pytest.raises(ValueError):
        sources.read_table(spark, None, str(tmp_path / "stored"), required=["missing"])
    sources.write_csv(back, str(tmp_path / "out"), max_rows=1, keys=["WBAN"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    sources.register(back, "airports")
    assert spark.sql("SELECT count(*) FROM airports").first()[0] == 2


def test_measures_at_the_edges(spark):
    none = spark.createDataFrame([(0, 0, 0, 5)], "tp long, tn long, fp long, fn long")
    r = training.metrics(none).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"], r["fpr"]) == (0.0, 0.0, 0.0, 0.0, 0.0)
    perfect = training.metrics(training.confusion(spark.createDataFrame([(1, 1), (0, 0)], "label int, prediction int"))).first()
    assert perfect["f1"] == 1.0 and perfect["specificity"] == 1.0
    gap = training.train_test_gap(training.metrics(spark.createDataFrame([(9, 9, 1, 1)], none.schema)), training.metrics(spark.createDataFrame([(7, 7, 3, 3)], none.schema))).first()
    assert gap["overfitting"] == "alert"


def test_resolve_and_selection(spark, tmp_path):
    got = features.resolve(["a", "origin_weather_a_h1", "origin_weather_a_h2", "destination_weather_a_Max", "ab"], {"a": "None"})
    assert got == {"None": ["a", "origin_weather_a_h1", "origin_weather_a_h2", "destination_weather_a_Max"]}
    df = spark.range(200).selectExpr("CAST(id % 2 AS DOUBLE) AS label", "array(CAST(id % 2 AS DOUBLE), CAST(id % 3 AS DOUBLE), CAST(id AS DOUBLE)) AS a").select("label", features.array_to_vector("a").alias("features"))
    picked = features.hybrid_selection([0, 1], [2], "label", threshold=0.05).fit(df)
    assert picked.transform(df).first()["selected"].size == 2
    sources.save_model(picked, str(tmp_path / "m"))
    assert sources.load_model(str(tmp_path / "m")).transform(df).count() == 200
    with pytest.raises(ValueError):
        training.classifier("lightgbm")


def test_runs_compared(spark):
    runs = spark.createDataFrame([("a", 3, 0.8), ("b", 6, 0.9), ("c", 3, 0.9)], "experiment string, depth int, f1 double")
    assert [tuple(r)[0::3] for r in training.compare_runs(runs).collect()] == [("b", 1), ("c", 1), ("a", 2)]
    assert training.depth_sensitivity(runs, "depth").filter("depth = 3").first()["f1_mean"] == pytest.approx(0.85)


def test_stream(spark, tmp_path):
    spark.sql("SELECT 1 AS k, timestamp'2024-01-01 10:05:00' + make_dt_interval(0, CAST(id AS INT)) AS ts, CAST(id AS DOUBLE) AS v FROM range(10)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = hour_statistics_stream(stream, "k", "ts", "v").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT max(hour_count) FROM hours").first()[0] == 1


def test_selection_against_sparks_own_tests(spark):
    import numpy as np
    from pyspark.ml.stat import ChiSquareTest

    from tidewater.ml import selection

    rnd = random.Random(4)
    rows = []
    for _ in range(400):
        y = rnd.randrange(3)
        rows.append((float(y), float(rnd.randrange(4)), float(y if rnd.random() < 0.6 else rnd.randrange(5)), 1.0, rnd.gauss(0, 1), rnd.gauss(y * 0.3, 1), rnd.gauss(0, 3)))
    names = ["label", "a", "b", "one", "u", "v", "w"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    found = {r["column"]: r for r in selection.tests(df, ["a", "b", "one"], ["u", "v", "w"], "label").collect()}
    points = df.select("label", features.array_to_vector(training.F.array("a", "b")).alias("features"))
    for c, r in zip(["a", "b"], ChiSquareTest.test(points, "features", "label", True).orderBy("featureIndex").collect(), strict=True):
        assert found[c]["statistic"] == pytest.approx(r["statistic"], rel=1e-9) and found[c]["p"] == pytest.approx(r["pValue"], rel=1e-6, abs=1e-12)
    x = np.array(rows)
    for k, c in enumerate(["u", "v", "w"], 4):
        groups = [x[x[:, 0] == y, k] for y in (0, 1, 2)]
        between = sum(len(g) * (g.mean() - x[:, k].mean()) ** 2 for g in groups) / 2
        ratio = between / (sum(((g - g.mean()) ** 2).sum() for g in groups) / 397)
        assert found[c]["statistic"] == pytest.approx(ratio, rel=1e-9) and found[c]["p"] == pytest.approx((1 + 2 * ratio / 397) ** (-397 / 2), rel=1e-6)  # closed form for 2 degrees
    for a, b in ((0.5, 3.0), (4.0, 2.5), (60.0, 1.0)):
        t = (np.arange(200_000) + 0.5) / 200_000
        density = t ** (a - 1) * (1 - t) ** (b - 1)
        assert selection.beta_share(a, b, 0.4) == pytest.approx(density[t < 0.4].sum() / density.sum(), abs=2e-3)
    assert (found["one"]["statistic"], found["one"]["p"]) == (0.0, 1.0)
    tested = selection.tests(df, ["a", "b", "one"], ["u", "v", "w"], "label")
    p = sorted((r["p"], c) for c, r in found.items())
    passing = [k for k, (x, _) in enumerate(p, 1) if x <= 0.3 * k / 6]
    for mode, threshold, want in (("fpr", 0.05, {c for x, c in p if x < 0.05}), ("fwe", 0.05, {c for x, c in p if x < 0.05 / 6}), ("numTopFeatures", 2, {c for _, c in p[:2]}),
                                  ("percentile", 0.5, {c for _, c in p[:3]}), ("fdr", 0.3, {c for _, c in p[: max(passing, default=0)]})):
        assert {r["column"] for r in selection.selected(tested, mode, threshold).filter("selected").collect()} == want
    assert selection.hybrid_columns(df, ["a", "b"], ["u", "v"], "label") == ["b", "u", "v"] and selection.hybrid_columns(df, ["a", "b"], ["u", "v"], "label", numeric_test=True)[:1] == ["b"]
    assert selection.tests(df.limit(0), ["a"], ["u"], "label").count() == 0
    nulls = spark.createDataFrame([(1, None, 1.0), (0, "x", None), (1, "x", 2.0), (None, "x", 3.0), (0, None, 2.0)], "label int, c string, n double")
    assert {r["column"]: r["statistic"] for r in selection.tests(nulls, ["c"], ["n"], "label").collect()}["c"] == pytest.approx(0.0)


def test_measures_in_one_pass(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("ab"), rnd.choice([0, 1]), rnd.choice([0.0, 0.25, 0.5, 0.75, 1.0, rnd.random()]), float(rnd.random() < 0.5)) for _ in range(500)] + [("c", 1, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "g string, label int, p1 double, prediction double")
    for group, r in {r["g"]: r for r in training.evaluate(df, by=["g"], bins=1 << 20).collect()}.items():
        some = df.filter(training.F.col("g") == group)
        assert tuple(r[c] for c in training.CELLS) == tuple(training.confusion(some).first())
        if group == "c":
            assert r["auc_roc"] is None and r["auc_pr"] is None
            continue
        want = training.areas(some.withColumn("rawPrediction", training.F.col("p1")))
        assert r["auc_roc"] == pytest.approx(want["auc_roc"], abs=1e-4) and r["auc_pr"] == pytest.approx(want["auc_pr"], abs=0.02)
    assert training.evaluate(df.limit(0)).first()["f1"] == 0.0
