"""Statistics, cleaning, joins and models on small frames and their edge cases."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattgrid.functions import advice as V
from wattgrid.functions import power as P
from wattgrid.operators import cleaning as C
from wattgrid.operators import joins as J
from wattgrid.operators import learning as M
from wattgrid.operators import scans as S
from wattgrid.operators import stats as A
from wattgrid.plans.models import KEYS, LABEL, jobs, trained
from wattgrid.plans.registry import REGISTRY
from wattgrid.session import SMALL_GROUPS, checkpointed


def test_published_score(spark):
    """The metrics of a saved validation run give its stored score."""
    rows = [("energy", -0.4730235262947049, 0.00347222222222221, 0.0443566673406141),
            ("thermal", -4.975393522216179, 0.460952380952381, -0.013261425651613661),
            ("performance", -2.440051879578541, 0.040000000000000036, 0.0)]
    df = spark.createDataFrame(rows, "component string, r2 double, distribution_similarity double, correlation double")
    assert A.validation_score(df).first()[0] == pytest.approx(0.4183399204808661)
    gap = df.withColumn("r2", F.when(F.col("component") == "thermal", F.col("r2")))
    only_thermal = 0.005 * (0.85 + 0.007 * (10 - 4.975393522216179)) + 0.99 * 0.460952380952381 + 0.005 * (1 - 0.013261425651613661) / 2
    assert A.validation_score(gap).first()[0] == pytest.approx(only_thermal)
    assert A.validation_score(df.filter("false")).first()[0] == 0.0


def test_validation_edges(spark):
    flat = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0), (None, 1.0)], "r double, s double")
    row = A.validation_metrics(flat, "r", "s").first()
    assert row.samples == 2 and row.r2 == 0.0 and row.correlation == 0.0
    wild = spark.createDataFrame([(1.0, 100.0), (2.0, -100.0)], "r double, s double")
    assert A.validation_metrics(wild, "r", "s").first().r2 == -1.0


def test_ks_pvalue(spark):
    df = spark.createDataFrame([(0.0, 10, 10), (0.5, 100, 100), (1.0, 50, 50)], "d double, n int, m int")
    p = [r[0] for r in df.select(A.ks_pvalue(F.col("d"), F.col("n"), F.col("m"))).collect()]
    lam2 = 0.25 * 50
    assert p[0] == 1.0 and p[1] == pytest.approx(2 * (math.exp(-2 * lam2) - math.exp(-8 * lam2))) and p[2] < 1e-15


def test_histogram_constant_and_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4)], "x double")
    got = {r.bin: r["count"] for r in A.histogram(df, "x", 4).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2}
    assert A.histogram(df.filter("x = 1"), "x", 4).collect()[0]["count"] == 1


def test_clip_and_scale_edges(spark):
    few = spark.createDataFrame([(float(i), 7.0) for i in (1, 2, 1000)], "a double, b double")
    assert [r.a for r in C.clip_deviations(few, ["a"]).orderBy("a").collect()] == [1, 2, 1000]
    many = spark.createDataFrame([(1.0, 7.0)] * 30 + [(1000.0, 7.0)], "a double, b double")
    out = C.clip_deviations(many, ["a", "b"])
    assert out.agg(F.max("a")).first()[0] < 1000 and out.filter("b <> 7").isEmpty()
    assert C.standard_scale(many, ["b"]).filter("b <> 0").isEmpty()
    assert C.robust_scale(many, ["b"]).filter("b <> 0").isEmpty()


def test_iqr_filter_is_sequential_and_drops_nulls(spark):
    rows = [(float(i), float(i % 5)) for i in range(100)] + [(10_000.0, 2.0), (None, 1.0), (50.0, 900.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert C.iqr_filter(df, ["a", "b"]).count() == 100
    assert C.iqr_filter(df.filter("a is null"), ["a"]).count() == 0


def test_codes_for_new_categories(spark):
    seen = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    codes = {"k": C.category_codes(seen, "k")}
    new = spark.createDataFrame([("c",), ("zz",)], "k string")
    assert {r.k: r.k_encoded for r in C.label_encode(new, ["k"], codes).collect()} == {"c": 2, "zz": 3}


def test_augmentation_sizes_are_repeatable(spark):
    df = spark.range(400).select("id", (F.col("id") * 1.0 + 5).alias("v"))
    noise = C.with_noise(df, ["v"], ["id"])
    assert noise.count() == 100 and sorted(noise.collect()) == sorted(C.with_noise(df.repartition(7), ["v"], ["id"]).collect())
    mixed = C.interpolated(df, ["v"], ["id"])
    assert mixed.count() == 50 and mixed.agg(F.max("v")).first()[0] <= 404
    train, test = C.hash_split(df, ["id"])
    assert train.count() + test.count() == 400 and train.intersect(test).isEmpty() and 40 < test.count() < 120


def test_upsert_and_ranges(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "x", 9, 1), (2, "y", 8, 2), (3, "z", 7, 1)], "k int, s string, n int, v int")
    got = sorted(map(tuple, S.upsert(base, new, ["k"], ["s"], ["v"]).collect()))
    assert got == [(1, "a", 5), (2, "y", 6), (3, "z", 7)]


def test_interval_join_crosses_buckets(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    runs = spark.createDataFrame([(1, "a", at(0, 30), at(3, 0)), (2, "a", at(2, 0), at(2, 0)), (3, "b", at(5), at(4))],
                                 "run_id int, node_id string, start_time timestamp, end_time timestamp")
    samples = spark.createDataFrame([(i, "a", at(i // 2, 30 * (i % 2))) for i in range(8)] + [(9, "b", at(4, 30))],
                                    "sample_id int, node_id string, time timestamp")
    got = sorted((r.run_id, r.sample_id) for r in J.during_runs(samples, runs, 1800).collect())
    assert got == [(1, i) for i in range(1, 7)] + [(2, 4)]


def test_run_statistics_without_pairs(spark):
    draw = random.Random(5)
    at = lambda seconds: datetime(2024, 1, 1) + timedelta(seconds=seconds)
    nodes = ["a", "b", None]
    samples = [(draw.choice(nodes), at(draw.randrange(40_000)) if i % 50 else None, None if i % 7 == 0 else draw.random() * 100) for i in range(1500)]
    spans = [(draw.randrange(40_000), draw.randrange(-200, 30_000)) for _ in range(150)]
    runs = [(i // 2 if i % 9 else None, draw.choice(nodes), at(s), at(s + d) if i % 13 else None) for i, (s, d) in enumerate(spans)] * 2
    runs += [(900, "a", samples[3][1] or at(0), samples[3][1] or at(0)), (901, "a", at(50_000), at(60_000))]
    s = spark.createDataFrame(samples, "node_id string, time timestamp, x double").cache()
    r = spark.createDataFrame(runs, "run_id int, node_id string, start_time timestamp, end_time timestamp")
    pairs = J.during_runs(s, r).groupBy("run_id").agg(F.avg("x"), F.sum("x"), F.max("x"), F.stddev_samp("x"), F.count("x"))
    expected = {row[0]: row[1:] for row in pairs.collect()}
    for rows_per_chunk in (30, 20_000):
        stats = J.stats_during_runs(s, r, ["x"], rows_per_chunk=rows_per_chunk)
        got = {row[0]: row[1:] for row in stats.select("run_id", J.mean_of("x"), J.sum_of("x"), J.largest_of("x"), J.deviation_of("x"), "x_n").collect()}
        assert got.keys() == expected.keys()
        for k, row in got.items():
            assert row == pytest.approx(expected[k], rel=1e-9, abs=1e-6), (k, rows_per_chunk)


def test_run_statistics_grow_with_the_rows(spark):
    """All runs cover all samples: the pairs would be 25 million."""
    at = F.timestamp_seconds(F.col("id") * 10)
    s = spark.range(5000).select(F.lit("a").alias("node_id"), at.alias("time"), F.col("id").cast("double").alias("x"))
    r = spark.range(5000).select(F.col("id").alias("run_id"), F.lit("a").alias("node_id"), F.timestamp_seconds(-F.col("id")).alias("start_time"), F.timestamp_seconds(F.lit(10**6)).alias("end_time"))
    stats = J.stats_during_runs(s, r, ["x"], rows_per_chunk=500)
    assert stats.groupBy("x_n", "x_sum", "x_max").count().collect() == [(5000, 4999 * 2500.0, 4999.0, 5000)]


def test_formulas_guard_zero(spark):
    df = spark.createDataFrame([(0.0,)], "z double")
    row = df.select(P.efficiency_score("z", "z", "z").alias("e"), P.performance_per_watt("z", "z", "z").alias("p"),
                    P.prediction_error_percent("z", F.lit(3.0)).alias("x"), P.monitor_watts("z", F.lit(50.0), F.lit(0.0), "z", "z").alias("m"),
                    P.cost_usd(F.lit(12345.0)).alias("c"), V.is_throttled(F.col("z"), F.col("z")).alias("t")).first()
    assert (row.e, row.p, row.x, row.m, row.c, row.t) == (0.0, 0.0, 0.0, 50.0, 1.4814, False)


def test_validation_advice_falls_back(spark):
    good = spark.createDataFrame([("energy", 0.9, 5.0)], "component string, r2 double, mape double")
    assert V.validation_advice(good).collect() == [("all", "fine-tune for specific uses")]


@pytest.fixture(scope="module")
def run(tables):
    return M.train_models(jobs(tables), LABEL, KEYS, ["linear_regression", "random_forest"], trees=5)


def test_models_beat_the_mean(run, tables):
    assert all(r.r2 > 0.5 for r in run.scores.collect())
    mean = M.mean_prediction(run.models, run.test)
    assert A.regression_errors(mean, LABEL, "prediction").first().r2 > 0.5
    ranking = M.importances(tables.spark, run.models["random_forest"], run.names)
    assert ranking.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_spread_brackets_the_trees(run):
    band = M.tree_spread(run.models["random_forest"], run.test)
    assert band.filter("lower > upper or spread < 0").isEmpty()
    line = M.tree_spread(run.models["linear_regression"], run.test).filter("prediction > 0")
    assert line.filter("abs(lower - prediction * 0.9) > 1e-9").isEmpty()


def test_leaves_vote_as_the_trees_do(run):
    model = run.models["random_forest"]
    rows = run.test.limit(40).persist()
    plain = [[r.prediction for r in tree.transform(rows.select("job_id", "features")).orderBy("job_id").collect()] for tree in model.trees]
    found = [r.votes for r in M.tree_votes(model, rows, lambda votes: votes, "votes").orderBy("job_id").collect()]
    assert np.allclose(np.array(plain).T, np.array(found))
    band = M.tree_spread(model, rows).orderBy("job_id").collect()
    assert np.allclose([r.upper for r in band], np.percentile(np.array(plain).T, 95, axis=1))
    assert M.tree_votes(model, rows.limit(0), lambda votes: votes, "votes").collect() == []


def test_stages_score_like_separate_fits(run):
    from pyspark.ml.regression import GBTRegressor

    boosting = GBTRegressor(featuresCol="features", labelCol=LABEL, maxDepth=2, seed=42)
    staged = {r.params: r for r in M.staged_search(run.train, boosting, {"maxIter": [2, 5], "stepSize": [0.1, 0.3]}, LABEL, KEYS, folds=2, rows=300).collect()}
    assert set(staged) == {f"maxIter={n}, stepSize={x}" for n in (2, 5) for x in (0.1, 0.3)}
    rows = M.sample_exact(run.train, 300, KEYS, 42)
    plain = M.search_table(rows.sparkSession, M.search(rows, boosting, {"maxIter": [2, 5], "stepSize": [0.1, 0.3]}, LABEL, KEYS, folds=2))
    for r in plain.collect():
        assert staged[r.params].mean_rmse == pytest.approx(r["mean"])


def test_saved_model_predicts_the_same(run, tables, tmp_path):
    best = run.pipeline(run.best())
    M.save_model(best, str(tmp_path / "m"))
    pick = lambda m: sorted(m.transform(jobs(tables)).select("job_id", "prediction").collect())
    assert pick(M.load_model(str(tmp_path / "m"))) == pick(best)


def test_permutation_importance_finds_duration(run):
    table = M.permutation_importance(run.models["linear_regression"], run.test, run.names, LABEL, KEYS, repeats=2)
    assert table.orderBy(F.desc("importance")).first().feature in ("duration_seconds", "cpu_hours", "memory_hours", "peak_cpu_temp", "cpu_usage", "avg_cpu_temp")
    assert table.count() == len(run.names)


def test_temperature_model_drops_its_target(tables):
    run = M.train_temperature(jobs(tables), KEYS, chosen=["linear_regression"])
    assert not set(M.HEAT) & set(run.names)


def test_correlations_with_and_without_nulls(spark):
    rows = [(float(i), float(i * i), 3.0, None if i % 4 == 0 else float(-i)) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    plain = {(r.i, r.j): r.r for r in A.correlations(df, ["a", "b", "c"]).collect()}
    assert plain["a", "b"] == plain["b", "a"] == pytest.approx(df.agg(F.corr("a", "b")).first()[0])
    assert plain["a", "c"] is None and plain["c", "c"] == 1.0
    gaps = {(r.i, r.j): r.r for r in A.correlations(df, ["a", "b", "c", "d"]).collect()}
    assert gaps["a", "d"] == pytest.approx(-1.0) and gaps["a", "b"] == pytest.approx(plain["a", "b"]) and gaps["d", "c"] is None
    assert C.varied_features(df, ["a", "b", "c", "d"], max_correlation=0.99) == ["a", "b"]


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(500)
    small = sorted(df.orderBy(S.hash_order(["id"], 42), "id").limit(120).collect())
    assert sorted(S.sample_exact(df.repartition(6), 120, ["id"]).collect()) == small and len(small) == 120


def test_keys_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = S.one_per_key(df, ["k"], [F.desc("id")])
    assert sorted(r.id for r in plan.collect()) == [97, 98, 99]
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_spreads_and_bounds_of_several_columns(spark):
    draw = np.random.default_rng(3)
    rows = [(str(k % 3), float(a), float(b) if k % 7 else None) for k, (a, b) in enumerate(draw.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    got = {r.g: r for r in A.spreads(df, {"a": "a_", "b": "b_"}, ["g"], {"p95": 0.95, "p50": 0.5}).collect()}
    for g, r in got.items():
        for k, c in ((1, "a"), (2, "b")):
            own = [x[k] for x in rows if x[0] == g and x[k] is not None]
            assert [r[f"{c}_{n}"] for n in ("avg", "std", "p95", "p50")] == pytest.approx([np.mean(own), np.std(own, ddof=1), *np.percentile(own, [95, 50])])
    kept = C.iqr_filter(df, ["a", "b"], reach=0.2)
    lo, hi = np.percentile([x[1] for x in rows], [15, 85])
    first = [x for x in rows if lo - 0.2 * (hi - lo) <= x[1] <= hi + 0.2 * (hi - lo)]
    lo, hi = np.percentile([x[2] for x in first if x[2] is not None], [15, 85])
    want = [x for x in first if x[2] is not None and lo - 0.2 * (hi - lo) <= x[2] <= hi + 0.2 * (hi - lo)]
    assert sorted((r.g, r.a, r.b) for r in kept.collect()) == sorted(want)


def test_training_joins_once_and_in_few_tasks(tables):
    run = M.train_models(jobs(tables).repartition(7), LABEL, KEYS, ["linear_regression"], most_rows=300)
    assert run.train.count() == 300 and run.train.rdd.getNumPartitions() == 1
    assert "Join" not in run.test._jdf.queryExecution().optimizedPlan().toString()


def test_sample_numbers_few_rows(spark, monkeypatch):
    numbered = []
    whole = S.position_in_order
    monkeypatch.setattr(S, "position_in_order", lambda df, *a: numbered.append(df.count()) or whole(df, *a))
    df = spark.range(40_000)
    got = {r.id for r in S.sample_exact(df, 100, ["id"], 7).collect()}
    order = [r.id for r in df.orderBy(S.hash_order(["id"], 7), "id").limit(100).collect()]
    assert got == set(order) and numbered[0] < 200
    assert S.sample_exact(df, 0, ["id"]).count() == 0 and S.sample_exact(df.limit(5), 9, ["id"]).count() == 5


def test_written_rows_are_read_by_several_tasks(spark):
    """One file of 2 million rows, each costly to score, is no single task."""
    wide = spark.range(0, 2_000_000, 1, 1).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    read = checkpointed(wide, SMALL_GROUPS)
    assert len(read.inputFiles()) == 1
    rows = [r[0] for r in read.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(rows) == 2_000_000 and len(rows) > 3 and max(rows) < 1_000_000


def test_long_runs_are_not_repeated_per_bucket(spark):
    """A run of ten thousand years touches more seconds than an array can hold."""
    at = lambda k: datetime(2024, 1, 1) + timedelta(seconds=k)
    samples = [(k, "ab"[k % 2], at(7 * k % 50), float(k)) for k in range(60)] + [(60, None, at(1), 0.0), (61, "a", None, 0.0), (62, "a", at(7), 1.0)]
    runs = [(0, "a", datetime(1, 1, 2), datetime(9999, 12, 30)), (1, "a", at(7), at(7)), (1, "a", at(7), at(7)), (2, "b", at(3), at(31)), (3, "b", at(9), at(8)),
            (4, "c", at(0), at(50)), (5, None, at(0), at(50)), (6, "b", None, at(50)), (7, "a", at(60), at(70))]
    s = spark.createDataFrame(samples, "sample_id long, node_id string, time timestamp_ntz, x double")
    r = spark.createDataFrame(runs, "run_id long, node_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    got = sorted((p.run_id, p.sample_id) for p in J.during_runs(s, r, 1, samples_per_cell=4).collect())
    assert got == sorted((i, k) for i, n, b, e in runs for k, m, t, _ in samples if n and n == m and t and b and b <= t <= e)
    assert J.during_runs(s, r).count() == len(got)


def labelled(df):
    return df.filter(S.finite(LABEL) & (F.col(LABEL) > 0))


@pytest.mark.parametrize("name", ["m15_evaluate_new_data", "m17_temperature_profile"])
def test_models_learn_from_all_rows(tables, monkeypatch, name):
    runs, whole = [], M.train_models
    monkeypatch.setattr(M, "train_models", lambda df, *a, **k: runs.append((df, whole(df, *a, **k))) or runs[-1][1])
    REGISTRY[name](tables.spark, tables.sf_dir)
    df, run = runs[0]
    assert run.train.count() + run.test.count() == df.filter(S.finite(run.label)).count() and run.train.count() > 3000


def test_registered_models_learn_from_all_rows(tables):
    run = trained(tables, "linear_regression")
    assert run.train.count() == C.hash_split(labelled(jobs(tables)), KEYS, 20, 42)[0].count() > 3000


def test_many_rows_are_learned_in_several_equal_tasks(spark):
    df = spark.range(130_000).select(F.col("id").cast("string").alias("job_id"), (F.col("id") % 97).cast("int").alias("duration_seconds"), (F.col("id") % 97 + 1.0).alias(LABEL))
    runs = [M.train_models(x, LABEL, KEYS, ["linear_regression"]) for x in (df, df.repartition(5))]
    place = lambda run: [[r.job_id for r in p] for p in run.train.rdd.glom().collect()]
    assert place(runs[0]) == place(runs[1]) and len(place(runs[0])) == 5
    assert sum(map(len, place(runs[0]))) == C.hash_split(df, KEYS, 20, 42)[0].count() > 100_000


def test_grid_search_takes_all_rows(tables, monkeypatch):
    searched, whole = [], M.fold_column
    monkeypatch.setattr(M, "FOREST_GRID", {"numTrees": [2], "maxDepth": [2], "minInstancesPerNode": [1]})
    monkeypatch.setattr(M, "sample_exact", None)
    monkeypatch.setattr(M, "fold_column", lambda *a: searched.append(a) or whole(*a))
    assert len(REGISTRY["m9_grid_search"](tables.spark, tables.sf_dir).collect()) == 1 and searched


def test_forests_predict_by_arrays_as_mllib_does(run):
    model = run.models["random_forest"]
    both = M.predicted(model.copy({model.predictionCol: "own"}), model.transform(run.test))
    assert both.filter("own != prediction").isEmpty() and both.count() == run.test.count()
    plan = M.tree_spread(model, run.test.select("features"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("summarised(") == 0 and plan.count("walked(") == 1
    assert M.predicted(model, run.test.limit(0)).collect() == []


def test_trees_that_split_by_category_vote(spark):
    from pyspark.ml.feature import VectorAssembler, VectorIndexer
    from pyspark.ml.regression import RandomForestRegressor

    df = spark.createDataFrame([(float(k % 5), k / 100, float([3, 9, 1, 7, 5][k % 5])) for k in range(200)], "a double, b double, y double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="raw").transform(df)
    df = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=8).fit(df).transform(df)
    model = RandomForestRegressor(labelCol="y", numTrees=3, seed=1).fit(df)
    assert M.tree_walk(model) is None
    rows = M.tree_votes(model, df, lambda votes: votes, "votes").collect()
    assert all(r.prediction == pytest.approx(np.mean(r.votes)) for r in rows)
