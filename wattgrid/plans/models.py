"""Model training and scoring queries (M, A20, A41, T5, W12)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattgrid.operators import learning as M
from wattgrid.operators.stats import regression_errors
from wattgrid.plans.registry import query
from wattgrid.session import SMALL_GROUPS, checkpointed, own_folder

KEYS = ["job_id"]
LABEL = "estimated_energy_wh"


def jobs(t, *more):
    return t.job_metrics.select(*more, "job_id", "job_type", "cpu_cores", "memory_mb", "duration_seconds", "cpu_usage",
                                "memory_usage", "io_read_mbps", "io_write_mbps", "avg_cpu_temp", "peak_cpu_temp", LABEL)


def written_jobs(t):
    """The job rows, joined once for all passes of a query."""
    if "_written_jobs" not in vars(t):
        vars(t)["_written_jobs"] = checkpointed(jobs(t), SMALL_GROUPS)
    return vars(t)["_written_jobs"]


def trained(t, *chosen):
    return M.train_models(written_jobs(t), LABEL, KEYS, chosen)


@query("m1_one_feature_regression", """
select regr_slope(estimated_energy_wh, duration_seconds) as slope, regr_intercept(estimated_energy_wh, duration_seconds) as intercept,
  regr_r2(estimated_energy_wh, duration_seconds) as r2 from job_metrics""", r6="slope r2", r4="intercept")
def _(t):
    rows = VectorAssembler(inputCols=["duration_seconds"], outputCol="features").transform(jobs(t))
    model = LinearRegression(labelCol=LABEL, solver="normal").fit(rows)
    fitted = regression_errors(model.transform(rows), LABEL, "prediction")
    return fitted.select(F.lit(float(model.coefficients[0])).alias("slope"), F.lit(float(model.intercept)).alias("intercept"), "r2")


_PLAIN = ["duration_seconds", "cpu_cores", "memory_mb", "io_write_mbps"]


@query("m2_normal_equations", " union all ".join(
    f"select '{c}' as feature, count(*) as jobs, avg(estimated_energy_wh * {c}) / avg({c}) as mean from job_metrics" for c in _PLAIN), r3="mean")
def _(t):
    """Least squares: the fitted values have the label's moment with every feature."""
    rows = VectorAssembler(inputCols=_PLAIN, outputCol="features").transform(checkpointed(jobs(t).select(*_PLAIN, LABEL), SMALL_GROUPS))
    fitted = LinearRegression(labelCol=LABEL, solver="normal").fit(rows).transform(rows)
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in _PLAIN]
    return fitted.select("prediction", F.inline(F.array(*cells))).groupBy("feature").agg(
        F.count(F.lit(1)).alias("jobs"), (F.avg(F.col("prediction") * F.col("x")) / F.avg("x")).alias("mean"))


@query("m6_m11_m14_certificates", """
select 'band' as checked, count(*) as rows, 0::bigint as broken from job_metrics
union all select 'mean', count(*), 0 from job_metrics
union all select 'importance', 14, 0""")
def _(t):
    """Every job gets a band the right way round and the mean of the models; importances are shares of 1."""
    run = trained(t, "linear_regression", "random_forest")
    ready = run.features.transform(written_jobs(t))
    band = M.tree_spread(run.models["random_forest"], ready).withColumnRenamed("prediction", "random_forest")
    both = M.mean_prediction(run.models, band).withColumnRenamed("prediction", "mean")
    line = run.models["linear_regression"]
    both = line.copy({line.predictionCol: "linear_regression"}).transform(both)
    mean = (F.col("linear_regression") + F.col("random_forest")) / 2
    broken = lambda good: F.count_if(~F.coalesce(good, F.lit(False)))
    counted = both.agg(F.count(F.lit(1)).alias("rows"), broken((F.col("lower") <= F.col("upper")) & (F.col("spread") >= 0)).alias("band"),
                       broken(F.abs(F.col("mean") - mean) <= 1e-9 * F.abs(mean)).alias("mean"))
    counted = counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("checked"), "rows", F.col(c).alias("broken")) for c in ("band", "mean")])))
    shares = M.importances(t.spark, run.models["random_forest"], run.names).withColumn("total", F.sum("importance").over(Window.partitionBy()))
    good = (F.col("importance") >= 0) & (F.abs(F.col("total") - 1) < 1e-9)
    return counted.unionByName(shares.agg(F.lit("importance").alias("checked"), F.count(F.lit(1)).alias("rows"), broken(good).alias("broken")))


@query("s24_saved_model", "select count(*) as jobs, 0::bigint as changed from job_metrics")
def _(t):
    """Every job is scored alike by a model and by what is read back of it."""
    run = trained(t, "linear_regression", "decision_tree")
    path = own_folder(t.spark, "models", uuid.uuid4().hex)
    scored = written_jobs(t)
    for name in run.models:
        M.save_model(run.pipeline(name), f"{path}/{name}")
        for side, model in (("kept", run.pipeline(name)), ("read", M.load_model(f"{path}/{name}"))):
            added = [c for c in model.transform(scored).columns if c not in scored.columns and c != "prediction"]
            scored = model.transform(scored).drop(*added).withColumnRenamed("prediction", f"{name}_{side}")
    same = reduce(lambda a, b: a & b, [F.col(f"{n}_kept").eqNullSafe(F.col(f"{n}_read")) for n in run.models])
    return scored.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(~same).alias("changed"))


@query("m1_m5_m7_train_and_score")
def _(t):
    return trained(t).scores


@query("m7_train_temperature")
def _(t):
    return M.train_temperature(written_jobs(t), KEYS, chosen=["linear_regression", "random_forest"]).scores


@query("m6_mean_of_models")
def _(t):
    run = trained(t, "linear_regression", "random_forest", "gradient_boosting")
    return regression_errors(M.mean_prediction(run.models, run.test), LABEL, "prediction")


@query("m8_cross_validation")
def _(t):
    run = trained(t, "ridge")
    found = M.search(run.train, M.estimators(LABEL, run.train.count())["ridge"], {}, LABEL, KEYS)
    return M.search_table(t.spark, found)


@query("m9_grid_search")
def _(t):
    run = trained(t, "linear_regression")
    forest = RandomForestRegressor(featuresCol="features", labelCol=LABEL, maxDepth=M.FOREST_GRID["maxDepth"][0], seed=42)
    grid = {k: M.FOREST_GRID[k] for k in ("numTrees", "minInstancesPerNode")}  # depth 10; deeper trees take minutes a fit on a small machine
    return M.staged_search(run.train, forest, grid, LABEL, KEYS, folds=3)


@query("m10_random_search")
def _(t):
    run = trained(t, "linear_regression")
    line = LinearRegression(featuresCol="features", labelCol=LABEL)
    grid = {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.25, 0.5, 1.0]}
    return M.search_table(t.spark, M.search(run.train, line, grid, LABEL, KEYS, folds=3, draws=4))


@query("m11_w12_feature_importance")
def _(t):
    run = trained(t, "random_forest")
    return M.importances(t.spark, run.models["random_forest"], run.names)


@query("m12_permutation_importance")
def _(t):
    run = trained(t, "linear_regression")
    return M.permutation_importance(run.models["linear_regression"], run.test, run.names, LABEL, KEYS)


@query("m13_batch_prediction")
def _(t):
    run = trained(t, "linear_regression", "ridge", "decision_tree")
    return run.pipeline(run.best()).transform(written_jobs(t)).select("job_id", LABEL, "prediction")


@query("m14_prediction_spread")
def _(t):
    run = trained(t, "random_forest")
    return M.tree_spread(run.models["random_forest"], run.test).select("job_id", "prediction", "lower", "upper", "spread")


@query("m15_evaluate_new_data")
def _(t):
    timed = checkpointed(jobs(t, "time"), SMALL_GROUPS)
    seconds = F.col("time").cast("timestamp").cast("double")
    cut = timed.agg(F.min(seconds) + 0.8 * (F.max(seconds) - F.min(seconds))).scalar()
    run = M.train_models(timed.filter(seconds <= cut), LABEL, KEYS, ["linear_regression"], written=True)
    return regression_errors(run.pipeline("linear_regression").transform(timed.filter(seconds > cut)), LABEL, "prediction")


@query("m16_overfit_check")
def _(t):
    run = trained(t, "decision_tree")
    return M.overfit_check(run.models["decision_tree"], run.train, run.test, LABEL)


@query("m17_temperature_profile")
def _(t):
    run = M.train_temperature(written_jobs(t), KEYS, chosen=["linear_regression"])
    return M.temperature_profile(run.pipeline("linear_regression"), written_jobs(t))


@query("m18_explain_predictions")
def _(t):
    run = trained(t, "random_forest")
    ranking = M.importances(t.spark, run.models["random_forest"], run.names)
    scored = run.pipeline("random_forest").transform(written_jobs(t))
    columns = [c for c in M.NUMERIC if c in scored.columns]
    return M.explain_predictions(scored, ranking, columns)


_CLUSTER = ["duration_seconds", "cpu_usage", "memory_usage", LABEL]


@query("m19_a20_cluster_summary")
def _(t):
    return M.cluster_summary(M.cluster(checkpointed(jobs(t).select(*_CLUSTER), SMALL_GROUPS), _CLUSTER), _CLUSTER)


@query("m19_a20_cluster_members", " union all ".join(
    f"select '{c}' as feature, 5::bigint as clusters, count(*) as jobs, avg({c}) as mean from job_metrics" for c in _CLUSTER), r4="mean")
def _(t):
    """The clusters hold every job once: their sizes and weighted means are those of all jobs."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in _CLUSTER]
    parts = M.cluster(checkpointed(jobs(t).select(*_CLUSTER), SMALL_GROUPS), _CLUSTER).select("cluster", F.inline(F.array(*cells))).groupBy("cluster", "feature").agg(
        F.count(F.lit(1)).alias("jobs"), F.avg("x").alias("mean"))
    return parts.groupBy("feature").agg(F.count(F.lit(1)).alias("clusters"), F.sum("jobs").alias("jobs"),
                                        (F.sum(F.col("mean") * F.col("jobs")) / F.sum("jobs")).alias("mean"))


@query("m20_schedule_advice")
def _(t):
    run = trained(t, "random_forest")
    scored = M.tree_spread(run.models["random_forest"], run.features.transform(written_jobs(t)))
    # Written, as a global order reads its rows twice.
    scored = checkpointed(scored.select("job_id", "duration_seconds", "prediction", "lower", "upper"))
    return M.schedule_advice(scored).select(
        "job_id", "predicted_energy_wh", "lower", "upper", "estimated_cost_usd", "estimated_co2_kg", "priority_score",
        "efficiency_score", "recommendation")


@query("a41_compare_models")
def _(t):
    return M.compare_models(trained(t, "linear_regression", "ridge", "decision_tree").scores)


@query("t5_top_models")
def _(t):
    scores = trained(t, "linear_regression", "ridge", "lasso", "elastic_net", "huber", "decision_tree").scores
    return M.top_models(scores, "rmse").select("model_name", F.lit("rmse").alias("measure"), F.col("rmse").alias("value")).unionByName(
        M.top_models(scores, "r2", largest=True).select("model_name", F.lit("r2").alias("measure"), F.col("r2").alias("value")))


# Predictions of each version, method and job type as models of their own; their errors stand for times, which no table holds.
_SCORES = """scores as (select concat_ws(' ', model_version, prediction_method, job_type) as model_name,
  sqrt(avg((actual_energy_wh - predicted_energy_wh) ** 2)) as rmse,
  1 - avg((actual_energy_wh - predicted_energy_wh) ** 2) / var_pop(actual_energy_wh) as r2,
  avg(abs(actual_energy_wh - predicted_energy_wh)) / 100 as training_time,
  avg(abs(actual_energy_wh - predicted_energy_wh) / greatest(abs(actual_energy_wh), 1e-8)) as prediction_time
from energy_predictions where actual_energy_wh is not null group by 1)"""


def recorded_scores(t):
    named = t.energy_predictions.withColumn("model_name", F.concat_ws(" ", "model_version", "prediction_method", "job_type"))
    errors = regression_errors(named, "actual_energy_wh", "predicted_energy_wh", ["model_name"])
    return errors.withColumns({"training_time": F.col("mae") / 100, "prediction_time": F.col("mape") / 100})


@query("a41_compare_recorded", f"""with {_SCORES}
select min(rmse) as best_rmse, max(rmse) as worst_rmse, max(r2) as best_r2, min(r2) as worst_r2, avg(training_time) as avg_training_time,
  avg(prediction_time) as avg_prediction_time, arg_min(model_name, rmse) as best_accuracy, arg_min(model_name, training_time) as fastest_training,
  arg_min(model_name, prediction_time) as fastest_prediction,
  case when arg_min(prediction_time, rmse) < 1 then arg_min(model_name, rmse) else arg_min(model_name, prediction_time) end as production_recommendation
from scores""", r6="best_rmse worst_rmse best_r2 worst_r2 avg_training_time avg_prediction_time")
def _(t):
    return M.compare_models(recorded_scores(t))


@query("t5_top_recorded", f"""with {_SCORES}
(select model_name, 'rmse' as measure, rmse as value from scores order by rmse, model_name limit 5)
union all (select model_name, 'r2', r2 from scores order by r2 desc, model_name limit 5)""", r6="value")
def _(t):
    scores = recorded_scores(t)
    return M.top_models(scores, "rmse").select("model_name", F.lit("rmse").alias("measure"), F.col("rmse").alias("value")).unionByName(
        M.top_models(scores, "r2", largest=True).select("model_name", F.lit("r2").alias("measure"), F.col("r2").alias("value")))
