"""Energy and temperature models on MLlib: training, search, scoring, importance."""

from __future__ import annotations

import itertools
import random
import re
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.functions import power as P
from wattgrid.operators.cleaning import hash_split
from wattgrid.operators.ordered import position_in_order
from wattgrid.operators.scans import available, finite, hash_order, sample_exact
from wattgrid.operators.stats import regression_errors
from wattgrid.session import SMALL_GROUPS, checkpointed

# Columns the models learn from, where present (fixed values).
NUMERIC = ["cpu_cores", "memory_mb", "duration_seconds", "cpu_usage", "memory_usage", "io_read_mbps", "io_write_mbps",
           "network_rx_mbps", "network_tx_mbps", "avg_cpu_temp", "peak_cpu_temp"]
CATEGORICAL = ["job_type", "partition", "workload_pattern"]
CLUSTERED = ["duration_seconds", "cpu_operations", "io_operations", "cpu_percent_mean", "memory_percent_mean",
             "estimated_energy_wh"]
HEAT = ["avg_cpu_temp", "peak_cpu_temp", "temp_variance"]

DERIVED = {
    "cpu_hours": (("cpu_cores", "duration_seconds"), "cpu_cores * duration_seconds / 3600D"),
    "memory_hours": (("memory_mb", "duration_seconds"), "double(memory_mb) * duration_seconds / 3600D"),
    "effective_cpu_usage": (("cpu_usage", "cpu_cores"), "cpu_usage * cpu_cores / 100D"),
    "temp_variance": (("avg_cpu_temp", "peak_cpu_temp"), "peak_cpu_temp - avg_cpu_temp"),
}


@dataclass(frozen=True)
class Features:
    """Pipeline stages that turn job rows into a feature vector, and its names."""

    stages: list = field(repr=False)
    names: list[str] = field(default_factory=list)


def job_features(df: DataFrame, drop: Sequence[str] = ()) -> Features:
    """Derived columns, category codes, medians for nulls, then one vector."""
    numeric = [c for c in available(df, NUMERIC) if c not in drop]
    categorical = available(df, CATEGORICAL)
    derived = {n: e for n, (needs, e) in DERIVED.items() if n not in drop and set(needs) <= set(df.columns)}
    doubles = [f"double({c}) as _{c}" for c in numeric] + [f"double({e}) as _{n}" for n, e in derived.items()]
    texts = [f"coalesce(string({c}), 'unknown') as _{c}" for c in categorical]
    stages: list = [SQLTransformer(statement=f"select *, {', '.join(doubles + texts)} from __THIS__")]
    if categorical:
        stages.append(StringIndexer(inputCols=[f"_{c}" for c in categorical], outputCols=[f"_{c}_code" for c in categorical],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
    plain = [*numeric, *derived]
    stages.append(Imputer(strategy="median", inputCols=[f"_{c}" for c in plain], outputCols=[f"_{c}_full" for c in plain]))
    columns = [f"_{c}_full" for c in plain] + [f"_{c}_code" for c in categorical]
    stages.append(VectorAssembler(inputCols=columns, outputCol="raw_features", handleInvalid="keep"))  # nulls are filled before; no row is left out
    return Features(stages, plain + [f"{c}_encoded" for c in categorical])


def scaler() -> StandardScaler:
    return StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)


def estimators(label: str, rows: int, trees: int = 100, seed: int = 42) -> dict[str, Estimator]:
    """The regressors by name.  ``rows`` turns a penalty on the summed error into one on the mean."""
    common = dict(featuresCol="features", labelCol=label)
    linear = lambda **kw: LinearRegression(**common, standardization=False, **kw)
    return {
        "linear_regression": linear(),
        "ridge": linear(regParam=1.0 / max(rows, 1), elasticNetParam=0.0),
        "lasso": linear(regParam=1.0, elasticNetParam=1.0),
        "elastic_net": linear(regParam=1.0, elasticNetParam=0.5),
        "huber": linear(loss="huber", epsilon=1.35),
        "random_forest": RandomForestRegressor(**common, numTrees=trees, maxDepth=10, seed=seed),
        "gradient_boosting": GBTRegressor(**common, maxIter=trees, maxDepth=3, stepSize=0.1, seed=seed),
        "decision_tree": DecisionTreeRegressor(**common, maxDepth=10, seed=seed),
    }


# Search grids (fixed values); an unlimited depth becomes MLlib's maximum of 30.
FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4]}
BOOSTING_GRID = {"maxIter": [100, 200, 300], "stepSize": [0.05, 0.1, 0.15], "maxDepth": [3, 5, 7],
                 "subsamplingRate": [0.8, 0.9, 1.0]}


#: Labelled rows that the analysis run's models learn from, drawn by hash.
SEARCH_ROWS = 1_000

#: Learned rows a task works on; few rows in many tasks make each of a fit's many jobs as slow as its tasks are many,
#: so beyond ``MANY_TASKS`` tasks get more rows, up to ``MOST_ROWS_PER_TASK``.
ROWS_PER_TASK, MANY_TASKS, MOST_ROWS_PER_TASK = 25_000, 64, 250_000


def learned_tasks(rows: int) -> int:
    return max(1, min(-(-rows // ROWS_PER_TASK), MANY_TASKS), -(-rows // MOST_ROWS_PER_TASK))


def dealt(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """``df`` in the same tasks and order however it was partitioned before: forests draw rows by their place."""
    tasks = learned_tasks(df.count())
    return df.repartition(tasks, *df.columns).sortWithinPartitions(hash_order(keys, seed), *df.columns)


def written_once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` if it is a written table, else its ``columns`` written as one: training reads its rows many times."""
    return df if hasattr(df, "_own_folder") else checkpointed(df.select(*columns), SMALL_GROUPS)


@dataclass
class Trained:
    """Fitted feature and regression models with their scores on the test rows."""

    features: PipelineModel
    models: dict[str, object]
    scores: DataFrame
    names: list[str]
    label: str
    train: DataFrame
    test: DataFrame

    def best(self, by: str = "rmse") -> str:
        order = F.desc("r2") if by == "r2" else F.asc(by)
        return self.scores.orderBy(order, "model_name").first().model_name

    def release(self) -> None:
        """Give up the cached training rows."""
        self.train.unpersist()

    def pipeline(self, name: str) -> PipelineModel:
        """Feature stages and model together: what is saved, loaded and applied."""
        return PipelineModel(stages=[self.features, self.models[name]])


def train_models(df: DataFrame, label: str, keys: Sequence[str], chosen: Sequence[str] | None = None, *,
                 trees: int = 100, drop: Sequence[str] = (), positive: bool = True, test_percent: int = 20,
                 seed: int = 42, most_rows: int | None = None, written: bool = False) -> Trained:
    """Fit every chosen regressor on the same prepared training rows and score each once.

    All labelled training rows are learned from, or ``most_rows`` of them, drawn by hash, if given; all test rows are scored.
    Rows are read several times, so they are written first, unless ``written`` says that ``df`` reads a written table.
    """
    needed = list(dict.fromkeys([*keys, label, *available(df, [*NUMERIC, *CATEGORICAL])]))
    df = df if written else written_once(df, needed)
    rows = df.filter(finite(label) & (F.col(label) > 0) if positive else finite(label))
    train, test = hash_split(rows, keys, test_percent, seed)
    train = train.select(*needed)
    if most_rows is not None:
        train = checkpointed(sample_exact(train, most_rows, keys, seed + 1))
    plan = job_features(df, drop)
    features = Pipeline(stages=[*plan.stages, scaler()]).fit(train)
    ready = features.transform(dealt(train, keys, seed + 1)).select(*keys, label, "features").persist()
    held = features.transform(test).select(*keys, label, "features")
    known = estimators(label, ready.count(), trees, seed)
    models, scores = {}, []
    for name in chosen or known:
        began = time.perf_counter()
        models[name] = known[name].fit(ready)
        fitted = time.perf_counter()
        score = regression_errors(predicted(models[name], held), label, "prediction").drop("variance").first()
        done = time.perf_counter()
        scores.append({"model_name": name, **score.asDict(), "training_time": fitted - began, "prediction_time": done - fitted})
    columns = ["model_name", "samples", "mae", "mse", "rmse", "mape", "r2", "correlation", "training_time", "prediction_time"]
    schema = ", ".join(f"{c} {'string' if c == 'model_name' else 'bigint' if c == 'samples' else 'double'}" for c in columns)
    table = df.sparkSession.createDataFrame([[s[c] for c in columns] for s in scores], schema)
    return Trained(features, models, table, plan.names, label, ready, held)


def train_temperature(df: DataFrame, keys: Sequence[str], keep_heat: bool = False, **options) -> Trained:
    """Temperature model; the target and what derives from it are no features unless asked for."""
    label = available(df, ["avg_cpu_temp", "peak_cpu_temp", "cpu_temp"])[0]
    return train_models(df, label, keys, drop=() if keep_heat else HEAT, positive=False, **options)


def mean_prediction(models: dict[str, object], df: DataFrame) -> DataFrame:
    """Average of the models' predictions."""
    names = []
    for name, model in models.items():
        df = predicted(model.copy({model.predictionCol: f"_p_{name}"}), df)
        names.append(f"_p_{name}")
    mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)
    return df.withColumn("prediction", mean).drop(*names)


def fold_column(keys: Sequence[str], folds: int, seed: int = 42) -> Column:
    return F.pmod(hash_order(keys, seed), F.lit(folds)).cast("int")


def search(df: DataFrame, estimator: Estimator, grid: dict[str, list], label: str, keys: Sequence[str], *, folds: int = 5,
           metric: str = "rmse", draws: int | None = None, parallelism: int = 4, seed: int = 42) -> CrossValidatorModel:
    """Cross-validated search over the grid, or over ``draws`` seeded picks of it."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    maps = builder.build()
    if draws is not None and draws < len(maps):
        maps = random.Random(seed).sample(maps, draws)
    evaluator = RegressionEvaluator(labelCol=label, metricName=metric)
    validator = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds,
                               foldCol="fold", parallelism=parallelism)
    return validator.fit(df.withColumn("fold", fold_column(keys, folds, seed)))


def search_table(spark, result: CrossValidatorModel) -> DataFrame:
    """One row per tried parameter set: mean and deviation of its score over the folds."""
    rows = [(", ".join(sorted(f"{p.name}={v}" for p, v in m.items())), float(a), float(s))
            for m, a, s in zip(result.getEstimatorParamMaps(), result.avgMetrics, result.stdMetrics)]
    return spark.createDataFrame(rows, "params string, mean double, std double")


def importances(spark, model, names: Sequence[str]) -> DataFrame:
    """Features by importance, or by absolute coefficient, ranked."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    table = spark.createDataFrame([(n, abs(float(v))) for n, v in zip(names, values.toArray())], "feature string, importance double")
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def permutation_importance(model, df: DataFrame, names: Sequence[str], label: str, keys: Sequence[str], repeats: int = 5,
                           seed: int = 42) -> DataFrame:
    """Rise of the mean squared error when one feature is taken from another row.

    Rows are numbered once in hash order; in each repeat every row borrows from
    the row a fixed distance further on, which is a permutation.
    """
    slim = df.select(*keys, label, vector_to_array("features").alias("_x"), hash_order(keys, seed).alias("_h"))
    numbered = checkpointed(position_in_order(slim, ["_h", *keys]).drop("_h", *keys))
    n = numbered.count()
    draw = random.Random(seed)
    shifts = [draw.randrange(1, max(n, 2)) for _ in range(repeats)]
    # Plain columns: each of these rows is shuffled once a repeat.
    rows = numbered.select(label, "_x", F.posexplode(F.array(*[F.pmod(F.col("position") - 1 + s, F.lit(n)) + 1 for s in shifts])).alias("repeat", "_from"))
    donors = numbered.select(F.col("position").alias("_at"), F.col("_x").alias("_y"))
    both = rows.join(donors, F.col("_from") == F.col("_at")).withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    mixed = F.transform("_x", lambda x, i: F.when(i == F.col("_f"), F.get(F.col("_y"), i)).otherwise(x))
    from pyspark.ml.functions import array_to_vector

    scored = model.transform(both.select(label, "_f", "repeat", array_to_vector(mixed).alias("features")))
    error = (F.col(label) - F.col("prediction")) ** 2
    base = model.transform(df).agg(F.avg(error)).scalar()
    per = scored.groupBy("_f", "repeat").agg(F.avg(error).alias("mse"))
    table = F.array(*[F.lit(x) for x in names])
    return per.groupBy(F.get(table, F.col("_f")).alias("feature")).agg(
        (F.avg("mse") - base).alias("importance"), F.coalesce(F.stddev_pop("mse"), F.lit(0.0)).alias("importance_std"))


def leaf_values(model) -> list[list[float]]:
    """What each leaf of each tree predicts, in the order that ``leafCol`` numbers leaves (from left to right)."""
    trees = re.split(r"^\s*Tree \d+ \(weight .*$", model.toDebugString, flags=re.M)[1:]
    return [[float(x) for x in re.findall(r"Predict: (\S+)", tree)] for tree in trees]


def tree_walk(model) -> Callable[[np.ndarray], np.ndarray] | None:
    """What each tree says of each row (rows x features in, trees x rows out), by arrays; None if a split is by category.

    All rows go down a tree together, a level at a time. Trees are read from the model's text, whose numbers are exact.
    """
    text = model.toDebugString
    if re.search(r"\(feature \d+ in \{", text):
        return None
    trees = []
    for tree in re.split(r"^\s*Tree \d+ \(weight .*$", text, flags=re.M)[1:]:
        feature, threshold, kids, value, above, free, depth = [], [], [], [], [], None, 0
        for word, *rest in filter(None, map(str.split, tree.splitlines())):
            if word == "Else":
                free = 2 * above.pop()
                continue
            node = len(value)
            if free is not None:
                kids[free] = node
            kids += [node, node]  # to the right and to the left; a leaf keeps its rows
            split = word == "If"
            feature.append(int(rest[1]) if split else 0)
            threshold.append(float(rest[3].rstrip(")")) if split else 0.0)
            value.append(0.0 if split else float(rest[0]))
            if split:
                above.append(node)
                free, depth = 2 * node + 1, max(depth, len(above))
        trees.append((np.array(feature), np.array(threshold), np.array(kids), np.array(value), depth))

    def walk(rows: np.ndarray) -> np.ndarray:
        flat, start = rows.ravel(), np.arange(len(rows)) * rows.shape[1]
        votes = np.empty((len(trees), len(rows)))
        for k, (feature, threshold, kids, value, depth) in enumerate(trees):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = kids.take(2 * node + (flat.take(start + feature.take(node)) <= threshold.take(node)))
            votes[k] = value.take(node)
        return votes

    return walk


def tree_votes(model, df: DataFrame, summary: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """``df`` with the prediction and, as array ``name``, a summary of what each row's trees say (rows x trees in, rows x numbers out).

    One pass whatever the number of trees; a forest's prediction is the mean of the votes, added tree by tree as MLlib adds them.
    """
    walk = tree_walk(model)
    if walk is None:
        return leaf_votes(model, df, summary, name)

    @F.arrow_udf("struct<mean double, found array<double>>")
    def walked(features: pa.Array) -> pa.Array:
        rows = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1) if len(features) else np.empty((0, 0))
        votes = walk(rows)
        mean = reduce(np.add, votes) / len(votes)
        found = summary(np.ascontiguousarray(votes.T)) if len(rows) else np.empty((0, 1))
        lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())
        return pa.StructArray.from_arrays([pa.array(mean), lists], ["mean", "found"])

    forest = isinstance(model, RandomForestRegressionModel)
    out = (df if forest else model.transform(df)).withColumn("_walked", walked(vector_to_array(model.getFeaturesCol())))
    added = {model.getPredictionCol(): F.col("_walked.mean")} if forest else {}
    return out.withColumns({**added, name: F.col("_walked.found")}).drop("_walked")


def predicted(model, df: DataFrame) -> DataFrame:
    """``df`` with the model's prediction; a forest's by arrays."""
    if not isinstance(model, RandomForestRegressionModel):
        return model.transform(df)
    return tree_votes(model, df, lambda votes: votes[:, :0], "_none").drop("_none")


def leaf_votes(model, df: DataFrame, summary: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """``tree_votes`` for trees that split by category: the model names each tree's leaf, and a table of leaf values says what it predicts."""
    values = leaf_values(model)
    offsets = np.cumsum([0, *[len(v) for v in values[:-1]]])
    table = np.concatenate([np.array(v) for v in values])
    leaf = f"_leaf_{name}"
    exact = "float32" if max(map(len, values)) < 1 << 24 else "float64"

    @F.arrow_udf("array<double>")
    def summarised(leaves: pa.Array) -> pa.Array:
        found = summary(table[leaves.flatten().to_numpy(zero_copy_only=False).reshape(len(leaves), -1).astype(np.int64) + offsets]) if len(leaves) else np.empty((0, 1))
        return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())

    return model.copy({model.leafCol: leaf}).transform(df).withColumn(name, summarised(vector_to_array(leaf, exact))).drop(leaf)


def tree_spread(model, df: DataFrame) -> DataFrame:
    """Prediction with the 5th and 95th percentile and deviation over a forest's trees.

    Models without trees, and boosting, whose trees are no votes, give a band of 10 percent.
    """
    if not hasattr(model, "treeWeights") or "GBT" in type(model).__name__:
        p = F.col("prediction")
        return model.transform(df).withColumns({"lower": p * 0.9, "upper": p * 1.1, "spread": F.lit(0.0)})

    def band(votes: np.ndarray) -> np.ndarray:
        return np.column_stack([*np.percentile(votes, [5, 95], axis=1), votes.std(axis=1)])

    out = tree_votes(model, df, band, "_band")
    return out.withColumns({n: F.get("_band", F.lit(k)) for k, n in enumerate(("lower", "upper", "spread"))}).drop("_band")


def staged_search(df: DataFrame, estimator: Estimator, grid: dict[str, list], label: str, keys: Sequence[str], *, folds: int = 5,
                  rows: int | None = None, seed: int = 42) -> DataFrame:
    """Cross-validated search of a tree ensemble: params, mean and deviation of RMSE and of R2 over the folds.

    For each setting of the other parameters one ensemble of the largest size is fitted a fold, and every smaller size in
    the grid is scored on the first trees of it. Boosting adds its trees one after another, so a stage is the same as a fit of that
    size; a forest's first trees are a forest of that size from the same draw. All rows are searched on, or ``rows`` of them,
    drawn by hash, if given. Fits run side by side only while their tasks leave cores idle: each holds its own draws of the rows.
    """
    size = "numTrees" if "numTrees" in grid else "maxIter"
    stages = sorted(grid[size])
    others = [dict(zip([k for k in grid if k != size], v)) for v in itertools.product(*[v for k, v in grid.items() if k != size])]
    drawn = df if rows is None else sample_exact(df, rows, keys, seed)
    folded = drawn.withColumn("fold", fold_column(keys, folds, seed))
    folded = (folded if rows is None else folded.coalesce(learned_tasks(rows))).persist()
    cores = df.sparkSession.sparkContext.defaultParallelism

    def scored(setting: dict, fold: int) -> list[tuple]:
        chosen = estimator.copy({estimator.getParam(k): v for k, v in {**setting, size: stages[-1]}.items()})
        model = chosen.fit(folded.filter(F.col("fold") != fold))
        weights = np.array(model.treeWeights)

        def at_stages(votes: np.ndarray) -> np.ndarray:
            total = np.cumsum(votes * weights, axis=1)[:, np.array(stages) - 1]
            return total / (np.cumsum(weights)[np.array(stages) - 1] if size == "numTrees" else 1.0)

        held = tree_votes(model, folded.filter(F.col("fold") == fold), at_stages, "_stages")
        error = held.select(label, F.posexplode("_stages").alias("k", "guess")).groupBy("k").agg(
            F.avg((F.col(label) - F.col("guess")) ** 2).alias("mse"), F.var_pop(label).alias("variance"))
        return [(", ".join(sorted(f"{a}={b}" for a, b in {**setting, size: stages[r.k]}.items())), float(r.mse) ** 0.5, 1 - r.mse / r.variance if r.variance else 0.0) for r in error.collect()]

    try:
        with ThreadPoolExecutor(max(1, min(4, cores // folded.rdd.getNumPartitions()))) as pool:
            found = [r for part in pool.map(lambda x: scored(*x), itertools.product(others, range(folds))) for r in part]
    finally:
        folded.unpersist()
    table = df.sparkSession.createDataFrame(found, "params string, rmse double, r2 double")
    return table.groupBy("params").agg(*[f(c).alias(f"{n}_{c}") for c in ("rmse", "r2") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def schedule_advice(scored: DataFrame) -> DataFrame:
    """Cost, emissions, priority and label for predicted jobs, best first."""
    energy = F.greatest(F.col("prediction"), F.lit(0.0))
    score = P.priority(energy, "duration_seconds")
    out = scored.withColumns({
        "predicted_energy_wh": F.round(energy, 2), "estimated_cost_usd": P.cost_usd(energy),
        "estimated_co2_kg": P.co2_kg(energy), "priority_score": F.round(score, 3),
        "efficiency_score": F.round(F.try_divide(energy, F.col("duration_seconds")), 3),
        "recommendation": P.priority_label(score)})
    return out.orderBy(F.desc("priority_score"), "job_id")


def temperature_profile(pipeline: PipelineModel, jobs: DataFrame, minutes: int = 60, step: int = 5) -> DataFrame:
    """Predicted temperature of each job every ``step`` minutes, were it to run that long."""
    grid = jobs.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(minutes - 1), F.lit(step))))
    asked = grid.withColumn("duration_seconds", (F.col("minute") * 60).cast("int")).withColumn("time_progress", F.col("minute") / minutes)
    return pipeline.transform(asked).select("job_id", "minute", F.col("prediction").alias("temperature"))


def profile_summary(profile: DataFrame) -> DataFrame:
    t = "temperature"
    return profile.groupBy("job_id").agg(F.min(t).alias("min"), F.max(t).alias("max"), F.avg(t).alias("mean"), F.stddev_pop(t).alias("std"))


def explain_predictions(scored: DataFrame, ranking: DataFrame, columns: Sequence[str], top: int = 3) -> DataFrame:
    """The ``top`` most important features of each prediction with their values."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    long = scored.select("job_id", "prediction", F.inline(F.array(*cells)))
    # One row per feature: the ranking is as small as the column list.
    best = ranking.filter(F.col("feature").isin(list(columns))).orderBy(F.desc("importance"), "feature").limit(top)
    return long.join(F.broadcast(best.select("feature", "importance")), "feature")


def overfit_check(model, train: DataFrame, validation: DataFrame, label: str, tolerance: float = 0.1) -> DataFrame:
    side = lambda df, name: regression_errors(model.transform(df), label, "prediction").select(F.lit(1).alias("_k"), F.col("r2").alias(name))
    both = side(train, "train_r2").join(side(validation, "validation_r2"), "_k").drop("_k")
    return both.withColumn("overfitted", F.col("train_r2") - F.col("validation_r2") > tolerance)


def compare_models(scores: DataFrame) -> DataFrame:
    """Best, worst and average scores, and the model to use: the most accurate if quick enough, else the quickest."""
    out = scores.agg(
        F.min("rmse").alias("best_rmse"), F.max("rmse").alias("worst_rmse"), F.max("r2").alias("best_r2"), F.min("r2").alias("worst_r2"),
        F.avg("training_time").alias("avg_training_time"), F.avg("prediction_time").alias("avg_prediction_time"),
        F.min_by("model_name", "rmse").alias("best_accuracy"), F.min_by("prediction_time", "rmse").alias("_t"),
        F.min_by("model_name", "training_time").alias("fastest_training"),
        F.min_by("model_name", "prediction_time").alias("fastest_prediction"))
    use = F.when(F.col("_t") < 1.0, F.col("best_accuracy")).otherwise(F.col("fastest_prediction"))
    return out.withColumn("production_recommendation", use).drop("_t")


def top_models(scores: DataFrame, by: str, largest: bool = False, n: int = 5) -> DataFrame:
    order = F.desc(by) if largest else F.asc(by)
    return scores.select("model_name", by).orderBy(order, "model_name").limit(n)


def cluster(df: DataFrame, columns: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """k-means cluster of each row on standardised columns; nulls count as 0."""
    filled = df.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    stages = [VectorAssembler(inputCols=[f"_{c}" for c in columns], outputCol="raw_features"), scaler(),
              KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")]
    out = Pipeline(stages=stages).fit(filled).transform(filled)
    return out.drop("raw_features", "features", *[f"_{c}" for c in columns])


def cluster_summary(clustered: DataFrame, columns: Sequence[str]) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("jobs"), *[
        F.round(f(c), 2).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
