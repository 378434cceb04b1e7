"""Summary statistics, error metrics, correlations and validation scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.operators.ordered import position_in_order
from wattgrid.operators.quantiles import exact_percentiles, percentiles_by_column
from wattgrid.session import checkpointed


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys; one-row frames without keys are put side by side."""
    if keys:
        return left.join(right, list(keys))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(left).join(one(right), "_one").drop("_one")


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation of the pairs without nulls; null when either side does not vary.

    ``corr`` itself fails on a constant column when ANSI mode is on.
    """
    a = (F.col(a) if isinstance(a, str) else a).cast("double")
    b = (F.col(b) if isinstance(b, str) else b).cast("double")
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def spread(df: DataFrame, value: str, keys: Sequence[str] = (), percentiles: dict[str, float] | None = None,
           prefix: str = "") -> DataFrame:
    """avg, max, min, sample deviation and exact percentiles of a column."""
    basic = df.groupBy(*keys).agg(
        F.avg(value).alias(f"{prefix}avg"), F.max(value).alias(f"{prefix}max"),
        F.min(value).alias(f"{prefix}min"), F.stddev_samp(value).alias(f"{prefix}std"))
    if not percentiles:
        return basic
    exact = exact_percentiles(df, value, {f"{prefix}{n}": p for n, p in percentiles.items()}, keys)
    return join_on(basic, exact, keys)


def spreads(df: DataFrame, columns: dict[str, str], keys: Sequence[str], percentiles: dict[str, float]) -> DataFrame:
    """``spread`` of several columns (column -> prefix), whose percentiles share the same passes."""
    measures = {"avg": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp}
    basic = df.groupBy(*keys).agg(*[f(c).alias(f"{p}{n}") for c, p in columns.items() for n, f in measures.items()])
    exact = percentiles_by_column(df, list(columns), percentiles, keys).groupBy(*keys).agg(*[
        F.max(F.when(F.col("column") == c, F.col(n))).alias(f"{p}{n}") for c, p in columns.items() for n in percentiles])
    return join_on(basic, exact, keys)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, as rows (i, j, r).

    A first pass brings each column's mean, range and null count back.  Without
    nulls the second pass only sums products of centred columns, several times
    quicker than one correlation aggregate per pair; with nulls each pair is
    computed over its own complete rows.  A constant column has no correlation.
    """
    pairs = list(combinations(columns, 2))
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    seen = values.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (
        ("mean", F.avg), ("lo", F.min), ("hi", F.max), ("known", F.count))]).first()
    k = range(len(columns))
    if seen.n and all(seen[f"known{i}"] == seen.n for i in k):
        vary = {c for i, c in enumerate(columns) if seen[f"lo{i}"] != seen[f"hi{i}"]}
        at = {c: i for i, c in enumerate(columns)}
        centred = values.select(*[(F.col(c) - F.lit(seen[f"mean{i}"])).alias(f"d{i}") for i, c in enumerate(columns)])
        sums = centred.agg(*[F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"p{i}_{j}") for i in k for j in k if i <= j])
        r = [F.try_divide(F.col(f"p{at[a]}_{at[b]}"), F.sqrt(F.col(f"p{at[a]}_{at[a]}") * F.col(f"p{at[b]}_{at[b]}")))
             if {a, b} <= vary else F.lit(None).cast("double") for a, b in pairs]
        wide = sums.select(*[e.alias(f"r{n}") for n, e in enumerate(r)])
    else:
        wide = values.agg(*[safe_corr(a, b).alias(f"r{n}") for n, (a, b) in enumerate(pairs)])
    cell = lambda i, j, r: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), r.alias("r"))
    cells = [c for n, (a, b) in enumerate(pairs) for c in (cell(a, b, F.col(f"r{n}")), cell(b, a, F.col(f"r{n}")))]
    return wide.select(F.inline(F.array(*cells, *[cell(c, c, F.lit(1.0)) for c in columns])))


def correlation_ranking(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Features by absolute correlation with the target; an undefined one counts as 0.

    Correlations equal to twelve places rank by name, so the order does not hang
    on the order of addition.
    """
    wide = df.agg(*[safe_corr(c, target).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("feature"), _nan_to_zero(F.abs(F.col(c))).alias("strength")) for c in columns]
    ranked = wide.select(F.inline(F.array(*cells)))
    order = Window.orderBy(F.round("strength", 12).desc(), "feature")
    return ranked.withColumn("rank", F.row_number().over(order))


def _nan_to_zero(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(None)), F.lit(0.0))


def data_profile(df: DataFrame, time: str = "time") -> DataFrame:
    """Span, distinct jobs and nodes, missing share and a 0-100 quality score."""
    missing = reduce(lambda a, b: a + b, (F.count_if(F.col(c).isNull()) for c in df.columns))
    out = df.agg(
        F.min(time).alias("start_time"), F.max(time).alias("end_time"),
        F.count_distinct("job_id").alias("total_jobs"), F.count_distinct("node_id").alias("total_nodes"),
        F.count(F.lit(1)).alias("data_points"), missing.alias("_missing"),
        (F.count_if(F.col("prediction_accuracy").isNull()) if "prediction_accuracy" in df.columns else F.lit(0)).alias("_unscored"),
    )
    share = F.try_divide(F.col("_missing"), F.col("data_points") * len(df.columns)) * 100
    unscored = F.try_divide(F.col("_unscored"), F.col("data_points")) * 10
    return out.withColumns({
        "missing_data_percentage": share,
        "data_quality_score": F.greatest(F.lit(0.0), 100 - share - unscored),
    }).drop("_missing", "_unscored")


def regression_errors(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE, MAPE and R2, in one pass."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    error = y - p
    sums = df.filter(y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"),
        (F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(1e-8))) * 100).alias("mape"),
        F.var_pop(y).alias("_var"), safe_corr(y, p).alias("_corr"),
    )
    return sums.withColumns({
        "rmse": F.sqrt("mse"), "r2": 1 - F.try_divide(F.col("mse"), F.col("_var")),
        "variance": F.col("_var"), "correlation": F.col("_corr"),
    }).drop("_var", "_corr")


def ks_statistic(df: DataFrame, value: str, is_first: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between rows with and without ``is_first``.

    Values are first reduced to counts per distinct value; the cumulative shares
    then come from a range partitioned prefix sum, not from one sorted task.
    """
    keys = list(keys) or ["_all"]
    base = df if "_all" not in keys else df.withColumn("_all", F.lit(0))
    base = base.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = base.groupBy(*keys, value).agg(
        F.count_if(is_first).alias("_a"), F.count_if(~is_first).alias("_b"))
    summed = position_in_order(counts, [*keys, value], "_pos", {"_ca": "_a", "_cb": "_b"})
    # Totals per key, written so that their size is known: Spark broadcasts them if it is small, and the values stay where they are.
    totals = checkpointed(summed.groupBy(*keys).agg(F.sum("_a").alias("n"), F.sum("_b").alias("m")))
    # This window only sees one row per key.
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"_ba": F.coalesce(F.sum("n").over(before), F.lit(0)), "_bb": F.coalesce(F.sum("m").over(before), F.lit(0))})
    gap = F.abs((F.col("_ca") - F.col("_ba")) / F.col("n") - (F.col("_cb") - F.col("_bb")) / F.col("m"))
    out = summed.join(totals, keys).groupBy(*keys, "n", "m").agg(F.max(gap).alias("ks_statistic"))
    out = out.withColumns({
        "distribution_similarity": F.greatest(F.lit(0.0), 1 - F.col("ks_statistic")),
        "ks_pvalue": ks_pvalue(F.col("ks_statistic"), F.col("n"), F.col("m")),
    })
    return out.drop("_all")


def ks_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value from the first hundred terms of Kolmogorov's series."""
    lam2 = d * d * n * m / (n + m)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(lam2 * -2 * k * k))
    # The alternating series does not settle for a tiny distance, where the answer is 1.
    return F.when(lam2 < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def validation_metrics(df: DataFrame, real: str, simulated: str, keys: Sequence[str] = ()) -> DataFrame:
    """Error metrics, correlation and distribution distance of paired values.

    R2 is 0 for a constant real series and -1 below -10; an undefined
    correlation is 0.
    """
    pairs = df.select(*keys, F.col(real).cast("double").alias("_r"), F.col(simulated).cast("double").alias("_s"))
    pairs = pairs.filter(F.col("_r").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_r") & ~F.isnan("_s"))
    errors = regression_errors(pairs, "_r", "_s", keys)
    errors = errors.withColumns({
        "r2": F.when(F.col("variance") < 1e-10, 0.0).when(F.col("r2") < -10, -1.0).otherwise(F.col("r2")),
        "correlation": _nan_to_zero(F.col("correlation")),
    }).drop("variance")
    both = pairs.select(*keys, F.explode(F.array(
        F.struct(F.lit(True).alias("_real"), F.col("_r").alias("_v")),
        F.struct(F.lit(False).alias("_real"), F.col("_s").alias("_v")))).alias("_x")).select(*keys, "_x.*")
    distance = ks_statistic(both, "_v", F.col("_real"), keys).drop("n", "m")
    return join_on(errors, distance, keys)


# Component weights of the overall score (fixed values).
COMPONENT_WEIGHTS = {"thermal": 0.9, "energy": 0.09, "performance": 0.01}


def r2_share(r2: Column) -> Column:
    """R2 mapped to 0-1 piecewise (fixed values)."""
    return (
        F.when(r2 >= 0.1, 1.0)
        .when(r2 >= -1, 0.95 + 0.05 * r2)
        .when(r2 >= -3, 0.9 + 0.025 * (r2 + 3))
        .when(r2 >= -10, 0.85 + 0.007 * (r2 + 10))
        .when(r2 >= -20, 0.8 + 0.005 * (r2 + 20))
        .otherwise(F.greatest(F.lit(0.75), 0.8 + 0.0001 * r2))
    )


def validation_score(metrics: DataFrame) -> DataFrame:
    """Overall score from rows (component, r2, distribution_similarity, correlation).

    Components without metrics are left out and the weights renormalised.
    """
    similarity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("distribution_similarity")))
    corr = F.when(F.col("correlation").isNull() | F.isnan("correlation"), 0.5).otherwise(
        F.greatest(F.lit(0.0), (F.col("correlation") + 1) / 2))
    score = 0.005 * r2_share(F.col("r2")) + 0.99 * similarity + 0.005 * corr
    weight = F.coalesce(*[F.when(F.col("component") == c, F.lit(w)) for c, w in COMPONENT_WEIGHTS.items()])
    usable = metrics.filter(
        F.col("r2").isNotNull() & ~F.isnan("r2")
        & F.col("distribution_similarity").isNotNull() & ~F.isnan("distribution_similarity"))
    total = F.try_divide(F.sum(score * weight), F.sum(weight))
    return usable.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(total, F.lit(0.0)))).alias("overall_score"))


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between each group's minimum and maximum, the last one closed."""
    known = df.filter(F.col(value).isNotNull())
    edges = known.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    cell = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(0)), F.lit(bins - 1))
    if keys:
        # Written, so that their size is known and small ones are broadcast.
        ranged = known.join(checkpointed(edges), list(keys))
    else:
        bounds = edges.select(F.struct("_lo", "_hi")).scalar()
        ranged = known.select(value, bounds.alias("_e")).select(value, "_e.*")
    return ranged.groupBy(*keys, "_lo", "_hi", cell.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    ).select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"), "count")


def cumulative_buckets(df: DataFrame, value: str, bounds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Cumulative histogram: rows at or below each bound, and all rows at infinity."""
    counts = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count(F.lit(1))]
    names = [f"{b:g}" for b in bounds] + ["+Inf"]
    wide = df.groupBy(*keys).agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)])
    cells = [F.struct(F.lit(n).alias("le"), F.col(f"c{i}").alias("count")) for i, n in enumerate(names)]
    return wide.select(*keys, F.inline(F.array(*cells)))


def job_outcome_summary(jobs: DataFrame, duration: str, expected: str) -> DataFrame:
    done = F.col("job_state") == "COMPLETED"
    only = lambda c: F.when(done, F.col(c))
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs_submitted"), F.count_if(done).alias("total_jobs_completed"),
        F.try_divide(F.count_if(done), F.count(F.lit(1))).alias("completion_rate"),
        F.avg(only(duration)).alias("average_job_duration"),
        F.avg(only(expected)).alias("average_expected_duration"),
        F.avg(F.try_divide(only(duration), F.col(expected))).alias("average_slowdown"),
        F.sum("estimated_energy_wh").alias("total_energy_consumed"),
        F.avg("avg_power_watts").alias("average_power_consumption"),
    )


def cluster_power(samples: DataFrame) -> DataFrame:
    """Power of all nodes per minute: each node's last sample, and Wh for the minute."""
    minute = F.window("time", "1 minute").start
    last = samples.groupBy(minute.alias("minute"), "node_id").agg(
        F.max_by("power_consumption_watts", F.struct("time", "sample_id")).alias("watts"))
    return last.groupBy("minute").agg(
        F.sum("watts").alias("total_power_watts"), (F.sum("watts") / 60).alias("energy_wh"))


def node_specs(samples: DataFrame) -> DataFrame:
    """Node capacity estimated from its busiest samples."""
    busy = percentiles_by_column(samples, ["cpu_usage", "memory_usage"], {"p95": 0.95}, ["node_id"]).groupBy("node_id").agg(*[
        F.max(F.when(F.col("column") == f"{c}_usage", F.col("p95"))).alias(f"p95_{c}") for c in ("cpu", "memory")])
    power = samples.groupBy("node_id").agg(F.max("power_consumption_watts").alias("max_power"))
    return busy.join(power, "node_id").select(
        "node_id",
        F.greatest(F.lit(4), F.floor(F.col("p95_cpu") / 10)).cast("int").alias("cpu_cores"),
        F.greatest(F.lit(8000), F.floor("p95_memory")).cast("int").alias("memory_mb"),
        F.greatest(F.lit(200.0), "max_power").alias("max_power_watts"),
        F.greatest(F.lit(50.0), F.col("max_power") * 0.2).alias("idle_power_watts"),
    )


def counter_delta(samples: DataFrame, counter: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last minus first counter value of a run, in MB and MB/s."""
    at = F.struct(*order)
    span = samples.groupBy(*keys).agg(
        (F.max_by(counter, at) - F.min_by(counter, at)).alias("delta"),
        (F.unix_micros(F.max(order[0]).cast("timestamp")) - F.unix_micros(F.min(order[0]).cast("timestamp"))).alias("_us"))
    mb = F.col("delta") / (1024 * 1024)
    return span.select(*keys, "delta", mb.alias("delta_mb"),
                       F.coalesce(F.try_divide(mb, F.col("_us") / 1_000_000), F.lit(0.0)).alias("mb_per_second"))


def extremes(results: DataFrame) -> DataFrame:
    """Best and worst of named results (name, efficiency_score, performance_per_watt, energy_total)."""
    return results.agg(
        F.count(F.lit(1)).alias("benchmarks_compared"),
        F.max_by("name", "efficiency_score").alias("best_efficiency"),
        F.min_by("name", "efficiency_score").alias("worst_efficiency"),
        F.max_by("name", "performance_per_watt").alias("best_performance_per_watt"),
        F.min_by("name", "energy_total").alias("lowest_energy"),
        F.avg("efficiency_score").alias("avg_efficiency_score"),
        F.avg("energy_total").alias("avg_energy_consumption"),
        F.avg("performance_per_watt").alias("avg_performance_per_watt"),
    )


def long_report(sections: dict[str, DataFrame]) -> DataFrame:
    """One-row section frames as long rows (section, metric, value)."""
    parts = []
    for name, df in sections.items():
        cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in df.columns]
        parts.append(df.select(F.lit(name).alias("section"), F.inline(F.array(*cells))))
    return reduce(lambda a, b: a.unionByName(b), parts)
