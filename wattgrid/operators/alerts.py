"""Alert rules as table rows, and the sustained-condition operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattgrid.operators.joins import change_since, missing_intervals, ratio_by
from wattgrid.operators.ordered import epoch_us, fill_gaps, running_sum, seconds_between, with_previous
from wattgrid.operators.rollups import bucket
from wattgrid.session import checkpointed

# (rule, metric, comparison, threshold, hold seconds, severity, component): fixed values.
RULES = [
    ("HighCPUTemperature", "cpu_temperature_celsius", ">", 80.0, 120, "warning", "thermal"),
    ("CriticalCPUTemperature", "cpu_temperature_celsius", ">", 90.0, 60, "critical", "thermal"),
    ("ThermalThrottlingActive", "thermal_throttling_active", "=", 1.0, 60, "warning", "thermal"),
    ("HighGPUTemperature", "gpu_temperature_celsius", ">", 85.0, 120, "warning", "thermal"),
    ("LongRunningJob", "job_runtime_seconds", ">", 86400.0, 300, "info", "slurm"),
    ("HighJobFailureRate", "job_failure_rate", ">", 0.1, 300, "warning", "slurm"),
    ("JobQueueBuildup", "pending_jobs", ">", 50.0, 300, "warning", "slurm"),
    ("HighEnergyConsumptionJob", "job_energy_joules", ">", 1000000.0, 120, "info", "energy"),
    ("HighCPUUsage", "cpu_usage_percent", ">", 90.0, 300, "warning", "system"),
    ("HighMemoryUsage", "memory_used_ratio", ">", 0.9, 300, "warning", "system"),
    ("DiskSpaceLow", "disk_used_ratio", ">", 0.85, 300, "warning", "system"),
    ("NodeDown", "node_up", "=", 0.0, 120, "critical", "system"),
    ("HighPowerConsumption", "cpu_power_watts", ">", 200.0, 300, "warning", "power"),
    ("PowerConsumptionSpike", "power_change_5m_watts", ">", 100.0, 120, "info", "power"),
    ("ExporterDown", "exporter_up", "=", 0.0, 120, "critical", "monitoring"),
    ("HighScrapeDuration", "scrape_duration_seconds", ">", 10.0, 300, "warning", "monitoring"),
    ("MissingThermalMetrics", "thermal_metrics_absent", "=", 1.0, 300, "warning", "monitoring"),
    ("MissingJobMetrics", "job_metrics_absent", "=", 1.0, 600, "warning", "monitoring"),
]
RULE_SCHEMA = ("rule string, metric string, comparison string, threshold double, hold_seconds int, "
               "severity string, component string")


def rule_table(spark: SparkSession, rules: Sequence[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def rule_holds(value: Column, comparison: Column, threshold: Column) -> Column:
    return F.when(comparison == ">", value > threshold).otherwise(value == threshold)


def evaluate_rules(series: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (rule, series, ts, value, holds) for each rule on its metric.

    The rule table has a fixed handful of rows, so broadcasting it is safe.
    """
    both = series.join(F.broadcast(rules), "metric")
    holds = F.coalesce(rule_holds(F.col("value"), F.col("comparison"), F.col("threshold")), F.lit(False))
    return both.withColumn("holds", holds)


def sustained(df: DataFrame, keys: Sequence[str], time: str, holds: str, hold_seconds: Column | int,
              ties: Sequence[str] = (), idle_seconds: int | None = None, **chunking) -> DataFrame:
    """Unbroken runs of true samples that last at least ``hold_seconds``.

    One row per run: first and last true sample and the sample at which the hold
    time was reached.  Time between samples is not interpolated; with
    ``idle_seconds``, a longer gap between two samples ends a run.
    """
    kept = df.withColumn("_hold", hold_seconds if isinstance(hold_seconds, Column) else F.lit(hold_seconds))
    prev = with_previous(kept, {"_before": holds, "_last": time}, keys, time, ties, **chunking)
    first = ~F.coalesce(F.col("_before"), F.lit(False))
    if idle_seconds is not None:
        first = first | (epoch_us(time) - epoch_us("_last") > idle_seconds * 1_000_000)
    began = F.when(F.col(holds) & first, F.col(time))
    runs = fill_gaps(prev.withColumn("since", began), ["since"], keys, time, ties, backward=False, **chunking)
    active = runs.filter(F.col(holds)).withColumn(
        "_met", epoch_us(time) - epoch_us("since") >= F.col("_hold").cast("bigint") * 1_000_000)
    spans = active.groupBy(*keys, "since").agg(
        F.max(time).alias("until"), F.count(F.lit(1)).alias("samples"),
        F.min(F.when(F.col("_met"), F.col(time))).alias("fired_at"))
    return spans.filter(F.col("fired_at").isNotNull())


def runs_in_row(points: Column, holds: Callable[[Column], Column], hold_seconds: Column, kind: str) -> Column:
    """What ``sustained`` finds in a series whose points (ts, value), by time, lie in one row: an array of its lasting runs."""
    run = f"struct<since:{kind},until:{kind},samples:bigint,fired_at:{kind}>"

    def longer(opened: Column, ts: Column) -> Column:
        since = F.coalesce(opened["since"], ts)
        met = epoch_us(ts) - epoch_us(since) >= hold_seconds.cast("bigint") * 1_000_000
        return F.struct(since.alias("since"), ts.alias("until"), (F.coalesce(opened["samples"], F.lit(0)) + 1).cast("bigint").alias("samples"),
                        F.coalesce(opened["fired_at"], F.when(met, ts)).alias("fired_at"))

    def ended(state: Column) -> Column:
        return F.when(state["open"]["fired_at"].isNotNull(), F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])

    def step(state: Column, point: Column) -> Column:
        on = F.coalesce(holds(point["value"]), F.lit(False))
        return F.struct(F.when(on, longer(state["open"], point["ts"])).alias("open"), F.when(on, state["done"]).otherwise(ended(state)).alias("done"))

    begin = F.struct(F.lit(None).cast(run).alias("open"), F.array().cast(f"array<{run}>").alias("done"))
    return F.aggregate(points, begin, step, ended)


def alerts(series: DataFrame, rules: DataFrame, **chunking) -> DataFrame:
    """Fired alerts of all rules over long series (ts, metric, series, value).

    With a column ``whole``, rows where it is not null hold all points of a short series, by time, as an array of (ts, value):
    their runs are found in the row, without a shuffle.
    """
    short = series.filter("whole is not null") if "whole" in series.columns else None
    judged = evaluate_rules(series if short is None else series.filter("whole is null").drop("whole"), rules)
    fired = sustained(judged, ["rule", "series"], "ts", "holds", F.col("hold_seconds"), **chunking)
    about = rules.select("rule", "severity", "component")
    out = fired.join(F.broadcast(about), "rule")
    if short is None:
        return out
    found = runs_in_row(F.col("whole"), lambda x: rule_holds(x, F.col("comparison"), F.col("threshold")), F.col("hold_seconds"), series.schema["ts"].dataType.simpleString())
    inside = short.join(F.broadcast(rules), "metric").select("rule", "series", F.inline(found), "severity", "component")
    return out.unionByName(inside)


def _series(df: DataFrame, metric: str, series: Column, ts: str, value: Column) -> DataFrame:
    return df.select(F.col(ts).alias("ts"), series.alias("series"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))


def absence_series(samples: DataFrame, metric: str) -> DataFrame:
    """For each hour of the samples' time span 1 if it has none, else 0."""
    kind = samples.schema["time"].dataType
    cluster = samples.select(F.lit("cluster").alias("all"), "time")
    seen = cluster.select("all", F.window("time", "1 hour").start.alias("at")).distinct()
    return reduce(DataFrame.unionByName, [
        _series(df.withColumn("at", F.col("at").cast(kind)), metric, F.col("all"), "at", F.lit(absent))
        for df, absent in ((seen, 0.0), (missing_intervals(cluster, ["all"]), 1.0))])


def _running_points(jobs: DataFrame, as_of, hours: int) -> DataFrame:
    """One row per running job (``series``) with its ``points`` (ts, seconds, joules), by time."""
    kind = jobs.schema["time"].dataType
    hour = lambda c: F.date_trunc("hour", c).cast(kind)
    now = hour(jobs.agg(F.max("time")).scalar() if as_of is None else (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast(kind))
    begun = jobs.withColumn("_now", now).filter((F.col("job_state") == "RUNNING") & (F.col("time") <= F.col("_now")))
    steps = [F.col("_now") - F.expr(f"interval {k} hour") for k in range(hours, -1, -1)]
    joules = lambda at: F.max(F.when(F.col("time") <= at, F.col("avg_power_watts") * seconds_between(at, "time")))
    # A column per hour, as a job's hours as rows would be shuffled, and so would its series.
    so_far = begun.groupBy(F.col("job_id").alias("series")).agg(F.max("_now").alias("_now"), F.min("time").alias("_first"), *[joules(at).alias(f"_j{k}") for k, at in enumerate(steps)])
    cells = [F.struct(at.alias("ts"), seconds_between(at, "_first").alias("seconds"), F.col(f"_j{k}").cast("double").alias("joules")) for k, at in enumerate(steps)]
    return so_far.select("series", F.filter(F.array(*cells), lambda p: p["ts"] >= F.col("_first")).alias("points"))


def running_series(jobs: DataFrame, as_of=None, hours: int = 24, whole: bool = False) -> DataFrame:
    """Seconds run and joules used so far by each running job, at every full hour of the last ``hours`` up to ``as_of``.

    ``jobs``: job_id, time (of the start), job_state, avg_power_watts. ``as_of`` is the latest time if not given. A job
    gives at most ``hours`` + 1 rows a metric; of several rows of one job the largest value counts. If ``whole``, a
    series is one row, its points in column ``whole`` (see ``alerts``).
    """
    cell = lambda metric, c: F.struct(F.lit(metric).alias("metric"), F.transform("points", lambda p: F.struct(p["ts"].alias("ts"), p[c].alias("value"))).alias("whole"))
    kept = _running_points(jobs, as_of, hours).select("series", F.inline(F.array(cell("job_runtime_seconds", "seconds"), cell("job_energy_joules", "joules"))))
    if whole:
        return kept.filter(F.size("whole") > 0)
    return kept.select("series", "metric", F.inline("whole")).select("ts", "series", "metric", "value")


def poll_series(polls: DataFrame, metric: str, target: str, time: str, up: str) -> DataFrame:
    """Whether each poll of a target was answered."""
    return _series(polls, metric, F.col(target), time, F.when(F.col(up), 1.0).otherwise(0.0))


def job_and_exporter_series(jobs: DataFrame, polls: DataFrame, as_of=None, hours: int = 24) -> DataFrame:
    """Series of the rules on running jobs, on missing job samples and on exporters.

    ``polls``: target, time, up. Rows are long (ts, series, metric, value), but a job's series is one row, its points in ``whole``. No series is made for ``gpu_temperature_celsius`` and ``disk_used_ratio``: no table has such a column.
    """
    # One row per hour, the latest time, says both how far the jobs reach and which hours are missing: the jobs are read once more only.
    latest = checkpointed(jobs.groupBy(F.window("time", "1 hour")).agg(F.max("time").alias("time")).select("time"))
    now = latest.agg(F.max("time")).scalar() if as_of is None else as_of
    long = absence_series(latest, "job_metrics_absent").unionByName(poll_series(polls, "exporter_up", "target", "time", "up"))
    return long.unionByName(running_series(jobs, now, hours, whole=True), allowMissingColumns=True)


def derived_series(samples: DataFrame, runs: DataFrame, jobs: DataFrame, **chunking) -> DataFrame:
    """Series of the rules that test a computed value.

    Power change over five minutes, presence of each node and of any thermal
    sample per hour, waiting jobs after each submit or start, and the share of
    failed among all jobs per queue and hour.
    """
    kind = samples.schema["time"].dataType
    power = change_since(samples, "power_consumption_watts", ["node_id"], ties=["sample_id"], **chunking)
    parts = [_series(power, "power_change_5m_watts", F.col("node_id"), "time", F.col("power_consumption_watts_change"))]
    hours = samples.select("node_id", F.window("time", "1 hour").start.alias("at")).distinct()
    gone = missing_intervals(samples.select("node_id", "time"), ["node_id"])
    for df, up in ((hours, 1.0), (gone, 0.0)):
        parts.append(_series(df.withColumn("at", F.col("at").cast(kind)), "node_up", F.col("node_id"), "at", F.lit(up)))
    parts.append(absence_series(samples, "thermal_metrics_absent"))
    moves = runs.select("run_id", F.inline(F.array(
        F.struct(F.col("submit_time").alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("start_time").alias("at"), F.lit(-1).alias("step")))))
    waiting = running_sum(moves, "step", "level", [], "at", ["step", "run_id"], **chunking)
    waiting = waiting.groupBy("at").agg(F.max(F.struct("step", "run_id", "level"))["level"].alias("level"))
    parts.append(_series(waiting, "pending_jobs", F.lit("cluster"), "at", F.col("level")))
    failed = ratio_by(jobs.select("queue", bucket(jobs, "hour").alias("at"), "job_state"), ["queue", "at"], F.col("job_state") == "FAILED")
    parts.append(_series(failed, "job_failure_rate", F.col("queue"), "at", F.col("ratio")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
