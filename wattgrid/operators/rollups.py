"""Time-bucket rollups and summaries: one map-side combined shuffle each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.operators.scans import ago, instant, optional_equal, time_range


def bucket(df: DataFrame, unit: str, column: str = "time") -> Column:
    """Start of the hour, day, ... holding ``column``, in the column's own type."""
    return F.date_trunc(unit, column).cast(df.schema[column].dataType)


def hourly_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(bucket(jobs, "hour").alias("bucket"), "job_type", "node_id").agg(
        F.count(F.lit(1)).alias("job_count"),
        F.avg("duration_seconds").alias("avg_duration"),
        F.avg("cpu_usage").alias("avg_cpu_usage"),
        F.avg("memory_usage").alias("avg_memory_usage"),
        F.avg("estimated_energy_wh").alias("avg_energy"),
        F.sum("estimated_energy_wh").alias("total_energy"),
        F.avg("avg_cpu_temp").alias("avg_temp"),
        F.max("peak_cpu_temp").alias("max_temp"),
    )


def daily_efficiency(facts: DataFrame) -> DataFrame:
    return facts.groupBy(bucket(facts, "day").alias("bucket"), "node_id").agg(
        F.avg("energy_per_job_wh").alias("avg_energy_per_job"),
        F.avg("energy_per_cpu_hour_wh").alias("avg_energy_per_cpu_hour"),
        F.sum("jobs_completed").alias("total_jobs"),
        F.sum("total_cpu_hours").alias("total_cpu_hours"),
        F.avg("avg_thermal_efficiency").alias("avg_thermal_efficiency"),
    )


def refresh_rows(source: DataFrame, as_of, start_hours: int, end_hours: int, unit: str) -> DataFrame:
    """Source rows of the whole buckets inside [as_of - start, as_of - end)."""
    at = instant(source, as_of)
    kind = source.schema["time"].dataType
    low, high = ago(at, hours=start_hours), ago(at, hours=end_hours)
    floor = F.date_trunc(unit, low).cast(kind)
    step = F.make_dt_interval(days=F.lit(1)) if unit == "day" else F.make_dt_interval(hours=F.lit(1))
    first = F.when(floor == low, floor).otherwise(floor + step)
    return source.filter((F.col("time") >= first) & (F.col("time") < F.date_trunc(unit, high).cast(kind)))


def hotspots(events: DataFrame, as_of=None, hours: int = 24) -> DataFrame:
    at = instant(events, as_of)
    rows = events.filter((F.col("time") >= ago(at, hours=hours)) & F.col("severity").isin("high", "critical"))
    return rows.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg("temperature").alias("avg_temp"),
        F.max("temperature").alias("max_temp"),
        F.sum("duration_seconds").alias("total_duration_seconds"),
        F.avg("performance_impact_percent").alias("avg_performance_impact"),
    ).orderBy(F.desc("event_count"), F.desc("max_temp"))


def prediction_accuracy(predictions: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    at = instant(predictions, as_of)
    rows = predictions.filter(F.col("actual_energy_wh").isNotNull() & (F.col("time") >= ago(at, days=days)))
    error = F.col("prediction_error_percent")
    return rows.groupBy("model_version", "prediction_method").agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.avg(F.abs(error)).alias("avg_absolute_error"),
        F.stddev_samp(error).alias("error_stddev"),
        (F.count_if(F.abs(error) <= 10) * 100.0 / F.count(F.lit(1))).alias("accuracy_within_10_percent"),
    ).orderBy("avg_absolute_error")


def node_ranking(facts: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """Nodes by mean energy per job; the ranking window sees one row per node."""
    at = instant(facts, as_of)
    means = facts.filter(F.col("time") >= ago(at, days=days)).groupBy("node_id").agg(
        F.avg("energy_per_job_wh").alias("avg_energy_per_job"),
        F.avg("energy_per_cpu_hour_wh").alias("avg_energy_per_cpu_hour"),
        F.count(F.lit(1)).alias("measurement_count"),
    )
    return means.withColumn("efficiency_rank", F.rank().over(Window.orderBy("avg_energy_per_job")))


def node_efficiency(jobs: DataFrame, node_id: str, start, end) -> DataFrame:
    rows = time_range(jobs, start, end).filter(
        (F.col("node_id") == node_id) & (F.col("job_state") == "COMPLETED")
    )
    energy = F.sum("estimated_energy_wh")
    cpu_hours = F.sum(F.col("duration_seconds") * F.col("cpu_cores") / 3600.0)
    return rows.agg(
        F.try_divide(energy, F.count(F.lit(1))).alias("energy_per_job"),
        F.try_divide(energy, cpu_hours).alias("energy_per_cpu_hour"),
        F.count(F.lit(1)).alias("total_jobs"),
        energy.alias("total_energy"),
    )


def thermal_summary(events: DataFrame, node_id: str | None = None, hours_back: int = 24, as_of=None) -> DataFrame:
    at = instant(events, as_of)
    rows = optional_equal(events, "node_id", node_id).filter(F.col("time") >= ago(at, hours=hours_back))
    return rows.groupBy("node_id", "event_type").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg("temperature").alias("avg_temperature"),
        F.sum("duration_seconds").alias("total_duration"),
        F.avg("performance_impact_percent").alias("avg_impact"),
    ).orderBy("node_id", F.desc("event_count"))


def efficiency_facts(jobs: DataFrame, unit: str = "day") -> DataFrame:
    """Energy per job, CPU hour and GB hour by node and interval."""
    energy = F.sum("estimated_energy_wh")
    cpu_h = F.sum(F.col("duration_seconds") * F.col("cpu_cores") / 3600.0)
    gb_h = F.sum(F.col("duration_seconds") * F.col("memory_mb") / 1024.0 / 3600.0)
    return (
        jobs.filter(F.col("job_state") == "COMPLETED")
        .groupBy(bucket(jobs, unit).alias("time"), "node_id")
        .agg(
            F.try_divide(energy, F.count(F.lit(1))).alias("energy_per_job_wh"),
            F.try_divide(energy, cpu_h).alias("energy_per_cpu_hour_wh"),
            F.try_divide(energy, gb_h).alias("energy_per_gb_hour_wh"),
            F.count(F.lit(1)).alias("jobs_completed"),
            cpu_h.alias("total_cpu_hours"),
            gb_h.alias("total_memory_gb_hours"),
            F.avg(F.try_divide(F.col("cpu_usage"), F.col("avg_cpu_temp"))).alias("avg_thermal_efficiency"),
        )
    )


def workload_patterns(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.col("job_type").alias("pattern_name")).agg(
        F.avg("cpu_usage").alias("avg_cpu_usage"),
        F.avg("memory_usage").alias("avg_memory_usage"),
        F.avg(F.col("io_read_mbps") + F.col("io_write_mbps")).alias("avg_io_usage"),
        F.avg("duration_seconds").cast("int").alias("avg_duration_seconds"),
        F.avg("estimated_energy_wh").alias("avg_energy_wh"),
        F.count(F.lit(1)).alias("sample_count"),
        F.max("time").alias("last_updated"),
    )


def trace_summary(jobs: DataFrame) -> DataFrame:
    """Totals per data source and, with a null source, over all of them."""
    return jobs.rollup("dataset_source").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.sum("cpu_hours").alias("cpu_hours"),
        F.sum("estimated_energy_wh").alias("energy_wh"),
        F.min("submit_time").alias("first_submit"),
        F.max("submit_time").alias("last_submit"),
        (F.avg("duration_seconds") / 3600.0).alias("avg_hours"),
        F.avg("num_nodes").alias("avg_nodes"),
    )


def energy_cube(jobs: DataFrame, dims: Sequence[str] = ("job_type", "node_id")) -> DataFrame:
    return jobs.cube(*dims).agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count(F.lit(1)).alias("jobs"),
        F.sum("estimated_energy_wh").alias("total_energy"),
        F.avg("estimated_energy_wh").alias("avg_energy"),
    )


def distinct_counts(jobs: DataFrame, columns: dict[str, str], approximate: bool = False) -> DataFrame:
    """Distinct values per column (new name -> column).

    The exact form shuffles every distinct value; ``approximate`` keeps a small
    sketch per column, within about 5 percent.
    """
    count = F.approx_count_distinct if approximate else F.count_distinct
    return jobs.agg(*[count(c).alias(n) for n, c in columns.items()])
