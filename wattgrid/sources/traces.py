"""Workload traces in Standard Workload Format and their cleaned job table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field order of a trace line (fixed by the format).
SWF_FIELDS = (
    "job_id", "submit_time", "wait_time", "run_time", "allocated_processors",
    "average_cpu_time", "used_memory", "requested_processors", "requested_time",
    "requested_memory", "status", "user_id", "group_id", "executable_id",
    "queue_id", "partition_id", "preceding_job_id", "think_time",
)
SWF_NUMERIC = SWF_FIELDS[1:10]


def read_swf(spark: SparkSession, path: str) -> DataFrame:
    """Trace files, plain or gzip, as one row per job."""
    return parse_swf(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_swf(lines: DataFrame) -> DataFrame:
    """Split ``line``; comment, blank and short lines are skipped, bad numbers are null."""
    text = F.trim(F.regexp_replace("line", r"\s+", " "))
    fields = (
        lines.filter(~F.col("line").startswith(";"))
        .select(F.split(text, " ").alias("f"))
        .filter(F.size("f") >= len(SWF_FIELDS))
    )
    return fields.select(*[
        (F.col("f")[i].try_cast("double") if name in SWF_NUMERIC else F.col("f")[i]).alias(name)
        for i, name in enumerate(SWF_FIELDS)
    ])


def seconds_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1_000_000).cast("bigint"))


def clean_trace(
    jobs: DataFrame,
    source: str,
    utilisation: Column | None = None,
    temperature: Column | None = None,
    temperature_rise: Column | None = None,
    seed: int = 42,
) -> DataFrame:
    """Completed jobs in the project's columns, with estimated power and energy.

    Utilisation is uniform in 0.6-0.9 and temperatures are random unless given.
    """
    utilisation = F.rand(seed) * 0.3 + 0.6 if utilisation is None else utilisation
    temperature = F.randn(seed + 1) * 8 + 45 if temperature is None else temperature
    rise = F.rand(seed + 2) * 10 + 5 if temperature_rise is None else temperature_rise
    kept = jobs.dropna(subset=["job_id", "submit_time", "run_time"]).filter(
        (F.col("run_time") > 0) & (F.col("allocated_processors") > 0)
    )
    start = F.col("submit_time") + F.col("wait_time")
    out = kept.select(
        F.col("job_id").cast("string").alias("job_id"),
        seconds_to_timestamp(F.col("submit_time")).alias("submit_time"),
        seconds_to_timestamp(start).alias("start_time"),
        seconds_to_timestamp(start + F.col("run_time")).alias("end_time"),
        F.col("run_time").alias("duration_seconds"),
        F.col("allocated_processors").alias("num_nodes"),
        (F.col("run_time") * F.col("allocated_processors") / 3600).alias("cpu_hours"),
        (F.coalesce(F.col("used_memory"), F.lit(0.0)) / 1024).alias("memory_gb"),
        F.col("queue_id").alias("queue"),
        "user_id",
        F.lit("COMPLETED").alias("status"),
        F.lit(source).alias("dataset_source"),
        (F.col("allocated_processors") * 200 * utilisation).alias("estimated_power_w"),
        temperature.alias("avg_temp_c"),
        rise.alias("_rise"),
    )
    return out.select(
        "*",
        (F.col("estimated_power_w") * F.col("duration_seconds") / 3600).alias("estimated_energy_wh"),
        (F.col("avg_temp_c") + F.col("_rise")).alias("max_temp_c"),
    ).drop("_rise")
