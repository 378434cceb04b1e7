"""Nested JSON inputs: benchmark results, scheduler accounting and node inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattgrid.functions import parse as Q
from wattgrid.functions import power as P

BENCHMARK = """
benchmark_info struct<start_time:string, workload_type:string, duration_actual:double>,
performance_metrics struct<total_cpu_operations:double, total_io_operations:double, total_throughput_mbps:double>,
system_metrics struct<avg_cpu_percent:double, disk_read_rate_mbps:double, disk_write_rate_mbps:double>,
metrics_history array<struct<timestamp:string, cpu_percent:double, memory_percent:double, disk_read_bytes:double,
  disk_write_bytes:double, error:string>>,
worker_results array<struct<total_cpu_operations:double, total_io_operations:double, total_bytes_processed:double, error:string>>
"""
ACCOUNTING = """
job_id string, name string, user string, partition string, state struct<current:string>,
time struct<elapsed:string>, required struct<cpus:int>,
average struct<cpu:string, rss:string>, exit_code int, nodes string
"""


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark files, one job each, named by file stem."""
    df = spark.read.schema(BENCHMARK).json(path, multiLine=True)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return df.withColumn("job_id", F.url_decode(stem))


def parse_benchmarks(texts: DataFrame, column: str = "value") -> DataFrame:
    """The same from a column of JSON texts, keeping the other columns."""
    parsed = texts.withColumn("_b", F.from_json(column, BENCHMARK))
    return parsed.select(*[c for c in texts.columns if c != column], "_b.*")


def benchmark_jobs(docs: DataFrame) -> DataFrame:
    info, perf, system = F.col("benchmark_info"), F.col("performance_metrics"), F.col("system_metrics")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    known = system.isNotNull()
    cpu = F.when(known, zero(system["avg_cpu_percent"])).otherwise(50.0)
    io = F.when(known, zero(system["disk_read_rate_mbps"]) + zero(system["disk_write_rate_mbps"])).otherwise(10.0)
    return docs.filter(info.isNotNull() & perf.isNotNull()).select(
        info["start_time"].try_cast("timestamp").alias("timestamp"), "job_id",
        F.coalesce(info["workload_type"], F.lit("unknown")).alias("job_type"),
        zero(info["duration_actual"]).alias("duration_seconds"),
        zero(perf["total_cpu_operations"]).alias("cpu_operations"), zero(perf["total_io_operations"]).alias("io_operations"),
        zero(perf["total_throughput_mbps"]).alias("throughput_mbps"),
        P.benchmark_wh(zero(info["duration_actual"]), cpu, io).alias("estimated_energy_wh"))


def benchmark_samples(docs: DataFrame) -> DataFrame:
    """History samples without error, bytes as MB."""
    s = F.col("s")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    # The outer form keeps the planner from parsing the document once more in a filter.
    rows = docs.select("job_id", F.explode_outer("metrics_history").alias("s"))
    return rows.filter(s.isNotNull() & s["error"].isNull()).select(
        s["timestamp"].try_cast("timestamp").alias("timestamp"), zero(s["cpu_percent"]).alias("cpu_percent"),
        zero(s["memory_percent"]).alias("memory_percent"), (zero(s["disk_read_bytes"]) / 1048576).alias("disk_read_mbps"),
        (zero(s["disk_write_bytes"]) / 1048576).alias("disk_write_mbps"), "job_id")


def worker_totals(docs: DataFrame) -> DataFrame:
    """Operations of workers without error: totals, per second and per worker."""
    w = F.col("w")
    rows = docs.select("job_id", F.col("benchmark_info.duration_actual").alias("_t"), F.explode_outer("worker_results").alias("w"))
    rows = rows.filter(w.isNotNull())
    good = w["error"].isNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, w[c])), F.lit(0.0))
    out = rows.groupBy("job_id", "_t").agg(
        F.count_if(good).alias("workers"), total("total_cpu_operations").alias("cpu_operations"),
        total("total_io_operations").alias("io_operations"), total("total_bytes_processed").alias("bytes_processed"))
    per = lambda c, by: F.coalesce(F.try_divide(F.col(c), F.col(by)), F.lit(0.0))
    return out.withColumns({
        "cpu_ops_per_second": per("cpu_operations", "_t"), "io_ops_per_second": per("io_operations", "_t"),
        "throughput_mbps": F.coalesce(F.try_divide(F.col("bytes_processed") / 1048576, F.col("_t")), F.lit(0.0)),
        "cpu_ops_per_worker": per("cpu_operations", "workers"), "io_ops_per_worker": per("io_operations", "workers"),
    }).drop("_t")


def accounting_jobs(texts: DataFrame, column: str = "value") -> DataFrame:
    """Scheduler job records as job rows; missing fields take their defaults."""
    j = texts.select(F.from_json(column, ACCOUNTING).alias("j")).select("j.*")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    running = F.col("state.current") == "RUNNING"
    text = lambda c: F.coalesce(F.col(c), F.lit("0"))
    cpu = F.when(running, Q.cpu_minutes(text("average.cpu"))).otherwise(0.0)
    seconds = Q.clock_seconds(text("time.elapsed"))
    cpus = F.coalesce(F.col("required.cpus"), F.lit(1))
    return j.select(
        blank("job_id").alias("job_id"), blank("user").alias("user_name"), blank("partition").alias("partition"),
        blank("name").alias("job_name"), blank("state.current").alias("job_state"),
        Q.job_type_from_name(blank("name")).alias("job_type"), cpus.alias("cpus_allocated"),
        seconds.alias("runtime_seconds"), cpu.alias("cpu_usage_percent"),
        F.when(running, Q.memory_bytes(text("average.rss"))).otherwise(0).alias("memory_usage_bytes"),
        P.scheduler_job_joules(cpu, cpus, seconds).alias("energy_estimate_joules"),
        Q.state_code("state.current").alias("state_code"))


def cluster_totals(nodes: DataFrame) -> DataFrame:
    """Nodes, CPUs and memory of the inventory (cpus, real_memory)."""
    return nodes.agg(
        F.count(F.lit(1)).alias("total_nodes"), F.coalesce(F.sum("cpus"), F.lit(0)).alias("total_cpus"),
        F.coalesce(F.sum("real_memory"), F.lit(0)).alias("total_memory_mb"))
