"""Text and JSON inputs, written by Spark from the tables and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattgrid.plans.registry import query
from wattgrid.plans.streams import log_lines
from wattgrid.operators import scans as S
from wattgrid.sources import documents as D
from wattgrid.sources import logs as G


def _benchmark_docs(t):
    """Each job as a benchmark result document with a good, a bad and an unfinished part."""
    j = t.job_metrics
    sample = lambda cpu, err: F.struct(
        F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), cpu.alias("cpu_percent"), F.col("memory_usage").alias("memory_percent"),
        (F.col("io_read_mbps") * 1048576).alias("disk_read_bytes"), (F.col("io_write_mbps") * 1048576).alias("disk_write_bytes"),
        F.lit(err).cast("string").alias("error"))
    worker = lambda ops, err: F.struct(
        F.col(ops).cast("double").alias("total_cpu_operations"), F.col("memory_mb").cast("double").alias("total_io_operations"),
        (F.col("cpu_cores") * 1048576.0).alias("total_bytes_processed"), F.lit(err).cast("string").alias("error"))
    doc = F.struct(
        F.struct(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("start_time"), F.col("job_type").alias("workload_type"),
                 F.col("duration_seconds").cast("double").alias("duration_actual")).alias("benchmark_info"),
        F.struct(F.col("cpu_cores").cast("double").alias("total_cpu_operations"), F.col("memory_mb").cast("double").alias("total_io_operations")).alias("performance_metrics"),
        F.when(F.col("job_state") == "COMPLETED", F.struct(
            F.col("cpu_usage").alias("avg_cpu_percent"), F.col("io_read_mbps").alias("disk_read_rate_mbps"),
            F.col("io_write_mbps").alias("disk_write_rate_mbps"))).alias("system_metrics"),
        F.array(sample(F.col("cpu_usage"), None), sample(F.lit(0.0), "sensor lost"), sample(F.col("cpu_usage") + 1, None)).alias("metrics_history"),
        F.array(worker("cpu_cores", None), worker("memory_mb", "timeout"), worker("duration_seconds", None)).alias("worker_results"))
    return D.parse_benchmarks(j.select("job_id", F.to_json(doc).alias("value")))


@query("s6_f9_benchmark_jobs", """
select date_trunc('second', time) as timestamp, job_id, job_type, duration_seconds::double as duration_seconds, cpu_cores::double as cpu_operations,
  memory_mb::double as io_operations, 0.0E0 as throughput_mbps,
  (50 + 2 * case when job_state = 'COMPLETED' then cpu_usage else 50 end
    + 0.5E0 * case when job_state = 'COMPLETED' then io_read_mbps + io_write_mbps else 10 end) * duration_seconds / 3600 as estimated_energy_wh
from job_metrics""", r6="estimated_energy_wh")
def _(t):
    return D.benchmark_jobs(_benchmark_docs(t)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("s7_benchmark_samples", """
select date_trunc('second', time) as timestamp, cpu_usage + k as cpu_percent, memory_usage as memory_percent,
  io_read_mbps as disk_read_mbps, io_write_mbps as disk_write_mbps, job_id from job_metrics, (select unnest([0, 1]) as k)""", r6="cpu_percent memory_percent")
def _(t):
    return D.benchmark_samples(_benchmark_docs(t)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("a31_worker_totals", """
select job_id, 2::bigint as workers, (cpu_cores + duration_seconds)::double as cpu_operations, 2.0E0 * memory_mb as io_operations,
  cpu_cores * 2097152.0E0 as bytes_processed, (cpu_cores + duration_seconds) / duration_seconds as cpu_ops_per_second,
  2.0E0 * memory_mb / duration_seconds as io_ops_per_second, cpu_cores * 2.0E0 / duration_seconds as throughput_mbps,
  (cpu_cores + duration_seconds) / 2 as cpu_ops_per_worker, memory_mb::double as io_ops_per_worker from job_metrics""",
       r4="cpu_ops_per_second io_ops_per_second throughput_mbps")
def _(t):
    return D.worker_totals(_benchmark_docs(t))


@query("s11_accounting_jobs", """
select job_id, '' as user_name, queue as partition, job_type as job_name, job_state,
  case job_type when 'cpu_intensive' then 'cpu_intensive' when 'io_intensive' then 'io_intensive' when 'mixed' then 'mixed_workload' else 'unknown' end as job_type,
  cpu_cores as cpus_allocated, duration_seconds::bigint as runtime_seconds, case when job_state = 'RUNNING' then 1.5E0 else 0 end as cpu_usage_percent,
  case when job_state = 'RUNNING' then memory_mb::bigint * 1048576 else 0 end as memory_usage_bytes,
  (20 + 30 * case when job_state = 'RUNNING' then 1.5E0 else 0 end / 100) * cpu_cores * duration_seconds as energy_estimate_joules,
  case job_state when 'RUNNING' then 1 when 'COMPLETED' then 2 else 3 end as state_code from job_metrics""", r4="energy_estimate_joules")
def _(t):
    d = F.col("duration_seconds")
    clock = F.concat_ws(":", F.floor(d / 3600), F.floor(d / 60) % 60, d % 60)
    doc = F.struct(
        "job_id", F.col("job_type").alias("name"), F.col("queue").alias("partition"), F.struct(F.col("job_state").alias("current")).alias("state"),
        F.struct(clock.alias("elapsed")).alias("time"), F.struct(F.col("cpu_cores").alias("cpus")).alias("required"),
        F.struct(F.lit("07:01:30").alias("cpu"), F.concat(F.col("memory_mb"), F.lit("M")).alias("rss")).alias("average"))
    return D.accounting_jobs(t.job_metrics.select(F.to_json(doc).alias("value")))


@query("a35_cluster_totals", """
select count(*) as total_nodes, cast(sum(s_suppkey % 64 + 1) as bigint) as total_cpus, cast(sum(s_nationkey * 1024) as bigint) as total_memory_mb from supplier""")
def _(t):
    return D.cluster_totals(t.supplier.select((F.col("s_suppkey") % 64 + 1).alias("cpus"), (F.col("s_nationkey") * 1024).alias("real_memory")))


@query("s12_a11_energy_log", """
select node_id, avg(case when sample_id % 10 <> 3 then power_consumption_watts else 0 end) as avg_power,
  max(case when sample_id % 10 <> 3 then power_consumption_watts end) as peak_power, avg(cpu_temp) as avg_temp, max(cpu_temp) as peak_temp,
  avg(case when sample_id % 10 <> 3 then power_consumption_watts else 0 end) * 7200 / 3600 as energy_wh, 7200 as seconds from node_metrics group by node_id""",
       r6="avg_power peak_power avg_temp peak_temp energy_wh")
def _(t):
    power = F.when(F.col("sample_id") % 10 == 3, F.lit("n/a")).otherwise(F.col("power_consumption_watts").cast("string"))
    line = F.concat_ws(",", F.date_format("time", "yyyy-MM-dd HH:mm:ss"), "cpu_usage", "memory_usage", "cpu_temp", power, F.lit("0"))
    lines = t.node_metrics.select("node_id", F.inline(F.array(F.struct(line.alias("value")), F.struct(F.lit("# comment").alias("value")), F.struct(F.lit(" ").alias("value")))))
    return G.log_energy(G.parse_energy_log(lines).withColumn("seconds", F.lit(7200)), "seconds", ["node_id"])


@query("s13_f51_json_log", """
select event_id, date_trunc('second', ts) as time, event_type as level, value from events""", r6="value")
def _(t):
    inner = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("level"), "value"))
    lines = t.events.select("event_id", inner.alias("log"))
    fields = G.unwrap_json(lines, "timestamp string, level string, value double")
    out = G.json_log_time(fields, "timestamp", "yyyy-MM-dd HH:mm:ss")
    return out.select("event_id", F.col("time").cast("timestamp_ntz").alias("time"), "level", "value")


@query("f36_p17_energy_messages", """
select event_id, case when event_type = 'error' then 'error' else 'normal' end as route,
  case when event_type <> 'error' then round(value, 2) end as energy_value, case when event_type <> 'error' then 'Wh' end as energy_unit,
  case when event_type <> 'error' then cast(event_id as varchar) end as job_id,
  case when event_type <> 'error' then concat('node', cast(user_id % 10 as varchar)) end as node_name from events""", r6="energy_value")
def _(t):
    out = G.route_errors(G.energy_messages(log_lines(t.events)))
    return out.select("event_id", "route", "energy_value", "energy_unit", "job_id", "node_name")


@query("f37_f38_thermal_messages", """
select sample_id, case when cpu_temp > 80 then 'critical' else 'warning' end as event_type, round(cpu_temp, 3) as temperature,
  concat('core', cast(sample_id % 8 as varchar)) as sensor_name, 'production' as environment, 'cluster' as cluster_name, 'thermal' as log_type,
  epoch_us(time) / 1000000.0E0 as parsed_time from node_metrics""", r2="temperature", r6="parsed_time")
def _(t):
    text = F.concat(F.lit("Thermal event: "), F.when(F.col("cpu_temp") > 80, "critical").otherwise("warning"), F.lit(", Temperature: "),
                    F.format_string("%.3f", "cpu_temp"), F.lit("°C, Sensor: core"), (F.col("sample_id") % 8).cast("string"))
    out = G.enrich(G.thermal_messages(t.node_metrics.select("sample_id", "time", text.alias("message"))), "thermal", environment="production", cluster_name="cluster")
    return out.select("sample_id", "event_type", "temperature", "sensor_name", "environment", "cluster_name", "log_type", "parsed_time")


@query("s27_s28_relabelled_series", """
select metric, count(*) as n, count(distinct node_id) as instances from (
  select node_id, 'cpu_temp' as metric from node_metrics) group by 1""")
def _(t):
    n = t.node_metrics
    label = F.create_map(F.lit("instance"), F.col("node_id"), F.lit("job"), F.lit("scrape"))
    series = n.select("time", F.explode(F.array(F.lit("cpu_temp"), F.lit("go_goroutines"))).alias("metric"), label.alias("labels"), F.col("cpu_temp").alias("value"))
    kept = S.relabel(S.drop_series(series), job="thermal-monitoring").filter(F.col("labels")["job"] == "thermal-monitoring")
    return kept.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("labels")["instance"]).alias("instances"))


@query("s20_start_records", "select job_id, time, 'STARTING' as job_state, 0.0E0 as estimated_energy_wh from job_metrics")
def _(t):
    from wattgrid.sources.store import start_records

    return start_records(t.job_metrics.select("job_id", "time", "job_state", "estimated_energy_wh"))
