"""Queries over files: written by Spark from the tables, read by the sources, compared by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattgrid.operators import scans as S
from wattgrid.operators import stats as A
from wattgrid.plans.measures import _KS, _PAIRS, _pairs
from wattgrid.plans.registry import query
from wattgrid.plans.tables import SWF_ORACLE
from wattgrid.sources import logs as G
from wattgrid.sources import store as O
from wattgrid.sources.traces import read_swf
from wattgrid.streaming.runs import new_folder


def _plain_times(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k == "timestamp"})


@query("s8_csv_scan", "select event_id, date_trunc('second', ts) as time, event_type, value from events", r6="value")
def _(t):
    path = new_folder(t.spark, "csv")
    rows = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "event_type", "value")
    O.write_dataset(rows, path, "csv")
    return _plain_times(O.read_csv(t.spark, path, "event_id bigint, time timestamp, event_type string, value double"))


@query("s10_gzip_trace", SWF_ORACLE)
def _(t):
    path = new_folder(t.spark, "trace")
    t.swf_lines.select("line").write.option("compression", "gzip").text(path)
    return read_swf(t.spark, path)


@query("s12_energy_log_files", """
select count(*) as samples, avg(cpu_usage) as cpu, avg(memory_usage) as memory, avg(cpu_temp) as temp,
  count(case when sample_id % 10 <> 3 then 1 end) as powered from node_metrics""", r6="cpu memory temp")
def _(t):
    path = new_folder(t.spark, "energy-log")
    power = F.when(F.col("sample_id") % 10 == 3, F.lit("n/a")).otherwise(F.col("power_consumption_watts").cast("string"))
    line = F.concat_ws(",", F.date_format("time", "yyyy-MM-dd HH:mm:ss"), "cpu_usage", "memory_usage", "cpu_temp", power, F.lit("0"))
    t.node_metrics.select(F.explode(F.array(line, F.lit("# comment"), F.lit(" "))).alias("value")).write.text(path)
    return G.read_energy_log(t.spark, path).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("cpu_usage").alias("cpu"), F.avg("memory_usage").alias("memory"),
        F.avg("cpu_temp").alias("temp"), F.count("power_estimate").alias("powered"))


@query("s13_json_log_files", "select event_id, date_trunc('second', ts) as time, event_type as level, value from events", r6="value")
def _(t):
    path = new_folder(t.spark, "json-log")
    t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("level"), "value").write.json(path)
    found = G.read_json_log(t.spark, path, "event_id bigint, timestamp string, level string, value double")
    return _plain_times(found.select("event_id", "time", "level", "value"))


@query("s14_multiline_log", """
select date_trunc('millisecond', ts) as time, upper(event_type) as level, 'event ' || event_id || repeat(chr(10) || '  detail', (event_id % 3)::int) as message
from events""")
def _(t):
    path = new_folder(t.spark, "log")
    text = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("] ["), F.upper("event_type"), F.lit("] event "), F.col("event_id").cast("string"),
                    F.repeat(F.lit("\n  detail"), (F.col("event_id") % 3).cast("int")))
    t.events.select(text.alias("value")).write.text(path)
    return _plain_times(G.read_multiline_log(t.spark, path).select("time", "level", "message"))


@query("s15_written_formats", " union all ".join(
    f"select '{kind}' as kind, run_id, node_id, start_time from job_runs" for kind in ("parquet", "csv", "json")))
def _(t):
    path = new_folder(t.spark, "formats")
    rows = t.job_runs.select("run_id", "node_id", F.col("start_time").cast("timestamp").alias("start_time"))
    found = []
    for kind in ("parquet", "csv", "json"):
        O.write_dataset(rows, f"{path}/{kind}", kind)
        reader = t.spark.read.schema(rows.schema).option("header", True).option("timestampFormat", O.TIME_FORMAT)
        found.append(reader.format(kind).load(f"{path}/{kind}").select(F.lit(kind).alias("kind"), "run_id", "node_id", "start_time"))
    return _plain_times(S.union_all(*found))


@query("s16_s17_written_results", """
select 'csv' as source, node_id, count(*)::bigint as n from job_metrics group by all
union all select 'parquet', node_id, count(*) from job_metrics group by all
union all select 'summary', null, count(*) from job_metrics""")
def _(t):
    path = new_folder(t.spark, "results")
    jobs = t.job_metrics.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    O.write_results({"jobs": jobs}, jobs.agg(F.sum("n").alias("n")), path)
    read = t.spark.read
    return S.union_all(
        read.schema(jobs.schema).csv(f"{path}/jobs_csv", header=True).select(F.lit("csv").alias("source"), "node_id", "n"),
        read.schema(jobs.schema).parquet(f"{path}/jobs").select(F.lit("parquet").alias("source"), "node_id", "n"),
        read.schema("n bigint").json(f"{path}/summary").select(F.lit("summary").alias("source"), F.lit(None).cast("string").alias("node_id"), "n"))


@query("p13_numeric_columns", """
select user_id, duration_seconds, cpu_cores, memory_mb, cpu_usage, memory_usage, io_read_mbps, io_write_mbps, avg_cpu_temp,
  peak_cpu_temp, avg_power_watts, estimated_energy_wh from job_metrics""", r6="avg_cpu_temp peak_cpu_temp avg_power_watts estimated_energy_wh cpu_usage memory_usage")
def _(t):
    return t.job_metrics.select(*S.numeric_columns(t.job_metrics))


@query("p14_available_columns", "select job_id, node_id, cpu_cores from job_metrics")
def _(t):
    return t.job_metrics.select(*S.available(t.job_metrics, ["job_id", "gpu_power_watts", "node_id", "cpu_cores", "rack"]))


@query("a25_ks_pvalue", f"""with {_PAIRS}, {_KS}, sizes as (select component, count(y) as n, count(p) as m from pairs group by 1),
l as (select component, ks_statistic * ks_statistic * n * m / (n + m) as lam2 from k join sizes using (component))
select component, case when lam2 < 0.04 then 1.0 else greatest(0.0, least(1.0,
  list_sum([case when i % 2 = 1 then 2.0e0 else -2.0e0 end * exp(-2 * lam2 * i * i) for i in range(1, 101)]))) end::double as ks_pvalue from l""", r8="ks_pvalue")
def _(t):
    p = _pairs(t)
    both = p.select("component", F.col("real").alias("v"), F.lit(True).alias("r")).unionByName(
        p.select("component", F.col("sim").alias("v"), F.lit(False).alias("r")))
    return A.ks_statistic(both, "v", F.col("r"), ["component"]).select("component", "ks_pvalue")
