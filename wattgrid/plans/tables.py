"""Table scans, predicates, sorts, set operations and keyed updates (S, P, T, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattgrid.operators import rollups as R
from wattgrid.operators import scans as S
from wattgrid.operators.quantiles import exact_percentiles
from wattgrid.plans.registry import query
from wattgrid.sources.traces import clean_trace, parse_swf

JOBS_AT = "1998-06-15 12:00:00"
NODES_AT = "2024-01-20 00:00:00"
ALL_JOBS = ("1994-01-01 00:00:00", "2003-01-01 00:00:00")
HALF_JOBS = ("1996-01-01 00:00:00", "1999-12-31 23:59:59")
HALF_NODES = ("2024-01-05 00:00:00", "2024-01-20 00:00:00")


@query("s1_recent_jobs", f"""
select time, job_id, job_state, job_type, cpu_usage, memory_usage, duration_seconds, estimated_energy_wh, node_id
from job_metrics where time >= timestamp '{JOBS_AT}' - interval 7 day and time <= timestamp '{JOBS_AT}'""")
def _(t):
    return S.recent(t.job_metrics, S.JOB_COLUMNS, JOBS_AT)


@query("s1_recent_thermal", f"""
select time, node_id, cpu_temp from node_metrics
where time >= timestamp '{NODES_AT}' - interval 7 day and time <= timestamp '{NODES_AT}'""")
def _(t):
    return S.recent(t.node_metrics, ["time", "node_id", "cpu_temp"], NODES_AT)


@query("s1_recent_system", """
select time, node_id, cpu_usage, memory_usage, power_consumption_watts from node_metrics
where time >= (select max(time) from node_metrics) - interval 7 day""")
def _(t):
    return S.recent(t.node_metrics, ["time", "node_id", "cpu_usage", "memory_usage", "power_consumption_watts"])


@query("s2_load_job_metrics", f"""
select time, job_id, job_type, node_id, duration_seconds, estimated_energy_wh from job_metrics
where time between timestamp '{HALF_JOBS[0]}' and timestamp '{HALF_JOBS[1]}'
  and job_type in ('cpu_intensive', 'mixed') and duration_seconds >= 1200""")
def _(t):
    rows = S.load_jobs(t.job_metrics, *HALF_JOBS, job_types=["cpu_intensive", "mixed"], min_duration=1200)
    return rows.select("time", "job_id", "job_type", "node_id", "duration_seconds", "estimated_energy_wh")


@query("s3_load_node_metrics", f"""
select sample_id, time, node_id, cpu_usage, cpu_temp from node_metrics
where time between timestamp '{HALF_NODES[0]}' and timestamp '{HALF_NODES[1]}' and node_id in ('node_01', 'node_07')""")
def _(t):
    rows = S.load_nodes(t.node_metrics, *HALF_NODES, node_ids=["node_01", "node_07"])
    return rows.select("sample_id", "time", "node_id", "cpu_usage", "cpu_temp")


@query("s4_load_energy_predictions", f"""
select time, job_id, predicted_energy_wh, actual_energy_wh, prediction_error_percent, model_version,
  prediction_method as features_used from energy_predictions
where time between timestamp '{HALF_JOBS[0]}' and timestamp '{HALF_JOBS[1]}'""",
       r6="predicted_energy_wh actual_energy_wh prediction_error_percent")
def _(t):
    return S.load_predictions(t.energy_predictions, *HALF_JOBS)


SWF_ORACLE = """
select f[1] as job_id, try_cast(f[2] as double) as submit_time, try_cast(f[3] as double) as wait_time,
  try_cast(f[4] as double) as run_time, try_cast(f[5] as double) as allocated_processors,
  try_cast(f[6] as double) as average_cpu_time, try_cast(f[7] as double) as used_memory,
  try_cast(f[8] as double) as requested_processors, try_cast(f[9] as double) as requested_time,
  try_cast(f[10] as double) as requested_memory, f[11] as status, f[12] as user_id, f[13] as group_id,
  f[14] as executable_id, f[15] as queue_id, f[16] as partition_id, f[17] as preceding_job_id, f[18] as think_time
from (select string_split_regex(trim(line), '\\s+') as f from swf_lines where line not like ';%') where len(f) >= 18"""


@query("s9_swf_trace", SWF_ORACLE)
def _(t):
    return parse_swf(t.swf_lines)


def _trace(t):
    """The cleaned trace with utilisation and temperatures fixed by the job's fields."""
    return clean_trace(
        parse_swf(t.swf_lines), "orders_trace",
        utilisation=F.lit(0.6) + (F.col("run_time") % 30) / 100,
        temperature=F.lit(40.0) + F.col("run_time") % 20,
        temperature_rise=F.lit(5.0) + F.col("wait_time") % 10,
    )


TRACE_SQL = f"""swf as ({SWF_ORACLE}), trace as (
select job_id, make_timestamp(cast(submit_time * 1000000 as bigint)) as submit_time,
  make_timestamp(cast((submit_time + wait_time) * 1000000 as bigint)) as start_time,
  make_timestamp(cast((submit_time + wait_time + run_time) * 1000000 as bigint)) as end_time,
  run_time as duration_seconds, allocated_processors as num_nodes,
  run_time * allocated_processors / 3600 as cpu_hours, coalesce(used_memory, 0) / 1024 as memory_gb,
  queue_id as queue, user_id, 'COMPLETED' as status, 'orders_trace' as dataset_source,
  allocated_processors * 200 * (0.6E0 + (run_time % 30) / 100) as estimated_power_w,
  allocated_processors * 200 * (0.6E0 + (run_time % 30) / 100) * run_time / 3600 as estimated_energy_wh,
  40.0E0 + run_time % 20 as avg_temp_c, 40.0E0 + run_time % 20 + 5.0E0 + wait_time % 10 as max_temp_c
from swf where job_id is not null and submit_time is not null and run_time > 0 and allocated_processors > 0)"""


@query("p6_f14_f24_clean_trace", f"with {TRACE_SQL} select * from trace",
       r6="cpu_hours memory_gb estimated_power_w estimated_energy_wh")
def _(t):
    out = _trace(t)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("submit_time", "start_time", "end_time")})


@query("a21_trace_summary", f"""with {TRACE_SQL}
select dataset_source, count(*) as jobs, sum(cpu_hours) as cpu_hours, sum(estimated_energy_wh) as energy_wh,
  min(submit_time) as first_submit, max(submit_time) as last_submit,
  avg(duration_seconds) / 3600 as avg_hours, avg(num_nodes) as avg_nodes
from trace group by rollup(dataset_source)""", r4="cpu_hours energy_wh", r6="avg_hours avg_nodes")
def _(t):
    out = R.trace_summary(_trace(t))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_submit", "last_submit")})


@query("p11_canonical_trace", f"""with {TRACE_SQL}
select job_id, num_nodes as cpu_cores, memory_gb * 1024 as memory_mb, estimated_power_w as avg_power_watts,
  avg_temp_c as avg_cpu_temp, max_temp_c as peak_cpu_temp, dataset_source as partition,
  75.0E0 as cpu_usage, 60.0E0 as memory_usage, 10.0E0 as io_read_mbps, 5.0E0 as io_write_mbps,
  1.0E0 as network_rx_mbps, 1.0E0 as network_tx_mbps, 'compute' as job_type,
  'cpu_intensive' as workload_pattern from trace""", r6="avg_power_watts")
def _(t):
    return S.canonical_trace(_trace(t)).select(
        "job_id", "cpu_cores", "memory_mb", "avg_power_watts", "avg_cpu_temp", "peak_cpu_temp", "partition",
        "cpu_usage", "memory_usage", "io_read_mbps", "io_write_mbps", "network_rx_mbps", "network_tx_mbps",
        "job_type", "workload_pattern")


@query("x1_union_sources", f"""with {TRACE_SQL}
select dataset_source, count(*) as n, count(job_type) as typed, sum(estimated_energy_wh) as energy_wh from (
  select dataset_source, null as job_type, estimated_energy_wh from trace
  union all select 'cluster', job_type, estimated_energy_wh from job_metrics) group by 1""", r4="energy_wh")
def _(t):
    cluster = t.job_metrics.select(F.lit("cluster").alias("dataset_source"), "job_type", "estimated_energy_wh")
    trace = _trace(t).select("dataset_source", "estimated_energy_wh")
    return S.union_all(cluster, trace).groupBy("dataset_source").agg(
        F.count(F.lit(1)).alias("n"), F.count("job_type").alias("typed"), F.sum("estimated_energy_wh").alias("energy_wh"))


@query("x2_weighted_union", """
with n as (select count(*) as internal, least(cast(floor(count(*) * 0.1E0) as bigint),
  (select count(*) from swf_lines)) as public from job_metrics)
select 'internal' as data_source, internal as n from n union all select 'public', public from n""")
def _(t):
    both = S.weighted_union(t.job_metrics, _trace(t), 0.1, ["job_id"])
    return both.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"))


@query("x3_common_keys", """
select node_id, job_type from job_metrics where job_state = 'FAILED'
intersect select node_id, job_type from job_metrics where job_state = 'RUNNING'""")
def _(t):
    j = t.job_metrics.select("node_id", "job_type", "job_state")
    pick = lambda s: j.filter(F.col("job_state") == s).select("node_id", "job_type")
    return pick("FAILED").intersect(pick("RUNNING"))


@query("x4_j10_new_categories", """
select user_id from job_metrics where time >= timestamp '1998-01-01'
except select user_id from job_metrics where time < timestamp '1996-01-01'""")
def _(t):
    j = t.job_metrics.select("user_id", "time")
    trained = j.filter(F.col("time") < F.lit("1996-01-01").cast("timestamp_ntz")).select("user_id")
    return j.filter(F.col("time") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("user_id").subtract(trained)


@query("s18_upsert", """
select time, job_id, case when job_state = 'RUNNING' then 'COMPLETED' else job_state end as job_state,
  case when job_state = 'RUNNING' then duration_seconds + 60 else duration_seconds end as duration_seconds,
  case when job_state = 'RUNNING' then cpu_usage / 2 else cpu_usage end as cpu_usage, memory_mb
from job_metrics
union all
select time, 'new-' || job_id, 'PENDING', 0, 0.0E0, null from job_metrics where job_state = 'FAILED'""")
def _(t):
    base = t.job_metrics.select("time", "job_id", "job_state", "duration_seconds", "cpu_usage", "memory_mb")
    done = base.filter("job_state = 'RUNNING'").select(
        "time", "job_id", F.lit("COMPLETED").alias("job_state"),
        (F.col("duration_seconds") + 60).alias("duration_seconds"), (F.col("cpu_usage") / 2).alias("cpu_usage"),
        F.lit(0).alias("memory_mb"), F.lit(2).alias("version"))
    stale = done.withColumns({"job_state": F.lit("STALE"), "version": F.lit(1)})
    new = base.filter("job_state = 'FAILED'").select(
        "time", F.concat(F.lit("new-"), "job_id").alias("job_id"), F.lit("PENDING").alias("job_state"),
        F.lit(0).alias("duration_seconds"), F.lit(0.0).alias("cpu_usage"),
        F.lit(None).cast("int").alias("memory_mb"), F.lit(1).alias("version"))
    changes = done.unionByName(stale).unionByName(new)
    return S.upsert(base, changes, ["time", "job_id"], ["job_state", "duration_seconds", "cpu_usage"], ["version"])


@query("s19_close_out", """
select job_id, node_id, case when job_state <> 'RUNNING' then job_state else 'STARTING' end as job_state,
  case when job_state <> 'RUNNING' then estimated_energy_wh else 0.0E0 end as estimated_energy_wh,
  case job_state when 'FAILED' then 1 when 'COMPLETED' then 0 end as exit_code
from job_metrics""")
def _(t):
    j = t.job_metrics
    started = j.select("job_id", "node_id", F.lit("STARTING").alias("job_state"), F.lit(0.0).alias("estimated_energy_wh"))
    ended = j.filter("job_state <> 'RUNNING'").select(
        "job_id", "node_id", "job_state", "estimated_energy_wh",
        F.when(F.col("job_state") == "FAILED", 1).otherwise(0).alias("exit_code"))
    return S.close_out(started, ended)


@query("s25_refresh_hourly", f"""
select date_trunc('hour', time) as bucket, job_type, node_id, count(*) as job_count,
  sum(estimated_energy_wh) as total_energy from job_metrics
where time >= timestamp '{JOBS_AT}' - interval 72 hour and time < timestamp '{JOBS_AT}' - interval 1 hour
group by all""", r6="total_energy")
def _(t):
    rows = R.refresh_rows(t.job_metrics, JOBS_AT, 72, 1, "hour")
    return R.hourly_jobs(rows).select("bucket", "job_type", "node_id", "job_count", "total_energy")


@query("s25_refresh_daily", f"""
select date_trunc('day', time) as bucket, node_id, avg(energy_per_job_wh) as avg_energy_per_job,
  cast(sum(jobs_completed) as bigint) as total_jobs from energy_efficiency
where time >= timestamp '1998-06-06' and time < timestamp '1998-06-14' group by all""", r6="avg_energy_per_job")
def _(t):
    rows = R.refresh_rows(t.energy_efficiency, JOBS_AT, 240, 24, "day")
    return R.daily_efficiency(rows).select("bucket", "node_id", "avg_energy_per_job", "total_jobs")


@query("s26_retention", """
select 'node_metrics' as table_name, count(*) as rows_kept, min(time) as oldest from node_metrics
where time >= timestamp '2024-02-15' - interval 30 day
union all select 'thermal_events', count(*), min(time) from thermal_events
where time >= timestamp '2024-04-05' - interval 90 day""")
def _(t):
    keep = lambda df, name, at, days: S.retained(df, at, days).agg(
        F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows_kept"), F.min("time").alias("oldest"))
    return keep(t.node_metrics, "node_metrics", "2024-02-15 00:00:00", 30).unionByName(
        keep(t.thermal_events, "thermal_events", "2024-04-05 00:00:00", 90))


@query("p1_current_jobs", f"""
select job_id, job_type, node_id, user_id, time as start_time, cpu_cores, memory_mb, cpu_usage, memory_usage,
  avg_cpu_temp, estimated_energy_wh from job_metrics
where job_state = 'RUNNING' and time >= timestamp '{JOBS_AT}' - interval 1 hour""")
def _(t):
    j = t.job_metrics
    rows = j.filter((F.col("job_state") == "RUNNING") & (F.col("time") >= S.ago(S.instant(j, JOBS_AT), hours=1)))
    return rows.select("job_id", "job_type", "node_id", "user_id", F.col("time").alias("start_time"), "cpu_cores",
                       "memory_mb", "cpu_usage", "memory_usage", "avg_cpu_temp", "estimated_energy_wh")


@query("p2_t3_energy_vs_temperature", f"""
select time, avg_cpu_temp as temperature, estimated_energy_wh as energy from job_metrics
where time between timestamp '{HALF_JOBS[0]}' and timestamp '{HALF_JOBS[1]}' order by time""")
def _(t):
    return S.time_range(t.job_metrics, *HALF_JOBS).select(
        "time", F.col("avg_cpu_temp").alias("temperature"), F.col("estimated_energy_wh").alias("energy")).orderBy("time")


@query("p3_completed_on_node", f"""
select job_id, time, estimated_energy_wh from job_metrics where node_id = 'node_03'
and time between timestamp '{HALF_JOBS[0]}' and timestamp '{HALF_JOBS[1]}' and job_state = 'COMPLETED'""")
def _(t):
    rows = S.time_range(t.job_metrics, *HALF_JOBS).filter("node_id = 'node_03' and job_state = 'COMPLETED'")
    return rows.select("job_id", "time", "estimated_energy_wh")


@query("p4_optional_filter", """
select node_id, event_type, temperature from thermal_events where (cast(null as varchar) is null or node_id = null)
union all select node_id, event_type, temperature from thermal_events where node_id = 'node_02'""")
def _(t):
    e = t.thermal_events.select("node_id", "event_type", "temperature")
    return S.optional_equal(e, "node_id", None).unionAll(S.optional_equal(e, "node_id", "node_02"))


@query("p5_severity_filter", "select * from thermal_events where severity in ('high', 'critical')")
def _(t):
    return t.thermal_events.filter(F.col("severity").isin("high", "critical"))


_DIRTY = """dirty as (select job_id, estimated_energy_wh as target,
  case job_state when 'FAILED' then null when 'RUNNING' then 'Infinity'::double else cpu_usage end as feature,
  case when job_type = 'mixed' then 'NaN'::double else memory_usage end as other,
  case when job_type = 'mixed' then null else duration_seconds end as maybe from job_metrics)"""


def _dirty(t):
    return t.job_metrics.selectExpr(
        "job_id", "estimated_energy_wh as target",
        "case job_state when 'FAILED' then null when 'RUNNING' then double('Infinity') else cpu_usage end as feature",
        "case when job_type = 'mixed' then double('NaN') else memory_usage end as other",
        "case when job_type = 'mixed' then null else duration_seconds end as maybe")


@query("p7_valid_rows", f"""with {_DIRTY} select job_id, target, feature, other from dirty
where feature is not null and not isnan(feature) and not isinf(feature) and other is not null
  and not isnan(other) and not isinf(other) and target > 0""")
def _(t):
    return S.valid_rows(_dirty(t), ["feature", "other"], "target").select("job_id", "target", "feature", "other")


@query("p8_drop_empty_rows", f"""with {_DIRTY} select feature, maybe from dirty
where not (feature is null and maybe is null)""")
def _(t):
    return _dirty(t).select("feature", "maybe").dropna(how="all")


@query("p9_drop_infinite", f"""with {_DIRTY} select job_id, feature, maybe from dirty
where coalesce(not isinf(feature), true)""")
def _(t):
    return S.drop_infinite(_dirty(t).select("job_id", "feature", "maybe"))


@query("p10_distinct_job_types", "select distinct job_type from job_metrics")
def _(t):
    return t.job_metrics.select("job_type").distinct()


@query("p12_one_row_per_key", """
select * exclude (rn) from (select date_trunc('hour', time) as hour, node_id, sample_id, cpu_temp,
  row_number() over (partition by date_trunc('hour', time), node_id order by time desc, sample_id desc) as rn
  from node_metrics) where rn = 1""")
def _(t):
    n = t.node_metrics
    hourly = n.withColumn("hour", R.bucket(n, "hour"))
    return S.one_per_key(hourly, ["hour", "node_id"], [F.desc("time"), F.desc("sample_id")]).select(
        "hour", "node_id", "sample_id", "cpu_temp")


@query("p15_energy_target", f"""with {TRACE_SQL}
select job_id, estimated_power_w * duration_seconds / 3600 as calculated_energy_wh from trace""",
       r6="calculated_energy_wh")
def _(t):
    df, name = S.energy_target(_trace(t).drop("estimated_energy_wh"))
    return df.select("job_id", name)


@query("p16_above_and_below", """
with q as (select quantile_cont(estimated_energy_wh, 0.25) as q1, quantile_cont(estimated_energy_wh, 0.75) as q3,
  quantile_cont(cpu_usage, 0.25) as c1 from job_metrics)
select job_id, 'high_energy' as kind from job_metrics, q where estimated_energy_wh > q3 + 1.5 * (q3 - q1)
union all select job_id, 'low_cpu' from job_metrics, q where cpu_usage < c1""")
def _(t):
    j = t.job_metrics
    fence = exact_percentiles(j, "estimated_energy_wh", {"q1": 0.25, "q3": 0.75}).select(
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("x")).scalar()
    quarter = exact_percentiles(j, "cpu_usage", {"q1": 0.25}).scalar()
    return j.filter(F.col("estimated_energy_wh") > fence).select("job_id", F.lit("high_energy").alias("kind")).unionAll(
        j.filter(F.col("cpu_usage") < quarter).select("job_id", F.lit("low_cpu").alias("kind")))


@query("t1_top_energy_jobs", """
select job_id, job_type, duration_seconds, avg_cpu_temp, peak_cpu_temp, estimated_energy_wh, time
from job_metrics order by estimated_energy_wh desc, job_id limit 20""")
def _(t):
    return t.job_metrics.select("job_id", "job_type", "duration_seconds", "avg_cpu_temp", "peak_cpu_temp",
                                "estimated_energy_wh", "time").orderBy(F.desc("estimated_energy_wh"), "job_id").limit(20)


@query("t2_recent_jobs_limited", """
select job_id, job_type, time, estimated_energy_wh from job_metrics order by time desc, job_id limit 1000""")
def _(t, rows=1000):
    return t.job_metrics.select("job_id", "job_type", "time", "estimated_energy_wh").orderBy(F.desc("time"), "job_id").limit(rows)


@query("t4_energy_vs_duration", f"""
select duration_seconds as "time", estimated_energy_wh as energy, job_type from job_metrics
where time between timestamp '{HALF_JOBS[0]}' and timestamp '{HALF_JOBS[1]}' order by 1""")
def _(t):
    return S.time_range(t.job_metrics, *HALF_JOBS).select(
        F.col("duration_seconds").alias("time"), F.col("estimated_energy_wh").alias("energy"), "job_type").orderBy("time")
