"""Rollups and SQL views."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattgrid.operators import rollups as R
from wattgrid.plans.registry import query
from wattgrid.plans.tables import HALF_JOBS
from wattgrid.operators.scans import time_range


@query("a1_job_metrics_hourly", """
select date_trunc('hour', time) as bucket, job_type, node_id, count(*) as job_count,
  avg(duration_seconds) as avg_duration, avg(cpu_usage) as avg_cpu_usage, avg(memory_usage) as avg_memory_usage,
  avg(estimated_energy_wh) as avg_energy, sum(estimated_energy_wh) as total_energy,
  avg(avg_cpu_temp) as avg_temp, max(peak_cpu_temp) as max_temp
from job_metrics group by 1, 2, 3""",
       r6="avg_duration avg_cpu_usage avg_memory_usage avg_energy total_energy avg_temp max_temp")
def _(t):
    return R.hourly_jobs(t.job_metrics)


@query("a2_energy_efficiency_daily", """
select date_trunc('day', time) as bucket, node_id, avg(energy_per_job_wh) as avg_energy_per_job,
  avg(energy_per_cpu_hour_wh) as avg_energy_per_cpu_hour, cast(sum(jobs_completed) as bigint) as total_jobs,
  sum(total_cpu_hours) as total_cpu_hours, avg(avg_thermal_efficiency) as avg_thermal_efficiency
from energy_efficiency group by 1, 2""",
       r6="avg_energy_per_job avg_energy_per_cpu_hour total_cpu_hours avg_thermal_efficiency")
def _(t):
    return R.daily_efficiency(t.energy_efficiency)


@query("a3_thermal_hotspots", """
select node_id, count(*) as event_count, avg(temperature) as avg_temp, max(temperature) as max_temp,
  cast(sum(duration_seconds) as bigint) as total_duration_seconds,
  avg(performance_impact_percent) as avg_performance_impact
from thermal_events where time >= (select max(time) from thermal_events) - interval 24 hour
  and severity in ('high', 'critical') group by node_id""", r6="avg_temp avg_performance_impact")
def _(t):
    return R.hotspots(t.thermal_events)


@query("a4_prediction_accuracy", """
select model_version, prediction_method, count(*) as prediction_count,
  avg(abs(prediction_error_percent)) as avg_absolute_error, stddev(prediction_error_percent) as error_stddev,
  count(case when abs(prediction_error_percent) <= 10 then 1 end) * 100.0E0 / count(*) as accuracy_within_10_percent
from energy_predictions where actual_energy_wh is not null
  and time >= (select max(time) from energy_predictions) - interval 3650 day
group by 1, 2""", r6="avg_absolute_error error_stddev accuracy_within_10_percent")
def _(t):
    return R.prediction_accuracy(t.energy_predictions, days=3650)


@query("w1_node_efficiency_ranking", """
select node_id, avg(energy_per_job_wh) as avg_energy_per_job, avg(energy_per_cpu_hour_wh) as avg_energy_per_cpu_hour,
  count(*) as measurement_count, rank() over (order by avg(energy_per_job_wh)) as efficiency_rank
from energy_efficiency where time >= timestamp '1998-06-15' - interval 365 day group by node_id""",
       r6="avg_energy_per_job avg_energy_per_cpu_hour")
def _(t):
    out = R.node_ranking(t.energy_efficiency, "1998-06-15 00:00:00", 365)
    return out.withColumn("efficiency_rank", F.col("efficiency_rank").cast("bigint"))


@query("a5_node_energy_efficiency", f"""
select sum(estimated_energy_wh) / count(*) as energy_per_job,
  sum(estimated_energy_wh) / sum(duration_seconds * cpu_cores / 3600.0E0) as energy_per_cpu_hour,
  count(*) as total_jobs, sum(estimated_energy_wh) as total_energy
from job_metrics where node_id = 'node_04' and job_state = 'COMPLETED'
  and time between timestamp '{HALF_JOBS[0]}' and timestamp '{HALF_JOBS[1]}'""",
       r6="energy_per_job energy_per_cpu_hour", r4="total_energy")
def _(t):
    return R.node_efficiency(t.job_metrics, "node_04", *HALF_JOBS)


def _thermal_sql(extra: str) -> str:
    return f"""
select node_id, event_type, count(*) as event_count, avg(temperature) as avg_temperature,
  cast(sum(duration_seconds) as bigint) as total_duration, avg(performance_impact_percent) as avg_impact
from thermal_events where time >= (select max(time) from thermal_events) - interval 240 hour {extra}
group by 1, 2"""


@query("a6_thermal_events_summary", _thermal_sql(""), r6="avg_temperature avg_impact")
def _(t):
    return R.thermal_summary(t.thermal_events, hours_back=240)


@query("a6_thermal_events_of_node", _thermal_sql("and node_id = 'node_05'"), r6="avg_temperature avg_impact")
def _(t):
    return R.thermal_summary(t.thermal_events, "node_05", 240)


@query("a7_energy_by_job_type", f"""
select job_type, count(*) as count, avg(estimated_energy_wh) as avg_energy from job_metrics
where time between timestamp '{HALF_JOBS[0]}' and timestamp '{HALF_JOBS[1]}' group by job_type""", r6="avg_energy")
def _(t):
    rows = time_range(t.job_metrics, *HALF_JOBS)
    return rows.groupBy("job_type").agg(
        F.count(F.lit(1)).alias("count"), F.avg("estimated_energy_wh").alias("avg_energy")).orderBy(F.desc("avg_energy"))


@query("a8_hourly_energy_by_job_type", f"""
select date_trunc('hour', time) as time, job_type, sum(estimated_energy_wh) as total_energy from job_metrics
where time between timestamp '{HALF_JOBS[0]}' and timestamp '{HALF_JOBS[1]}' group by 1, 2""", r6="total_energy")
def _(t):
    rows = time_range(t.job_metrics, *HALF_JOBS)
    return rows.groupBy(R.bucket(rows, "hour").alias("time"), "job_type").agg(
        F.sum("estimated_energy_wh").alias("total_energy"))


@query("a43_workload_patterns", """
select job_type as pattern_name, avg(cpu_usage) as avg_cpu_usage, avg(memory_usage) as avg_memory_usage,
  avg(io_read_mbps + io_write_mbps) as avg_io_usage, cast(floor(avg(duration_seconds)) as int) as avg_duration_seconds,
  avg(estimated_energy_wh) as avg_energy_wh, count(*) as sample_count, max(time) as last_updated
from job_metrics group by 1""", r6="avg_cpu_usage avg_memory_usage avg_io_usage avg_energy_wh")
def _(t):
    return R.workload_patterns(t.job_metrics)


@query("a44_efficiency_facts", """
select date_trunc('day', time) as time, node_id, sum(estimated_energy_wh) / count(*) as energy_per_job_wh,
  sum(estimated_energy_wh) / sum(duration_seconds * cpu_cores / 3600.0E0) as energy_per_cpu_hour_wh,
  sum(estimated_energy_wh) / sum(duration_seconds * memory_mb / 1024.0E0 / 3600.0E0) as energy_per_gb_hour_wh,
  count(*) as jobs_completed, sum(duration_seconds * cpu_cores / 3600.0E0) as total_cpu_hours,
  sum(duration_seconds * memory_mb / 1024.0E0 / 3600.0E0) as total_memory_gb_hours,
  avg(cpu_usage / avg_cpu_temp) as avg_thermal_efficiency
from job_metrics where job_state = 'COMPLETED' group by 1, 2""",
       r6="energy_per_job_wh energy_per_cpu_hour_wh energy_per_gb_hour_wh total_cpu_hours "
          "total_memory_gb_hours avg_thermal_efficiency")
def _(t):
    return R.efficiency_facts(t.job_metrics)


@query("a45_energy_cube", """
select job_type, node_id, grouping_id(job_type, node_id) as level, count(*) as jobs,
  sum(estimated_energy_wh) as total_energy, avg(estimated_energy_wh) as avg_energy
from job_metrics group by cube(job_type, node_id)""", r4="total_energy", r6="avg_energy")
def _(t):
    return R.energy_cube(t.job_metrics)


@query("a46_distinct_counts", """
select count(distinct job_id) as jobs, count(distinct node_id) as nodes, count(distinct user_id) as users from job_metrics""")
def _(t):
    return R.distinct_counts(t.job_metrics, {"jobs": "job_id", "nodes": "node_id", "users": "user_id"})


@query("a15_job_type_counts", "select job_type, count(*) as count from job_metrics group by 1")
def _(t):
    return t.job_metrics.groupBy("job_type").count()
