"""Scalar formulas, parsing, features and advice rows (F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.functions import advice as V
from wattgrid.functions import features as X
from wattgrid.functions import parse as Q
from wattgrid.functions import power as P
from wattgrid.operators import stats as A
from wattgrid.operators.ordered import position_in_order, seconds_between
from wattgrid.plans.measures import _METRICS, _pairs, benchmark_totals
from wattgrid.plans.registry import query


def _ints(df: DataFrame) -> DataFrame:
    """Calendar parts as bigint, as the checking engine has them."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if k in ("int", "tinyint") else F.col(c) for c, k in df.dtypes])


@query("f1_clock_seconds", """
select job_id, cast(case when duration_seconds < 3600 then duration_seconds else duration_seconds end as bigint) as seconds,
  0::bigint as bad from job_metrics""")
def _(t):
    j = t.job_metrics
    d = F.col("duration_seconds")
    h, m, s = F.floor(d / 3600), F.floor(d / 60) % 60, d % 60
    text = (F.when(d < 60, s.cast("string")).when(d < 3600, F.concat_ws(":", m, s)).otherwise(F.concat_ws(":", h, m, s)))
    return j.select("job_id", Q.clock_seconds(text).cast("bigint").alias("seconds"),
                    Q.clock_seconds(F.concat(F.lit("x"), text)).cast("bigint").alias("bad"))


@query("f2_memory_bytes", """
select job_id, cast(memory_mb as bigint) * 1024 * 1024 as in_m, cast(memory_mb as bigint) * 1024 * 1024 as in_k,
  cast(memory_mb / 1024.0E0 * 1073741824 as bigint) as in_g, cast(memory_mb as bigint) as plain, 0::bigint as bad from job_metrics""")
def _(t):
    m = F.col("memory_mb")
    return t.job_metrics.select(
        "job_id", Q.memory_bytes(F.concat(m, F.lit("M"))).alias("in_m"),
        Q.memory_bytes(F.concat(m * 1024, F.lit("KB"))).alias("in_k"),
        Q.memory_bytes(F.concat(m / 1024, F.lit("g"))).alias("in_g"),
        Q.memory_bytes(m.cast("string")).alias("plain"), Q.memory_bytes(F.concat(m, F.lit(" pages"))).alias("bad"))


@query("f3_cpu_minutes", """
select job_id, ((duration_seconds // 60) % 60 * 60 + duration_seconds % 60) / 60.0E0 as minutes from job_metrics""", r6="minutes")
def _(t):
    d = F.col("duration_seconds")
    text = F.concat_ws(":", F.floor(d / 3600), F.floor(d / 60) % 60, d % 60)
    return t.job_metrics.select("job_id", Q.cpu_minutes(text).alias("minutes"))


@query("f4_job_type_from_name", """
select p_partkey, p_name, case when regexp_matches(lower(p_name), 'cpu|compute|calc') then 'cpu_intensive'
  when regexp_matches(lower(p_name), 'io|read|write|copy') then 'io_intensive'
  when regexp_matches(lower(p_name), 'mixed|hybrid') then 'mixed_workload' else 'unknown' end as job_type from part
union all select l_orderkey, job_type, case job_type when 'memory_intensive' then 'unknown' when 'mixed' then 'mixed_workload' else job_type end
from (select cast(user_id as bigint) as l_orderkey, job_type from job_metrics)""")
def _(t):
    parts = t.part.select("p_partkey", "p_name", Q.job_type_from_name("p_name").alias("job_type"))
    jobs = t.job_metrics.select(F.col("user_id").alias("p_partkey"), F.col("job_type").alias("p_name"),
                                Q.job_type_from_name("job_type").alias("job_type"))
    return parts.unionAll(jobs)


@query("f5_job_type_from_usage", """
select job_id, case when cpu_usage > 70 and memory_usage < 50 then 'cpu_intensive'
  when memory_usage > 70 and cpu_usage < 50 then 'memory_intensive' when io_read_mbps > 50 then 'io_intensive'
  when cpu_usage > 40 and memory_usage > 40 then 'mixed' else 'light' end as job_type from job_metrics""")
def _(t):
    return t.job_metrics.select("job_id", Q.job_type_from_usage("cpu_usage", "memory_usage", "io_read_mbps").alias("job_type"))


@query("f6_f7_f21_codes", """
select job_id, case job_state when 'RUNNING' then 1 when 'COMPLETED' then 2 when 'FAILED' then 3 else 0 end as state,
  case job_type when 'cpu_intensive' then 0 when 'io_intensive' then 1 when 'memory_intensive' then 3 else 2 end as type_code,
  case when cpu_cores % 3 <> 0 then 'FAILED' else 'COMPLETED' end as from_exit,
  2 as unknown_type from job_metrics""")
def _(t):
    return t.job_metrics.select(
        "job_id", Q.state_code("job_state").alias("state"), Q.job_type_code("job_type").alias("type_code"),
        Q.state_from_exit(F.col("cpu_cores") % 3).alias("from_exit"), Q.job_type_code("queue").alias("unknown_type"))


@query("f8_f9_f13_f15_job_energy", """
select job_id, (20 + 30 * cpu_usage / 100) * cpu_cores * duration_seconds as joules,
  (50 + 2 * cpu_usage + 0.5E0 * (io_read_mbps + io_write_mbps)) * duration_seconds / 3600 as benchmark_wh,
  (50 + 2 * 50.0E0 + 0.5E0 * 10) * duration_seconds / 3600 as default_wh,
  50 + 2 * cpu_usage + 0.5E0 * memory_usage as prolog_w,
  greatest((50 + 2 * cpu_usage + 0.5E0 * memory_usage + 0.3E0 * (io_read_mbps + io_write_mbps) + 10 * cpu_cores)
    * duration_seconds / 3600, 1) as request_wh from job_metrics""", r6="joules benchmark_wh default_wh prolog_w request_wh")
def _(t):
    return t.job_metrics.select(
        "job_id", P.scheduler_job_joules("cpu_usage", "cpu_cores", "duration_seconds").alias("joules"),
        P.benchmark_wh("duration_seconds", "cpu_usage", F.col("io_read_mbps") + F.col("io_write_mbps")).alias("benchmark_wh"),
        P.benchmark_wh("duration_seconds").alias("default_wh"), P.prolog_watts("cpu_usage", "memory_usage").alias("prolog_w"),
        P.request_wh("duration_seconds", "cpu_usage", "memory_usage", "io_read_mbps", "io_write_mbps", "cpu_cores").alias("request_wh"))


@query("f11_f12_node_power", """
select sample_id, (15 + 35 * cpu_usage / 100) * 8 as cpu_w, 3.0E0 * 64 as memory_w,
  50 + case when cpu_usage <> 0 then cpu_usage * 0.8E0 * (2400.0E0 / 2000) * (1 + (cpu_temp - 40) / 100) else 0 end
    + 0.1E0 * memory_usage + case when cpu_temp > 30 then 2 * (cpu_temp - 30) else 0 end as monitor_w from node_metrics""",
       r6="cpu_w monitor_w")
def _(t):
    return t.node_metrics.select(
        "sample_id", P.cpu_watts("cpu_usage", 8).alias("cpu_w"), P.memory_watts(64.0).alias("memory_w"),
        P.monitor_watts("cpu_usage", "cpu_temp", 2400.0, "memory_usage", "cpu_temp").alias("monitor_w"))


@query("f16_workload_power", """
with j as (select job_id, job_type, cpu_usage / 100 as c, memory_usage / 100 as m, duration_seconds / 2.0E0 as t from job_metrics)
select job_id, case job_type when 'cpu_intensive' then (60 + 240 * c + 20 * m) * (1 + 0.1E0 * sin(t / 60))
  when 'memory_intensive' then (60 + 240 * 0.6E0 * c + 40 * m) * (1 + 0.05E0 * sin(t / 120))
  when 'io_intensive' then (60 + 240 * 0.4E0 * c + 15 * m + 30) * (case when sin(t / 30) > 0.5 then 1.3E0 else 1 end)
  else (60 + 240 * 0.7E0 * c + 25 * m) * (1 + 0.1E0 * sin(t / 60) + 0.05E0 * cos(t / 180)) end as watts from j""", r6="watts")
def _(t):
    return t.job_metrics.select("job_id", P.workload_watts(
        "job_type", F.col("cpu_usage") / 100, F.col("memory_usage") / 100, F.col("duration_seconds") / 2.0, 60.0, 300.0
    ).alias("watts"))


@query("f19_f22_cost_and_priority", """
select job_id, estimated_energy_wh * 0.12E0 / 1000 as cost_usd, estimated_energy_wh * 0.5E0 / 1000 as co2_kg,
  1 / (1 + estimated_energy_wh / duration_seconds / 100) as priority_score,
  case when 1 / (1 + estimated_energy_wh / duration_seconds / 100) > 0.7 then 'high_priority'
    when 1 / (1 + estimated_energy_wh / duration_seconds / 100) > 0.4 then 'medium_priority' else 'low_priority' end as recommendation
from job_metrics""", r3="cost_usd co2_kg", r6="priority_score")
def _(t):
    # The library rounds money to four places; the check compares to three.
    score = P.priority("estimated_energy_wh", "duration_seconds")
    return t.job_metrics.select(
        "job_id", (F.col("estimated_energy_wh") * 0.12 / 1000).alias("cost_usd"),
        (F.col("estimated_energy_wh") * 0.5 / 1000).alias("co2_kg"),
        score.alias("priority_score"), P.priority_label(score).alias("recommendation"))


@query("f20_request_clamp", """
select job_id, least(greatest(cast(duration_seconds * 20 as double), 1), 86400) as duration_seconds,
  least(greatest(cpu_usage * 2 - 50, 0), 100) as cpu_usage_percent,
  least(greatest(case when job_state = 'FAILED' then 30.0E0 else memory_usage end, 0), 100) as memory_usage_percent,
  least(greatest(io_read_mbps * 20, 0), 1000) as io_read_mbps, 5.0E0 as io_write_mbps,
  least(greatest(cast(cpu_cores * 8 as double), 1), 64) as cpu_cores from job_metrics""", r6="cpu_usage_percent")
def _(t):
    return t.job_metrics.select(
        "job_id", Q.clamped("duration_seconds", F.col("duration_seconds") * 20).alias("duration_seconds"),
        Q.clamped("cpu_usage_percent", F.col("cpu_usage") * 2 - 50).alias("cpu_usage_percent"),
        Q.clamped("memory_usage_percent", F.when(F.col("job_state") != "FAILED", F.col("memory_usage"))).alias("memory_usage_percent"),
        Q.clamped("io_read_mbps", F.col("io_read_mbps") * 20).alias("io_read_mbps"),
        Q.clamped("io_write_mbps", F.lit(None)).alias("io_write_mbps"),
        Q.clamped("cpu_cores", F.col("cpu_cores") * 8).alias("cpu_cores"))


@query("f23_epilog_usage", """
select run_id, case when t > 0 then c * 100 / (t * 4) else 0 end as cpu_usage,
  case when t > 0 then m * 100 / 2048 else 0 end as memory_usage, case when t > 0 then b / 1048576 / t else 0 end as io_mbps
from (select run_id, (epoch_us(end_time) - epoch_us(start_time)) / 1000000.0E0 as t,
  (epoch_us(start_time) - epoch_us(submit_time)) / 1000000.0E0 as c, run_id % 2048 as m, run_id * 100000.0E0 as b from job_runs)""",
       r6="cpu_usage memory_usage io_mbps")
def _(t):
    r = t.job_runs.select("run_id", seconds_between("end_time", "start_time").alias("t"),
                          seconds_between("start_time", "submit_time").alias("c"))
    guarded = lambda e: F.when(F.col("t") > 0, e).otherwise(0.0)
    return r.select("run_id", guarded(F.try_divide(F.col("c") * 100, F.col("t") * 4)).alias("cpu_usage"),
                    guarded((F.col("run_id") % 2048) * 100 / F.lit(2048.0)).alias("memory_usage"),
                    guarded(F.try_divide(F.col("run_id") * 100000.0 / 1048576, F.col("t"))).alias("io_mbps"))


@query("f25_job_derived", """
select job_id, cpu_cores * duration_seconds / 3600.0E0 as cpu_hours,
  memory_mb::double * duration_seconds / 3600.0E0 as memory_hours, cpu_usage * cpu_cores / 100 as effective_cpu_usage,
  peak_cpu_temp - avg_cpu_temp as temp_variance from job_metrics""", r6="cpu_hours memory_hours effective_cpu_usage temp_variance")
def _(t):
    df, added = X.job_derived(t.job_metrics)
    return df.select("job_id", *added)


@query("f26_f27_calendar", """
select sample_id, hour(time) as hour, isodow(time) - 1 as day_of_week, day(time) as day_of_month, month(time) as month,
  quarter(time) as quarter, year(time) as year, sin(2 * pi() * hour(time) / 24) as hour_sin, cos(2 * pi() * hour(time) / 24) as hour_cos,
  sin(2 * pi() * (isodow(time) - 1) / 7) as day_sin, cos(2 * pi() * (isodow(time) - 1) / 7) as day_cos,
  sin(2 * pi() * month(time) / 12) as month_sin, cos(2 * pi() * month(time) / 12) as month_cos,
  case when hour(time) between 9 and 17 then 1::bigint else 0 end as is_business_hours,
  case when isodow(time) >= 6 then 1::bigint else 0 end as is_weekend from node_metrics""",
       r6="hour_sin hour_cos day_sin day_cos month_sin month_cos")
def _(t):
    df, added = X.calendar(t.node_metrics)
    return _ints(df.select("sample_id", *added))


@query("f28_combined_efficiency", """
select job_id, coalesce(cpu_cores / nullif(cpu_usage * duration_seconds, 0), 0) as cpu_efficiency,
  memory_mb / (io_read_mbps + io_write_mbps + 1) as io_efficiency,
  estimated_energy_wh / (cpu_cores + memory_mb) as energy_per_operation from job_metrics""",
       r9="cpu_efficiency io_efficiency energy_per_operation")
def _(t):
    df = t.job_metrics.withColumnsRenamed({
        "cpu_cores": "cpu_operations", "memory_mb": "io_operations", "cpu_usage": "cpu_percent_mean",
        "io_read_mbps": "disk_read_mbps_mean", "io_write_mbps": "disk_write_mbps_mean"})
    out, added = X.combined_efficiency(df)
    return out.select("job_id", *added)


@query("f29_f32_job_ratios", """
with j as (select job_id, estimated_energy_wh as e, cpu_cores as c, peak_cpu_temp as t, duration_seconds as d, memory_mb / 1024.0E0 as m from job_metrics)
select job_id, e / (c + 1e-6) as energy_per_core, c / (e + 1e-6) as power_efficiency, e / (t + 1e-6) as thermal_efficiency,
  t / (c + 1e-6) as thermal_per_core, c * d / 3600.0E0 as workload_intensity, c / (d + 1e-6) as compute_density,
  m / (c + 1e-6) as memory_per_core, sqrt(c * m) as resource_utilization, d / (e + 1e-6) as performance_per_watt,
  e / (d + 1e-6) as power_scaling_factor, d / (t + 1e-6) as cooling_efficiency, t / (e + 1e-6) as thermal_resistance,
  pow(c, 2) as cpu_cores_squared, ln(1 + c) as cpu_cores_log, pow(m, 2) as memory_gb_squared, ln(1 + m) as memory_gb_log,
  pow(d, 2) as duration_seconds_squared, ln(1 + d) as duration_seconds_log, c * m as cpu_cores_memory_gb_interaction,
  c::double * d as cpu_cores_duration_seconds_interaction, m * d as memory_gb_duration_seconds_interaction from j""",
       r6="energy_per_core power_efficiency thermal_efficiency thermal_per_core workload_intensity compute_density memory_per_core "
          "resource_utilization performance_per_watt power_scaling_factor cooling_efficiency thermal_resistance cpu_cores_log "
          "memory_gb_log duration_seconds_log")
def _(t):
    df = t.job_metrics.select("job_id", F.col("estimated_energy_wh").alias("energy_consumed_wh"), "cpu_cores",
                              F.col("peak_cpu_temp").alias("max_temp_c"), "duration_seconds",
                              (F.col("memory_mb") / 1024.0).alias("memory_gb"))
    df, ratios = X.job_efficiency(df)
    df, powers = X.powers_and_products(df)
    return df.select("job_id", *ratios, *powers)


@query("f30_s21_prediction_records", """
select job_id, '1.0.0' as model_version, 'post_job_analysis' as prediction_method, predicted_energy_wh,
  coalesce(actual_energy_wh, 0) as actual_energy_wh, case when predicted_energy_wh = 0 or coalesce(actual_energy_wh, 0) = 0 then 0
  else (predicted_energy_wh - actual_energy_wh) * 100 / actual_energy_wh end as prediction_error_percent from energy_predictions""",
       r6="predicted_energy_wh actual_energy_wh prediction_error_percent")
def _(t):
    actual = F.coalesce(F.col("actual_energy_wh"), F.lit(0.0))
    return t.energy_predictions.select(
        "job_id", F.lit("1.0.0").alias("model_version"), F.lit("post_job_analysis").alias("prediction_method"),
        "predicted_energy_wh", actual.alias("actual_energy_wh"),
        P.prediction_error_percent("predicted_energy_wh", actual).alias("prediction_error_percent"))


@query("f31_workload_features", """
with n as (select sample_id, cpu_usage, memory_usage, cpu_temp, power_consumption_watts as p, cpu_usage / 2 as r, memory_usage / 3 as w from node_metrics)
select sample_id, cpu_usage / 800 as cpu_efficiency, memory_usage / 128 as memory_pressure, 1 - memory_usage / 128 as memory_available_ratio,
  r + w as io_total, r / (r + w + 1e-8) as io_read_ratio, w / (r + w + 1e-8) as io_write_ratio,
  w + r as network_total, w / (w + r + 1e-8) as network_in_ratio, r / (w + r + 1e-8) as network_out_ratio,
  p / (cpu_usage + 1e-8) as power_per_cpu_usage, p / (cpu_temp + 1e-8) as thermal_efficiency from n""",
       r9="cpu_efficiency memory_pressure memory_available_ratio io_total io_read_ratio io_write_ratio network_total "
          "network_in_ratio network_out_ratio power_per_cpu_usage thermal_efficiency")
def _(t):
    df = t.node_metrics.withColumns({
        "cpu_cores": F.lit(8), "memory_total": F.lit(128.0), "disk_read": F.col("cpu_usage") / 2,
        "disk_write": F.col("memory_usage") / 3, "network_in": F.col("memory_usage") / 3, "network_out": F.col("cpu_usage") / 2,
        "power_consumption": F.col("power_consumption_watts"), "temperature": F.col("cpu_temp")})
    df, added = X.workload(df)
    return df.select("sample_id", *added)


_FIVE = ["cpu_usage", "memory_usage", "avg_cpu_temp", "avg_power_watts", "io_read_mbps"]
_PAIRS5 = [("cpu_usage", "memory_usage"), ("cpu_usage", "avg_cpu_temp"), ("cpu_usage", "avg_power_watts"),
           ("cpu_usage", "io_read_mbps"), ("memory_usage", "avg_cpu_temp")]


@query("f33_interactions", "select job_id, " + ", ".join(
    f"{a} * {b} as {a}_x_{b}, {a} / ({b} + 1e-8) as {a}_div_{b}" for a, b in _PAIRS5) + " from job_metrics",
       r4=" ".join(f"{a}_x_{b} {a}_div_{b}" for a, b in _PAIRS5))
def _(t):
    df, added = X.interactions(t.job_metrics, _FIVE, limit=10)
    # Shares of a near-zero divisor reach 1e10, so compare them to four places only.
    return df.select("job_id", *added)


@query("f34_polynomials", "select job_id, " + ", ".join(
    f'{a} * {b} as "poly_{a}{"^2" if a == b else " " + b}"' for i, a in enumerate(_FIVE) for b in _FIVE[i:]) + " from job_metrics")
def _(t):
    df, added = X.polynomials(t.job_metrics, _FIVE)
    return df.select("job_id", *added)


@query("f35_row_statistics", """
with u as (select job_id, unnest([cpu_usage, memory_usage, avg_cpu_temp, avg_power_watts, io_read_mbps]) as x from job_metrics)
select job_id, avg(x) as features_mean, stddev_pop(x) as features_std, min(x) as features_min, max(x) as features_max,
  max(x) - min(x) as features_range, skewness(x) as features_skew, kurtosis(x) as features_kurtosis from u group by 1""",
       r6="features_mean features_std features_range features_skew features_kurtosis")
def _(t):
    df, added = X.row_statistics(t.job_metrics, _FIVE)
    return df.select("job_id", *added)


@query("f39_quality_grade", """
select job_id, case when q >= 0.9 and m <= 5 and r >= 0.95 then 'excellent' when q >= 0.8 and m <= 10 and r >= 0.85 then 'good'
  when q >= 0.7 and m <= 15 and r >= 0.75 then 'acceptable' else 'poor' end as grade
from (select job_id, cpu_usage / 100 as q, memory_usage / 8 as m, avg_cpu_temp / 80 as r from job_metrics)""")
def _(t):
    return t.job_metrics.select("job_id", P.quality_grade(
        F.col("cpu_usage") / 100, F.col("memory_usage") / 8, F.col("avg_cpu_temp") / 80).alias("grade"))


@query("f40_throttling_flags", """
select sample_id, (3000 - cpu_usage * 10) / 3000 < 0.8 as by_frequency, cpu_temp > 0.9E0 * 85 as by_temperature from node_metrics""")
def _(t):
    return t.node_metrics.select("sample_id", V.is_throttled(3000 - F.col("cpu_usage") * 10, F.lit(3000.0)).alias("by_frequency"),
                                 V.is_hot(F.col("cpu_temp")).alias("by_temperature"))


def _heat_sql(part, warn, crit):
    return (f"select time, node_id, case when cpu_temp > {crit} then 'temperature_critical' else 'temperature_warning' end as event_type, "
            f"'{part}' as component, cpu_temp as temperature, case when cpu_temp > {crit} then {crit}E0 else {warn}E0 end as threshold, "
            f"case when cpu_temp > {crit} then 'critical' else 'warning' end as severity from node_metrics where cpu_temp > {warn}")


@query("f41_heat_events", _heat_sql("cpu", 75, 85) + " union all " + _heat_sql("gpu", 80, 90))
def _(t):
    return V.heat_events(t.node_metrics).unionByName(V.heat_events(t.node_metrics, "gpu"))


@query("f42_sensor_choice", """
with z as (select time, node_id, unnest([{'kind': 'x86_pkg_temp', 'm': cpu_temp * 1000}, {'kind': 'acpitz', 'm': 20000.0E0},
  {'kind': 'core', 'm': memory_usage * 2000}]) as s from node_metrics)
select time, node_id, avg(s.m / 1000) as cpu_temp_avg, max(s.m / 1000) as cpu_temp_max from z
where regexp_matches(s.kind, 'cpu|core|package|x86_pkg_temp') and s.m / 1000 > 0 and s.m / 1000 < 150 group by 1, 2""",
       r6="cpu_temp_avg cpu_temp_max")
def _(t):
    zone = lambda kind, m: F.struct(F.lit(kind).alias("kind"), m.alias("milli"))
    zones = t.node_metrics.select("time", "node_id", F.inline(F.array(
        zone("x86_pkg_temp", F.col("cpu_temp") * 1000), zone("acpitz", F.lit(20000.0)), zone("core", F.col("memory_usage") * 2000))))
    return cpu_zones(zones)


def cpu_zones(zones: DataFrame) -> DataFrame:
    """Mean and maximum of plausible CPU sensors (kind, millidegrees) per node and time."""
    kept = zones.filter(F.col("kind").rlike("cpu|core|package|x86_pkg_temp")).withColumn("_t", F.col("milli") / 1000)
    return kept.filter((F.col("_t") > 0) & (F.col("_t") < 150)).groupBy("time", "node_id").agg(
        F.avg("_t").alias("cpu_temp_avg"), F.max("_t").alias("cpu_temp_max"))


def _daily(t) -> DataFrame:
    """Load summary of the jobs of each node and day for the rules below."""
    n = t.job_metrics.withColumn("w", P.sample_watts("cpu_usage", "memory_usage"))
    return n.groupBy("node_id", F.date_trunc("day", "time").cast("timestamp_ntz").alias("day")).agg(
        F.avg("cpu_usage").alias("avg_cpu"), F.avg("memory_usage").alias("avg_memory"), F.avg("w").alias("avg_power"),
        F.count_if(F.col("avg_cpu_temp") > 76.5).alias("throttling_events"),
        F.avg(P.efficiency_score("cpu_usage", "memory_usage", "w")).alias("efficiency_score"),
        F.sum((F.col("io_read_mbps") + F.col("io_write_mbps")) * F.col("duration_seconds")).alias("disk_total_mb"),
        F.sum("duration_seconds").alias("duration_seconds"))


_DAILY = """s as (select node_id, date_trunc('day', time) as day, avg_cpu_temp as cpu_temp, cpu_usage as c, memory_usage as m,
  (io_read_mbps + io_write_mbps) * duration_seconds as mb, duration_seconds, 50 + 1.5E0 * cpu_usage + 20 * memory_usage / 100 as w from job_metrics),
d as (select node_id, day, avg(c) as avg_cpu, avg(m) as avg_memory, avg(w) as avg_power, count(case when cpu_temp > 76.5 then 1 end) as throttling_events,
  avg(least(0.4E0 * least(c / 85, 1) * 100 + 0.3E0 * least(m / 80, 1) * 100 + 0.3E0 * least(200 / w, 1) * 100, 100)) as efficiency_score,
  sum(mb) as disk_total_mb, sum(duration_seconds) as duration_seconds from s group by 1, 2)"""


@query("f43_bottlenecks", f"""with {_DAILY}
select node_id, day, 'cpu' as type, 'high' as severity from d where avg_cpu > 90
union all select node_id, day, 'memory', 'high' from d where avg_memory > 85
union all select node_id, day, 'thermal', 'critical' from d where throttling_events > 0
union all select node_id, day, 'energy_efficiency', 'medium' from d where efficiency_score < 60""")
def _(t):
    return V.bottlenecks(_daily(t), ["node_id", "day"])


def _advice_sql(kind, priority, pct, effort, cond):
    return (f"select node_id, day, '{kind}' as category, '{priority}' as priority, {pct}.0E0 as savings_percent, '{effort}' as effort, "
            f"avg_power * {pct} / 100 * duration_seconds / 3600 as savings_wh, avg_power * {pct} / 100 * 0.12E0 / 1000 as savings_usd from d where {cond}")


@query("f44_optimisation_advice", f"with {_DAILY} " + " union all ".join([
    _advice_sql("cpu", "high", 15, "medium", "avg_cpu > 90"), _advice_sql("memory", "high", 10, "medium", "avg_memory > 80"),
    _advice_sql("energy_efficiency", "medium", 20, "easy", "efficiency_score < 70"),
    _advice_sql("io", "medium", 12, "medium", "disk_total_mb > 1000")]), r6="savings_wh savings_usd")
def _(t):
    return V.optimisations(_daily(t), ["node_id", "day"])


@query("f45_thermal_advice", """
with n as (select node_id, avg(temperature) as a, max(temperature) as p from thermal_events group by 1)
select node_id, 'high_average' as level, 'improve cooling' as advice from n where a > 80
union all select node_id, 'moderate_average', 'watch thermal performance' from n where a > 70 and a <= 80
union all select node_id, 'good_average', 'keep current cooling' from n where a <= 70
union all select node_id, 'critical_peak', 'optimise cooling now' from n where p > 90
union all select node_id, 'high_peak', 'spread the workload' from n where p > 85 and p <= 90""")
def _(t):
    return V.thermal_advice(t.thermal_events.groupBy("node_id").agg(
        F.avg("temperature").alias("avg_temp"), F.max("temperature").alias("max_peak")), ["node_id"])


@query("f46_validation_advice", f"""with {_METRICS}, found as (
select component, 'improve power models or features' as advice from metrics where component = 'energy' and r2 < 0.7
union all select component, 'review workload characterisation' from metrics where component = 'energy' and mape > 20
union all select component, 'improve thermal dynamics' from metrics where component = 'thermal' and r2 < 0.6
union all select component, 'review scheduling and contention' from metrics where component = 'performance' and r2 < 0.8)
select * from found union all select 'all', 'fine-tune for specific uses' where not exists (select 1 from found)""")
def _(t):
    errors = A.regression_errors(_pairs(t), "real", "sim", ["component"])
    return V.validation_advice(errors.withColumn("r2", F.when(F.col("r2") < -10, -1.0).otherwise(F.col("r2"))))


@query("f47_integrated_score", """
select node_id, (1 - abs(least(c, 1) - 0.7E0) + 1 - abs(least(m, 1) - 0.7E0) + greatest(0, 1 - e / 2000)) / 3 as score
from (select node_id, avg(cpu_usage) / 100 as c, avg(memory_usage) / 100 as m, avg(power_consumption_watts) * 5 as e from node_metrics group by 1)""",
       r6="score")
def _(t):
    n = t.node_metrics.groupBy("node_id").agg(
        (F.avg("cpu_usage") / 100).alias("c"), (F.avg("memory_usage") / 100).alias("m"),
        (F.avg("power_consumption_watts") * 5).alias("e"))
    return n.select("node_id", P.integrated_score(["c", "m"], "e").alias("score"))


@query("f48_cluster_advice", """
with d as (select node_id, date_trunc('day', time) as day, avg(cpu_usage) as c, avg(memory_usage) as m, sum(power_consumption_watts) as e from node_metrics group by 1, 2)
select node_id, day, 'performance_optimizations' as advice_group, 'bottleneck' as type from d where c > 90
union all select node_id, day, 'energy_optimizations', 'high_energy_consumption' from d where e > 1000
union all select node_id, day, 'scheduling_recommendations', 'cpu_overutilization' from d where c > 80
union all select node_id, day, 'hardware_recommendations', 'memory_upgrade' from d where m > 85""")
def _(t):
    n = t.node_metrics
    d = n.groupBy("node_id", F.date_trunc("day", "time").cast("timestamp_ntz").alias("day")).agg(
        F.avg("cpu_usage").alias("cpu_percent"), F.avg("memory_usage").alias("memory_percent"),
        F.sum("power_consumption_watts").alias("predicted_energy"))
    d = d.withColumn("high_bottlenecks", F.when(F.col("cpu_percent") > 90, 1).otherwise(0))
    return V.cluster_advice(d, ["node_id", "day"])


@query("f50_used_percent", """
select sample_id, (1 - (128 - memory_usage) / 128) * 100 as memory_used_percent, (200 - cpu_temp) / 200 as disk_used from node_metrics""",
       r6="memory_used_percent disk_used")
def _(t):
    return t.node_metrics.select(
        "sample_id", used_percent(128 - F.col("memory_usage"), F.lit(128.0)).alias("memory_used_percent"),
        (used_percent(F.col("cpu_temp"), F.lit(200.0)) / 100).alias("disk_used"))


def used_percent(free: Column, total: Column) -> Column:
    return (1 - F.try_divide(free, total)) * 100


@query("t6_ranked_recommendations", """
select job_id, priority_score, row_number() over (order by round(priority_score, 9) desc, job_id) as position from (
  select job_id, 1 / (1 + estimated_energy_wh / duration_seconds / 100) as priority_score from job_metrics)
order by 3""", r6="priority_score")
def _(t):
    j = t.job_metrics.select("job_id", P.priority("estimated_energy_wh", "duration_seconds").alias("priority_score"))
    numbered = position_in_order(j, [F.round("priority_score", 9).desc(), "job_id"])
    return numbered.withColumn("position", F.col("position").cast("bigint"))
