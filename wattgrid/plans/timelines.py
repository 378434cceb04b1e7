"""Ordered-series queries (W) and alert rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattgrid.operators import alerts as L
from wattgrid.operators import series as W
from wattgrid.operators.ordered import fill_gaps, running_sum, seconds_between
from wattgrid.plans.registry import query

BY_NODE = dict(keys=["node_id"], order="time", ties=["sample_id"])
AT_NODE = dict(keys=["node_id"], time="time", ties=["sample_id"])
W_NODE = "window w as (partition by node_id order by time, sample_id)"


@query("w2_lag_features", "select sample_id, node_id, " + ", ".join(
    f"lag({c}, {n}) over w as {c}_lag_{n}" for c in ("cpu_usage", "cpu_temp") for n in W.LAGS) + f" from node_metrics {W_NODE}")
def _(t):
    n = t.node_metrics.select("sample_id", "time", "node_id", "cpu_usage", "cpu_temp")
    return W.lag_features(n, ["cpu_usage", "cpu_temp"], **BY_NODE).drop("time", "cpu_usage", "cpu_temp")


def _rolling_sql(c, n):
    f = f"over (partition by node_id order by time, sample_id rows between {n - 1} preceding and current row)"
    full = f"count({c}) {f} = {n}"
    cells = [f"case when {full} then {e} {f} end as {c}_rolling_{s}_{n}" for s, e in (
        ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})"), ("max", f"max({c})"),
        ("median", f"quantile_cont({c}, 0.5)"))]
    return ", ".join([*cells, f"{c} / (case when {full} then avg({c}) {f} end) as {c}_ratio_to_rolling_mean_{n}"])


@query("w3_w4_w5_rolling_features", "select sample_id, node_id, " + ", ".join(
    _rolling_sql("cpu_temp", n) for n in W.WINDOWS) + " from node_metrics",
       r6=" ".join(f"cpu_temp_rolling_{s}_{n}" for s in ("mean", "std", "min", "max", "median") for n in W.WINDOWS)
          + " " + " ".join(f"cpu_temp_ratio_to_rolling_mean_{n}" for n in W.WINDOWS))
def _(t):
    n = t.node_metrics.select("sample_id", "time", "node_id", "cpu_temp")
    return W.rolling_features(n, ["cpu_temp"], **BY_NODE).drop("time", "cpu_temp")


@query("w6_fill_gaps", f"""
with g as (select sample_id, time, node_id, case when cpu_temp > 60 then null else cpu_temp end as cpu_temp,
  case when memory_usage < 50 then null else memory_usage end as memory_usage from node_metrics)
select sample_id, node_id, coalesce(last_value(cpu_temp ignore nulls) over a, first_value(cpu_temp ignore nulls) over b) as cpu_temp,
  coalesce(last_value(memory_usage ignore nulls) over a, first_value(memory_usage ignore nulls) over b) as memory_usage from g
window a as (partition by node_id order by time, sample_id rows between unbounded preceding and current row),
  b as (partition by node_id order by time, sample_id rows between current row and unbounded following)""")
def _(t):
    gaps = t.node_metrics.select(
        "sample_id", "time", "node_id", F.when(F.col("cpu_temp") <= 60, F.col("cpu_temp")).alias("cpu_temp"),
        F.when(F.col("memory_usage") >= 50, F.col("memory_usage")).alias("memory_usage"))
    return fill_gaps(gaps, ["cpu_temp", "memory_usage"], **BY_NODE).drop("time")


def _rate_sql(scale):
    return f"""
with s as (select node_id, sample_id, time, counter_value as v, epoch_us(time) as us, cast(ceil(epoch_us(time) / 3600000000) as bigint) as b from counter_samples),
e as (select distinct node_id, b from s),
p as (select e.node_id, e.b, s.us, s.v, lag(s.v) over (partition by e.node_id, e.b order by s.time, s.sample_id) as pv
  from e join s on e.node_id = s.node_id and s.us > (e.b - 6) * 3600000000 and s.us <= e.b * 3600000000)
select node_id, b * 3600 as at_epoch, count(*) as samples,
  sum(case when pv is null then 0 when v < pv then v else v - pv end) / ((max(us) - min(us)) / 1000000.0E0) * {scale} as rate
from p group by node_id, b having count(*) > 1"""


@query("w7_counter_rate", _rate_sql(1), r9="rate")
def _(t):
    return W.rate(t.counter_samples, "counter_value", **AT_NODE, window_seconds=6 * 3600, step_seconds=3600)


@query("f49_scaled_rate", _rate_sql(300), r6="rate")
def _(t):
    out = W.rate(t.counter_samples, "counter_value", **AT_NODE, window_seconds=6 * 3600, step_seconds=3600)
    return out.withColumn("rate", F.col("rate") * 300)


@query("w8_instant_rate", f"""
with d as (select sample_id, node_id, counter_value as v, lag(counter_value) over w as pv,
  (epoch_us(time) - lag(epoch_us(time)) over w) / 1000000.0E0 as dt from counter_samples {W_NODE})
select sample_id, node_id, case when dt < 3600 then case when v < pv then v else v - pv end / dt end as irate from d""", r9="irate")
def _(t):
    return W.instant_rate(t.counter_samples, "counter_value", **AT_NODE, window_seconds=3600).select("sample_id", "node_id", "irate")


@query("w9_busy_percent", f"""
with c as (select sample_id, node_id, time, sum(100) over w as total, sum(100 - cast(memory_usage as bigint)) over w as idle from node_metrics {W_NODE}),
d as (select sample_id, node_id, total - lag(total) over w as t, idle - lag(idle) over w as i from c {W_NODE})
select sample_id, node_id, (t - i) * 100.0E0 / t as usage_percent from d""")
def _(t):
    n = t.node_metrics.select("sample_id", "time", "node_id", F.lit(100).alias("a"),
                              (100 - F.col("memory_usage").cast("bigint")).alias("b"))
    n = running_sum(n, "a", "total", ["node_id"], "time", ["sample_id"])
    n = running_sum(n, "b", "idle", ["node_id"], "time", ["sample_id"])
    return W.busy_percent(n, "total", "idle", **AT_NODE).select("sample_id", "node_id", "usage_percent")


@query("w10_sector_rate", f"""
with d as (select sample_id, node_id, counter_value as v, lag(counter_value) over w as pv,
  (epoch_us(time) - lag(epoch_us(time)) over w) / 1000000.0E0 as dt from counter_samples {W_NODE})
select sample_id, node_id, case when v < pv then v else v - pv end * 512 / 1048576.0E0 / dt as mbps from d""", r12="mbps")
def _(t):
    return W.byte_rate(t.counter_samples, "counter_value", **AT_NODE, unit_bytes=512).select("sample_id", "node_id", "mbps")


def node_series(t):
    """Hourly series of the metrics the node rules test: (ts, metric, series, value)."""
    n = t.node_metrics
    hourly = n.groupBy("node_id", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("ts")).agg(
        F.round(F.avg("cpu_temp"), 6).alias("heat"), F.round(F.avg("cpu_usage"), 6).alias("cpu"),
        F.round(F.avg("memory_usage") / 100, 6).alias("memory"), F.round(F.avg("power_consumption_watts"), 6).alias("power"),
        F.max(F.when(F.col("cpu_temp") > 76.5, 1.0).otherwise(0.0)).alias("throttled"))
    cell = lambda metric, c: F.struct(F.lit(metric).alias("metric"), F.col(c).alias("value"))
    return hourly.select("ts", F.col("node_id").alias("series"), F.inline(F.array(
        cell("cpu_temperature_celsius", "heat"), cell("thermal_throttling_active", "throttled"),
        cell("cpu_usage_percent", "cpu"), cell("memory_used_ratio", "memory"), cell("cpu_power_watts", "power"))))


_RULE_ROWS = ", ".join(f"('{r}', '{m}', '{op}', {x}E0, {d}, '{s}', '{c}')" for r, m, op, x, d, s, c in L.RULES)


def _alert_sql(series: str) -> str:
    """Fired alerts over the rows of CTE ``m`` that the text ``series`` defines."""
    return f"""
with rules(rule, metric, comparison, threshold, hold_seconds, severity, component) as (values {_RULE_ROWS}), {series},
j as (select rule, series, ts, hold_seconds, severity, component,
  coalesce(case when comparison = '>' then value > threshold else value = threshold end, false) as holds from m join rules using (metric)),
g as (select *, sum(case when holds then 0 else 1 end) over (partition by rule, series order by ts) as island from j),
s as (select *, min(ts) over (partition by rule, series, island) as since from g where holds)
select rule, series, since, max(ts) as until, count(*) as samples,
  min(case when epoch_us(ts) - epoch_us(since) >= hold_seconds * 1000000 then ts end) as fired_at, severity, component
from s group by rule, series, island, since, severity, component
having max(epoch_us(ts) - epoch_us(since) - hold_seconds * 1000000) >= 0"""


@query("w11_alerts", _alert_sql("""
h as (select node_id as series, date_trunc('hour', time) as ts, round(avg(cpu_temp), 6) as heat, round(avg(cpu_usage), 6) as cpu,
  round(avg(memory_usage) / 100, 6) as memory, round(avg(power_consumption_watts), 6) as power,
  max(case when cpu_temp > 76.5 then 1.0E0 else 0 end) as throttled from node_metrics group by 1, 2),
m as (select ts, series, 'cpu_temperature_celsius' as metric, heat as value from h union all select ts, series, 'thermal_throttling_active', throttled from h
  union all select ts, series, 'cpu_usage_percent', cpu from h union all select ts, series, 'memory_used_ratio', memory from h
  union all select ts, series, 'cpu_power_watts', power from h)"""))
def _(t):
    return L.alerts(node_series(t), L.rule_table(t.spark))


@query("w11_derived_alerts", _alert_sql("""
ask as (select sample_id, node_id, time, time - interval 5 minute as asked, power_consumption_watts as p from node_metrics),
pc as (select a.time as ts, a.node_id as series, 'power_change_5m_watts' as metric,
  a.p - case when a.asked - n.time < interval 300 second then n.power_consumption_watts end as value
  from ask a asof left join node_metrics n on a.node_id = n.node_id and a.asked >= n.time),
sh as (select distinct node_id, date_trunc('hour', time) as h from node_metrics),
grid as (select node_id, unnest(generate_series(lo, hi, interval 1 hour)) as h from (select node_id, min(h) as lo, max(h) as hi from sh group by 1)),
allgrid as (select unnest(generate_series(lo, hi, interval 1 hour)) as h from (select min(h) as lo, max(h) as hi from sh)),
mv as (select run_id, submit_time as moment, 1 as step from job_runs union all select run_id, start_time, -1 from job_runs),
lv as (select moment, arg_max(level, (step, run_id)) as level from (select *, sum(step) over (order by moment, step, run_id
  rows between unbounded preceding and current row) as level from mv) group by 1),
m as (select * from pc
  union all select g.h, g.node_id, 'node_up', case when s.h is null then 0 else 1 end from grid g left join sh s on g.node_id = s.node_id and g.h = s.h
  union all select g.h, 'cluster', 'thermal_metrics_absent', case when s.h is null then 1 else 0 end from allgrid g left join (select distinct h from sh) s on g.h = s.h
  union all select moment, 'cluster', 'pending_jobs', level from lv
  union all select date_trunc('hour', time), queue, 'job_failure_rate', count(case when job_state = 'FAILED' then 1 end) / count(*) from job_metrics group by 1, 2)"""))
def _(t):
    n = t.node_metrics.select("sample_id", "time", "node_id", "power_consumption_watts")
    return L.alerts(L.derived_series(n, t.job_runs, t.job_metrics), L.rule_table(t.spark))


@query("w11_job_and_exporter_alerts", _alert_sql("""
edge as (select date_trunc('hour', max(time)) as hi from job_metrics),
grid as (select unnest(generate_series(hi - interval 24 hour, hi, interval 1 hour)) as moment from edge),
pt as (select job_id, moment, max((epoch_us(moment) - epoch_us(time)) / 1000000.0E0) as secs, max(avg_power_watts * ((epoch_us(moment) - epoch_us(time)) / 1000000.0E0)) as joules
  from (select * from job_metrics where job_state = 'RUNNING') join grid on moment >= time group by 1, 2),
sh as (select distinct date_trunc('hour', time) as h from job_metrics),
hours as (select unnest(generate_series(lo, hi, interval 1 hour)) as h from (select min(h) as lo, max(h) as hi from sh)),
m as (select moment as ts, job_id as series, 'job_runtime_seconds' as metric, secs as value from pt
  union all select moment, job_id, 'job_energy_joules', joules from pt
  union all select g.h, 'cluster', 'job_metrics_absent', case when s.h is null then 1 else 0 end from hours g left join sh s on g.h = s.h
  union all select ts, 'target_' || (user_id % 5), 'exporter_up', case when event_type = 'error' then 0 else 1 end from events)"""))
def _(t):
    polls = t.events.select(F.concat(F.lit("target_"), (F.col("user_id") % 5).cast("string")).alias("target"), F.col("ts").alias("time"), (F.col("event_type") != "error").alias("up"))
    return L.alerts(L.job_and_exporter_series(t.job_metrics, polls), L.rule_table(t.spark))


@query("w13_queue_length", """
with e as (select run_id, submit_time as moment, 1 as step from job_runs union all select run_id, start_time, -1 from job_runs)
select run_id, moment as start_time, cast(level as bigint) as queue_length from (
  select *, sum(step) over (order by moment, step, run_id rows between unbounded preceding and current row) as level from e) where step = -1""")
def _(t):
    return W.queue_lengths(t.job_runs)


@query("w14_concurrent_runs", """
with e as (select node_id, run_id, start_time as moment, 1 as step from job_runs union all select node_id, run_id, end_time, -1 from job_runs)
select node_id, run_id, moment, step, cast(sum(step) over (partition by node_id order by moment, step, run_id
  rows between unbounded preceding and current row) as bigint) as running from e""")
def _(t):
    return W.concurrent_runs(t.job_runs).withColumnRenamed("at", "moment")


@query("w15_queue_wait", """
select run_id, (epoch_us(start_time) - epoch_us(submit_time)) / 1000000.0E0 as queue_seconds from job_runs""")
def _(t):
    return t.job_runs.select("run_id", seconds_between("start_time", "submit_time").alias("queue_seconds"))


@query("w16_energy_integral", f"""
with d as (select node_id, power_consumption_watts as p, lead(epoch_us(time)) over w - epoch_us(time) as us from node_metrics {W_NODE})
select node_id, sum(p * us / 1000000.0E0 / 3600) as energy_wh, sum(p * 5 / 3600) as fixed_step_wh from d group by 1""",
       r6="energy_wh fixed_step_wh")
def _(t):
    return W.energy_integral(t.node_metrics, "power_consumption_watts", **AT_NODE)


@query("w17_thermal_filter", """
with recursive o as (select sample_id, node_id, power_consumption_watts as p,
  row_number() over (partition by node_id order by time, sample_id) as i from node_metrics),
f as (select sample_id, node_id, i, greatest(22.0E0, 25.0E0 + (0.8E0 * p - 3.0E0 * 50) / 1000 * 10) as temp from o where i = 1
  union all select o.sample_id, o.node_id, o.i, greatest(22.0E0, f.temp + (0.8E0 * o.p - (f.temp - 22) * 50) / 1000 * 10)
  from f join o on o.node_id = f.node_id and o.i = f.i + 1)
select sample_id, node_id, temp as model_temp, temp > 0.9E0 * 85 as is_throttling from f""", r11="model_temp")
def _(t):
    n = t.node_metrics.select("sample_id", "time", "node_id", "power_consumption_watts")
    out = W.thermal_filter(n, "power_consumption_watts", ["node_id"], "time", ["sample_id"], dt=10.0)
    return out.select("sample_id", "node_id", "model_temp", "is_throttling")


@query("w18_last_samples", """
select sample_id, node_id, 'all' as scope from (select * from node_metrics order by time desc, sample_id desc limit 100)
union all select sample_id, node_id, 'node' from (select *, row_number() over (partition by node_id order by time desc, sample_id desc) as rn
  from node_metrics) where rn <= 100""")
def _(t):
    n = t.node_metrics.select("sample_id", "time", "node_id")
    order = [F.desc("time"), F.desc("sample_id")]
    pick = lambda keys, name: W.last_samples(n, 100, keys, order).select("sample_id", "node_id", F.lit(name).alias("scope"))
    return pick([], "all").unionAll(pick(["node_id"], "node"))


@query("w19_chronological_split", """
select job_id, row_number() over (order by time, job_id) as position,
  row_number() over (order by time, job_id) <= cast(floor((select count(*) from job_metrics) * 0.7E0) as bigint) as is_train from job_metrics""")
def _(t):
    out = W.chronological_split(t.job_metrics.select("job_id", "time"), ["time", "job_id"], 0.3)
    return out.select("job_id", "position", "is_train")


@query("w20_energy_shares", """
with s as (select job_type, sum(estimated_energy_wh) as total from job_metrics group by 1)
select job_type, total, total / sum(total) over () as share, sum(total) over (order by total desc, job_type) / sum(total) over () as running_share from s""",
       r3="total", r9="share running_share")
def _(t):
    return W.category_shares(t.job_metrics, "job_type", "estimated_energy_wh")
