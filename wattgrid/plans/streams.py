"""Streaming queries (R): each drains a bounded file stream into a table and reads it."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattgrid.operators import learning as M
from wattgrid.operators.alerts import rule_table
from wattgrid.plans.models import LABEL, jobs, trained
from wattgrid.plans.registry import query
from wattgrid.sources import logs as G
from wattgrid.streaming import flows as S
from wattgrid.streaming.runs import StreamTables, append_table, latest_table, new_folder, replayed


def _ntz(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k == "timestamp"})


def _streams(t):
    return StreamTables(t.spark, t.sf_dir)


@query("r1_append_samples", "select sample_id, time, node_id, cpu_usage, cpu_temp from node_metrics")
def _(t):
    n = _streams(t).node_metrics.select("sample_id", "time", "node_id", "cpu_usage", "cpu_temp")
    return _ntz(append_table(n, "samples"))


def _load_sql(unit):
    return f"""select date_trunc('{unit}', time) as bucket, node_id, count(*) as samples, avg(cpu_usage) as avg_cpu,
  avg(power_consumption_watts) as avg_power, sum(power_consumption_watts) as total_power, max(cpu_temp) as max_temp
from node_metrics group by 1, 2"""


@query("r2_hourly_load", _load_sql("hour"), r6="avg_cpu avg_power total_power")
def _(t):
    return _ntz(latest_table(S.hourly_load(_streams(t).node_metrics), "hourly", ["bucket", "node_id"]))


@query("r3_daily_load", _load_sql("day"), r6="avg_cpu avg_power total_power")
def _(t):
    return _ntz(latest_table(S.daily_load(_streams(t).node_metrics), "daily", ["bucket", "node_id"]))


@query("r4_sliding_rate", """
with w as (select node_id, memory_usage, unnest(generate_series(0, 5)) as k,
  epoch_us(date_trunc('hour', time)) // 1000000 as h from node_metrics)
select make_timestamp((h + (k + 1) * 3600) * 1000000) as window_end, node_id, count(*) as samples, sum(memory_usage) as increase,
  sum(memory_usage) / 21600 as rate from w group by 1, 2""", r9="rate")
def _(t):
    n = _streams(t).node_metrics.select("time", "node_id", "memory_usage")
    rates = S.sliding_rate(n, "memory_usage", ["node_id"], "6 hours", "1 hour").withColumnRenamed("at", "window_end")
    return _ntz(latest_table(rates, "rates", ["window_end", "node_id"]))


def _final(sql: str, time: str, table: str, seconds: int) -> str:
    """Of the rows of ``sql`` those whose ``when_us`` lies before the watermark that a drained stream ends with."""
    return f"select * exclude (when_us) from ({sql}) where when_us < (select max(epoch_us({time})) // 1000 * 1000 - {seconds * 1000000} from {table})"


def _counter_sql(window: int, step: int, lateness: int) -> str:
    return _final(f"""
with s as (select *, epoch_us(time) as us, lag(counter_value) over (partition by node_id order by time, sample_id) as pv,
    (epoch_us(time) + {step * 1000000 - 1}) // {step * 1000000} as b from counter_samples),
e as (select distinct node_id, b from s),
p as (select e.node_id, e.b, s.us, s.counter_value as v, lag(s.counter_value) over (partition by e.node_id, e.b order by s.us, s.sample_id) as pv
  from e join s on e.node_id = s.node_id and s.b > e.b - {window // step} and s.b <= e.b)
select node_id, b * {step} as at_epoch, count(*) as samples,
  case when max(us) > min(us) then sum(case when pv is null then 0 when v < pv then v else v - pv end) / ((max(us) - min(us)) / 1000000.0E0) end as rate,
  b * {step * 1000000} as when_us
from p group by node_id, b having count(*) > 1""", "time", "counter_samples", lateness)


def _counter_rate(t, window, step, lateness):
    samples = replayed(t.counter_samples.repartition(4, "sample_id"), "counter")
    return append_table(S.counter_rate(samples, "counter_value", ["node_id"], window, step, f"{lateness} seconds"), "counter-rates")


@query("r4_counter_rate", _counter_sql(300, 15, 300), r9="rate")
def _(t):
    return _counter_rate(t, 300, 15, 300)


@query("r4_w7_counter_rate_6h", _counter_sql(6 * 3600, 3600, 3600), r9="rate")
def _(t):
    return _counter_rate(t, 6 * 3600, 3600, 3600)


#: Lateness and idle time of the alert streams, in seconds.
LATE, IDLE = 3600, 86400


def _held_sql(judged: str, time: str, table: str) -> str:
    """Fired alerts over the rows of CTE ``j``, up to the watermark."""
    return _final(f"""
with {judged}
select rule, series, min(ts) as since, min(case when epoch_us(ts) - s0 >= d * 1000000 then ts end) as fired_at,
  epoch_us(min(case when epoch_us(ts) - s0 >= d * 1000000 then ts end)) as when_us from (
  select *, first_value(epoch_us(ts)) over (partition by rule, series, island order by ts) as s0 from (
    select *, sum(case when holds and not idle then 0 else 1 end) over (partition by rule, series order by ts) as island from (
      select *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by rule, series order by ts) > {IDLE * 1000000}, false) as idle from j)) where holds)
group by rule, series, island having max(epoch_us(ts) - s0) >= any_value(d) * 1000000""", time, table, LATE)


@query("r5_held_alerts", _held_sql("""
j as (select 'HighCPUTemperature' as rule, 120 as d, node_id as series, time as ts, cpu_temp > 80 as holds from node_metrics
  union all select 'HighPowerConsumption', 300, node_id, time, power_consumption_watts > 200 from node_metrics
  union all select 'CriticalCPUTemperature', 60, node_id, time, cpu_temp > 90 from node_metrics)""", "time", "node_metrics"))
def _(t):
    n = _streams(t).node_metrics
    cell = lambda m, c: F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"))
    series = n.select(F.col("time").alias("ts"), F.col("node_id").alias("series"), F.inline(F.array(
        cell("cpu_temperature_celsius", "cpu_temp"), cell("cpu_power_watts", "power_consumption_watts"))))
    return _ntz(append_table(S.held_alerts(series, rule_table(t.spark), f"{LATE} seconds", IDLE), "alerts"))


@query("r6_threshold_events", """
select time, node_id, case when cpu_temp > 85 then 'temperature_critical' else 'temperature_warning' end as event_type, 'cpu' as component,
  cpu_temp as temperature, case when cpu_temp > 85 then 85.0E0 else 75.0E0 end as threshold,
  case when cpu_temp > 85 then 'critical' else 'warning' end as severity from node_metrics where cpu_temp > 75""")
def _(t):
    return _ntz(append_table(S.threshold_events(_streams(t).node_metrics), "heat"))


@query("r7_silent_nodes", _final("""
select node_id, time as last_seen, epoch_us(time) + 600 * 1000000 as when_us from (select node_id, time, lead(time) over (partition by node_id order by time) as nxt
  from node_metrics) where nxt is null or epoch_us(nxt) - epoch_us(time) > 600 * 1000000""", "time", "node_metrics", 60))
def _(t):
    return _ntz(append_table(S.silent_series(_streams(t).node_metrics, ["node_id"], 600, "60 seconds"), "silent"))


@query("r8_target_alerts", _held_sql("""
s as (select concat('target_', cast(user_id % 5 as varchar)) as series, ts, case when event_type = 'error' then 0 else 1 end as up, value / 20 as scrape from events),
j as (select 'NodeDown' as rule, 120 as d, series, ts, up = 0 as holds from s
  union all select 'HighScrapeDuration', 300, series, ts, scrape > 10 from s)""", "ts", "events"))
def _(t):
    e = _streams(t).raw("events")
    cell = lambda m, c: F.struct(F.lit(m).alias("metric"), c.alias("value"))
    up = F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)
    series = e.select("ts", F.concat(F.lit("target_"), (F.col("user_id") % 5).cast("string")).alias("series"), F.inline(F.array(
        cell("node_up", up), cell("scrape_duration_seconds", F.col("value") / 20))))
    return _ntz(append_table(S.held_alerts(series, rule_table(t.spark), f"{LATE} seconds", IDLE), "targets"))


@query("r9_upsert_sink", """
select user_id, arg_max(event_type, (ts, event_id)) as job_state, arg_max(value, (ts, event_id)) as value from events group by 1""")
def _(t):
    e = _streams(t).raw("events").select("user_id", "ts", "event_id", F.col("event_type").alias("job_state"), "value")
    return latest_table(e, "upsert", ["user_id"], ["ts", "event_id"]).select("user_id", "job_state", "value")


@query("r10_job_lifecycle", """
with e as (select run_id, end_time from job_runs where run_id % 11 <> 0),
w as (select least((select max(epoch_us(start_time)) from job_runs), (select max(epoch_us(end_time)) from e)) // 1000 * 1000 - 3600000000 as mark),
j as (select s.run_id, s.node_id, s.start_time, e.end_time, epoch_us(s.start_time) as b, epoch_us(e.end_time) as f from job_runs s left join e using (run_id))
select run_id, node_id, start_time, case when f - b <= 300 * 1000000 or f <= mark then end_time end as end_time,
  case when f - b <= 300 * 1000000 or f <= mark then 'ended' else 'unfinished' end as state, case when f - b <= 300 * 1000000 or f <= mark then f - b end as duration_us
from j, w where f - b <= 300 * 1000000 or b + 300 * 1000000 <= mark""")
def _(t):
    starts = _streams(t).job_runs.select("run_id", "node_id", "start_time")
    ends = _streams(t).job_runs.filter("run_id % 11 <> 0").select("run_id", "end_time")  # the others' last message never comes
    parts = append_table(S.job_lifecycle(starts, ends, longest="5 minutes"), "lifecycle")
    return _ntz(S.whole_runs(parts))


def log_lines(events):
    """Energy and error messages of events, as a log collector would see them."""
    energy = F.concat(F.lit("Energy: "), F.format_string("%.2f", "value"), F.lit(" Wh, Job: "), F.col("event_id").cast("string"),
                      F.lit(", Node: node"), (F.col("user_id") % 10).cast("string"))
    failed = F.concat(F.lit("job error on node"), (F.col("user_id") % 10).cast("string"))
    return events.select(F.col("ts").alias("time"), "event_id",
                         F.when(F.col("event_type") == "error", failed).otherwise(energy).alias("message"))


@query("r11_s22_log_files", """
select output, date, hour, route, count(*) as records, count(energy_value) as parsed, sum(energy_value) as energy from (
  select 'all' as output, strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%H') as hour,
    case when event_type = 'error' then 'error' else 'normal' end as route, case when event_type <> 'error' then round(value, 2) end as energy_value from events
  union all select 'errors', strftime(ts, '%Y-%m-%d'), strftime(ts, '%H'), 'error', null from events where event_type = 'error') group by all""", r4="energy")
def _(t):
    stream = G.route_errors(G.energy_messages(G.enrich(log_lines(_streams(t).raw("events")), "energy")))
    files = S.write_hourly_json(S.dated(stream), new_folder(t.spark, "logs"))
    return files.groupBy("output", "date", "hour", "route").agg(
        F.count(F.lit(1)).alias("records"), F.count("energy_value").alias("parsed"), F.sum("energy_value").alias("energy"))


@query("r12_sampled_logs", """
select ts as time, event_id, case when event_type = 'error' then 'job error on node' || (user_id % 10)
  else 'Energy: ' || format('{:.2f}', value) || ' Wh, Job: ' || event_id || ', Node: node' || (user_id % 10) end as message
from events where ('0x' || substr(md5(event_id || '|42'), 1, 13))::bigint % 100 = 0""")
def _(t):
    return _ntz(append_table(G.one_in(log_lines(_streams(t).raw("events")), 100, "event_id"), "sampled"))


@query("r13_record_counters", """
select event_type as tag, concat('host', cast(user_id % 4 as varchar)) as host, count(*) as records_total from events group by 1, 2""")
def _(t):
    e = _streams(t).raw("events").select(F.col("event_type").alias("tag"), F.concat(F.lit("host"), (F.col("user_id") % 4).cast("string")).alias("host"))
    return latest_table(S.record_counters(e, "tag", "host"), "counters", ["tag", "host"])


@query("r14_scored_stream")
def _(t):
    run = trained(t, "linear_regression")
    path = new_folder(t.spark, "model")
    M.save_model(run.pipeline("linear_regression"), path)
    scored = M.load_model(path).transform(jobs(_JobsFromStream(t)))
    return append_table(scored.select("job_id", LABEL, "prediction"), "scored")


class _JobsFromStream(StreamTables):
    """Job rows from a stream of lineitems joined with the orders table."""

    def __init__(self, t):
        super().__init__(t.spark, t.sf_dir)

    def raw(self, name):
        if name != "orders":
            return super().raw(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


@query("r15_unique_polls", "select event_id, ts as time, event_type from events")
def _(t):
    poll = lambda: _streams(t).raw("events").select("event_id", F.col("ts").alias("time"), "event_type")
    return _ntz(append_table(S.unique_polls(poll().unionByName(poll()), ["event_id"]), "polls"))
