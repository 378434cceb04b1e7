"""Summary statistics and validation metrics."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattgrid.functions import power as P
from wattgrid.operators import stats as A
from wattgrid.operators.ordered import with_previous, seconds_between
from wattgrid.operators.rollups import bucket
from wattgrid.plans.registry import query

NUMERIC = ["duration_seconds", "cpu_cores", "memory_mb", "cpu_usage", "memory_usage", "avg_cpu_temp",
           "avg_power_watts", "estimated_energy_wh"]


def _spread_sql(c, prefix, ps):
    extra = "".join(f", quantile_cont({c}, {p}) as {prefix}{n}" for n, p in ps.items())
    return (f"avg({c}) as {prefix}avg, max({c}) as {prefix}max, min({c}) as {prefix}min, "
            f"stddev_samp({c}) as {prefix}std{extra}")


TAIL = {"p95": 0.95, "p99": 0.99}


@query("a12_load_statistics", f"""
select node_id, {_spread_sql('cpu_usage', 'cpu_', TAIL)}, {_spread_sql('memory_usage', 'memory_', TAIL)}
from node_metrics group by node_id""",
       r6="cpu_avg cpu_std cpu_max cpu_min cpu_p95 cpu_p99 memory_avg memory_std memory_p95 memory_p99")
def _(t):
    n = t.node_metrics.select("node_id", "cpu_usage", "memory_usage")
    return A.spreads(n, {"cpu_usage": "cpu_", "memory_usage": "memory_"}, ["node_id"], TAIL)


@query("a13_f10_f17_f18_benchmark_totals", """
with s as (select node_id, time, cpu_temp, memory_usage,
  50 + 1.5E0 * cpu_usage + 20 * memory_usage / 100 as w, cpu_usage as c, memory_usage as m from node_metrics),
x as (select *, least(0.4E0 * least(c / 85, 1) * 100 + 0.3E0 * least(m / 80, 1) * 100 + 0.3E0 * least(200 / w, 1) * 100, 100) as score,
  (c + 100 - m) / w as ppw, w * 0.0005E0 as carbon from s)
select node_id, avg(w) as avg_power, max(w) as max_power, min(w) as min_power, sum(w * 5 / 3600) as total_energy_wh,
  avg(score) as efficiency_score, avg(cpu_temp) as cpu_temp_avg, max(cpu_temp) as cpu_temp_max,
  count(case when cpu_temp > 76.5 then 1 end) as throttling_events, avg(ppw) as performance_per_watt,
  sum(carbon) as carbon_total_g, count(*) / ((epoch_us(max(time)) - epoch_us(min(time))) / 1000000.0E0) as samples_per_second
from x group by node_id""",
       r6="avg_power max_power min_power total_energy_wh efficiency_score cpu_temp_avg cpu_temp_max performance_per_watt "
          "carbon_total_g samples_per_second")
def _(t):
    return benchmark_totals(t)


def benchmark_totals(t):
    n = t.node_metrics.withColumn("w", P.sample_watts("cpu_usage", "memory_usage"))
    return n.groupBy("node_id").agg(
        F.avg("w").alias("avg_power"), F.max("w").alias("max_power"), F.min("w").alias("min_power"),
        F.sum(F.col("w") * 5 / 3600).alias("total_energy_wh"),
        F.avg(P.efficiency_score("cpu_usage", "memory_usage", "w")).alias("efficiency_score"),
        F.avg("cpu_temp").alias("cpu_temp_avg"), F.max("cpu_temp").alias("cpu_temp_max"),
        F.count_if(F.col("cpu_temp") > 76.5).alias("throttling_events"),
        F.avg(P.performance_per_watt("cpu_usage", "memory_usage", "w")).alias("performance_per_watt"),
        F.sum(P.carbon_grams("w")).alias("carbon_total_g"),
        F.try_divide(F.count(F.lit(1)), seconds_between(F.max("time"), F.min("time"))).alias("samples_per_second"))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


@query("a14_energy_describe", f"select {_spread_sql('estimated_energy_wh', '', QUARTILES)} from job_metrics",
       r6="avg std q1 median q3 max min")
def _(t):
    return A.spread(t.job_metrics.select("estimated_energy_wh"), "estimated_energy_wh", (), QUARTILES)


_CORR = " union all ".join(
    f"select '{a}' as i, '{b}' as j, corr({a}, {b}) as r from job_metrics"
    for a, b in product(NUMERIC, NUMERIC) if a != b)


@query("a16_correlation_matrix", _CORR + " union all " + " union all ".join(
    f"select '{c}', '{c}', 1.0E0" for c in NUMERIC), r8="r")
def _(t):
    return A.correlations(t.job_metrics, NUMERIC)


def _rank_sql(target, columns, tail=""):
    cells = " union all ".join(
        f"select '{c}' as feature, coalesce(abs(corr({c}, {target})), 0) as strength from job_metrics" for c in columns)
    return f"""select feature, strength, rank from (select *, row_number() over (order by round(strength, 12) desc, feature) as rank
from ({cells})) {tail}"""


_FEATURES = [c for c in NUMERIC if c != "estimated_energy_wh"]


@query("a17_t7_energy_correlation_ranking", _rank_sql("estimated_energy_wh", _FEATURES, "where rank <= 10"), r6="strength")
def _(t):
    return A.correlation_ranking(t.job_metrics, "estimated_energy_wh", _FEATURES).filter("rank <= 10").withColumn(
        "rank", F.col("rank").cast("bigint"))


_TEMP = [c for c in NUMERIC if c != "avg_cpu_temp"]


@query("a18_temperature_correlations", f"select feature, round(strength, 6) as strength from ({_rank_sql('avg_cpu_temp', _TEMP)}) where rank <= 5")
def _(t):
    out = A.correlation_ranking(t.job_metrics, "avg_cpu_temp", _TEMP).filter("rank <= 5")
    return out.select("feature", F.round("strength", 6).alias("strength"))


@query("a19_data_profile", """
with p as (select time, job_id, node_id, prediction_error_percent as prediction_accuracy, actual_energy_wh
  from (select e.*, j.node_id from energy_predictions e join job_metrics j on e.job_id = j.job_id))
select min(time) as start_time, max(time) as end_time, count(distinct job_id) as total_jobs,
  count(distinct node_id) as total_nodes, count(*) as data_points,
  (count(*) * 5 - count(time) - count(job_id) - count(node_id) - count(prediction_accuracy) - count(actual_energy_wh))
    / (count(*) * 5) * 100 as missing_data_percentage,
  greatest(0, 100 - (count(*) * 5 - count(time) - count(job_id) - count(node_id) - count(prediction_accuracy)
    - count(actual_energy_wh)) / (count(*) * 5) * 100 - (count(*) - count(prediction_accuracy)) / count(*) * 10)
    as data_quality_score from p""", r6="missing_data_percentage data_quality_score")
def _(t):
    e = t.energy_predictions.select("time", "job_id", F.col("prediction_error_percent").alias("prediction_accuracy"),
                                    "actual_energy_wh")
    return A.data_profile(e.join(t.job_metrics.select("job_id", "node_id"), "job_id"))


_ERRORS = """count(*) as samples, avg(abs(y - p)) as mae, avg((y - p) * (y - p)) as mse, sqrt(avg((y - p) * (y - p))) as rmse,
  avg(abs(y - p) / greatest(abs(y), 1e-8)) * 100 as mape, 1 - avg((y - p) * (y - p)) / var_pop(y) as r2,
  corr(y, p) as correlation"""


@query("a22_regression_errors", f"""
select model_version, {_ERRORS} from (select model_version, actual_energy_wh as y, predicted_energy_wh as p
from energy_predictions where actual_energy_wh is not null) group by 1""", r4="mae mse rmse", r6="mape r2 correlation")
def _(t):
    return A.regression_errors(t.energy_predictions, "actual_energy_wh", "predicted_energy_wh", ["model_version"]).drop("variance")


def _pairs(t):
    """Pairs of real and simulated values for the three validated components."""
    p = t.energy_predictions.filter("actual_energy_wh is not null").select(
        F.lit("energy").alias("component"), F.col("actual_energy_wh").alias("real"), F.col("predicted_energy_wh").alias("sim"))
    j = t.job_metrics
    heat = j.select(F.lit("thermal").alias("component"), F.col("avg_cpu_temp").alias("real"),
                    (F.col("peak_cpu_temp") - 7.5).alias("sim"))
    perf = j.select(F.lit("performance").alias("component"), F.col("duration_seconds").cast("double").alias("real"),
                    (F.col("duration_seconds") * (0.8 + F.col("cpu_cores") / 40)).alias("sim"))
    return p.unionByName(heat).unionByName(perf)


_PAIRS = """pairs as (select 'energy' as component, actual_energy_wh as y, predicted_energy_wh as p
  from energy_predictions where actual_energy_wh is not null
  union all select 'thermal', avg_cpu_temp, peak_cpu_temp - 7.5 from job_metrics
  union all select 'performance', duration_seconds::double, duration_seconds * (0.8E0 + cpu_cores / 40) from job_metrics)"""
_KS = """v as (select component, y as x, 1 as a, 0 as b from pairs union all select component, p, 0, 1 from pairs),
c as (select component, x, sum(a) as a, sum(b) as b from v group by 1, 2),
f as (select component, abs(sum(a) over w / sum(a) over t - sum(b) over w / sum(b) over t) as d from c
  window w as (partition by component order by x rows between unbounded preceding and current row), t as (partition by component)),
k as (select component, max(d) as ks_statistic, greatest(0, 1 - max(d)) as distribution_similarity from f group by 1)"""


@query("a24_ks_statistic", f"with {_PAIRS}, {_KS} select * from k", r8="ks_statistic distribution_similarity")
def _(t):
    p = _pairs(t)
    both = p.select("component", F.col("real").alias("v"), F.lit(True).alias("r")).unionByName(
        p.select("component", F.col("sim").alias("v"), F.lit(False).alias("r")))
    return A.ks_statistic(both, "v", F.col("r"), ["component"]).drop("n", "m", "ks_pvalue")


_METRICS = f"""{_PAIRS}, {_KS}, e as (select component, {_ERRORS}, var_pop(y) as v0 from pairs group by 1),
metrics as (select e.component, samples, mae, mse, rmse, mape, case when v0 < 1e-10 then 0 when r2 < -10 then -1 else r2 end as r2,
  coalesce(correlation, 0) as correlation, ks_statistic, distribution_similarity from e join k on e.component = k.component)"""


@query("a23_validation_metrics", f"with {_METRICS} select * from metrics",
       r2="mse", r3="mae rmse", r6="mape r2 correlation ks_statistic distribution_similarity")
def _(t):
    return A.validation_metrics(_pairs(t), "real", "sim", ["component"]).drop("ks_pvalue")


@query("a42_validation_score", f"""with {_METRICS}
select greatest(0, least(1, sum(w * (0.005E0 * q + 0.99E0 * distribution_similarity + 0.005E0 * greatest(0, (correlation + 1) / 2))) / sum(w)))
  as overall_score from (select *, case component when 'thermal' then 0.9E0 when 'energy' then 0.09E0 else 0.01E0 end as w,
  case when r2 >= 0.1 then 1 when r2 >= -1 then 0.95E0 + 0.05E0 * r2 when r2 >= -3 then 0.9E0 + 0.025E0 * (r2 + 3)
    when r2 >= -10 then 0.85E0 + 0.007E0 * (r2 + 10) when r2 >= -20 then 0.8E0 + 0.005E0 * (r2 + 20)
    else greatest(0.75E0, 0.8E0 + 0.0001E0 * r2) end as q from metrics)""", r8="overall_score")
def _(t):
    return A.validation_score(A.validation_metrics(_pairs(t), "real", "sim", ["component"]))


@query("a26_thermal_efficiency", """
select avg(e) as mean_efficiency, stddev_samp(e) as std_efficiency, min(e) as min_efficiency, max(e) as max_efficiency
from (select avg_power_watts / (avg_cpu_temp - 20) as e from job_metrics)""",
       r6="mean_efficiency std_efficiency min_efficiency max_efficiency")
def _(t):
    e = F.try_divide(F.col("avg_power_watts"), F.col("avg_cpu_temp") - 20)
    return t.job_metrics.agg(F.avg(e).alias("mean_efficiency"), F.stddev_samp(e).alias("std_efficiency"),
                             F.min(e).alias("min_efficiency"), F.max(e).alias("max_efficiency"))


RANGES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query("a27_temperature_ranges", f"select {_spread_sql('cpu_temp', '', RANGES)} from node_metrics",
       r6="avg std max min p25 p50 p75 p95")
def _(t):
    return A.spread(t.node_metrics.select("cpu_temp"), "cpu_temp", (), RANGES)


@query("a28_job_outcomes", """
select count(*) as total_jobs_submitted, count(case when job_state = 'COMPLETED' then 1 end) as total_jobs_completed,
  count(case when job_state = 'COMPLETED' then 1 end) / count(*) as completion_rate,
  avg(case when job_state = 'COMPLETED' then duration_seconds end) as average_job_duration,
  avg(case when job_state = 'COMPLETED' then expected end) as average_expected_duration,
  avg(case when job_state = 'COMPLETED' then duration_seconds / expected end) as average_slowdown,
  sum(estimated_energy_wh) as total_energy_consumed, avg(avg_power_watts) as average_power_consumption
from (select *, 60.0E0 * (1 + cpu_cores) as expected from job_metrics)""",
       r6="completion_rate average_job_duration average_expected_duration average_slowdown average_power_consumption",
       r3="total_energy_consumed")
def _(t):
    jobs = t.job_metrics.withColumn("expected", 60.0 * (1 + F.col("cpu_cores")))
    return A.job_outcome_summary(jobs, "duration_seconds", "expected")


@query("a29_cluster_power", """
select minute, sum(w) as total_power_watts, sum(w) / 60 as energy_wh from (
  select date_trunc('minute', time) as minute, node_id, arg_max(power_consumption_watts, (time, sample_id)) as w
  from node_metrics group by 1, 2) group by 1""", r6="total_power_watts energy_wh")
def _(t):
    return A.cluster_power(t.node_metrics)


@query("a30_node_specs", """
select node_id, cast(greatest(4, floor(quantile_cont(cpu_usage, 0.95) / 10)) as int) as cpu_cores,
  cast(greatest(8000, floor(quantile_cont(memory_usage, 0.95))) as int) as memory_mb,
  greatest(200.0E0, max(power_consumption_watts)) as max_power_watts,
  greatest(50.0E0, max(power_consumption_watts) * 0.2E0) as idle_power_watts from node_metrics group by 1""",
       r6="max_power_watts idle_power_watts")
def _(t):
    return A.node_specs(t.node_metrics)


@query("a32_counter_delta", """
select node_id, arg_max(counter_value, (time, sample_id)) - arg_min(counter_value, (time, sample_id)) as delta,
  (arg_max(counter_value, (time, sample_id)) - arg_min(counter_value, (time, sample_id))) / 1048576.0E0 as delta_mb,
  (arg_max(counter_value, (time, sample_id)) - arg_min(counter_value, (time, sample_id))) / 1048576.0E0
    / ((epoch_us(max(time)) - epoch_us(min(time))) / 1000000.0E0) as mb_per_second
from counter_samples group by 1""", r9="delta_mb", r15="mb_per_second")
def _(t):
    return A.counter_delta(t.counter_samples, "counter_value", ["node_id"], ["time", "sample_id"])


@query("a33_pending_jobs", """
with s as (select run_id, case when submit_time <= timestamp '2024-01-15 12:00:00' and start_time > timestamp '2024-01-15 12:00:00' then 1 end as pending
  from job_runs)
select count(pending) as pending_jobs, count(pending) > 50 as queue_buildup from s""")
def _(t):
    r = t.job_runs
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    changes = r.select("run_id", F.explode(F.array(
        F.struct(F.col("submit_time").alias("at"), F.lit(0).alias("step"), F.lit("PENDING").alias("state")),
        F.struct(F.col("start_time").alias("at"), F.lit(1).alias("step"), F.lit("RUNNING").alias("state")))).alias("c"))
    latest = changes.filter(F.col("c.at") <= at).groupBy("run_id").agg(
        F.max_by("c.state", F.struct("c.at", "c.step")).alias("state"))
    pending = F.count_if(F.col("state") == "PENDING")
    return latest.agg(pending.alias("pending_jobs"), (pending > 50).alias("queue_buildup"))


@query("a34_avg_counter_rate_by_node", """
with d as (select node_id, counter_value as v, lag(counter_value) over w as pv,
  (epoch_us(time) - epoch_us(lag(time) over w)) / 1000000.0E0 as dt from counter_samples
  window w as (partition by node_id order by time, sample_id))
select node_id, avg(case when v < pv then v else v - pv end / dt) as avg_rate from d where dt > 0 group by 1""", r6="avg_rate")
def _(t):
    s = with_previous(t.counter_samples, {"pv": "counter_value", "pt": "time"}, ["node_id"], "time", ["sample_id"])
    step = F.when(F.col("counter_value") < F.col("pv"), F.col("counter_value")).otherwise(F.col("counter_value") - F.col("pv"))
    return s.groupBy("node_id").agg(F.avg(F.try_divide(step.cast("double"), seconds_between("time", "pt"))).alias("avg_rate"))


BOUNDS = (600, 1200, 1800, 3600, 5400)


@query("a36_duration_buckets", " union all ".join(
    [f"select queue, job_type, '{b}' as le, count(case when duration_seconds <= {b} then 1 end) as count from job_metrics group by 1, 2"
     for b in BOUNDS] + ["select queue, job_type, '+Inf', count(*) from job_metrics group by 1, 2"]))
def _(t):
    return A.cumulative_buckets(t.job_metrics, "duration_seconds", BOUNDS, ["queue", "job_type"])


@query("a37_jobs_by_state", "select job_state, queue, count(*) as jobs_total from job_metrics group by 1, 2")
def _(t):
    return t.job_metrics.groupBy("job_state", "queue").agg(F.count(F.lit(1)).alias("jobs_total"))


@query("a38_jobs_over_time", """
with d as (select date_trunc('hour', submit_time) as hour, 1 as p, 0 as r, 0 as c from job_runs
  union all select date_trunc('hour', start_time), -1, 1, 0 from job_runs
  union all select date_trunc('hour', end_time), 0, -1, 1 from job_runs),
h as (select hour, sum(p) as p, sum(r) as r, sum(c) as c from d group by 1)
select hour, cast(sum(p) over w as bigint) as pending, cast(sum(r) over w as bigint) as running,
  cast(sum(c) over w as bigint) as completed from h window w as (order by hour)""")
def _(t):
    r = t.job_runs
    step = lambda c, p, q, d: r.select(bucket(r, "hour", c).alias("hour"), F.lit(p).alias("p"), F.lit(q).alias("r"), F.lit(d).alias("c"))
    moves = step("submit_time", 1, 0, 0).unionAll(step("start_time", -1, 1, 0)).unionAll(step("end_time", 0, -1, 1))
    hours = moves.groupBy("hour").agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.sum("c").alias("c"))
    # One row per hour of the whole span, so an unpartitioned running sum is small.
    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return hours.select("hour", F.sum("p").over(w).alias("pending"), F.sum("r").over(w).alias("running"),
                        F.sum("c").over(w).alias("completed"))


def _hist_sql(groups, value, source, bins):
    g = f"{groups}, " if groups else ""
    by = f"partition by {groups}" if groups else ""
    return f"""select {g}bin, min(lo) + bin * ((min(hi) - min(lo)) / {bins}) as bin_start, count(*) as count from (
select *, cast(least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) as int) as bin from (
select {g}{value} as x, min({value}) over ({by}) as lo, max({value}) over ({by}) as hi from {source}))
group by {g}bin"""


@query("a39_error_histogram", _hist_sql("", "prediction_error_percent",
       "(select * from energy_predictions where prediction_error_percent is not null)", 20), r6="bin_start")
def _(t):
    return A.histogram(t.energy_predictions, "prediction_error_percent", 20)


@query("a39_value_histograms", f"""with {_PAIRS}, v as (select component, 'real' as side, y as x from pairs
  union all select component, 'sim', p from pairs) {_hist_sql('component, side', 'x', 'v', 30)}""", r6="bin_start")
def _(t):
    p = _pairs(t)
    long = p.select("component", F.inline(F.array(
        F.struct(F.lit("real").alias("side"), F.col("real").alias("x")),
        F.struct(F.lit("sim").alias("side"), F.col("sim").alias("x")))))
    return A.histogram(long, "x", 30, ["component", "side"])


@query("a40_compare_benchmarks", """
with s as (select node_id, 50 + 1.5E0 * cpu_usage + 20 * memory_usage / 100 as w, cpu_usage as c, memory_usage as m from node_metrics),
b as (select node_id as name, avg(least(0.4E0 * least(c / 85, 1) * 100 + 0.3E0 * least(m / 80, 1) * 100 + 0.3E0 * least(200 / w, 1) * 100, 100)) as e,
  avg((c + 100 - m) / w) as p, sum(w * 5 / 3600) as t from s group by 1)
select count(*) as benchmarks_compared, arg_max(name, e) as best_efficiency, arg_min(name, e) as worst_efficiency,
  arg_max(name, p) as best_performance_per_watt, arg_min(name, t) as lowest_energy, avg(e) as avg_efficiency_score,
  avg(t) as avg_energy_consumption, avg(p) as avg_performance_per_watt from b""",
       r6="avg_efficiency_score avg_energy_consumption avg_performance_per_watt")
def _(t):
    return A.extremes(benchmark_totals(t).select(
        F.col("node_id").alias("name"), "efficiency_score", "performance_per_watt",
        F.col("total_energy_wh").alias("energy_total")))


@query("s23_report_sections", """
select 'jobs' as section, 'rows' as metric, cast(count(*) as varchar) as value from job_metrics
union all select 'jobs', 'users', cast(count(distinct user_id) as varchar) from job_metrics
union all select 'nodes', 'samples', cast(count(*) as varchar) from node_metrics
union all select 'nodes', 'nodes', cast(count(distinct node_id) as varchar) from node_metrics""")
def _(t):
    return A.long_report({
        "jobs": t.job_metrics.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users")),
        "nodes": t.node_metrics.agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("node_id").alias("nodes"))})
