"""Cleaning and preparation queries (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattgrid.functions import features as X
from wattgrid.operators import cleaning as C
from wattgrid.operators import series as W
from wattgrid.operators.scans import sample_exact, union_all
from wattgrid.plans.registry import query
from wattgrid.session import checkpointed

_GAPPY = """gappy as (select sample_id, time, node_id, case when cpu_temp > 60 then null else cpu_temp end as cpu_temp,
  case when memory_usage < 50 then null else memory_usage end as memory_usage,
  case when cpu_usage > 90 then null else node_id end as label from node_metrics)"""


def gappy(t):
    return t.node_metrics.select(
        "sample_id", "time", "node_id", F.when(F.col("cpu_temp") <= 60, F.col("cpu_temp")).alias("cpu_temp"),
        F.when(F.col("memory_usage") >= 50, F.col("memory_usage")).alias("memory_usage"),
        F.when(F.col("cpu_usage") <= 90, F.col("node_id")).alias("label"))


@query("c1_impute_median", f"""with {_GAPPY}
select sample_id, coalesce(cpu_temp, (select median(cpu_temp) from gappy)) as cpu_temp,
  coalesce(memory_usage, (select median(memory_usage) from gappy)) as memory_usage from gappy""", r9="cpu_temp memory_usage")
def _(t):
    return C.impute_median(gappy(t).select("sample_id", "cpu_temp", "memory_usage"), ["cpu_temp", "memory_usage"])


@query("c2_c3_fill_defaults", f"""with {_GAPPY}
select sample_id, coalesce(cpu_temp, 0) as cpu_temp, coalesce(label, 'unknown') as label from gappy""")
def _(t):
    return C.known_category(gappy(t).select("sample_id", "cpu_temp", "label").fillna(0, subset=["cpu_temp"]), ["label"])


_IQR = ["estimated_energy_wh", "avg_power_watts", "duration_seconds"]


def _iqr_sql(source, columns, k="0.3"):
    steps, last = [], source
    for i, c in enumerate(columns):
        steps.append(f"""s{i} as (select * from {last} where {c} between (select quantile_cont({c}, 0.15) - {k} * (quantile_cont({c}, 0.85) - quantile_cont({c}, 0.15)) from {last})
  and (select quantile_cont({c}, 0.85) + {k} * (quantile_cont({c}, 0.85) - quantile_cont({c}, 0.15)) from {last}))""")
        last = f"s{i}"
    return ", ".join(steps), last


_STEPS, _LAST = _iqr_sql("job_metrics", _IQR)
_STEPS3, _LAST3 = _iqr_sql("job_metrics", _IQR, "3.0")


@query("c4_iqr_filter", f"with {_STEPS3} select job_id, estimated_energy_wh, avg_power_watts, duration_seconds from {_LAST3}")
def _(t):
    return C.iqr_filter(t.job_metrics.select("job_id", *_IQR), _IQR)


@query("c4_iqr_filter_tight", f"with {_STEPS} select job_id, estimated_energy_wh, avg_power_watts, duration_seconds from {_LAST}")
def _(t):
    return C.iqr_filter(t.job_metrics.select("job_id", *_IQR), _IQR, reach=0.3)


@query("c4_iqr_filter_one_pass", "select job_id, estimated_energy_wh, avg_power_watts, duration_seconds from job_metrics where " + " and ".join(
    f"{c} between (select quantile_cont({c}, 0.15) - 0.3 * (quantile_cont({c}, 0.85) - quantile_cont({c}, 0.15)) from job_metrics) "
    f"and (select quantile_cont({c}, 0.85) + 0.3 * (quantile_cont({c}, 0.85) - quantile_cont({c}, 0.15)) from job_metrics)" for c in _IQR))
def _(t):
    return C.iqr_filter(t.job_metrics.select("job_id", *_IQR), _IQR, reach=0.3, one_pass=True)


@query("c5_energy_anomalies", """
with f as (select quantile_cont(estimated_energy_wh, 0.75) + 1.5 * (quantile_cont(estimated_energy_wh, 0.75) - quantile_cont(estimated_energy_wh, 0.25)) as threshold from job_metrics)
select count(*) as count, avg(estimated_energy_wh) as avg_value, any_value(threshold) as threshold from job_metrics, f where estimated_energy_wh > threshold""",
       r6="avg_value threshold")
def _(t):
    return C.above_fence(t.job_metrics.select("estimated_energy_wh"), "estimated_energy_wh")


@query("c6_clip_deviations", """
with s as (select avg(estimated_energy_wh) as m, stddev_samp(estimated_energy_wh) as d from job_metrics)
select job_id, least(greatest(estimated_energy_wh, m - 1.5 * d), m + 1.5 * d) as estimated_energy_wh from job_metrics, s""",
       r6="estimated_energy_wh")
def _(t):
    return C.clip_deviations(t.job_metrics.select("job_id", "estimated_energy_wh"), ["estimated_energy_wh"], reach=1.5)


@query("c7_robust_scale", """
with q as (select quantile_cont(cpu_temp, 0.25) as a, median(cpu_temp) as b, quantile_cont(cpu_temp, 0.75) as c from node_metrics)
select sample_id, (cpu_temp - b) / (c - a) as cpu_temp from node_metrics, q""", r9="cpu_temp")
def _(t):
    return C.robust_scale(t.node_metrics.select("sample_id", "cpu_temp"), ["cpu_temp"])


@query("c8_standard_scale", """
select sample_id, (cpu_temp - avg(cpu_temp) over ()) / stddev_pop(cpu_temp) over () as cpu_temp,
  (memory_usage - avg(memory_usage) over ()) / stddev_pop(memory_usage) over () as memory_usage from node_metrics""",
       r6="cpu_temp memory_usage")
def _(t):
    return C.standard_scale(t.node_metrics.select("sample_id", "cpu_temp", "memory_usage"), ["cpu_temp", "memory_usage"])


@query("c9_label_encode", """
select job_id, job_type, queue, dense_rank() over (order by job_type) - 1 as job_type_encoded,
  dense_rank() over (order by queue) - 1 as queue_encoded from job_metrics""")
def _(t):
    return C.label_encode(t.job_metrics.select("job_id", "job_type", "queue"), ["job_type", "queue"])


@query("c10_to_number", """
select run_id, try_cast(case when node_id > 'node_05' then node_id else cast(run_id as varchar) end as double) as value from job_runs""")
def _(t):
    r = t.job_runs.select("run_id", F.when(F.col("node_id") > "node_05", F.col("node_id")).otherwise(F.col("run_id").cast("string")).alias("value"))
    return C.to_number(r, ["value"])


_NUM = ["cpu_usage", "memory_usage", "cpu_temp"]


def _hash(key: str, seed: int) -> str:
    return f"('0x' || substr(md5({key} || '|{seed}'), 1, 13))::bigint"


def _uniform(key: str, seed: int) -> str:
    return f"(({_hash(key, seed)} % (1::bigint << 40)) + 0.5e0) / (1::bigint << 40)::double"


def _normal(key: str, seed: int) -> str:
    return f"sqrt(-2 * ln({_uniform(key, seed * 2)})) * cos(2 * pi() * ({_uniform(key, seed * 2 + 1)}))"


_DRAWN = f"""drawn as (
  select *, row_number() over (order by {_hash('sample_id', 42)}, sample_id) as position, count(*) over () as n from node_metrics)"""
_NOISE = f"""select sample_id, {', '.join(f"greatest(0.0, {c} * (1 + 0.05e0 * {_normal('sample_id', 43 + i)})) as {c}" for i, c in enumerate(_NUM))}
from drawn where position <= floor(n * 0.25e0)"""
_BETWEEN = f"""select a.sample_id, {', '.join(f"({_share}) * a.{c} + (1 - ({_share})) * b.{c} as {c}" for _share in [f"0.2e0 + 0.6e0 * {_uniform('a.sample_id', 49)}"] for c in _NUM)}
from drawn a join drawn b on a.position % 2 = 1 and b.position = a.position + 1 where b.position <= 2 * floor(b.n * 0.125e0)"""


@query("c11_noise_augmentation", f"with {_DRAWN} {_NOISE}", r6=" ".join(_NUM))
def _(t):
    return C.with_noise(t.node_metrics.select("sample_id", *_NUM), _NUM, ["sample_id"])


@query("c12_interpolation_augmentation", f"with {_DRAWN} {_BETWEEN}", r6=" ".join(_NUM))
def _(t):
    return C.interpolated(t.node_metrics.select("sample_id", *_NUM), _NUM, ["sample_id"])


@query("x5_original_and_synthetic", f"""with {_DRAWN}
select sample_id, cpu_usage, memory_usage, cpu_temp, 'measured' as origin from node_metrics
union all select *, 'noise' from ({_NOISE}) union all select *, 'interpolated' from ({_BETWEEN})""", r6=" ".join(_NUM))
def _(t):
    n = t.node_metrics.select("sample_id", *_NUM)
    return union_all(n.withColumn("origin", F.lit("measured")),
                     C.with_noise(n, _NUM, ["sample_id"]).withColumn("origin", F.lit("noise")),
                     C.interpolated(n, _NUM, ["sample_id"]).withColumn("origin", F.lit("interpolated")))


_SHIFTED = [f"""greatest(0.0, {c} + case when avg({c}) over () > 0
  then avg({c}) over () * {0.05 + 0.10 * ((42 * 31 + i * 17) % 100) / 100!r}e0 * {_normal('sample_id', 42 + i)} else 0 end) {'+ 1.5e0' if c == 'cpu_temp' else ''} as {c}"""
            for i, c in enumerate(_NUM)]


@query("c13_synthetic_reference", f"select sample_id, {', '.join(_SHIFTED)} from node_metrics", r6=" ".join(_NUM))
def _(t):
    return C.synthetic_reference(t.node_metrics.select("sample_id", *_NUM), _NUM, ["sample_id"], bias={"cpu_temp": (1.0, 1.5)})


@query("c14_random_sample", f"select job_id from job_metrics order by {_hash('job_id', 42)}, job_id limit 1000")
def _(t):
    return sample_exact(t.job_metrics.select("job_id"), 1000, ["job_id"])


@query("c15_train_test_split", f"select job_id, estimated_energy_wh, case when {_hash('job_id', 42)} % 100 < 80 then 'train' else 'test' end as part from job_metrics")
def _(t):
    train, test = C.hash_split(t.job_metrics.select("job_id", "estimated_energy_wh"), ["job_id"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


_FEATURES = ["duration_seconds", "cpu_cores", "memory_mb", "cpu_usage", "memory_usage", "io_read_mbps"]


@query("c16_f_scores", " union all ".join(
    f"select '{c}' as feature, pow(corr({c}, estimated_energy_wh), 2) / (1 - pow(corr({c}, estimated_energy_wh), 2)) * (count(*) - 2) as f_score from job_metrics"
    for c in _FEATURES), r4="f_score")
def _(t):
    return C.f_scores(t.job_metrics, _FEATURES, "estimated_energy_wh")


@query("c17_feature_selection")
def _(t):
    wanted = [*_FEATURES, "avg_cpu_temp", "avg_power_watts"]
    rows = checkpointed(t.job_metrics.select("job_id", *wanted))  # joined once for all passes
    return rows.select("job_id", *C.varied_features(rows, wanted))


@query("c18_usable_jobs", """
select job_id, job_state, duration_seconds from job_metrics where job_state not in ('FAILED', 'CANCELLED')
  and duration_seconds between 60 and 48 * 3600""")
def _(t):
    return C.usable_jobs(t.job_metrics.select("job_id", "job_state", "duration_seconds"))


@query("c19_drop_incomplete", """
select sample_id, l1, l3 from (select sample_id, lag(cpu_temp, 1) over w as l1, lag(cpu_temp, 3) over w as l3 from node_metrics
  window w as (partition by node_id order by time, sample_id)) where l1 is not null and l3 is not null""")
def _(t):
    n = t.node_metrics.select("sample_id", "time", "node_id", "cpu_temp")
    lagged = W.lag_features(n, ["cpu_temp"], ["node_id"], "time", ["sample_id"], lags=(1, 3)).dropna()
    return lagged.select("sample_id", F.col("cpu_temp_lag_1").alias("l1"), F.col("cpu_temp_lag_3").alias("l3"))


@query("c20_all_features")
def _(t):
    df, _ = all_features(t.node_metrics, "power_consumption_watts", ["cpu_usage", "memory_usage", "cpu_temp"])
    return df


def all_features(df, target, numeric):
    """Calendar, workload, lag, rolling, interaction, row and polynomial features; full rows only."""
    keep = df.columns
    df, _ = X.calendar(df)
    df, _ = X.workload(df)
    df = W.lag_features(df, [target, *numeric], ["node_id"], "time", ["sample_id"])
    df = W.rolling_features(df, [target, *numeric], ["node_id"], "time", ["sample_id"])
    df, _ = X.interactions(df, numeric)
    df, _ = X.row_statistics(df, numeric)
    df, _ = X.polynomials(df, numeric)
    return df.dropna(), [c for c in df.columns if c not in keep]


_CLEAN, _CLEANED = _iqr_sql("filled", ["cpu_temp", "memory_usage"], "3.0")


@query("c21_preprocess", f"""with {_GAPPY}, filled as (select sample_id,
  coalesce(last_value(cpu_temp ignore nulls) over a, first_value(cpu_temp ignore nulls) over b) as cpu_temp,
  coalesce(last_value(memory_usage ignore nulls) over a, first_value(memory_usage ignore nulls) over b) as memory_usage from gappy
window a as (partition by node_id order by time, sample_id rows between unbounded preceding and current row),
  b as (partition by node_id order by time, sample_id rows between current row and unbounded following)), {_CLEAN},
q as (select quantile_cont(cpu_temp, 0.25) as a1, median(cpu_temp) as a2, quantile_cont(cpu_temp, 0.75) as a3,
  quantile_cont(memory_usage, 0.25) as b1, median(memory_usage) as b2, quantile_cont(memory_usage, 0.75) as b3 from {_CLEANED})
select sample_id, (cpu_temp - a2) / (a3 - a1) as cpu_temp, (memory_usage - b2) / (b3 - b1) as memory_usage from {_CLEANED}, q""",
       r9="cpu_temp memory_usage")
def _(t):
    out = C.preprocess(gappy(t).drop("label"), ["node_id"], "time", ["sample_id"], normalise=True,
                       columns=["cpu_temp", "memory_usage"])
    return out.select("sample_id", "cpu_temp", "memory_usage")
