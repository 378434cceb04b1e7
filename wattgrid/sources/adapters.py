"""Views that shape the driver's tables into the canonical telemetry tables.

Each view is one SQL text with slots for the few spellings that differ between
Spark and the checking engine.  ``Tables`` serves them as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {
    "S": "string",
    "K": "get_json_object(props, '$.k')",
    "SHIFT": "timestampadd(SECOND, cast((l_orderkey * 7919 + l_linenumber * 613) % 86400 as int), l_shipdate)",
    "DAY": "cast(date_trunc('day', time) as timestamp_ntz)",
    "MINUS": "timestampadd(SECOND, -cast(event_id % 900 as int), ts)",
    "PLUS": "timestampadd(SECOND, cast(60 + user_id * 30 as int), ts)",
    "EPOCH": "unix_seconds(cast(o_orderdate as timestamp))",
}
_DUCK = {
    "S": "varchar",
    "K": "json_extract_string(props, '$.k')",
    "SHIFT": "l_shipdate + to_seconds((l_orderkey * 7919 + l_linenumber * 613) % 86400)",
    "DAY": "date_trunc('day', time)",
    "MINUS": "ts - to_seconds(event_id % 900)",
    "PLUS": "ts + to_seconds(60 + user_id * 30)",
    "EPOCH": "cast(epoch(o_orderdate) as bigint)",
}

# name -> (inputs, text)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "node_metrics": (("events",), """
select event_id as sample_id, ts as time,
  concat('node_', lpad(cast(user_id % 10 as <S>), 2, '0')) as node_id,
  least(value * 1.5, 100.0) as cpu_usage,
  cast(<K> as double) as memory_usage,
  35.0 + least(value, 180.0) / 3.0 as cpu_temp,
  50.0 + least(value * 1.5, 100.0) * 2.0 + cast(<K> as double) * 0.5 as power_consumption_watts
from events"""),
    "job_metrics": (("lineitem", "orders"), """
select <SHIFT> as time,
  concat_ws('-', cast(l_orderkey as <S>), cast(l_linenumber as <S>), cast(l_partkey as <S>),
    cast(l_suppkey as <S>), cast(cast(l_quantity as int) as <S>)) as job_id,
  case l_orderkey % 4 when 0 then 'cpu_intensive' when 1 then 'io_intensive'
    when 2 then 'memory_intensive' else 'mixed' end as job_type,
  concat('node_', lpad(cast(l_suppkey % 10 as <S>), 2, '0')) as node_id,
  o_custkey as user_id, o_orderpriority as queue,
  cast(l_quantity * 120 as int) as duration_seconds,
  cast(1 + l_partkey % 16 as int) as cpu_cores,
  cast(1024 * (1 + l_partkey % 32) as int) as memory_mb,
  l_discount * 1000.0 as cpu_usage, l_tax * 1000.0 as memory_usage,
  cast(l_partkey % 100 as double) as io_read_mbps, cast(l_suppkey % 50 as double) as io_write_mbps,
  40.0 + l_discount * 400.0 as avg_cpu_temp,
  45.0 + l_discount * 400.0 + l_tax * 100.0 as peak_cpu_temp,
  50.0 + l_discount * 2000.0 + l_tax * 500.0 as avg_power_watts,
  (50.0 + l_discount * 2000.0 + l_tax * 500.0) * l_quantity * 120.0 / 3600.0 as estimated_energy_wh,
  case l_returnflag when 'R' then 'FAILED' when 'N' then 'RUNNING' else 'COMPLETED' end as job_state
from lineitem join orders on l_orderkey = o_orderkey"""),
    "thermal_events": (("node_metrics",), """
select time, node_id,
  case when cpu_temp > 85.0 then 'temperature_critical' else 'temperature_warning' end as event_type,
  cpu_temp as temperature,
  case when cpu_temp > 85.0 then 85.0E0 else 75.0E0 end as threshold,
  cast(30 * (1 + sample_id % 10) as int) as duration_seconds,
  case when cpu_temp > 85.0 then 'critical' else 'high' end as severity,
  cast(sample_id % 25 as double) as performance_impact_percent
from node_metrics where cpu_temp > 75.0"""),
    "energy_predictions": (("job_metrics",), """
select time, job_id, job_type,
  case when cpu_cores % 2 = 0 then 'v1' else 'v2' end as model_version,
  case when memory_mb % 2048 = 0 then 'post_job_analysis' else 'api' end as prediction_method,
  estimated_energy_wh * (0.85E0 + 0.03E0 * (duration_seconds % 11)) as predicted_energy_wh,
  case when job_state = 'COMPLETED' then estimated_energy_wh end as actual_energy_wh,
  case when job_state = 'COMPLETED'
    then (0.85E0 + 0.03E0 * (duration_seconds % 11) - 1.0E0) * 100.0E0 end as prediction_error_percent
from job_metrics"""),
    "energy_efficiency": (("job_metrics",), """
select <DAY> as time, node_id,
  sum(estimated_energy_wh) / count(*) as energy_per_job_wh,
  sum(estimated_energy_wh) / sum(duration_seconds * cpu_cores / 3600.0E0) as energy_per_cpu_hour_wh,
  sum(estimated_energy_wh) / sum(duration_seconds * memory_mb / 1024.0E0 / 3600.0E0) as energy_per_gb_hour_wh,
  count(*) as jobs_completed,
  sum(duration_seconds * cpu_cores / 3600.0E0) as total_cpu_hours,
  avg(cpu_usage / avg_cpu_temp) as avg_thermal_efficiency
from job_metrics where job_state = 'COMPLETED' group by 1, 2"""),
    "swf_lines": (("orders",), """
select concat_ws(' ', cast(o_orderkey as <S>), cast(<EPOCH> as <S>), cast(o_custkey % 3600 as <S>),
  cast((o_orderkey * 37) % 86400 as <S>), cast(1 + o_custkey % 64 as <S>), '-1',
  cast(1024 * (1 + o_orderkey % 32) as <S>), '1', '3600', '1024', '1', cast(o_custkey as <S>),
  '1', '1', '1', '-1', '-1', '0') as line
from orders"""),
    "counter_samples": (("node_metrics",), """
select sample_id, time, node_id,
  cast(sum(cast(memory_usage as bigint)) over (partition by node_id order by time, sample_id
    rows between unbounded preceding and current row) % 5000 as bigint) as counter_value
from node_metrics"""),
    "job_runs": (("events",), """
select event_id as run_id,
  concat('node_', lpad(cast(user_id % 10 as <S>), 2, '0')) as node_id,
  <MINUS> as submit_time, ts as start_time, <PLUS> as end_time
from events where event_type = 'purchase'"""),
}

VIEW_NAMES = tuple(_VIEWS)


def _fill(text: str, spelling: dict[str, str]) -> str:
    for slot, value in spelling.items():
        text = text.replace(f"<{slot}>", value)
    return text.strip()


def duckdb_view(name: str) -> str:
    """The view's text in the checking engine's spelling."""
    return _fill(_VIEWS[name][1], _DUCK)


class Tables:
    """Lazy access to the driver's tables and the canonical views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name == "counter_samples":
            return self._counter_samples()
        if name not in _VIEWS:
            return self.raw(name)
        inputs, text = _VIEWS[name]
        frames = {i: getattr(self, i) for i in inputs}
        for i in inputs:
            text = text.replace(f"from {i}", f"from {{{i}}}").replace(f"join {i}", f"join {{{i}}}")
        return self.spark.sql(_fill(text, _SPARK), **frames)

    def _counter_samples(self) -> DataFrame:
        from pyspark.sql import functions as F

        from wattgrid.operators.ordered import running_sum

        samples = self.node_metrics.select(
            "sample_id", "time", "node_id", F.col("memory_usage").cast("bigint").alias("step")
        )
        summed = running_sum(samples, "step", "total", ["node_id"], "time", ["sample_id"])
        return summed.select(
            "sample_id", "time", "node_id", (F.col("total") % 5000).cast("bigint").alias("counter_value")
        )
