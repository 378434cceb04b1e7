"""The series of alert rules, and rules that fire on them."""

from datetime import datetime, timedelta

from wattgrid.operators import alerts as L

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def jobs_of(spark, rows):
    return spark.createDataFrame(rows, "job_id string, time timestamp_ntz, job_state string, avg_power_watts double")


def test_running_jobs_are_told_every_hour(spark):
    jobs = jobs_of(spark, [("a", at(0.5), "RUNNING", 100.0), ("a", at(2.5), "RUNNING", 100.0), ("b", at(3), "RUNNING", 10.0), ("c", at(1), "COMPLETED", 10.0), ("d", at(9), "RUNNING", 1.0)])
    found = {(r.series, r.metric, r.ts): r.value for r in L.running_series(jobs, at(5.2), hours=3).collect()}
    assert {k[2] for k in found if k[0] == "a"} == {at(2), at(3), at(4), at(5)} and {k[2] for k in found if k[0] == "b"} == {at(3), at(4), at(5)}
    assert {k[0] for k in found} == {"a", "b"}
    assert found["a", "job_runtime_seconds", at(4)] == 3.5 * 3600 and found["a", "job_energy_joules", at(4)] == 350 * 3600
    assert found["b", "job_runtime_seconds", at(3)] == 0
    assert L.running_series(jobs, hours=0).filter("series = 'd' and ts = '2024-01-01 09:00:00'").count() == 2
    assert L.running_series(jobs_of(spark, [])).collect() == []


def test_rules_on_jobs_and_exporters_fire(spark):
    jobs = jobs_of(spark, [("long", at(0), "RUNNING", 1.0), ("hungry", at(29), "RUNNING", 400.0), ("short", at(30), "RUNNING", 1.0), ("old", at(0), "COMPLETED", 900.0)])
    polls = spark.createDataFrame([("x", at(k / 60), not 3 <= k <= 6) for k in range(10)] + [("y", at(k / 60), True) for k in range(10)], "target string, time timestamp_ntz, up boolean")
    fired = L.alerts(L.job_and_exporter_series(jobs, polls, as_of=at(32)), L.rule_table(spark))
    assert {(r.rule, r.series) for r in fired.collect()} == {("LongRunningJob", "long"), ("HighEnergyConsumptionJob", "hungry"), ("ExporterDown", "x"), ("MissingJobMetrics", "cluster")}
    down = fired.filter("rule = 'ExporterDown'").first()
    assert (down.since, down.fired_at, down.until) == (at(3 / 60), at(5 / 60), at(6 / 60))


def test_a_gap_ends_a_run(spark):
    rows = [("s", at(h), True) for h in (0, 1, 2, 20, 21, 22, 23)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, holds boolean")
    found = lambda idle: sorted((r.since, r.fired_at) for r in L.sustained(df, ["series"], "ts", "holds", 7200, idle_seconds=idle).collect())
    assert found(None) == [(at(0), at(2))] and found(3600 * 5) == [(at(0), at(2)), (at(20), at(22))]


def test_every_rule_has_a_series_or_is_named(spark, tables):
    from wattgrid.plans.timelines import node_series

    polls = spark.createDataFrame([("x", START, True)], "target string, time timestamp_ntz, up boolean")
    n = tables.node_metrics.select("sample_id", "time", "node_id", "power_consumption_watts")
    made = node_series(tables).select("metric").union(L.derived_series(n, tables.job_runs, tables.job_metrics).select("metric")).union(
        L.job_and_exporter_series(tables.job_metrics, polls).select("metric"))
    missing = {r[1] for r in L.RULES} - {r.metric for r in made.distinct().collect()} - {"scrape_duration_seconds"}  # a stream's, see r8
    assert missing == {"gpu_temperature_celsius", "disk_used_ratio"}


def test_short_series_in_one_row_fire_like_long_ones(spark):
    from pyspark.sql import functions as F

    values = {"a": [2, 2, 0, 2, None, 2, 2, 2], "b": [0, 0], "c": [2], None: [2, 2, 2], "d": [2] * 6}
    rows = [(at(h), s, "m", float(v) if v is not None else None) for s, vs in values.items() for h, v in enumerate(vs)]
    long = spark.createDataFrame(rows, "ts timestamp_ntz, series string, metric string, value double")
    rules = L.rule_table(spark, [("over", "m", ">", 1.0, 3600, "warning", "x"), ("at once", "m", "=", 2.0, 0, "info", "y")])
    whole = long.groupBy("series", "metric").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("whole"))
    mixed = long.filter("series = 'd'").unionByName(whole.filter("not series <=> 'd'"), allowMissingColumns=True)
    told = lambda df: sorted(map(str, L.alerts(df, rules).collect()))
    assert told(mixed) == told(long) and len(told(long)) == 10


def test_running_jobs_are_shuffled_once_a_job(spark):
    jobs = jobs_of(spark, [(f"j{k}", at(0), "RUNNING", 1.0) for k in range(50)])
    polls = spark.createDataFrame([("x", at(0), True)], "target string, time timestamp_ntz, up boolean")
    series = L.job_and_exporter_series(jobs, polls, as_of=at(40))
    assert series.filter("metric = 'job_runtime_seconds'").count() == 50
