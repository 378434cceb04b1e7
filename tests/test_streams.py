"""Streams over several files, so state and watermarks pass from batch to batch."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattgrid.operators.alerts import evaluate_rules, rule_table, sustained
from wattgrid.operators.series import rate
from wattgrid.streaming import event_order as E
from wattgrid.streaming import flows as S
from wattgrid.streaming import runs as R

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    """Four files in time order: (static frame, folder)."""
    folder = tmp_path_factory.mktemp("samples")
    draw = random.Random(3)
    rows, at = [], START
    for i in range(240):
        at += timedelta(seconds=draw.choice([20, 40, 70, 900]))
        node = "a" if i % 3 else "b"
        rows.append((i, at, node, draw.choice([70.0, 85.0, 95.0]), float(i * 10 % 700)))
    schema = "sample_id int, time timestamp, node_id string, cpu_temp double, counter double"
    for part in range(4):
        df = spark.createDataFrame(rows[part * 60:(part + 1) * 60], schema)
        df.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.read.parquet(str(folder)), str(folder), schema


def stream(spark, samples):
    return spark.readStream.schema(samples[2]).option("maxFilesPerTrigger", 1).parquet(samples[1])


def rows(df):
    return sorted(map(tuple, df.collect()))


def ordered_stream(spark, samples):
    """Files sorted by their first time: file streams read them by modification time."""
    return stream(spark, samples)


@pytest.fixture(scope="module")
def mixed_up(spark, samples, tmp_path_factory):
    """The same rows in six files, each with rows up to two hours older than those of the file before."""
    folder = tmp_path_factory.mktemp("mixed")
    draw = random.Random(4)
    data = sorted(samples[0].collect(), key=lambda r: r.time.timestamp() + draw.uniform(0, 7200))
    for part in range(6):
        spark.createDataFrame(data[part * 40:(part + 1) * 40], samples[2]).coalesce(1).write.mode("append").parquet(str(folder))
    times = [r.time for r in data]
    assert times != sorted(times)
    return samples[0], str(folder), samples[2]


def before_watermark(samples, seconds):
    return max(r.time for r in samples[0].collect()) - timedelta(seconds=seconds)


@pytest.mark.parametrize("idle", [600, 86400])
def test_held_alerts_match_batch_in_any_order(spark, mixed_up, idle):
    pick = lambda df: df.select(F.col("time").alias("ts"), F.col("node_id").alias("series"), F.lit("cpu_temperature_celsius").alias("metric"), F.col("cpu_temp").alias("value"))
    rules = rule_table(spark)
    got = R.append_table(S.held_alerts(pick(stream(spark, mixed_up)), rules, "2 hours", idle), "alerts")
    judged = evaluate_rules(pick(mixed_up[0]), rules)
    want = sustained(judged, ["rule", "series"], "ts", "holds", F.col("hold_seconds"), idle_seconds=idle).filter(F.col("fired_at") < before_watermark(mixed_up, 7200))
    assert rows(got.select("rule", "series", "since", "fired_at")) == rows(want.select("rule", "series", "since", "fired_at"))
    assert got.count() > 5


@pytest.mark.parametrize("window,step", [(300, 15), (7200, 600)])
def test_counter_rate_matches_batch_in_any_order(spark, mixed_up, window, step):
    got = R.append_table(S.counter_rate(stream(spark, mixed_up), "counter", ["node_id"], window, step, "2 hours"), "rates")
    want = rate(mixed_up[0], "counter", ["node_id"], "time", window_seconds=window, step_seconds=step).filter(F.col("at_epoch") < before_watermark(mixed_up, 7200).timestamp())
    assert got.count() > 20
    for g, w in zip(rows(got), rows(want), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3])


def test_silences_are_told_once_in_any_order(spark, mixed_up):
    got = R.append_table(S.silent_series(stream(spark, mixed_up), ["node_id"], 600, "2 hours"), "silent")
    data = sorted(mixed_up[0].collect(), key=lambda r: r.time)
    mark = before_watermark(mixed_up, 7200)
    want = []
    for node in "ab":
        times = [r.time for r in data if r.node_id == node]
        want += [(node, a) for a, b in zip(times, [*times[1:], datetime.max]) if b - a > timedelta(seconds=600) and a + timedelta(seconds=600) < mark]
    assert rows(got) == sorted(want) and want


def test_idle_state_is_dropped(spark, mixed_up):
    """Held alerts keep state only for open runs, silences only for series that are not known to be silent."""
    us = np.array([0, 10, 20, 100, 110]) * 1_000_000
    begun, met, since, fired = E.held_runs(us, np.array([True, True, True, True, False]), 15_000_000, 30_000_000, None, False, None)
    assert begun.tolist() == [0] and met.tolist() == [20_000_000] and since is None and not fired
    assert [x.tolist() if hasattr(x, "tolist") else x for x in E.silences(us, 50_000_000, 0, None, False)] == [[20_000_000], 110_000_000, False]
    assert E.silences(np.zeros(0, np.int64), 50_000_000, 161_000_000, 110_000_000, False)[0].tolist() == [110_000_000]
    _, _, since, fired = E.held_runs(us[:3], np.array([True] * 3), 15_000_000, 30_000_000, None, False, None)
    assert (since, fired) == (0, True)
    assert E.held_runs(us[:1] + 25_000_000, np.array([True]), 15_000_000, 30_000_000, since, fired, 20_000_000)[0].tolist() == []


def test_long_and_unfinished_jobs_are_told(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    starts = [(k, "a", at(10 * k)) for k in range(12)]
    ends = [(0, at(3)), (1, at(95)), (3, at(32)), (11, at(112))]  # 1 runs long, 3 in time, the rest never end
    for name, data, schema in (("starts", starts, "run_id int, node_id string, start_time timestamp"), ("ends", ends, "run_id int, end_time timestamp")):
        for k in range(0, len(data), 4):
            spark.createDataFrame(data[k:k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    parts = R.append_table(S.job_lifecycle(read("starts", "run_id int, node_id string, start_time timestamp"), read("ends", "run_id int, end_time timestamp"), longest="5 minutes", lateness="10 minutes"), "jobs")
    found = {r.run_id: (r.state, None if r.duration_us is None else r.duration_us / 60e6) for r in S.whole_runs(parts).collect()}
    assert found[0] == ("ended", 3) and found[1] == ("ended", 85) and found[3] == ("ended", 2) and found[11] == ("ended", 2)
    assert {k for k, v in found.items() if v[0] == "unfinished"} == {2, 4, 5, 6, 7, 8, 9}  # 10 may still end in time


def test_rollup_append_gives_closed_windows(spark, samples):
    named = lambda df: df.withColumns({"cpu_usage": F.col("cpu_temp"), "power_consumption_watts": F.col("counter")})
    closed = R.append_table(S.hourly_load(named(ordered_stream(spark, samples)), "10 minutes"), "closed")
    all_hours = R.latest_table(S.hourly_load(named(ordered_stream(spark, samples)), "10 minutes"), "all", ["bucket", "node_id"])
    batch = named(samples[0]).groupBy(F.date_trunc("hour", "time").alias("bucket"), "node_id").agg(F.count(F.lit(1)).alias("n"))
    want = {(r.bucket, r.node_id): r.n for r in batch.collect()}
    assert {(r.bucket, r.node_id): r.samples for r in all_hours.collect()} == want
    got = {(r.bucket, r.node_id): r.samples for r in closed.collect()}
    assert got and set(got) < set(want) and all(want[k] == n for k, n in got.items())


def test_upsert_keeps_last_change_and_restarts(spark, samples, tmp_path):
    folder = str(tmp_path / "changes")
    for _ in range(2):
        R.finish(R.write_changes(ordered_stream(spark, samples).select("node_id", "time", "counter"), folder, "append"))
    schema = samples[0].select("node_id", "time", "counter").schema
    got = {r.node_id: r.counter for r in R.read_changes(spark, folder, schema, ["node_id"], ["time"]).collect()}
    want = {r.node_id: r.c for r in samples[0].groupBy("node_id").agg(F.max_by("counter", "time").alias("c")).collect()}
    assert got == want
    R.compact_changes(spark, folder, str(tmp_path / "plain"), schema, ["node_id"], ["time"])
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 2


def test_polls_are_deduplicated(spark, samples):
    twice = ordered_stream(spark, samples).unionByName(ordered_stream(spark, samples))
    got = R.append_table(S.unique_polls(twice, ["sample_id"]), "polls")
    assert got.count() == 240 and got.select("sample_id").distinct().count() == 240


def test_sliding_rate_counts_each_window(spark, samples):
    df = R.latest_table(S.sliding_rate(ordered_stream(spark, samples), "counter", ["node_id"], "2 minutes", "1 minute"), "rate", ["at", "node_id"])
    data = samples[0].collect()
    for r in df.collect()[:40]:
        inside = [x.counter for x in data if x.node_id == r.node_id and r["at"] - timedelta(minutes=2) <= x.time < r["at"]]
        assert r.samples == len(inside) and r.rate == pytest.approx(sum(inside) / 120)


def test_a_series_of_flags_is_held_as_one_number_a_sample(monkeypatch):
    rng = np.random.default_rng(1)
    us, ok = rng.integers(0, 5_000_000, 4_000), rng.random(4_000) < 0.9
    parts = [pd.DataFrame({"us": us[k::4], "holds": ok[k::4]}) for k in range(4)]
    (due_us, due_ok), (late_us, late_ok) = E.in_order(parts, ([7], [True]), ("us", "holds"), 4_000_000)
    due, waiting = E.flags_in_order(parts, ([7], [True]), ("us", "holds"), 4_000_000)
    assert due.dtype == np.int64 and due.nbytes == 8 * len(due_us)
    for packed, times, flags in ((due, due_us, due_ok), (waiting, late_us, late_ok)):
        assert E.unpacked(packed)[0].tolist() == times.tolist() and E.unpacked(packed)[1].tolist() == flags.astype(bool).tolist()
    want = E.held_runs(due_us, due_ok.astype(bool), 10_000, 50_000, None, False, None)
    monkeypatch.setattr(E, "SAMPLES_AT_ONCE", 97)
    begun, met, since, fired, last = E.packed_runs(due, 10_000, 50_000, None, False, None)
    assert (begun.tolist(), met.tolist(), since, fired, last) == (want[0].tolist(), want[1].tolist(), want[2], want[3], int(due_us[-1])) and len(begun) > 50
    assert E.packed_runs(due[:0], 10_000, 50_000, 5, True, 9)[2:] == (5, True, 9)


def test_held_alerts_pass_over_samples_without_a_time(spark, tmp_path):
    rows_in = [(START + timedelta(minutes=k), "s", "cpu_temperature_celsius", 95.0) for k in range(6)] + [(None, "s", "cpu_temperature_celsius", 1.0)]
    df = spark.createDataFrame(rows_in, "ts timestamp, series string, metric string, value double")
    df.write.parquet(f"{tmp_path}/in")
    got = R.append_table(S.held_alerts(R.file_stream(spark, f"{tmp_path}/in", df.schema), rule_table(spark), "0 seconds"), "alerts")
    assert {r.since for r in got.collect()} == {START} and {r.rule for r in got.collect()} == {"HighCPUTemperature", "CriticalCPUTemperature"}
