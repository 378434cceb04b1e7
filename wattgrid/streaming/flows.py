"""Streaming rollups, joins, deduplication and stateful alerts.

The stateful operators bring a series' samples into order of event time: what is newer than the
watermark waits in the state, so files may come in any order within the allowed lateness. They see the rows one
series has in one batch together, so the source bounds its batches (``BYTES_PER_BATCH`` of ``runs``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wattgrid.functions.advice import heat_events
from wattgrid.operators.alerts import evaluate_rules
from wattgrid.streaming import event_order as E


def hourly_load(samples: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Hourly mean and maximum per node; rows later than ``lateness`` are not counted."""
    return _tumbling(samples, "1 hour", lateness)


def daily_load(samples: DataFrame, lateness: str = "1 day") -> DataFrame:
    return _tumbling(samples, "1 day", lateness)


def _tumbling(samples: DataFrame, width: str, lateness: str) -> DataFrame:
    grouped = samples.withWatermark("time", lateness).groupBy(F.window("time", width), "node_id")
    return grouped.agg(
        F.count(F.lit(1)).alias("samples"), F.avg("cpu_usage").alias("avg_cpu"), F.avg("power_consumption_watts").alias("avg_power"),
        F.sum("power_consumption_watts").alias("total_power"), F.max("cpu_temp").alias("max_temp"),
    ).select(F.col("window.start").alias("bucket"), "node_id", "samples", "avg_cpu", "avg_power", "total_power", "max_temp")


def sliding_rate(increments: DataFrame, value: str, keys: Sequence[str], window: str = "5 minutes", step: str = "15 seconds",
                 lateness: str = "5 minutes") -> DataFrame:
    """Per-second rate over a sliding window from rows that carry their own rise."""
    grouped = increments.withWatermark("time", lateness).groupBy(F.window("time", window, step), *keys)
    seconds = F.col("window.end").cast("double") - F.col("window.start").cast("double")
    out = grouped.agg(F.sum(value).alias("increase"), F.count(F.lit(1)).alias("samples"))
    return out.select(F.col("window.end").alias("at"), *keys, "samples", "increase", (F.col("increase") / seconds).alias("rate"))


def _key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _stateful(rows: DataFrame, keys: Sequence[str], step: Callable, out: str, state: str) -> DataFrame:
    """``step`` on the rows of each key as they come, and when the watermark passes what the state waits for."""
    return rows.groupBy(*keys).applyInPandasWithState(step, f"{_key_ddl(rows, keys)}, {out}", state, "append", GroupStateTimeout.EventTimeTimeout)


def _wake_at(state: GroupState, *times_us: int) -> None:
    """Have the key called again once the watermark is later than the first of the times."""
    state.setTimeoutTimestamp(max(int(min(times_us)) // 1000, state.getCurrentWatermarkMs() + 1))


def _out(keys: Sequence[str], key: tuple, **columns: np.ndarray) -> pd.DataFrame:
    size = len(next(iter(columns.values())))
    return pd.DataFrame({**{k: [v] * size for k, v in zip(keys, key)}, **columns})


def _moments(us: np.ndarray) -> pd.Series:
    return pd.Series(pd.to_datetime(us.astype(np.int64), unit="us"))


def counter_rate(samples: DataFrame, counter: str, keys: Sequence[str], window_seconds: int = 300, step_seconds: int = 15,
                 lateness: str = "5 minutes") -> DataFrame:
    """Per-second rise of a counter over (T - window, T] at each step T that received a sample, told once T is final.

    Two levels of panes: samples, in order of event time, become cells of one step, and a window adds up at
    most window / step cells. A fall is a restart from 0; the divisor is the span the window's samples cover, and a
    window needs two of them. State: the samples newer than the watermark, the last one before it, and one
    window of cells; all of it goes when a series has been silent for a window, as no later window reaches back to it.
    """
    if window_seconds % step_seconds:
        raise ValueError("the window must be a whole number of steps")
    steps, step_us, window_us = window_seconds // step_seconds, step_seconds * 1_000_000, window_seconds * 1_000_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held_us, held_v, last_us, last, told, *cells = state.get if state.exists else ([], [], None, None, None, *[[] for _ in E.CELLS])
        watermark = state.getCurrentWatermarkMs() * 1000
        (us, v), (wait_us, wait_v) = E.in_order([] if state.hasTimedOut else parts, (held_us, held_v), ("us", "value"), watermark)
        if len(us):
            cells = E.joined_cells(cells, E.counter_cells(us, v, step_us, last_us, last))
            last_us, last = int(us[-1]), float(v[-1])
        else:
            cells = [np.asarray(c, kind) for c, kind in zip(cells, E.CELLS)]
        at = cells[0]
        number, rate = E.window_rates(cells, steps)
        fresh = (at * step_us < watermark) & (at > (-1 if told is None else told))
        said = fresh & (number > 1)
        yield _out(keys, key, at_epoch=at[said] * step_seconds, samples=number[said], rate=pd.Series(rate[said]).astype("Float64"))
        if fresh.any():
            told = int(at[fresh][-1])
        kept = at > (told if told is not None else at[0] if len(at) else 0) - steps
        cells = [c[kept] for c in cells]
        waits = [*wait_us[:1].tolist(), *[x * step_us for x in at if x > (-1 if told is None else told)][:1]]
        if not waits and (last_us is None or last_us + window_us < watermark):
            state.remove()
            return
        state.update((wait_us.tolist(), wait_v.tolist(), last_us, last, told, *[c.tolist() for c in cells]))
        _wake_at(state, *waits or [last_us + window_us])

    rows = samples.withWatermark("time", lateness).select(*keys, "time", F.unix_micros("time").alias("us"), F.col(counter).cast("double").alias("value"))
    return _stateful(rows.filter("value is not null"), keys, step, "at_epoch bigint, samples bigint, rate double",
                     "us array<bigint>, v array<double>, last_us bigint, last double, told bigint, c0 array<bigint>, c1 array<bigint>, c2 array<double>, c3 array<double>, c4 array<bigint>, c5 array<bigint>")


def held_alerts(series: DataFrame, rules: DataFrame, lateness: str = "1 hour", idle_seconds: int = 86400) -> DataFrame:
    """Alerts whose condition held without a break for the rule's time, fired once per run.

    Samples may come up to ``lateness`` late and in any order: they wait until the watermark has passed
    them, so an alert is put out as much later. A sample more than ``idle_seconds`` after the one before begins a run anew.
    State per (rule, series): the samples that wait, start of the present run and whether it has fired; none is
    kept outside a run, nor longer than ``idle_seconds`` after the last sample.
    """
    timed = series.withWatermark("ts", lateness).filter("ts is not null")  # without a time, a sample has no place in the order
    judged = evaluate_rules(timed, rules).select("rule", "series", "hold_seconds", "ts", F.unix_micros("ts").alias("us"), "holds")
    keys = ["rule", "series", "hold_seconds"]
    idle_us = idle_seconds * 1_000_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held_us, held_ok, since, fired, last = state.get if state.exists else ([], [], None, False, None)
        watermark = state.getCurrentWatermarkMs() * 1000
        due, waiting = E.flags_in_order([] if state.hasTimedOut else parts, (held_us, held_ok), ("us", "holds"), watermark)
        begun, met, since, fired, last = E.packed_runs(due, key[2] * 1_000_000, idle_us, since, fired, last)
        wait_us, wait_ok = E.unpacked(waiting)
        yield _out(keys, key, since=_moments(begun), fired_at=_moments(met))
        over = since is None or last + idle_us < watermark
        if over and not len(wait_us):
            state.remove()
            return
        state.update((wait_us.tolist(), wait_ok.tolist(), since, fired, last))
        _wake_at(state, *wait_us[:1].tolist() or [last + idle_us])

    return _stateful(judged, keys, step, "since timestamp, fired_at timestamp", "us array<bigint>, ok array<boolean>, since bigint, fired boolean, last bigint").drop("hold_seconds")


def silent_series(samples: DataFrame, keys: Sequence[str], seconds: int, lateness: str = "1 minute") -> DataFrame:
    """A row when a series has had no sample for ``seconds``, once per silence, told when the watermark passes its end.

    Samples may come up to ``lateness`` late and in any order. State: the samples that wait and the last one; it goes once
    the silence after that has been told.
    """
    limit_us = seconds * 1_000_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held_us, last, told = state.get if state.exists else ([], None, False)
        watermark = state.getCurrentWatermarkMs() * 1000
        (us,), (wait_us,) = E.in_order([] if state.hasTimedOut else parts, (held_us,), ("us",), watermark)
        silent, last, told = E.silences(us, limit_us, watermark, last, told)
        yield _out(keys, key, last_seen=_moments(silent))
        if told and not len(wait_us):
            state.remove()
            return
        state.update((wait_us.tolist(), last, told))
        _wake_at(state, *wait_us[:1].tolist(), *([] if last is None or told else [last + limit_us]))

    rows = samples.withWatermark("time", lateness).select(*keys, "time", F.unix_micros("time").alias("us"))
    return _stateful(rows, keys, step, "last_seen timestamp", "us array<bigint>, last bigint, told boolean")


def threshold_events(samples: DataFrame) -> DataFrame:
    return heat_events(samples)


def job_lifecycle(starts: DataFrame, ends: DataFrame, longest: str, lateness: str = "1 hour") -> DataFrame:
    """Starts (run_id, node_id, start_time) joined with their ends (run_id, end_time), and either alone once ``longest`` is over.

    A job that has not ended within ``longest`` is put out without an end, so that state stays bounded; an end that
    comes after that is put out without a start. ``whole_runs`` brings the two together.
    """
    s = starts.withWatermark("start_time", lateness).alias("s")
    e = ends.withWatermark("end_time", lateness).alias("e")
    same = (F.col("s.run_id") == F.col("e.run_id")) & (F.col("e.end_time") >= F.col("s.start_time"))
    same = same & (F.col("e.end_time") <= F.col("s.start_time") + F.expr(f"interval {longest}"))
    return s.join(e, same, "full_outer").select(F.coalesce("s.run_id", "e.run_id").alias("run_id"), "s.node_id", "s.start_time", "e.end_time")


def whole_runs(parts: DataFrame) -> DataFrame:
    """One row per run of what ``job_lifecycle`` has put out so far: long runs made whole, unfinished ones without an end."""
    runs = parts.groupBy("run_id").agg(*[F.max(c).alias(c) for c in ("node_id", "start_time", "end_time")])
    ended = F.col("end_time").isNotNull()
    return runs.withColumns({"state": F.when(ended, "ended").otherwise("unfinished"), "duration_us": F.unix_micros("end_time") - F.unix_micros("start_time")})


def unique_polls(polls: DataFrame, key: Sequence[str], time: str = "time", lateness: str = "24 hours") -> DataFrame:
    """Each record once, however often it is polled within ``lateness``."""
    return polls.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(key))


def record_counters(records: DataFrame, *labels: str) -> DataFrame:
    return records.groupBy(*labels).agg(F.count(F.lit(1)).alias("records_total"))


def dated(df: DataFrame, time: Column | str = "time") -> DataFrame:
    """Add the date and hour that log files are split by."""
    return df.withColumns({"date": F.date_format(time, "yyyy-MM-dd"), "hour": F.date_format(time, "HH")})


def write_hourly_json(stream: DataFrame, folder: str) -> DataFrame:
    """All records by date and hour, error records again by date, as gzip JSON; reads both back."""
    from wattgrid.streaming.runs import finish

    parts = {"all": (stream, ["date", "hour"]), "errors": (stream.filter("route = 'error'"), ["date"])}
    queries = [
        df.writeStream.format("json").option("compression", "gzip").partitionBy(*by).outputMode("append")
        .option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start(f"{folder}/{name}")
        for name, (df, by) in parts.items()]
    for q in queries:
        finish(q)
    read = lambda name: stream.sparkSession.read.schema(stream.schema).json(f"{folder}/{name}")
    return read("all").withColumn("output", F.lit("all")).unionByName(read("errors").withColumn("output", F.lit("errors")))
