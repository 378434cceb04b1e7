"""Lags, rolling statistics, counter rates and other functions of ordered series.

Everything goes through ``ordered.chunked``: one hot node is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattgrid.operators.ordered import (
    CHUNK,
    GRAIN_SECONDS,
    HALO,
    chunk_window,
    chunked,
    epoch_us,
    over_rows,
    position_in_order,
    running_sum,
    seconds_between,
    with_previous,
)
from wattgrid.session import checkpointed

LAGS = (1, 2, 3, 6, 12, 24)
WINDOWS = (3, 6, 12, 24)


def lag_features(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str, ties: Sequence[str] = (),
                 lags: Sequence[int] = LAGS, **chunking) -> DataFrame:
    build = lambda w: {f"{c}_lag_{n}": F.lag(c, n).over(w) for c in columns for n in lags}
    return over_rows(df, keys, order, ties, max(lags), build, **chunking)


def _rolling(window: WindowSpec, column: str, n: int) -> dict[str, Column]:
    frame = window.rowsBetween(-(n - 1), 0)
    full = F.count(column).over(frame) == n
    stats = {
        "mean": F.avg(column), "std": F.stddev_samp(column), "min": F.min(column), "max": F.max(column),
    }
    out = {f"{column}_rolling_{s}_{n}": F.when(full, e.over(frame)) for s, e in stats.items()}
    # Sorting the window's few values is quicker than a percentile buffer for every row.
    ordered = F.sort_array(F.collect_list(F.col(column).cast("double")).over(frame))
    middle = (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2
    out[f"{column}_rolling_median_{n}"] = F.when(full, middle)
    mean = out[f"{column}_rolling_mean_{n}"]
    return out | {f"{column}_ratio_to_rolling_mean_{n}": F.try_divide(F.col(column), mean)}


def rolling_features(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str, ties: Sequence[str] = (),
                     windows: Sequence[int] = WINDOWS, **chunking) -> DataFrame:
    """Mean, deviation, extremes, median and ratio to the mean of the last n rows; null until n rows are there."""
    build = lambda w: {k: v for c in columns for n in windows for k, v in _rolling(w, c, n).items()}
    return over_rows(df, keys, order, ties, max(windows) - 1, build, **chunking)


def increments(samples: DataFrame, counter: str, keys: Sequence[str], time: str, ties: Sequence[str] = (),
               **chunking) -> DataFrame:
    """Add the counter's rise since the previous sample (a fall is a reset to 0) and that sample's time."""
    prev = with_previous(samples, {"_pv": counter, "prev_time": time}, keys, time, ties, **chunking)
    rise = F.when(F.col(counter) < F.col("_pv"), F.col(counter)).otherwise(F.col(counter) - F.col("_pv"))
    return prev.withColumn("increase", rise).drop("_pv")


def rate(samples: DataFrame, counter: str, keys: Sequence[str], time: str, ties: Sequence[str] = (),
         window_seconds: int = 300, step_seconds: int = 15, **chunking) -> DataFrame:
    """Per-second rise over (T - window, T] at each step T that received a sample.

    Samples are first reduced to one row per series and step; the sliding window
    runs over those rows only, in chunks that know the window's span before them.  The divisor is the
    span the window's samples cover.
    """
    if window_seconds % step_seconds:
        raise ValueError("the window must be a whole number of steps")
    risen = increments(samples, counter, keys, time, ties, **chunking)
    step_us = step_seconds * 1_000_000
    step_of = lambda c: F.ceil(epoch_us(c) / F.lit(step_us)).cast("bigint")
    step = step_of(time)
    # The first sample of a step brings its rise from an earlier step.
    enters = F.coalesce(step_of("prev_time") != step, F.lit(False))
    cells = risen.groupBy(*keys, step.alias("_step")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("increase").alias("_sum"),
        F.coalesce(F.sum(F.when(enters, F.col("increase"))), F.lit(0)).alias("_entering"),
        F.min(epoch_us(time)).alias("_first"), F.max(epoch_us(time)).alias("_last"),
    )
    reach = window_seconds // step_seconds - 1
    steps = {**chunking, "grain": max(1, (chunking.get("grain") or GRAIN_SECONDS) // step_seconds)}
    cells = chunked(checkpointed(cells), keys, "_step", lookback=reach, **steps)
    w = chunk_window(keys, "_step").rangeBetween(-reach, 0)
    rise = F.coalesce(F.sum("_sum").over(w), F.lit(0)) - F.first("_entering").over(w)
    span = (F.max("_last").over(w) - F.min("_first").over(w)) / 1_000_000.0
    out = cells.select(*keys, HALO, (F.col("_step") * step_seconds).alias("at_epoch"), F.sum("_n").over(w).alias("samples"),
                       F.try_divide(rise.cast("double"), span).alias("rate"))
    return out.filter(~F.col(HALO) & (F.col("samples") > 1)).drop(HALO)


def instant_rate(samples: DataFrame, counter: str, keys: Sequence[str], time: str, ties: Sequence[str] = (),
                 window_seconds: int = 300, **chunking) -> DataFrame:
    """Per-second rise between the last two samples, if both lie inside the window."""
    risen = increments(samples, counter, keys, time, ties, **chunking)
    gap = seconds_between(time, "prev_time")
    value = F.when(gap < window_seconds, F.try_divide(F.col("increase").cast("double"), gap))
    return risen.withColumn("irate", value).drop("increase", "prev_time")


def busy_percent(samples: DataFrame, total: str, idle: str, keys: Sequence[str], time: str, ties: Sequence[str] = (),
                 **chunking) -> DataFrame:
    """Share of a total counter's rise that its idle counter did not have; 0 without a rise."""
    prev = with_previous(samples, {"_pt": total, "_pi": idle}, keys, time, ties, **chunking)
    whole, rest = F.col(total) - F.col("_pt"), F.col(idle) - F.col("_pi")
    value = F.when(whole > 0, (whole - rest) * 100.0 / whole).when(whole.isNotNull(), 0.0)
    return prev.withColumn("usage_percent", value).drop("_pt", "_pi")


def byte_rate(samples: DataFrame, counter: str, keys: Sequence[str], time: str, ties: Sequence[str] = (),
              unit_bytes: int = 1, **chunking) -> DataFrame:
    """MB/s since the previous sample; ``unit_bytes`` is 512 for sector counters."""
    risen = increments(samples, counter, keys, time, ties, **chunking)
    mb = F.col("increase") * unit_bytes / F.lit(1048576.0)
    return risen.withColumn("mbps", F.try_divide(mb, seconds_between(time, "prev_time"))).drop("increase", "prev_time")


def _balance(events: DataFrame, keys: Sequence[str], ties: Sequence[str], **chunking) -> DataFrame:
    return running_sum(events, "step", "level", keys, "at", ["step", *ties], **chunking)


def queue_lengths(runs: DataFrame, **chunking) -> DataFrame:
    """Jobs still waiting right after each start."""
    events = runs.select("run_id", F.inline(F.array(
        F.struct(F.col("submit_time").alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("start_time").alias("at"), F.lit(-1).alias("step")))))
    out = _balance(events, [], ["run_id"], **chunking)
    return out.filter("step = -1").select("run_id", F.col("at").alias("start_time"), F.col("level").alias("queue_length"))


def concurrent_runs(runs: DataFrame, **chunking) -> DataFrame:
    """Running jobs per node after each start and end."""
    events = runs.select("node_id", "run_id", F.inline(F.array(
        F.struct(F.col("start_time").alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("end_time").alias("at"), F.lit(-1).alias("step")))))
    out = _balance(events, ["node_id"], ["run_id"], **chunking)
    return out.select("node_id", "run_id", "at", "step", F.col("level").alias("running"))


def energy_integral(samples: DataFrame, power: str, keys: Sequence[str], time: str, ties: Sequence[str] = (),
                    step_seconds: float = 5.0, **chunking) -> DataFrame:
    """Wh per series: each power held until the next sample, and with a fixed step."""
    prev = with_previous(samples, {"_pp": power, "_pt": time}, keys, time, ties, **chunking)
    held = F.col("_pp") * seconds_between(time, "_pt") / 3600.0
    return prev.groupBy(*keys).agg(F.sum(held).alias("energy_wh"),
                                   F.sum(F.col(power) * step_seconds / 3600.0).alias("fixed_step_wh"))


def last_samples(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest ``n`` rows per key; Spark cuts each task to ``n`` rows before the shuffle."""
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def chronological_split(df: DataFrame, order: Sequence[str], holdout: float) -> DataFrame:
    """Mark the first (1 - holdout) of the rows in order as training rows."""
    cut = int(df.count() * (1 - holdout))
    numbered = position_in_order(df, order)
    return numbered.withColumn("is_train", F.col("position") <= cut)


def category_shares(df: DataFrame, category: str, value: str) -> DataFrame:
    """Each category's total, its share of all and the running share, largest first.

    The unpartitioned windows see one row per category.
    """
    totals = df.groupBy(category).agg(F.sum(value).alias("total"))
    everything = Window.partitionBy()
    running = Window.orderBy(F.desc("total"), category).rowsBetween(Window.unboundedPreceding, 0)
    return totals.withColumns({
        "share": F.try_divide(F.col("total"), F.sum("total").over(everything)),
        "running_share": F.try_divide(F.sum("total").over(running), F.sum("total").over(everything)),
    })


# First-order thermal filter: constants of the model (fixed values).
AMBIENT, HEAT_SHARE, START_TEMP, MAX_TEMP = 22.0, 0.8, 25.0, 85.0


def thermal_filter(samples: DataFrame, power: str, keys: Sequence[str], order: str, ties: Sequence[str] = (), *,
                   dt: float, capacity: float = 1000.0, cooling: float = 50.0, start: float = START_TEMP,
                   max_temp: float = MAX_TEMP, rows_per_chunk: int = 100_000, grain: float = 60) -> DataFrame:
    """Node temperature under its power: T += (0.8 P - (T - 22) cooling) / capacity * dt, at least 22.

    One step is T -> max(22, a T + b) with the same ``a`` for all.  Steps in a row
    compose to T -> clamp(A T + B, low, high), so a chunk is summed up in four
    numbers, chunks are chained through those, and all chunks run in parallel.
    """
    a = 1 - cooling * dt / capacity
    if abs(a) > 1:
        raise ValueError(f"the step is unstable (factor {a:g}); use a smaller dt")
    keys, names = list(keys), list(samples.columns)
    cut = chunked(samples, keys, order, rows_per_chunk=rows_per_chunk, grain=grain).drop(HALO)
    sort = [order, *ties]
    gain = lambda p: (HEAT_SHARE * p + AMBIENT * cooling) / capacity * dt
    key_types = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    prefix = f"{key_types}, " if keys else ""

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        A, B, low, high = 1.0, 0.0, float("-inf"), float("inf")
        for b in gain(pdf.sort_values(sort)[power].astype("float64")).to_numpy():
            ends = [max(AMBIENT, a * e + b) if a else max(AMBIENT, b) for e in (low, high)]
            A, B, (low, high) = a * A, a * B + b, sorted(ends)
        return pd.DataFrame([[*pdf[[*keys, CHUNK]].iloc[0], A, B, low, high]],
                            columns=[*keys, CHUNK, "A", "B", "low", "high"])

    summaries = cut.select(*keys, CHUNK, *dict.fromkeys([*sort, power])).groupBy(*keys, CHUNK).applyInPandas(
        summarise, f"{prefix}{CHUNK} bigint, A double, B double, low double, high double")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        temp, starts = start, []
        for A, B, low, high in pdf[["A", "B", "low", "high"]].itertuples(index=False):
            starts.append(temp)
            temp = min(max(A * temp + B, low), high)
        return pdf[[*keys, CHUNK]].assign(start=starts)

    starts = summaries.groupBy(*(keys or [F.lit(0)])).applyInPandas(chain, f"{prefix}{CHUNK} bigint, start double")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(sort)
        temp, out = float(pdf["_start"].iloc[0]), []
        for b in gain(pdf[power].astype("float64")).to_numpy():
            temp = max(AMBIENT, a * temp + b)
            out.append(temp)
        return pdf[names].assign(model_temp=out)

    together = cut.join(starts.withColumnRenamed("start", "_start"), [*keys, CHUNK])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema)
    out = together.groupBy(*keys, CHUNK).applyInPandas(follow, f"{schema}, model_temp double")
    return out.withColumn("is_throttling", F.col("model_temp") > 0.9 * max_temp)
