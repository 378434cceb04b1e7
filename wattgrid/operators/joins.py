"""Joins between jobs, node samples and simulated results."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.operators.ordered import CHUNK, GRAIN_SECONDS, HALO, ROWS_PER_CHUNK, chunked, epoch_us, fill_gaps, position_in_order
from wattgrid.operators.rollups import bucket
from wattgrid.session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


#: Samples that a run is compared with at once; a run is repeated once per so many samples that it covers.
SAMPLES_PER_CELL = 4_000


def during_runs(samples: DataFrame, runs: DataFrame, bucket_seconds: int = 3600, samples_per_cell: int = SAMPLES_PER_CELL) -> DataFrame:
    """Samples taken on a run's node between its start and end, both included.

    Each run is repeated for the cells it touches, which turns the range condition into an equi-join on (node, cell);
    adaptive execution can then split a hot cell. A cell is as many time buckets of a node as hold ``samples_per_cell``
    samples, so the repeated runs grow with the runs and a small part of the pairs, not with the runs' length.
    """
    width = F.lit(bucket_seconds * 1_000_000)
    at = lambda c: F.floor(epoch_us(c) / width)
    timed = runs.filter(F.col("end_time") >= F.col("start_time")).withColumns({"_from": at("start_time"), "_to": at("end_time")})
    keyed = samples.withColumn("_at", at("time"))
    # Buckets that hold samples, or a start or end of a run.
    asked = timed.select("node_id", F.explode(F.array("_from", "_to")).alias("_at"), F.lit(0).alias("_n"))
    held = keyed.select("node_id", "_at", F.lit(1).alias("_n")).unionByName(asked).filter(F.col("node_id").isNotNull() & F.col("_at").isNotNull())
    held = checkpointed(held.groupBy("node_id", "_at").agg(F.sum("_n").alias("_n")))
    series = Window.partitionBy("node_id")
    before = F.coalesce(F.sum("_n").over(series.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = held.withColumn("_filled", F.floor(before / F.lit(samples_per_cell)))
    cells = checkpointed(filled.select("node_id", "_at", F.dense_rank().over(series.orderBy("_filled")).alias("_cell")))
    place = lambda c: cells.select("node_id", F.col("_at").alias(c), F.col("_cell").alias(f"_cell{c}"))
    spread = timed.join(place("_from"), ["node_id", "_from"]).join(place("_to"), ["node_id", "_to"])
    spread = spread.withColumn("_cell", F.explode(F.sequence("_cell_from", "_cell_to"))).drop("_from", "_to", "_cell_from", "_cell_to")
    both = keyed.join(cells, ["node_id", "_at"]).drop("_at").join(spread, ["node_id", "_cell"])
    return both.filter(F.col("time").between(F.col("start_time"), F.col("end_time"))).drop("_cell")


# What is known of a set of samples' values: their number, sum, squared deviations from their mean, and largest.
PARTS_OF_STATS = ("n", "sum", "dev", "max")

# Ranges up to this long are added in order of time, so that they are rounded like a plain sum.
PLAIN_CELLS = 256


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Statistics of pairs of disjoint sets: arrays of 4 (``PARTS_OF_STATS``) x columns x sets."""
    n = a[0] + b[0]
    apart = b[1] / np.maximum(b[0], 1) - a[1] / np.maximum(a[0], 1)
    both = (a[0] > 0) & (b[0] > 0)
    dev = a[2] + b[2] + np.where(both, apart * apart * a[0] * b[0] / np.maximum(n, 1), 0.0)
    return np.stack([n, a[1] + b[1], dev, np.maximum(a[3], b[3])])


def _nothing(columns: int, sets: int) -> np.ndarray:
    out = np.zeros((4, columns, sets))
    out[3] = -np.inf
    return out


def range_stats(cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Statistics of the cells ``low`` to before ``high``, for many ranges at once.

    Cells are merged in pairs, pairs of pairs and so on; a range takes at most two of each size, so nothing is ever
    taken away again and sums keep their precision.
    """
    out, (low, high) = _nothing(cells.shape[1], len(low)), (low.copy(), np.maximum(low, high))
    while (low < high).any():
        if cells.shape[2] % 2:
            cells = np.concatenate([cells, _nothing(cells.shape[1], 1)], axis=2)
        for odd, at in (((low < high) & (low % 2 == 1), low), ((low < high) & (high % 2 == 1), high - 1)):
            out[:, :, odd] = _merge(out[:, :, odd], cells[:, :, at[odd]])
        low, high = (low + 1) // 2, high // 2
        cells = _merge(cells[:, :, ::2], cells[:, :, 1::2])
    return out


def plain_sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of the cells ``low`` to before ``high``, added one after another."""
    out = np.zeros((values.shape[0], len(low)))
    for step in range(int((high - low).max(initial=0))):
        going = np.flatnonzero(high - low > step)
        out[:, going] += values[:, low[going] + step]
    return out


def _merged(parts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key with the statistics of all its parts."""
    whole = Window.partitionBy(*keys)
    mean = {f"_mean_{c}": F.try_divide(F.sum(f"{c}_sum").over(whole), F.sum(f"{c}_n").over(whole)) for c in columns}
    apart = lambda c: F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sum") / F.col(f"{c}_n") - F.col(f"_mean_{c}"))
    return parts.withColumns(mean).groupBy(*keys).agg(*[e.alias(f"{c}_{n}") for c in columns for n, e in (
        ("n", F.sum(f"{c}_n")), ("sum", F.sum(f"{c}_sum")),
        ("dev", F.sum(F.col(f"{c}_dev") + F.coalesce(F.col(f"{c}_n") * apart(c) * apart(c), F.lit(0.0)))), ("max", F.max(f"{c}_max")))])


def _chunk_parts(columns: Sequence[str]):
    """For a chunk of one node: statistics inside it of each run that starts or ends there, and of all its samples."""
    names = [f"{c}_{n}" for n in PARTS_OF_STATS for c in columns]

    def parts(rows: pd.DataFrame) -> pd.DataFrame:
        node, chunk, first = rows["node_id"].iloc[0], rows[CHUNK].iloc[0], rows["at"].min()
        cells = rows[rows["began"].isna()].sort_values("at")
        asked = rows[rows["began"].notna()]
        values = cells[names].to_numpy(np.float64).T.reshape(4, len(columns), len(cells))
        began, ended = asked["began"].to_numpy(np.int64), asked["ended"].to_numpy(np.int64)
        low = np.searchsorted(cells["at"], began, "left")
        high = np.searchsorted(cells["at"], ended, "right")
        # A run that starts and ends in one chunk is told at its start only.
        again = asked["is_end"].to_numpy(bool) & (began >= first)
        low, high = np.append(low, 0), np.append(np.where(again, low, high), len(cells))
        found = range_stats(values, low, high)
        short = np.flatnonzero(high - low <= PLAIN_CELLS)
        found[1][:, short] = plain_sums(values[1], low[short], high[short])
        out = pd.DataFrame(found.reshape(len(names), -1).T, columns=names)
        return out.assign(node_id=node, **{CHUNK: chunk}, began=pd.array([*began, None], "Int64"), ended=pd.array([*ended, None], "Int64"))

    return parts


def _between_chunks(spans: DataFrame, totals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics of the chunks between ``first`` and ``last`` of each node's spans, both left out.

    Totals are merged for 1, 2, 4, ... chunks; a span takes at most two of each size.
    """
    top = totals.agg(F.max(CHUNK)).first()[0] or 0
    sizes = F.explode(F.sequence(F.lit(0), F.lit(int(top).bit_length()))).alias("level")
    power = F.expr("shiftleft(1L, level)")
    blocks = _merged(totals.select("*", sizes).withColumn("block", F.floor(F.col(CHUNK) / power)), ["node_id", "level", "block"], columns)
    low, high = F.ceil((F.col("first") + 1) / power), F.floor(F.col("last") / power)
    taken = spans.select("*", sizes).withColumns({"low": low, "high": high}).filter("low < high").withColumn("block", F.explode(F.array_compact(F.array(
        F.when(F.col("low") % 2 == 1, F.col("low")), F.when(F.col("high") % 2 == 1, F.col("high") - 1)))))
    return _merged(taken.join(blocks, ["node_id", "level", "block"]), spans.columns, columns)


def stats_during_runs(samples: DataFrame, runs: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("run_id",),
                      rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Statistics of the samples taken on a run's node between its start and end, per ``keys`` of the runs.

    The same as ``during_runs`` grouped by the keys, without making the pairs, whose number grows with the square of
    the load: each node is cut along time into chunks; a run takes what it covers of the chunks of its start and end,
    and the totals of the chunks between, merged in powers of two. Keys without any sample are left out.
    Gives ``<column>_n``, ``_sum``, ``_dev`` (squared deviations) and ``_max``.
    """
    columns, samples = [*columns, "_sample"], samples.withColumn("_sample", F.lit(0.0))  # counts samples without values as well
    names = [f"{c}_{n}" for n in PARTS_OF_STATS for c in columns]
    ends = lambda name: epoch_us(name).alias({"start_time": "began", "end_time": "ended"}[name])
    timed = runs.filter((F.col("end_time") >= F.col("start_time")) & F.col("node_id").isNotNull())
    timed = timed.select("*", ends("start_time"), ends("end_time"))
    cells = samples.filter(F.col("node_id").isNotNull() & F.col("time").isNotNull()).groupBy("node_id", epoch_us("time").alias("at")).agg(*[
        e.cast("double").alias(f"{c}_{n}") for c in columns for n, e in (
            ("n", F.count(c)), ("sum", F.coalesce(F.sum(c), F.lit(0.0))),
            ("dev", F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0))), ("max", F.coalesce(F.max(c), F.lit(float("-inf")))))])
    asked = timed.select("node_id", "began", "ended").distinct()
    asked = asked.select("*", F.inline(F.array(*[F.struct(F.col(c).alias("at"), F.lit(c == "ended").alias("is_end")) for c in ("began", "ended")])))
    series = cells.unionByName(asked, allowMissingColumns=True)
    cut = chunked(series, ["node_id"], "at", rows_per_chunk=rows_per_chunk, grain=GRAIN_SECONDS * 1_000_000).drop(HALO)
    doubles = ", ".join(f"{n} double" for n in names)
    found = checkpointed(cut.groupBy("node_id", CHUNK).applyInPandas(
        _chunk_parts(columns), f"{doubles}, node_id string, {CHUNK} bigint, began bigint, ended bigint"))
    run = ["node_id", "began", "ended"]
    told = found.filter("began is not null")
    spans = told.groupBy(*run).agg(F.min(CHUNK).alias("first"), F.max(CHUNK).alias("last")).filter("last > first + 1")
    distinct = spans.select("node_id", "first", "last").distinct()
    between = _between_chunks(distinct, found.filter("began is null").select("node_id", CHUNK, *names), columns)
    parts = told.select(*run, *names).unionByName(spans.join(between, ["node_id", "first", "last"]).select(*run, *names))
    whole = _merged(parts, run, columns).filter("_sample_n > 0")
    return _merged(timed.select(*keys, *[F.col(c).alias(f"_{c}") for c in run]).join(
        whole.select(*[F.col(c).alias(f"_{c}") for c in run], *names), [f"_{c}" for c in run]), keys, columns)


def mean_of(column: str) -> Column:
    return F.try_divide(F.col(f"{column}_sum"), F.col(f"{column}_n"))


def largest_of(column: str) -> Column:
    return F.when(F.col(f"{column}_n") > 0, F.col(f"{column}_max"))


def sum_of(column: str) -> Column:
    return F.when(F.col(f"{column}_n") > 0, F.col(f"{column}_sum"))


def deviation_of(column: str) -> Column:
    return F.when(F.col(f"{column}_n") > 1, F.sqrt(F.col(f"{column}_dev") / (F.col(f"{column}_n") - 1)))


def run_usage(samples: DataFrame, runs: DataFrame, digits: int = 2, **chunking) -> DataFrame:
    """System load per run: mean, max and sample deviation, rounded."""
    power = "power_consumption_watts"
    stats = {}
    for c, short in (("cpu_usage", "cpu"), ("memory_usage", "memory")):
        stats |= {f"{short}_mean": mean_of(c), f"{short}_max": largest_of(c), f"{short}_std": deviation_of(c)}
    stats |= {"power_mean": mean_of(power), "power_sum": sum_of(power)}
    found = stats_during_runs(samples, runs, ["cpu_usage", "memory_usage", power], **chunking)
    return found.select("run_id", *[F.round(e, digits).alias(n) for n, e in stats.items()])


def node_thermals(samples: DataFrame, throttle_at: float = 76.5) -> DataFrame:
    """Temperatures per node: mean and max rounded to 2 places, and throttled samples."""
    return samples.groupBy("node_id").agg(
        F.round(F.avg("cpu_temp"), 2).alias("cpu_temp_mean"),
        F.round(F.max("cpu_temp"), 2).alias("cpu_temp_max"),
        F.count_if(F.col("cpu_temp") > throttle_at).alias("throttling_sum"),
    )


def combine_jobs(jobs: DataFrame, usage: DataFrame | None = None, thermals: DataFrame | None = None,
                 usage_key: str = "run_id") -> DataFrame:
    """Jobs with their system and thermal summaries where known."""
    if usage is not None:
        jobs = jobs.join(usage, usage_key, "left")
    if thermals is not None:
        jobs = jobs.join(thermals, "node_id", "left")
    return jobs


def matched_jobs(real: DataFrame, simulated: DataFrame, value: str, key: str = "job_id") -> DataFrame:
    """Real and simulated values of the same job, ids compared as text."""
    side = lambda df, name: df.select(
        F.col(key).cast("string").alias(key), F.col(value).try_cast("double").alias(f"{value}_{name}"))
    both = side(real, "real").join(side(simulated, "sim"), key)
    return both.dropna(subset=[f"{value}_real", f"{value}_sim"])


def aligned_by_time(real: DataFrame, simulated: DataFrame, value: str, time: str = "time",
                    unit: str = "hour") -> DataFrame:
    """Mean per time bucket of both series inside their common time range."""
    span = lambda df: df.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    common = span(real).unionByName(span(simulated)).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    low, high = common.select("lo").scalar(), common.select("hi").scalar()

    def means(df: DataFrame, name: str) -> DataFrame:
        inside = df.filter((F.col(time) >= low) & (F.col(time) <= high) & (low < high))
        return inside.groupBy(bucket(df, unit, time).alias("bucket")).agg(F.avg(value).alias(name))

    both = means(real, "real").join(means(simulated, "simulated"), "bucket")
    return both.dropna(subset=["real", "simulated"])


def aligned_by_position(real: DataFrame, simulated: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Pair the n-th real with the n-th simulated row; the shorter side ends it."""
    side = lambda df, name: position_in_order(df, list(order)).select(
        "position", F.col(value).alias(name))
    return side(real, "real").join(side(simulated, "simulated"), "position")


def ratio_by(df: DataFrame, keys: Sequence[str], part: Column) -> DataFrame:
    """Share of rows satisfying ``part`` per key, as one aggregate."""
    return df.groupBy(*keys).agg(
        F.count_if(part).alias("part"), F.count(F.lit(1)).alias("total"),
        F.try_divide(F.count_if(part), F.count(F.lit(1))).alias("ratio"),
    )


def change_since(samples: DataFrame, value: str, keys: Sequence[str], time: str = "time",
                 ties: Sequence[str] = (), offset_seconds: int = 300, stale_seconds: int = 300,
                 **chunking) -> DataFrame:
    """``value - value offset d``: each sample less the series' value ``offset`` earlier.

    The earlier value is the last sample at or before that instant, if not older
    than ``stale_seconds``.  Samples and look-up instants are merged into one
    ordered series and filled forward, so no pair of samples is ever joined.
    """
    kind = samples.schema[time].dataType
    shifted = F.col(time) - F.make_dt_interval(secs=F.lit(offset_seconds))
    own = F.struct(F.col(time).alias("at"), F.col(value).alias("value"))
    seen = samples.select(*keys, F.col(time).alias("_at"), F.lit(0).alias("_ask"), own.alias("_seen"),
                          F.struct(*samples.columns).alias("_row"))
    asked = samples.select(*keys, shifted.cast(kind).alias("_at"), F.lit(1).alias("_ask"),
                           F.lit(None).cast(seen.schema["_seen"].dataType).alias("_seen"),
                           F.struct(*samples.columns).alias("_row"))
    series = seen.unionByName(asked).withColumn("_tie", F.struct("_ask", *[F.col(f"_row.{c}").alias(c) for c in ties]))
    filled = fill_gaps(series, ["_seen"], keys, "_at", ["_tie"], backward=False, **chunking)
    fresh = (epoch_us("_at") - epoch_us(F.col("_seen.at"))) < stale_seconds * 1_000_000
    earlier = F.when(fresh, F.col("_seen.value"))
    return filled.filter("_ask = 1").select(
        "_row.*", earlier.alias(f"{value}_before"), (F.col(f"_row.{value}") - earlier).alias(f"{value}_change"))


def missing_intervals(samples: DataFrame, keys: Sequence[str], time: str = "time", step: str = "1 hour") -> DataFrame:
    """Steps of each series' time span that hold no sample."""
    cell = F.window(time, step).start
    seen = samples.select(*keys, cell.alias("at")).distinct()
    span = seen.groupBy(*keys).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    grid = span.select(*keys, F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias("at"))
    return grid.join(seen, [*keys, "at"], "left_anti")


def coverage(real: DataFrame, simulated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts per key on both sides and the smaller over the larger."""
    side = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = side(real, "real_records").join(side(simulated, "simulated_records"), list(keys), "full_outer")
    both = both.fillna(0, subset=["real_records", "simulated_records"])
    return both.withColumn("coverage_ratio", F.try_divide(
        F.least("real_records", "simulated_records"), F.greatest("real_records", "simulated_records")))
