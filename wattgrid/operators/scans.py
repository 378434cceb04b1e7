"""Scans, predicates, keyed updates and set operations over telemetry tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattgrid.operators.ordered import position_in_order


JOB_COLUMNS = ["time", "job_id", "job_state", "job_type", "cpu_usage", "memory_usage",
               "duration_seconds", "estimated_energy_wh", "node_id"]


def instant(df: DataFrame, value, column: str = "time") -> Column:
    """``value`` as a literal of the column's type; None means the column's maximum."""
    if value is None:
        return df.agg(F.max(column)).scalar()
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast(df.schema[column].dataType)


def ago(at: Column, **span: int) -> Column:
    names = {"days": "days", "hours": "hours", "minutes": "mins", "seconds": "secs"}
    return at - F.make_dt_interval(**{names[k]: F.lit(v) for k, v in span.items()})


def time_range(df: DataFrame, start=None, end=None, column: str = "time",
               date_column: str | None = "date") -> DataFrame:
    """Rows with start <= time <= end.

    When the table is partitioned by ``date_column`` the same bounds are put on
    it too, because Spark does not derive a partition filter from ``time``.
    """
    for bound, above in ((start, True), (end, False)):
        if bound is None:
            continue
        at = instant(df, bound, column)
        df = df.filter(F.col(column) >= at if above else F.col(column) <= at)
        if date_column and date_column in df.columns:
            day = at.cast("date")
            df = df.filter(F.col(date_column) >= day if above else F.col(date_column) <= day)
    return df


def recent(df: DataFrame, columns: Sequence[str], as_of=None, days: int = 7,
           column: str = "time") -> DataFrame:
    """The last ``days`` days before ``as_of``, newest first."""
    at = instant(df, as_of, column)
    rows = df.filter((F.col(column) >= ago(at, days=days)) & (F.col(column) <= at))
    return rows.select(*columns).orderBy(F.col(column).desc())


def load_jobs(df: DataFrame, start, end, job_types: Iterable[str] | None = None,
              min_duration: int | None = None) -> DataFrame:
    parts = []
    if job_types:
        parts.append(F.col("job_type").isin(list(job_types)))
    if min_duration is not None:
        parts.append(F.col("duration_seconds") >= min_duration)
    rows = time_range(df, start, end)
    return rows.filter(reduce(lambda a, b: a & b, parts)) if parts else rows


def load_nodes(df: DataFrame, start, end, node_ids: Iterable[str] | None = None) -> DataFrame:
    rows = time_range(df, start, end)
    return rows.filter(F.col("node_id").isin(list(node_ids))) if node_ids else rows


def load_predictions(df: DataFrame, start, end) -> DataFrame:
    return time_range(df, start, end).select(
        "time", "job_id", "predicted_energy_wh", "actual_energy_wh", "prediction_error_percent",
        "model_version", F.col("prediction_method").alias("features_used"),
    )


def retained(df: DataFrame, as_of, days: int) -> DataFrame:
    """Rows young enough to keep; whole date partitions older than that are pruned."""
    return time_range(df, ago(instant(df, as_of), days=days))


def optional_equal(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == value)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def available(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def finite(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def valid_rows(df: DataFrame, features: Sequence[str], target: str, positive: bool = True) -> DataFrame:
    """Rows whose features and target are finite, and whose target is above zero."""
    keep = reduce(lambda a, b: a & b, (finite(c) for c in [*features, target]))
    return df.filter(keep & (F.col(target) > 0) if positive else keep)


def drop_infinite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with an infinity in a numeric column; nulls stay."""
    for c in columns or numeric_columns(df):
        df = df.filter(F.coalesce(F.abs(F.col(c).cast("double")) != F.lit(float("inf")), F.lit(True)))
    return df


def one_per_key(df: DataFrame, keys: Sequence[str], prefer: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first by ``prefer``, so a rerun picks the same row.

    Spark keeps one row per key in each task before the shuffle, so a key with
    very many copies does not reach one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*prefer)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


# Defaults for columns a public trace lacks (fixed values).
TRACE_DEFAULTS = {
    "cpu_usage": 75.0, "memory_usage": 60.0, "io_read_mbps": 10.0, "io_write_mbps": 5.0,
    "network_rx_mbps": 1.0, "network_tx_mbps": 1.0,
    "job_type": "compute", "workload_pattern": "cpu_intensive",
}
# Trace column -> canonical column (fixed values).
TRACE_NAMES = {
    "num_nodes": "cpu_cores", "estimated_power_w": "avg_power_watts",
    "avg_temp_c": "avg_cpu_temp", "max_temp_c": "peak_cpu_temp", "dataset_source": "partition",
}


def canonical_trace(df: DataFrame) -> DataFrame:
    """Copy trace columns to canonical names, GB to MB, and add missing columns."""
    added = {new: F.col(old) for old, new in TRACE_NAMES.items() if old in df.columns}
    if "memory_gb" in df.columns:
        added["memory_mb"] = F.col("memory_gb") * 1024
    added |= {c: F.lit(v) for c, v in TRACE_DEFAULTS.items() if c not in df.columns}
    return df.withColumns(added)


def energy_target(df: DataFrame) -> tuple[DataFrame, str]:
    """Pick the energy column to predict, or derive it from power and duration."""
    for name in ("estimated_energy_wh", "energy_wh", "avg_power_watts"):
        if name in df.columns:
            return df, name
    if "estimated_power_w" in df.columns and "duration_seconds" in df.columns:
        energy = F.col("estimated_power_w") * F.col("duration_seconds") / 3600.0
        return df.withColumn("calculated_energy_wh", energy), "calculated_energy_wh"
    raise ValueError(f"no energy target among {df.columns}")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str],
           latest_by: Sequence[str] = ()) -> DataFrame:
    """Insert unknown keys; for known keys replace only the ``update`` columns.

    With several changes to one key the last by ``latest_by`` wins.
    """
    if latest_by:
        changes = one_per_key(changes, keys, [F.col(c).desc() for c in latest_by])
    missing = [c for c in base.columns if c not in changes.columns]
    changes = changes.withColumns({c: F.lit(None).cast(base.schema[c].dataType) for c in missing})
    b, c = base.withColumn("_old", F.lit(True)).alias("b"), changes.withColumn("_new", F.lit(True)).alias("c")
    joined = b.join(c, reduce(lambda x, y: x & y, (F.col(f"b.{k}") == F.col(f"c.{k}") for k in keys)), "full_outer")
    known, changed = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    out = []
    for name in base.columns:
        old, new = F.col(f"b.{name}"), F.col(f"c.{name}")
        replace = changed if name in update else changed & ~known
        out.append(F.when(replace, new).otherwise(old).alias(name))
    return joined.select(*out)


def close_out(started: DataFrame, finished: DataFrame, keys: Sequence[str] = ("job_id", "node_id")) -> DataFrame:
    """Fill started jobs with the values reported at their end, where there are any."""
    s, f = started.alias("s"), finished.alias("f")
    joined = s.join(f, reduce(lambda x, y: x & y, (F.col(f"s.{k}") == F.col(f"f.{k}") for k in keys)), "left")
    out = []
    for name in started.columns:
        old = F.col(f"s.{name}")
        both = name in finished.columns and name not in keys
        out.append((F.coalesce(F.col(f"f.{name}"), old) if both else old).alias(name))
    extra = [F.col(f"f.{c}") for c in finished.columns if c not in started.columns]
    return joined.select(*out, *extra)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def hash_order(keys: Sequence[str], seed: int) -> Column:
    """52 bits of the MD5 of keys and seed as text, a hash that other engines have as well."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


#: Bits of the hash order, and of its leading part that is counted to find a sample's bound.
HASH_BITS, BOUND_BITS = 52, 12


def sample_exact(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones whatever the partitioning.

    Rows are counted by the leading bits of their hash, which bounds the hashes that can be in the sample; only the rows
    below the bound are numbered in hash order, over range partitions; no task gathers the sample.
    """
    hashed = df.withColumn("_h", hash_order(keys, seed))
    lead = F.shiftright("_h", HASH_BITS - BOUND_BITS)
    counts = dict(hashed.groupBy(lead).count().collect())
    reached, bound = 0, 0
    while reached < n and bound < 1 << BOUND_BITS:
        reached += counts.get(bound, 0)
        bound += 1
    numbered = position_in_order(hashed.filter(lead < bound), ["_h", *keys], "_position")
    return numbered.filter(F.col("_position") <= n).drop("_h", "_position")


def weighted_union(internal: DataFrame, public: DataFrame, weight: float, keys: Sequence[str],
                   seed: int = 42) -> DataFrame:
    """All internal rows plus at most ``weight`` x as many public rows, on shared columns."""
    shared = [c for c in internal.columns if c in public.columns]
    wanted = int(internal.count() * weight)
    chosen = sample_exact(public, wanted, keys, seed)
    return internal.select(*shared, F.lit("internal").alias("data_source")).unionByName(
        chosen.select(*shared, F.lit("public").alias("data_source"))
    )


def drop_series(df: DataFrame, pattern: str = "^go_.*") -> DataFrame:
    return df.filter(~F.col("metric").rlike(pattern))


def relabel(df: DataFrame, **labels: str) -> DataFrame:
    """Set label values in a ``labels`` map column."""
    extra = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    kept = F.map_filter("labels", lambda k, v: ~k.isin(list(labels)))
    return df.withColumn("labels", F.map_concat(kept, extra))
