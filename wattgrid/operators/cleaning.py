"""Filling, outlier treatment, scaling, encoding, selection, sampling and augmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.operators.ordered import fill_gaps, position_in_order
from wattgrid.operators.quantiles import column_percentiles, exact_percentiles
from wattgrid.operators.scans import drop_infinite, hash_order, numeric_columns, sample_exact
from wattgrid.operators.stats import correlations, safe_corr
from wattgrid.session import checkpointed


def to_number(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; text that is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the column's exact median."""
    medians = column_percentiles(df, columns, {"median": 0.5})
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m.median)) for c, m in medians.items()})


def known_category(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns})


def iqr_filter(df: DataFrame, columns: Sequence[str], low: float = 0.15, high: float = 0.85, reach: float = 3.0,
               one_pass: bool = False) -> DataFrame:
    """Keep rows within ``reach`` x (high - low percentile) of the percentiles.

    Columns are treated one after another: the bounds of each come from the rows
    the earlier ones left, which takes one job per column and two numbers back
    on the driver.  The bounds then are literals, so the scan can use them.  Those jobs read
    a slim copy of the treated columns, written once.
    ``one_pass`` takes all bounds from the unfiltered rows instead.  Rows with a
    null in a treated column are dropped.
    """
    names = {"lo": low, "hi": high}
    fixed = column_percentiles(df, columns, names) if one_pass else {}
    slim = df if one_pass else checkpointed(df.select(*columns))
    for c in columns:
        got = fixed.get(c) or exact_percentiles(slim, c, names).first()
        if got.lo is None:
            return df.filter(F.lit(False))
        margin = reach * (got.hi - got.lo)
        inside = (F.col(c) >= got.lo - margin) & (F.col(c) <= got.hi + margin)
        df, slim = df.filter(inside), slim.filter(inside)
    return df


def upper_fence(df: DataFrame, column: str) -> Column:
    """q75 + 1.5 IQR as a scalar subquery."""
    q = exact_percentiles(df, column, {"q1": 0.25, "q3": 0.75})
    return q.select((F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("fence")).scalar()


def above_fence(df: DataFrame, column: str) -> DataFrame:
    """Count and mean of the values above the upper fence, with the fence."""
    fence = upper_fence(df, column)
    return df.filter(F.col(column) > fence).agg(
        F.count(F.lit(1)).alias("count"), F.avg(column).alias("avg_value")).withColumn("threshold", fence)


def clip_deviations(df: DataFrame, columns: Sequence[str], reach: float = 3.0) -> DataFrame:
    """Cap at mean +- ``reach`` deviations, given more than ten rows that vary."""
    stats = df.agg(F.struct(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).alias("s")).scalar()
    out = {}
    for i, c in enumerate(columns):
        mean, dev = stats[f"m{i}"], stats[f"s{i}"]
        capped = F.least(F.greatest(F.col(c).cast("double"), mean - reach * dev), mean + reach * dev)
        usable = (stats["n"] > 10) & (dev > 0) & F.col(c).isNotNull()
        out[c] = F.when(usable, capped).otherwise(F.col(c))
    return df.withColumns(out)


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / IQR from exact percentiles; a zero IQR divides by 1."""
    out = {}
    for c, q in column_percentiles(df, columns, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).items():
        if q.q2 is not None:
            out[c] = (F.col(c) - q.q2) / ((q.q3 - q.q1) or 1.0)
    return df.withColumns(out)


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores with the population deviation; a constant column divides by 1."""
    stats = df.agg(F.struct(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).alias("s")).scalar()
    return df.withColumns({
        c: (F.col(c) - stats[f"m{i}"]) / F.when(stats[f"s{i}"] == 0, 1.0).otherwise(stats[f"s{i}"])
        for i, c in enumerate(columns)})


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """Code table (value, code): sorted distinct values numbered from 0."""
    values = df.select(F.col(column).alias("value")).distinct()
    return position_in_order(values, ["value"]).select("value", (F.col("position") - 1).alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str], codes: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add ``<column>_encoded``; values missing from a given code table get its next number."""
    for c in columns:
        table = codes[c] if codes else category_codes(df, c)
        name = f"{c}_encoded"
        df = df.join(table.select(F.col("value").alias(c), F.col("code").alias(name)), c, "left")
        if codes:
            df = df.withColumn(name, F.coalesce(F.col(name), table.agg(F.max("code") + 1).scalar()))
    return df


def f_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Univariate F score of each feature: r2 / (1 - r2) * (n - 2)."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[safe_corr(c, target).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("feature"),
                      F.try_divide(F.col(c) * F.col(c) * (F.col("_n") - 2), 1 - F.col(c) * F.col(c)).alias("f_score"))
             for c in columns]
    return wide.select(F.inline(F.array(*cells)))


def best_features(df: DataFrame, columns: Sequence[str], target: str, k: int) -> list[str]:
    """Names of the ``k`` features with the highest F score (one row per feature comes back)."""
    top = f_scores(df, columns, target).orderBy(F.desc_nulls_last("f_score"), "feature").limit(k)
    return [r.feature for r in top.collect()]


def varied_features(df: DataFrame, columns: Sequence[str], min_variance: float = 0.01, max_correlation: float = 0.95) -> list[str]:
    """Features that vary, without those nearly equal to an earlier one."""
    row = df.agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    kept = [c for i, c in enumerate(columns) if (row[f"v{i}"] or 0) > min_variance]
    close = {(r.i, r.j) for r in correlations(df, kept).filter(F.abs("r") > max_correlation).collect()}
    chosen: list[str] = []
    for c in kept:
        if not any((o, c) in close for o in chosen):
            chosen.append(c)
    return chosen


def usable_jobs(df: DataFrame, min_seconds: int = 60, max_hours: int = 48) -> DataFrame:
    """Without failed and cancelled jobs and those outside the duration range."""
    return df.filter(~F.col("job_state").isin("FAILED", "CANCELLED")
                     & F.col("duration_seconds").between(min_seconds, max_hours * 3600))


def hash_split(df: DataFrame, keys: Sequence[str], test_percent: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key, the same whatever the partitioning."""
    side = F.pmod(hash_order(keys, seed), F.lit(100)) < 100 - test_percent
    return df.filter(side), df.filter(~side)


def with_noise(df: DataFrame, columns: Sequence[str], keys: Sequence[str], level: float = 0.05, share: float = 0.25,
               seed: int = 42) -> DataFrame:
    """A ``share`` as many rows, values shifted by N(0, level x value), none below 0.

    Base rows are drawn by hash order and noise comes from hashes too, so a lost
    task recomputes the same rows.
    """
    base = sample_exact(df, int(df.count() * share), keys, seed)
    noisy = {c: F.greatest(F.lit(0.0), F.col(c) * (1 + level * _normal(keys, seed + 1 + i))) for i, c in enumerate(columns)}
    return base.withColumns(noisy)


def _uniform(keys: Sequence[str], seed: int) -> Column:
    """Uniform in (0, 1) from a hash of the key."""
    return (F.pmod(hash_order(keys, seed), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(keys: Sequence[str], seed: int) -> Column:
    radius = F.sqrt(-2 * F.log(_uniform(keys, seed * 2)))
    return radius * F.cos(2 * F.pi() * _uniform(keys, seed * 2 + 1))


def interpolated(df: DataFrame, columns: Sequence[str], keys: Sequence[str], share: float = 0.125, seed: int = 42) -> DataFrame:
    """A ``share`` as many rows, each between two different rows."""
    wanted = int(df.count() * share)
    drawn = position_in_order(df.withColumn("_h", hash_order(keys, seed)), ["_h", *keys]).filter(F.col("position") <= 2 * wanted)
    drawn = drawn.withColumn("_pair", F.floor((F.col("position") - 1) / 2))
    first = drawn.filter(F.col("position") % 2 == 1)
    second = drawn.filter(F.col("position") % 2 == 0).select("_pair", *[F.col(c).alias(f"_o_{c}") for c in columns])
    share = 0.2 + 0.6 * _uniform(keys, seed + 7)
    both = first.join(second, "_pair").withColumn("_a", share)
    mixed = {c: F.col("_a") * F.col(c) + (1 - F.col("_a")) * F.col(f"_o_{c}") for c in columns}
    return both.withColumns(mixed).select(*df.columns)


def synthetic_reference(df: DataFrame, columns: Sequence[str], keys: Sequence[str], seed: int = 42,
                        bias: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows with noise of 5-15 % of the column mean, then an optional (factor, shift) per column."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
    out = {}
    for i, c in enumerate(columns):
        level = 0.05 + 0.10 * ((seed * 31 + i * 17) % 100) / 100
        noise = F.when(means[c] > 0, means[c] * level * _normal(keys, seed + i)).otherwise(0.0)
        factor, shift = (bias or {}).get(c, (1.0, 0.0))
        out[c] = F.greatest(F.lit(0.0), F.col(c) + noise) * factor + shift
    return df.withColumns(out)


def preprocess(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), *, fill: bool = True,
               outliers: bool = True, normalise: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill gaps along time and by median, drop outliers, scale: each step can be turned off.

    Each step takes statistics of the one before it, so the steps are checkpointed
    instead of being computed again for every statistic.
    """
    columns = list(columns or [c for c in numeric_columns(df) if c not in (*keys, order, *ties)])
    df = drop_infinite(df, columns)
    if fill:
        df = checkpointed(impute_median(checkpointed(fill_gaps(df, columns, keys, order, ties)), columns))
    if outliers:
        df = iqr_filter(df, columns)
        df = checkpointed(df) if normalise else df
    if normalise:
        df = robust_scale(df, columns)
    return df
