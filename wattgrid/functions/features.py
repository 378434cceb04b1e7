"""Feature expressions; each adds what the frame's columns allow and says what it added."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Added = tuple[DataFrame, list[str]]


def _add(df: DataFrame, new: dict[str, Column]) -> Added:
    return (df.withColumns(new) if new else df), list(new)


def _has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def calendar(df: DataFrame, time: str = "time") -> Added:
    """Calendar parts (Monday is 0), their sine and cosine, business hours and weekend."""
    if time not in df.columns:
        return df, []
    hour, weekday, month = F.hour(time), F.weekday(time), F.month(time)
    turn = lambda c, n: 2 * math.pi * c / n
    new = {
        "hour": hour, "day_of_week": weekday, "day_of_month": F.dayofmonth(time), "month": month,
        "quarter": F.quarter(time), "year": F.year(time),
        "hour_sin": F.sin(turn(hour, 24)), "hour_cos": F.cos(turn(hour, 24)),
        "day_sin": F.sin(turn(weekday, 7)), "day_cos": F.cos(turn(weekday, 7)),
        "month_sin": F.sin(turn(month, 12)), "month_cos": F.cos(turn(month, 12)),
        "is_business_hours": hour.between(9, 17).cast("int"),
        "is_weekend": (weekday >= 5).cast("int"),
    }
    return _add(df, new)


def job_efficiency(df: DataFrame, energy: str = "energy_consumed_wh") -> Added:
    """Ratio features of jobs, with 1e-6 in each divisor."""
    new: dict[str, Column] = {}
    per = lambda a, b: F.col(a) / (F.col(b) + 1e-6)
    if _has(df, energy, "cpu_cores"):
        new |= {"energy_per_core": per(energy, "cpu_cores"), "power_efficiency": per("cpu_cores", energy)}
    if _has(df, "max_temp_c", energy, "cpu_cores"):
        new |= {"thermal_efficiency": per(energy, "max_temp_c"), "thermal_per_core": per("max_temp_c", "cpu_cores")}
    if _has(df, "duration_seconds", "cpu_cores"):
        new |= {"workload_intensity": F.col("cpu_cores") * F.col("duration_seconds") / 3600,
                "compute_density": per("cpu_cores", "duration_seconds")}
    if _has(df, "memory_gb", "cpu_cores"):
        new |= {"memory_per_core": per("memory_gb", "cpu_cores"),
                "resource_utilization": F.sqrt(F.col("cpu_cores") * F.col("memory_gb"))}
    if _has(df, energy, "duration_seconds"):
        new |= {"performance_per_watt": per("duration_seconds", energy),
                "power_scaling_factor": per(energy, "duration_seconds")}
    if _has(df, "max_temp_c", "duration_seconds", energy):
        new |= {"cooling_efficiency": per("duration_seconds", "max_temp_c"),
                "thermal_resistance": per("max_temp_c", energy)}
    return _add(df, new)


def powers_and_products(df: DataFrame, columns: Sequence[str] = ("cpu_cores", "memory_gb", "duration_seconds")) -> Added:
    known = [c for c in columns if c in df.columns]
    new = {}
    for c in known:
        new |= {f"{c}_squared": F.pow(c, F.lit(2)), f"{c}_log": F.log1p(c)}
    new |= {f"{a}_{b}_interaction": F.col(a).cast("double") * F.col(b) for a, b in combinations(known, 2)}
    return _add(df, new)


def job_derived(df: DataFrame) -> Added:
    """CPU hours, memory hours, effective CPU and temperature spread."""
    new: dict[str, Column] = {}
    if _has(df, "cpu_cores", "duration_seconds"):
        new["cpu_hours"] = F.col("cpu_cores") * F.col("duration_seconds") / 3600.0
    if _has(df, "memory_mb", "duration_seconds"):
        new["memory_hours"] = F.col("memory_mb").cast("double") * F.col("duration_seconds") / 3600.0
    if _has(df, "cpu_usage", "cpu_cores"):
        new["effective_cpu_usage"] = F.col("cpu_usage") * F.col("cpu_cores") / 100.0
    if _has(df, "avg_cpu_temp", "peak_cpu_temp"):
        new["temp_variance"] = F.col("peak_cpu_temp") - F.col("avg_cpu_temp")
    return _add(df, new)


def combined_efficiency(df: DataFrame) -> Added:
    """Operations per load and energy per operation; an undefined ratio is 0."""
    at = lambda c, default: F.col(c) if c in df.columns else F.lit(default)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    new = {
        "cpu_efficiency": ratio(at("cpu_operations", 0), at("cpu_percent_mean", 1) * at("duration_seconds", 1)),
        "io_efficiency": ratio(at("io_operations", 0), at("disk_read_mbps_mean", 1) + at("disk_write_mbps_mean", 1) + 1),
        "energy_per_operation": ratio(at("estimated_energy_wh", 0), at("cpu_operations", 1) + at("io_operations", 1)),
    }
    return _add(df, new)


def workload(df: DataFrame) -> Added:
    """Pressure, traffic and power ratios of node samples."""
    new: dict[str, Column] = {}
    c = F.col
    if _has(df, "cpu_usage", "cpu_cores"):
        new["cpu_efficiency"] = F.try_divide(c("cpu_usage"), c("cpu_cores") * 100)
    if _has(df, "memory_usage", "memory_total"):
        share = F.try_divide(c("memory_usage"), c("memory_total"))
        new |= {"memory_pressure": share, "memory_available_ratio": 1 - share}
    for left, right, name, first, second in (
        ("disk_read", "disk_write", "io", "read", "write"),
        ("network_in", "network_out", "network", "in", "out"),
    ):
        if _has(df, left, right):
            total = c(left) + c(right)
            new |= {f"{name}_total": total, f"{name}_{first}_ratio": c(left) / (total + 1e-8),
                    f"{name}_{second}_ratio": c(right) / (total + 1e-8)}
    if _has(df, "power_consumption", "cpu_usage"):
        new["power_per_cpu_usage"] = c("power_consumption") / (c("cpu_usage") + 1e-8)
    if _has(df, "temperature", "power_consumption"):
        new["thermal_efficiency"] = c("power_consumption") / (c("temperature") + 1e-8)
    return _add(df, new)


def interactions(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> Added:
    """Products and ratios of column pairs; with ``limit``, about so many new columns."""
    known = [c for c in columns if c in df.columns]
    new = {}
    for a, b in list(combinations(known, 2))[: limit and (limit + 1) // 2]:
        new |= {f"{a}_x_{b}": F.col(a) * F.col(b), f"{a}_div_{b}": F.col(a) / (F.col(b) + 1e-8)}
    return _add(df, new)


def polynomials(df: DataFrame, columns: Sequence[str]) -> Added:
    """Squares and pairwise products of the columns."""
    known = [c for c in columns if c in df.columns]
    new = {}
    for i, a in enumerate(known):
        new[f"poly_{a}^2"] = F.col(a) * F.col(a)
        new |= {f"poly_{a} {b}": F.col(a) * F.col(b) for b in known[i + 1:]}
    return _add(df, new)


def row_statistics(df: DataFrame, columns: Sequence[str]) -> Added:
    """Mean, population deviation, extremes, and sample-adjusted skew and kurtosis of a row."""
    known = [c for c in columns if c in df.columns]
    if len(known) < 2:
        return df, []
    n = len(known)
    values = [F.col(c).cast("double") for c in known]
    mean = sum(values[1:], values[0]) / n
    moment = lambda k: sum((_power(v - mean, k) for v in values[1:]), _power(values[0] - mean, k))
    m2, m3, m4 = moment(2), moment(3), moment(4)
    var = m2 / (n - 1)
    new = {
        "features_mean": mean, "features_std": F.sqrt(m2 / n),
        "features_min": F.least(*values), "features_max": F.greatest(*values),
        "features_range": F.greatest(*values) - F.least(*values),
    }
    if n > 2:
        new["features_skew"] = F.when(var > 0, n * m3 / ((n - 1) * (n - 2) * var * F.sqrt(var))).otherwise(0.0)
    if n > 3:
        new["features_kurtosis"] = F.when(
            var > 0,
            n * (n + 1) * m4 / ((n - 1) * (n - 2) * (n - 3) * var * var) - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)),
        ).otherwise(0.0)
    return _add(df, new)


def _power(c: Column, k: int) -> Column:
    out = c
    for _ in range(k - 1):
        out = out * c
    return out
