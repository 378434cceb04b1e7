"""Flags, severities and advice rows derived from measurements by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, rules: list[tuple[Column, dict[str, Column]]], keep: list[str]) -> DataFrame:
    """One output row per rule that holds for an input row."""
    cells = [F.when(cond, F.struct(*[v.alias(n) for n, v in out.items()])) for cond, out in rules]
    return df.select(*keep, F.inline(F.filter(F.array(*cells), lambda r: r.isNotNull())))


def is_throttled(mhz: Column, max_mhz: Column) -> Column:
    return F.coalesce(F.try_divide(mhz, max_mhz) < 0.8, F.lit(False))


def is_hot(temp: Column, limit: Column | float = 85.0) -> Column:
    return temp > 0.9 * limit


# Warning and critical temperatures (fixed values).
HEAT_LIMITS = {"cpu": (75.0, 85.0), "gpu": (80.0, 90.0)}


def heat_events(samples: DataFrame, component: str = "cpu", column: str = "cpu_temp") -> DataFrame:
    """Samples above the warning temperature as thermal event rows."""
    warn, critical = HEAT_LIMITS[component]
    temp = F.col(column)
    worst = temp > critical
    return samples.filter(temp > warn).select(
        "time", "node_id",
        F.when(worst, "temperature_critical").otherwise("temperature_warning").alias("event_type"),
        F.lit(component).alias("component"), temp.alias("temperature"),
        F.when(worst, F.lit(critical)).otherwise(F.lit(warn)).alias("threshold"),
        F.when(worst, "critical").otherwise("warning").alias("severity"),
    )


def bottlenecks(summary: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (type, severity) for avg_cpu, avg_memory, throttling_events and efficiency_score."""
    row = lambda kind, severity: {"type": F.lit(kind), "severity": F.lit(severity)}
    return _rows(summary, [
        (F.col("avg_cpu") > 90, row("cpu", "high")),
        (F.col("avg_memory") > 85, row("memory", "high")),
        (F.col("throttling_events") > 0, row("thermal", "critical")),
        (F.col("efficiency_score") < 60, row("energy_efficiency", "medium")),
    ], keep)


def optimisations(summary: DataFrame, keep: list[str]) -> DataFrame:
    """Advice with saved energy and money, from load, efficiency and disk traffic."""

    def advice(kind: str, priority: str, percent: float, effort: str) -> dict[str, Column]:
        saved = F.col("avg_power") * percent / 100
        return {"category": F.lit(kind), "priority": F.lit(priority), "savings_percent": F.lit(percent),
                "effort": F.lit(effort), "savings_wh": saved * F.col("duration_seconds") / 3600,
                "savings_usd": saved * 0.12 / 1000}

    return _rows(summary, [
        (F.col("avg_cpu") > 90, advice("cpu", "high", 15.0, "medium")),
        (F.col("avg_memory") > 80, advice("memory", "high", 10.0, "medium")),
        (F.col("efficiency_score") < 70, advice("energy_efficiency", "medium", 20.0, "easy")),
        (F.col("disk_total_mb") > 1000, advice("io", "medium", 12.0, "medium")),
    ], keep)


def thermal_advice(summary: DataFrame, keep: list[str]) -> DataFrame:
    avg, peak = F.col("avg_temp"), F.col("max_peak")
    row = lambda level, text: {"level": F.lit(level), "advice": F.lit(text)}
    return _rows(summary, [
        (avg > 80, row("high_average", "improve cooling")),
        ((avg > 70) & (avg <= 80), row("moderate_average", "watch thermal performance")),
        (avg <= 70, row("good_average", "keep current cooling")),
        (peak > 90, row("critical_peak", "optimise cooling now")),
        ((peak > 85) & (peak <= 90), row("high_peak", "spread the workload")),
    ], keep)


def validation_advice(metrics: DataFrame) -> DataFrame:
    """Advice rows for components (component, r2, mape); one general row if none applies."""
    comp, r2, mape = F.col("component"), F.col("r2"), F.col("mape")
    known = r2.isNotNull() & ~F.isnan(r2)
    row = lambda text: {"advice": F.lit(text)}
    found = _rows(metrics, [
        (known & (comp == "energy") & (r2 < 0.7), row("improve power models or features")),
        (known & (comp == "energy") & (mape > 20), row("review workload characterisation")),
        (known & (comp == "thermal") & (r2 < 0.6), row("improve thermal dynamics")),
        (known & (comp == "performance") & (r2 < 0.8), row("review scheduling and contention")),
    ], ["component"])
    counted = found.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return found.unionByName(counted.select(
        F.lit("all").alias("component"), F.lit("fine-tune for specific uses").alias("advice")))


def cluster_advice(summary: DataFrame, keep: list[str]) -> DataFrame:
    """Advice by group from cpu_percent, memory_percent, predicted_energy and bottlenecks."""
    row = lambda group, kind: {"advice_group": F.lit(group), "type": F.lit(kind)}
    return _rows(summary, [
        (F.col("high_bottlenecks") > 0, row("performance_optimizations", "bottleneck")),
        (F.col("predicted_energy") > 1000, row("energy_optimizations", "high_energy_consumption")),
        (F.col("cpu_percent") > 80, row("scheduling_recommendations", "cpu_overutilization")),
        (F.col("memory_percent") > 85, row("hardware_recommendations", "memory_upgrade")),
    ], keep)
