"""Text and code conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _int(c: Column) -> Column:
    """Whole number text, else null."""
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("bigint"))


def clock_seconds(text) -> Column:
    """HH:MM:SS, MM:SS or SS as seconds; anything else 0."""
    p = F.split(_c(text), ":")
    n = F.size(p)
    at = lambda i: _int(F.get(p, F.lit(i)))
    value = (
        F.when(n == 3, at(0) * 3600 + at(1) * 60 + at(2))
        .when(n == 2, at(0) * 60 + at(1))
        .otherwise(at(0))
    )
    return F.coalesce(value, F.lit(0))


def memory_bytes(text) -> Column:
    """Sizes like 512K, 1.5G, 10MB or plain bytes; bad input 0."""
    t = F.replace(F.upper(_c(text)), F.lit("B"), F.lit(""))
    number = lambda unit: F.replace(t, F.lit(unit), F.lit("")).try_cast("double")
    value = (
        F.when(t.contains("K"), number("K") * 1024)
        .when(t.contains("M"), number("M") * 1024 ** 2)
        .when(t.contains("G"), number("G") * 1024 ** 3)
        .otherwise(_int(t))
    )
    return F.coalesce(value.try_cast("bigint"), F.lit(0))


def cpu_minutes(text) -> Column:
    """Minutes from the last two parts of a CPU time; the hours part is not used."""
    p = F.split(_c(text), ":")
    n = F.size(p)
    minutes, seconds = _int(F.get(p, n - 2)), _int(F.get(p, n - 1))
    return F.coalesce(F.when(n >= 2, (minutes * 60 + seconds) / F.lit(60.0)), F.lit(0.0))


def job_type_from_name(name) -> Column:
    """First keyword group found in the job name."""
    n = F.lower(_c(name))
    return (
        F.when(n.rlike("cpu|compute|calc"), "cpu_intensive")
        .when(n.rlike("io|read|write|copy"), "io_intensive")
        .when(n.rlike("mixed|hybrid"), "mixed_workload")
        .otherwise("unknown")
    )


def job_type_from_usage(cpu, memory, io) -> Column:
    cpu, memory, io = _c(cpu), _c(memory), _c(io)
    return (
        F.when((cpu > 70) & (memory < 50), "cpu_intensive")
        .when((memory > 70) & (cpu < 50), "memory_intensive")
        .when(io > 50, "io_intensive")
        .when((cpu > 40) & (memory > 40), "mixed")
        .otherwise("light")
    )


# Codes of the job state gauge and of job types in requests (fixed values).
STATE_CODES = {"PENDING": 0, "RUNNING": 1, "COMPLETED": 2, "FAILED": 3, "CANCELLED": 3}
JOB_TYPE_CODES = {"cpu_intensive": 0, "cpu": 0, "io_intensive": 1, "io": 1, "mixed": 2, "memory_intensive": 3, "memory": 3}


def _coded(column: Column, codes: dict[str, int], default: int) -> Column:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), F.lit(default))


def state_code(state) -> Column:
    return _coded(_c(state), STATE_CODES, 0)


def job_type_code(job_type) -> Column:
    return _coded(F.lower(_c(job_type)), JOB_TYPE_CODES, 2)


def state_from_exit(code) -> Column:
    return F.when(_c(code) != 0, "FAILED").otherwise("COMPLETED")


# Accepted range and default of each request field (fixed values).
REQUEST_LIMITS = {
    "duration_seconds": (1.0, 86400.0, 300.0),
    "cpu_usage_percent": (0.0, 100.0, 50.0),
    "memory_usage_percent": (0.0, 100.0, 30.0),
    "io_read_mbps": (0.0, 1000.0, 10.0),
    "io_write_mbps": (0.0, 1000.0, 5.0),
    "cpu_cores": (1.0, 64.0, 4.0),
}


def clamped(field: str, column=None) -> Column:
    low, high, default = REQUEST_LIMITS[field]
    value = F.coalesce(_c(field if column is None else column).cast("double"), F.lit(default))
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


# The message formats and error words of the logs.
ENERGY_LINE = r"^Energy: (\d+\.\d+) (\w+), Job: (\d+), Node: (\w+)"
THERMAL_LINE = r"^Thermal event: (\w+), Temperature: (\d+\.\d+)°C, Sensor: (\w+)"
ERROR_WORDS = r"(?i)(ERROR|CRITICAL|FATAL|Exception|Traceback)"


def _groups(text: Column, pattern: str, names: list[str]) -> dict[str, Column]:
    hit = text.rlike(pattern)
    return {n: F.when(hit, F.regexp_extract(text, pattern, i + 1)) for i, n in enumerate(names)}


def energy_fields(message) -> dict[str, Column]:
    out = _groups(_c(message), ENERGY_LINE, ["energy_value", "energy_unit", "job_id", "node_name"])
    return out | {"energy_value": out["energy_value"].try_cast("double")}


def thermal_fields(message) -> dict[str, Column]:
    out = _groups(_c(message), THERMAL_LINE, ["event_type", "temperature", "sensor_name"])
    return out | {"temperature": out["temperature"].try_cast("double")}
