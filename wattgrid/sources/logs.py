"""Log lines: structured, multi-line and energy logs; enrichment and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattgrid.functions import parse as Q
from wattgrid.operators.scans import hash_order

# The record layout of the log files.
RECORD_START = r"^\[\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}\]"
RECORD = r"(?s)^\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3})\] \[(\w+)\] (.*)"


def read_json_log(spark: SparkSession, path: str, schema: str, time_key: str = "timestamp",
                  time_format: str = "yyyy-MM-dd HH:mm:ss", streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return json_log_time(reader.schema(schema).json(path), time_key, time_format)


def json_log_time(df: DataFrame, time_key: str, time_format: str) -> DataFrame:
    return df.withColumn("time", F.try_to_timestamp(F.col(time_key), F.lit(time_format)))


def parse_energy_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Sample lines of an energy log: comments and blanks skipped, first five fields."""
    kept = lines.filter(~F.col(column).startswith("#") & (F.trim(column) != ""))
    f = F.split(column, ",")
    number = lambda i: F.get(f, F.lit(i)).try_cast("double")
    others = [c for c in lines.columns if c != column]
    return kept.select(
        *others, F.get(f, F.lit(0)).alias("timestamp"), number(1).alias("cpu_usage"), number(2).alias("memory_usage"),
        number(3).alias("cpu_temp"), number(4).alias("power_estimate"))


def read_energy_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_energy_log(spark.read.text(path))


def log_energy(samples: DataFrame, seconds: str, keys: list[str]) -> DataFrame:
    """Mean and peak power and temperature over all samples of a log, and Wh for its duration."""
    n = F.count(F.lit(1))
    power = F.coalesce(F.sum("power_estimate"), F.lit(0.0)) / n
    return samples.groupBy(*keys, seconds).agg(
        power.alias("avg_power"), F.coalesce(F.max("power_estimate"), F.lit(0.0)).alias("peak_power"),
        (F.coalesce(F.sum("cpu_temp"), F.lit(0.0)) / n).alias("avg_temp"),
        F.coalesce(F.max("cpu_temp"), F.lit(0.0)).alias("peak_temp"),
    ).withColumn("energy_wh", F.col("avg_power") * F.col(seconds) / 3600)


def read_multiline_log(spark: SparkSession, path: str) -> DataFrame:
    """Records that start at ``[time]`` and go on over the lines up to the next start.

    Lines are numbered by (file, block, position in the block).  Each block only
    counts its own starts; a prefix sum over blocks gives the record number, so a
    big file is never put into one window.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("_start", F.col("value").rlike(RECORD_START).cast("int"))
    blocks = lines.groupBy("file", "block").agg(F.sum("_start").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.join(blocks, ["file", "block"]).withColumn("record", F.col("_before") + F.sum("_start").over(inside))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda r: r["value"]), "\n")
    # Lines before the first start are no record; each stays a row of its own.
    alone = F.when(F.col("record") == 0, F.col("at"))
    records = numbered.groupBy("file", "record", alone.alias("_alone")).agg(text.alias("text")).drop("_alone")
    return split_record(records)


def split_record(records: DataFrame) -> DataFrame:
    """Time, level and message of a record's text; other text keeps only its message."""
    hit = F.col("text").rlike(RECORD)
    part = lambda i: F.when(hit, F.regexp_extract("text", RECORD, i))
    return records.withColumns({
        "time": F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")), "level": part(2),
        "message": F.coalesce(part(3), F.col("text"))}).drop("text")


def unwrap_json(df: DataFrame, schema: str, column: str = "log") -> DataFrame:
    """Fields of the JSON held in ``column`` beside the other columns."""
    return df.withColumn("_j", F.from_json(column, schema)).select(*[c for c in df.columns if c != column], "_j.*")


def enrich(df: DataFrame, log_type: str, time: str = "time", **fields: str) -> DataFrame:
    """Add the caller's constant ``fields``, the log type and the record's time as epoch seconds."""
    fixed = {**fields, "log_type": log_type}
    epoch = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000.0
    return df.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"parsed_time": epoch})


def energy_messages(df: DataFrame, column: str = "message") -> DataFrame:
    return df.withColumns(Q.energy_fields(column))


def thermal_messages(df: DataFrame, column: str = "message") -> DataFrame:
    return df.withColumns(Q.thermal_fields(column))


def route_errors(df: DataFrame, column: str = "message") -> DataFrame:
    """Mark records as error or normal; none are dropped."""
    return df.withColumn("route", F.when(F.col(column).rlike(Q.ERROR_WORDS), "error").otherwise("normal"))


def one_in(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """A repeatable one-in-n sample of high-volume records."""
    return df.filter(F.pmod(hash_order(columns, 42), F.lit(n)) == 0)
