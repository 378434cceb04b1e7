"""Database scans and table sinks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattgrid.operators.rollups import bucket, hourly_jobs, refresh_rows


TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def time_predicates(start: datetime, end: datetime, parts: int, column: str = "time") -> list[str]:
    """``parts`` adjoining half-open ranges over [start, end], one JDBC partition each."""
    step = (end - start) / parts
    edges = [start + step * i for i in range(parts)] + [end + timedelta(microseconds=1)]
    return [f"{column} >= '{a.isoformat(sep=' ')}' AND {column} < '{b.isoformat(sep=' ')}'" for a, b in zip(edges, edges[1:])]


def scan_jdbc(spark: SparkSession, url: str, table: str, start: datetime, end: datetime, parts: int = 32,
              columns: Sequence[str] | None = None, **properties: str) -> DataFrame:
    """Read a time range of a database table in parallel, one query per time slice."""
    df = spark.read.jdbc(url, table, predicates=time_predicates(start, end, parts), properties=properties)
    return df.select(*columns) if columns else df


def write_dataset(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Save as parquet, csv (with header) or json."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown format {kind}")
    writer = df.write.mode(mode).format(kind)
    if kind != "parquet":  # text formats would cut times to milliseconds
        writer = writer.option("timestampFormat", TIME_FORMAT)
    if kind == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_results(frames: dict[str, DataFrame], summary: DataFrame, path: str) -> None:
    """Each result as csv and parquet, and the summary as json."""
    for name, df in frames.items():
        write_dataset(df, f"{path}/{name}_csv", "csv")
        write_dataset(df, f"{path}/{name}")
    write_dataset(summary, f"{path}/summary", "json")


def read_csv(spark: SparkSession, path: str, schema: str, time_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, timestampFormat=time_format)


def start_records(jobs: DataFrame) -> DataFrame:
    """Start rows of jobs: state STARTING and no energy yet."""
    return jobs.withColumns({"job_state": F.lit("STARTING"), "estimated_energy_wh": F.lit(0.0)})


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a table partitioned by date, which later scans prune on."""
    df.withColumn("date", F.to_date("time")).write.mode("append").partitionBy("date").parquet(path)


def refresh_hourly_summary(jobs: DataFrame, path: str, as_of, start_hours: int = 3, end_hours: int = 1) -> None:
    """Recompute the summary hours inside the refresh window and replace just those."""
    rows = hourly_jobs(refresh_rows(jobs, as_of, start_hours, end_hours, "hour"))
    out = rows.withColumn("hour", F.date_format(bucket(rows, "hour", "bucket"), "yyyy-MM-dd-HH"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(path)
