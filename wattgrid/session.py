"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wattgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; ``conf`` overrides them.

    ``spark.sql.shuffle.partitions`` is left to the cluster: adaptive execution
    merges small partitions from whatever starting number is configured.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folders written in place of lineage by this process.
_WRITTEN: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking it from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: on a
    cluster the folder must be shared, so a missing setting is an error there.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="wattgrid-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


#: Bytes of a row group, for tables whose rows are costly to work on: a reading task takes whole groups.
SMALL_GROUPS = 2 << 20


def checkpointed(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from that table.

    Unlike a plain checkpoint the table is read by column and has a known size.
    """
    path = own_folder(df.sparkSession, "tables", uuid.uuid4().hex)
    df.write.options(**{"parquet.block.size": group_bytes} if group_bytes else {}).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._own_folder = path
    return table


def written_so_far() -> list[str]:
    """Folders that are written and not yet deleted."""
    return list(_WRITTEN)


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete ``checkpointed`` tables, or folders, that nothing reads any more, and let Spark clean the shuffles of finished steps.

    Shuffle files go when the driver collects the plans that made them, which on its own happens only now and then.
    """
    for table in tables:
        path = table if isinstance(table, str) else table._own_folder
        if path in _WRITTEN:
            _delete(spark, path)
            _WRITTEN.remove(path)
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def own_folder(spark: SparkSession, *names: str) -> str:
    """A folder below the checkpoint folder that ``release`` deletes."""
    path = "/".join((ensure_checkpoint_dir(spark), *names))
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete what earlier queries wrote to the checkpoint folder, once their results are no longer read."""
    count = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return count
