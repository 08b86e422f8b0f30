"""Session factory and the shared-folder helper that cuts lineage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset (tests, local runs).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/threadlode"

#: What the JVM hands to a Python worker at a time; documents may be very long, so the bytes count.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def build_session(app: str = "threadlode", cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings every query assumes (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH["spark.sql.execution.arrow.maxRecordsPerBatch"])
        .config("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH["spark.sql.execution.arrow.maxBytesPerBatch"])
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local default."""
    return (spark.conf.get("spark.checkpoint.dir", None) or LOCAL_CHECKPOINTS).rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; never reused, so a lost executor's retry cannot clash."""
    return f"{shared_dir(spark)}/threadlode-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a durable lineage cut."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now and not whenever the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application, so that they needn't have it installed,
    and bound the batches that they are sent, where the session doesn't say how."""
    for key, value in ARROW_BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    own = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # executors fetch the archive from the driver as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    clean = shutil.copytree(own, Path(folder, "copy", own.name), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(folder, own.name)), "zip", clean.parent))
