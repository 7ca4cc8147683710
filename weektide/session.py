"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffle partitions, turns joins into broadcast joins on
# measured sizes and splits skewed join partitions, so none of that is hand-set.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Columns do not record the Python line they come from; building plans is faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "weektide", checkpoints: str | None = None
) -> SparkSession:
    """Session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    return (
        builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = f"{tempfile.gettempdir()}/weektide-{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """New folder below the one of this application, for state and written tables."""
    return f"{application_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/weektide-{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Remove what this application has stored, when its frames are no longer needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")
