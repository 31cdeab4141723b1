"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app_name: str = "frameloom") -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer, for local runs."""
    return (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FRAMELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own setting, or a temporary one where none is set.

    A temporary folder is only right where driver and executors are one process, as in tests: elsewhere a missing
    setting is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not configured and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="frameloom-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder and return it with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Remove the checkpoint of a frame that ``cut`` returned, once nothing is computed from it any more."""
    plan = df._jdf.queryExecution().logical()
    stored = plan.rdd().getCheckpointFile() if plan.nodeName() == "LogicalRDD" else None
    if stored is not None and stored.isDefined():
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(stored.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_if_counted(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A materialised join side: broadcast if it has at most so many rows, else joined by shuffle."""
    return broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A join side with its lineage cut: broadcast if it has at most so many rows, else joined by shuffle.

    For sides that are tiny in all likelihood but have no proven bound. The count is of what was really computed, so
    the other side isn't shuffled by a key of few values only to find that out.
    """
    return small_if_counted(cut(df), rows)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="frameloom-package-")) / "frameloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
