"""Spark session and table helpers.

Cluster settings (shuffle partitions, file split size, checkpoint directory)
come from the session the caller hands in; ``local_session`` is only for
tests, benches and the command line.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

FIXTURE_TABLES = (
    "documents", "conversations", "benchmark", "labels", "events", "pages",
)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "subseg") -> SparkSession:
    """A single-JVM session for tests and the bench (UI off, AQE on).

    The join settings are the ones recommended on a cluster too: static
    broadcast off, AQE runtime broadcast and skew-join splitting on.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # No broadcast from planner estimates (they ignore explode fan-out);
        # AQE converts a join to broadcast only from measured stage sizes.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint directory: the one already set on the context, else ``spark.checkpoint.dir``.

    A caller's choice is never overridden.  Where neither is set, a local
    session (tests) gets a private scratch folder; a cluster gets an error,
    since a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="subseg-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started: its modules go out once an application, as a zip."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="subseg-modules-"), "subseg_modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)  # Spark's own file service hands it to executors
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
