"""Session and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "codelode", cpus: int | None = None) -> SparkSession:
    """A local session with the settings the library is tuned for; an active session wins."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CODELODE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the executors share, as the session's spark.checkpoint.dir names it.

    Where none is named, a local session gets a folder of its own that goes when the program ends; on a cluster that is an error: a folder of one
    machine is no place for data that must outlive an executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="codelode-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, so that a lost executor costs no recomputation.

    The planner knows nothing of a checkpoint's size, so joins on it never become broadcasts by mistake.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
