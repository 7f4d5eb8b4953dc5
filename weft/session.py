"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("weft")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


#: Bytes of a batch between Spark and a Python worker.  Rows here are whole texts and their tokens, so ten thousand of them
#: would be held several times over on both sides.
BATCH_BYTES = 1 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Batches for Python by their bytes, where the session leaves Spark's own size."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context, and set the size of their batches.

    Workers import it from there unless their own path already has it, so that neither the driver's
    folder nor an installation on the executors matters.
    """
    small_batches(spark)
    sc = spark.sparkContext
    if not getattr(sc, "_weft_shipped", False):
        here = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="weft-package-"), "weft")
        archive = shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here))
        sc.addPyFile(archive)
        sc._weft_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the cluster's ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall
    back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
    return sc.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder so that later reads see the same partitions."""
    folder = shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
