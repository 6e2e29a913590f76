"""Session helpers: lineage cuts that survive executor loss, and table readers."""

from __future__ import annotations

import gc
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; a private one only in local mode where none is set, as in tests.

    On a cluster without such a folder there is nowhere all executors could see: that is an error.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="regolith-checkpoint-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", "8000")  # the driver keeps the text of every plan
    # shuffle files of the plans cut before leave the executors' disks only once the driver has dropped their objects; frames of
    # Python hang together in cycles, and hold those of the JVM
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per context, so that they need no installation or shared path.

    The driver serves the archive itself; executors, new ones included, fetch it from the driver.
    """
    context = spark.sparkContext
    if not getattr(context, "_regolith_shipped", False):
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='regolith-')}/regolith", "zip", root.parent, root.name)
        context.addPyFile(archive)
        context._regolith_shipped = True
