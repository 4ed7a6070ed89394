"""Sessions: sending this package to executors, rows written and read back."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def send_package(spark: SparkSession, root: str) -> None:
    """Makes the package importable in the session's Python workers, wherever they run. Once a session."""
    context = spark.sparkContext
    if getattr(context, "_skyloom_sent", None):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "skyloom")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    # The driver's own file server hands the archive out; executors never read this folder.
    path = os.path.join(tempfile.mkdtemp(prefix="skyloom-"), "skyloom.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    context.addPyFile(path)
    context._skyloom_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without one uses its warehouse; a cluster without one is refused, as its executors
    would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir")


def materialised(frame: DataFrame) -> DataFrame:
    """The frame's rows written to reliable shared storage (``shared_folder``) and read back, with its lineage cut.

    Spark removes the files once the frame is no longer used, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(f"{shared_folder(spark)}/checkpoints-{uuid.uuid4().hex}")
    return frame.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of shared storage that this library wrote."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
