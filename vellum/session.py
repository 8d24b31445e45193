"""Session settings, and the shared folder that written intermediate tables go to."""

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Document bodies are large: batches handed to Python are cut by bytes, not only by rows.
ARROW_BYTES = 16 * 1024 * 1024


class SharedFolderMissing(RuntimeError):
    """A cluster's session names no folder that all executors share."""


def session(app: str = "vellum", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(limit_batches(builder.getOrCreate()))


def limit_batches(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """This package on every Python worker, once per Spark context, as `--py-files` would put it."""
    context = spark.sparkContext
    if getattr(context, "_vellum_shipped", False):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="vellum-"), "vellum.zip")
    with zipfile.ZipFile(archive, "w") as zipped:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zipped.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)
    context._vellum_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from the session.

    Where none is set, a process that is driver and executor in one (a local master) gets a temporary one, removed
    when it ends; on a cluster, where each machine would write to a disk of its own, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise SharedFolderMissing(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir() or folder
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, so that runs never meet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """`frame` as a table in the shared folder: lineage ends there and survives a lost executor."""
    spark = frame.sparkSession
    folder = fresh_folder(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)
