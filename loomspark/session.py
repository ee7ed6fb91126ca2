"""Session factory and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "loomspark", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster use the session that it gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this package sent to its executors once, so that tasks can import it wherever they run.

    Where it is installed on all machines (see pyproject.toml) this changes nothing.
    """
    context = spark.sparkContext
    if not getattr(context, "_loomspark_shipped", False):
        folder = tempfile.mkdtemp(prefix="spark-")  # on the driver, which serves it to the executors
        with zipfile.ZipFile(f"{folder}/loomspark.zip", "w", zipfile.ZIP_DEFLATED) as out:
            package = Path(__file__).resolve().parent
            for file in sorted(package.rglob("*")):
                if file.suffix in (".py", ".txt"):
                    out.write(file, file.relative_to(package.parent))
        context.addPyFile(f"{folder}/loomspark.zip")
        context._loomspark_shipped = True
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there.

    The folder is the session's ``spark.checkpoint.dir``. Where neither that nor a folder set by hand exists, a temporary one
    is taken on a single machine, as in tests; on a cluster, whose executors would each write to their own disk, it is an error.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one in which lineage is cut: all executors share it."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
