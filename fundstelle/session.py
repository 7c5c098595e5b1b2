"""Session settings that the operators rely on, and the shared folder for cut lineages."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only settings that change the plan; sizes of executors belong to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("fundstelle")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_LOCAL: list[str] = []


def _base_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it names none, a folder of this machine that is removed at exit, but only for a local master:
    executors of a cluster couldn't reach it, so there it is an error."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="fundstelle-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder of the session."""
    return f"{_base_folder(spark)}/{uuid.uuid4()}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a path that ``shared_folder`` gave, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers of a cluster where it isn't installed; without it, no function in Python could be loaded there."""
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="fundstelle-")) / "fundstelle"), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Files of a checkpoint go when nothing refers to it any more if the cluster sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``local_session`` does.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_base_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a narrow table that are sent to all executors at most; at some 100 bytes a row, 20 MB.
SMALL_ROWS = 200_000


def small_side(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` written once, and marked for broadcast only if it has at most ``most`` rows; else Spark joins by shuffling."""
    written = cut_lineage(df)
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written
