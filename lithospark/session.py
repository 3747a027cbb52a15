"""Session settings and lineage cuts shared by every layer."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}

LOCAL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in LOCAL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", shuffle_partitions).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, unless they find it where they start.

    A cluster that got it by --py-files, and a run from the repository's folder
    or with it on PYTHONPATH, need nothing.
    """
    root = Path(__file__).resolve().parent.parent
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == root for p in places) or root.suffix == ".zip":
        return
    context = spark.sparkContext
    if _shipped.get(context.applicationId) is None:
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "lithospark"), "zip", root, "lithospark")
        context.addPyFile(archive)
        _shipped[context.applicationId] = archive


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local run may do without one; a cluster's machines share no temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = os.path.join(tempfile.gettempdir(), "lithospark-checkpoints")
    return named


#: Shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and drop its lineage, so a lost executor loses nothing.

    What was shuffled for it is not needed any more and is removed with it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Spark's limit for the bytes of a batch that Python gets at once (64 MB if it isn't set), and ours: a batch is one piece of textkernel.CHUNK then.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 7 << 19


def small_batches(spark: SparkSession) -> None:
    """From now on tasks of this session hand their rows to Python in batches of BATCH_BYTES (or one row), or less if less is set.

    A batch lies in memory several times, in the JVM as well as in a worker, and
    neither gives all of it back. The limit is read when a result is computed, so it stays.
    """
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, wherever that is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
