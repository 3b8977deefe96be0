"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", app: str = "medloom", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if master.startswith("local"):
        # a cluster's own setting holds there; adaptive execution joins what is too small
        defaults["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The application's folder under ``spark.checkpoint.dir``. Only where that is unset and everything runs on one machine
    a temporary one; on a cluster that would be a folder of each machine's own, so there it is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        configured = context.getConf().get("spark.checkpoint.dir")
        if not configured and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="medloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A path of its own in the shared folder for files that an operator writes and reads; deleted when the application ends."""
    path = f"{_shared_folder(spark)}/files-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the cluster's shared checkpoint folder and read it from there.

    That ends its lineage, survives the loss of an executor and, unlike a checkpointed plan, carries true sizes: a
    checkpoint keeps its plan's estimate, which self-joins square from round to round until planning takes longer than
    running. The table is deleted when the application ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._medloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``cut`` that nothing reads any more."""
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._medloom_path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def recut(old: DataFrame, new: DataFrame) -> DataFrame:
    """``cut(new)``, after which ``old``, a table that only ``new`` reads, is deleted."""
    out = cut(new)
    discard(old)
    return out


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def default_data() -> str:
    """Folder of the smallest test tables."""
    return os.environ.get("MEDLOOM_DATA", "/root/testdata/sf0.001")
