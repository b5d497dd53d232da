"""Session settings and the folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch. Texts are long, and 10,000 of them at once would fill a worker.
BATCH_BYTES = 8 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine runs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tickerloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def bounded_batches(spark: SparkSession) -> None:
    """Have this session cut Arrow batches by bytes, too; called by every operator that sends texts to Python."""
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def durable_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh one only in local runs."""
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="tickerloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _application_folder(spark: SparkSession) -> str:
    return f"{durable_folder(spark)}/tickerloom-{spark.sparkContext.applicationId}"


def drop_durable_tables(spark: SparkSession) -> None:
    """Remove what this application wrote; DataFrames built on it can't be read afterwards."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def durable_path(spark: SparkSession) -> str:
    """A new folder beside the durable tables, for a layout of one's own."""
    return f"{_application_folder(spark)}/{uuid.uuid4().hex}"


def durable_table(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so later stages see fixed rows.

    Needed where a value depends on how rows were spread over tasks: a lost
    executor then re-reads the same numbers instead of working out new ones.
    The tables of an application lie in one folder; ``drop_durable_tables`` removes it.
    """
    spark = df.sparkSession
    path = durable_path(spark)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
