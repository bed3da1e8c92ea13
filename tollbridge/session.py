"""Session start-up, the shared folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def local_session(name: str = "tollbridge", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the one set for checkpoints; a temporary one
    only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="tollbridge-")
    return _own_folders[context.applicationId]


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path of its own inside this application's part of the shared folder; nothing is created yet."""
    return f"{_own_part(spark)}/{label}-{uuid.uuid4().hex}"


def _own_part(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tollbridge-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete this application's intermediate tables: once no DataFrame that reads them is used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_part(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write the rows as a parquet table in the shared folder and go on from that table.

    Later stages then re-read files instead of recomputing, so values that depend on how rows
    happened to be partitioned stay as they are when an executor is lost.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
