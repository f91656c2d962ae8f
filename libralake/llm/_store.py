"""Where intermediate tables go: the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of a local session without the setting.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only for a local session without the setting (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="libralake-ckpt-"))
        path = _own[0]
    return path.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/libralake/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later jobs start from stable, replicated files."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """As ``materialize``, packed closer; Spark deletes the shuffle files behind the table once it is written."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch_uri(spark: SparkSession) -> str:
    """A folder for files that live as long as a task, in the shared folder."""
    return f"{_folder(spark)}/scratch-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; results that still read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
