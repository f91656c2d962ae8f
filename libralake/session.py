"""Sessions for local runs and tests; on a cluster the session comes from outside."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: The folder of a local session without the setting.
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder named by ``spark.checkpoint.dir``; only local sessions without the setting get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="libralake-tables-"))
        base = _own[0]
    return f"{base.rstrip('/')}/libralake/{spark.sparkContext.applicationId}"


def local_session(threads: int = 8, driver_memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution and UTC."""
    spark = (
        SparkSession.builder.master(f"local[{threads}]")
        .appName("libralake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # A copy of a task that takes over 2.2 times the median is started once four fifths are done; of no effect in local mode.
        .config("spark.speculation", "true")
        .config("spark.speculation.multiplier", "2.2")
        .config("spark.speculation.quantile", "0.8")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt to all of them; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
