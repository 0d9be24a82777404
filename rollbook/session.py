"""Session defaults and tables written between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "rollbook", work: str | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own.

    ``work`` is its work folder, by default a new temporary one: everything a local
    session runs is on this machine.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Small local inputs would otherwise be merged into one task.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.checkpoint.dir", work or tempfile.mkdtemp(prefix="rollbook-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, and in it one of this application.

    There is no other place: a folder that executors do not share would lose its files
    with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{configured.rstrip('/')}/rollbook-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in the work folder and continue from that.

    Lineage ends there, a lost executor costs only a re-read, and the planner sees
    the true size of the result.
    """
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Removes what this application has cut; call it when the results are written or read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle a small table that is about to fan out, so the work behind it is spread.

    A fixed partition number keeps adaptive execution from merging it back by its size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
