"""Session settings that the operators rely on, and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results; anything about sizes and memory is left to the cluster.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.orc.impl": "native",
    "spark.sql.caseSensitive": "false",
}

#: The JVM compiles no method of more than so many bytes of code; beyond it, expressions are better generated in parts.
CODEGEN = {"spark.sql.codegen.hugeMethodLimit": "8000"}

#: Settings that only change speed; a cluster may override them.
SPEED = CODEGEN | {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.orc.filterPushdown": "true",
}


#: The paths given out by `fresh_path`.
_made: list[str] = []


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass the cluster's own session around instead."""
    conf = SEMANTICS | SPEED | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cores}]").appName("lamella").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can reach.

    Where the setting is absent, a local master gets a temporary folder of its own; on a cluster that would not be shared, so an error is raised.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_lamella_folder", None)
    if made is None:
        folder = tempfile.mkdtemp(prefix="lamella-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        made = "file://" + folder
        spark._lamella_folder = made
        spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that no other call gets. What is written there stays until `clear`, as Spark reads it lazily."""
    path = os.path.join(shared_folder(spark), f"{what}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever Hadoop reaches it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has written to the shared folder. Call it when no result that was read from there is needed any more."""
    while _made:
        removed(spark, _made.pop())


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends here, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, by a hash of the key in as many partitions as there are cores, if it is read in fewer.

    For work that takes far longer than moving the rows. A table that is large, or that comes out of a shuffle, stays as it is; results don't depend on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan") or plan.execute().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
