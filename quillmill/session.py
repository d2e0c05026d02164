"""Session helpers: where tables are, where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; on a cluster everything else comes from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table; for costly Python its rows can be spread over all cores where the scan has fewer tasks than there are cores.

    Only the number of tasks depends on that, never a result; a large table has tasks enough and isn't shuffled.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not spread:
        return df
    try:
        cores, tasks = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    except (AttributeError, NotImplementedError):  # Spark Connect doesn't tell
        return df
    return df.repartition(cores) if tasks < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; a folder of our own only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set; name a folder all executors share")
        named = tempfile.mkdtemp(prefix=f"quillmill-{os.getpid()}-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: survives the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """As cut, by a table in the same folder: for loops. A checkpoint carries its plan's size estimate on, which joins multiply in every round."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._qm_settled = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table of a settled DataFrame that nothing reads any more."""
    jvm, path = df.sparkSession._jvm, df._qm_settled
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
