"""Written tables in the shared folder: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="synodic-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialised(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table; ``written_at`` of the result is its path."""
    path = f"{shared_folder(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out.written_at = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes, as Spark estimates and shuffles them, that a task of small_tasks() takes, about.
TASK_BYTES = 8 << 20


def small_tasks(frame: DataFrame, *read: DataFrame) -> DataFrame:
    """The frame, in a copy of the session in which a task takes few shuffled bytes: for what makes many rows of each row of ``read``.

    The number of partitions grows with the sizes of ``read``; adaptive execution joins those that stay small.
    """
    spark = frame.sparkSession
    own, jvm = spark._jsparkSession.cloneSession(), spark.sparkContext._jvm
    sizes = [int(str(r._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for r in read]
    # a plan of unknown size tells the largest number
    partitions = min(sum(s for s in sizes if s < 1 << 62) // TASK_BYTES, 20_000)
    own.conf().set("spark.sql.shuffle.partitions", str(max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    advised = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    own.conf().set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(min(advised, TASK_BYTES)))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, frame._jdf.logicalPlan()), spark)
