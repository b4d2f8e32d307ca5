"""Tables written once, so that later steps see a fixed result of known size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder of its own; a cluster
    session without it is an error, because a machine-local folder would not be shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="almanac-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/almanac-{uuid.uuid4().hex}"


def _delete_at_the_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete a written table when the session's JVM ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def settle(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written table.

    The rows then survive the loss of executors and are not computed again by each user.
    Spark also knows the true size of the table, so it broadcasts it in a join only when it
    is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise. The files go
    when the session ends. ``compression`` names a Parquet codec other than that of the session.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path, compression=compression)
    _delete_at_the_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
