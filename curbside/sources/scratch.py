"""Written intermediate results in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SHARED = "spark.checkpoint.dir"
_WAREHOUSE = "spark.sql.warehouse.dir"


class NoSharedFolderError(RuntimeError):
    """A cluster's session does not say which folder all machines reach."""


def scratch_root(spark: SparkSession) -> str:
    """The application's folder below `spark.checkpoint.dir`. A session without that setting
    gets one below its warehouse if it is local, and an error on a cluster, where the
    warehouse may be the driver's own disk. The file system removes the folder when the
    session's JVM ends."""
    shared = spark.conf.get(_SHARED, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise NoSharedFolderError(f"set {_SHARED} to a folder that all machines reach")
        shared = f"{spark.conf.get(_WAREHOUSE).rstrip('/')}/_scratch"
    root = f"{shared.rstrip('/')}/curbside-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one table, gone when the session ends."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """`df` computed once, stored, and read back: later plans start from the file,
    and losing an executor does not bring the computation back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
