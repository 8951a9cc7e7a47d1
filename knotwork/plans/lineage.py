"""Tables that cut lineage, kept in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of the machine's own only where none is set and the master is local (tests). On a cluster each executor would write to a disk of its own, so there it must be set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="knotwork-"))
    return where.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """A path as Hadoop knows it, and the file system that it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; what is there is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/knotwork/{name}-{uuid.uuid4().hex}"
    p, fs = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def keep(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write df as Parquet under the shared folder; give it reread, and its path for drop()."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that keep() wrote and that nothing reads any more."""
    for path in paths:
        p, fs = file_system(spark, path)
        fs.delete(p, True)
