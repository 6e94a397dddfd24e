"""Files of whatever store a path names, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def open_path(spark: SparkSession, path: str):
    """(path, file system) as Hadoop's objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
