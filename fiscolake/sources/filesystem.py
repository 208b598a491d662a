"""Folders on whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), named


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder, or any match of a pattern, is there, on whatever
    file system the path names."""
    system, named = _file_system(spark, path)
    found = system.globStatus(named)
    return found is not None and len(found) > 0


def delete_folder(spark: SparkSession, path: str) -> None:
    system, named = _file_system(spark, path)
    system.delete(named, True)


def move_file(spark: SparkSession, path: str, to: str) -> None:
    system, named = _file_system(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    system.mkdirs(target.getParent())
    system.rename(named, target)
