"""Folders that driver and executors share, through Hadoop's file systems."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str = "retail") -> str:
    """A new folder below ``spark.checkpoint.dir``, which goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tillroll-")
    path = os.path.join(shared, f"{name}-{uuid.uuid4().hex}")
    files = file_system(spark, path)
    files.mkdirs(hadoop_path(spark, path))  # only what exists can be registered
    files.deleteOnExit(hadoop_path(spark, path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    return file_system(spark, path).exists(hadoop_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of what is directly inside a folder; none if there is no such folder."""
    if not exists(spark, folder):
        return []
    return [s.getPath().getName() for s in file_system(spark, folder).listStatus(hadoop_path(spark, folder))]


def remove(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(hadoop_path(spark, path), True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, which appears whole: it is written beside and renamed."""
    files, beside = file_system(spark, path), hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(beside, hadoop_path(spark, path)):
        files.delete(beside, False)
        if not exists(spark, path):
            raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    data = file_system(spark, path).open(hadoop_path(spark, path))
    text = bytes(data.readAllBytes()).decode()
    data.close()
    return text
