"""Folders of the store that Spark reads, listed and removed through Spark's own file systems (any store)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    size: int
    modified_ms: int
    folder: bool


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def entries(spark: SparkSession, path: str) -> list[Entry]:
    """What a folder holds (a file: itself), by name; nothing if it doesn't exist."""
    fs, where = _open(spark, path)
    if not fs.exists(where):
        return []
    found = [Entry(s.getPath().getName(), s.getPath().toString(), s.getLen(), s.getModificationTime(), s.isDirectory())
             for s in fs.listStatus(where)]
    return sorted(found, key=lambda e: e.name)


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, where = _open(spark, path)
    fs.delete(where, True)
