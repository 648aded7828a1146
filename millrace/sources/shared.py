"""Small files beside the data, through Hadoop's file systems: local disks, HDFS and object stores alike."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.getActiveSession()
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, jvm


def exists(path: str) -> bool:
    fs, place, _ = _at(path)
    return bool(fs.exists(place))


def delete(path: str) -> None:
    """A file, or a folder with all that is in it; nothing happens if there is none."""
    fs, place, _ = _at(path)
    fs.delete(place, True)


def read_text(path: str) -> str | None:
    """The text of a file, or None if there is none."""
    fs, place, jvm = _at(path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Write beside the target, then move into place: a reader sees the old text or the new one."""
    fs, place, jvm = _at(path)
    beside = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
        stream.hsync() if hasattr(stream, "hsync") else stream.flush()
    finally:
        stream.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(beside, place):
        fs.delete(beside, False)
        raise OSError(f"could not move the report to {path}")
