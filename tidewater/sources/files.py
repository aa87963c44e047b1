"""Small files on any file system that Hadoop knows (file:, hdfs:, viewfs:, object stores): text, listing, checksums.

Only the driver reads and writes these, and only small ones: manifests, cards, parameters, a model's files."""

from __future__ import annotations

import hashlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """The file's bytes; FileNotFoundError where there is none, ValueError where the file system's own checksum doesn't fit them."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    except Py4JJavaError as e:
        if "ChecksumException" in str(e.java_exception):
            raise ValueError(f"{path} was changed since it was written") from e
        raise
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """Write a file; without ``overwrite`` only if there is none, which the file system decides, and False if it lost."""
    fs, at = _at(spark, path)
    try:
        stream = fs.create(at, overwrite)
    except Py4JJavaError as e:
        if not overwrite and "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def folders(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, seconds since 1970 of its last change) of the folders in a folder."""
    fs, at = _at(spark, path)
    return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def tree_sha256(spark: SparkSession, path: str) -> str:
    """Checksum of the names and bytes of all files below, without the file system's own checksum files."""
    h, found = hashlib.sha256(), []
    fs, at = _at(spark, path)
    top = fs.makeQualified(at).toString().rstrip("/")

    def walk(folder):
        for s in fs.listStatus(folder):
            where = s.getPath()
            if s.isDirectory():
                walk(where)
            elif not where.getName().endswith(".crc"):
                found.append(where.toString())

    walk(at)
    for where in sorted(found):
        h.update(where[len(top) :].encode())
        h.update(read_bytes(spark, where))
    return h.hexdigest()
