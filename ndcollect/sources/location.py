"""Locations, and small files through Spark's file systems, so that every store Spark reads will do."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession

from ..errors import SourceError

#: Schemes of object stores and web servers that a location may have. Fixed values.
REMOTE_SCHEMES = ("s3", "s3a", "gs", "gcs", "az", "adl", "abfs", "abfss", "azure", "http", "https")
#: Schemes that Spark's own file systems add.
SPARK_SCHEMES = ("hdfs", "viewfs", "wasb", "wasbs")
#: What Hadoop calls stores that go by several names.
HADOOP_NAMES = {"s3": "s3a", "gcs": "gs", "az": "abfs", "azure": "abfs"}
#: Store options and the settings of Hadoop's S3 file system for one bucket.
_BUCKET_SETTINGS = {"region": "endpoint.region", "endpoint": "endpoint", "access_key_id": "access.key", "secret_access_key": "secret.key", "session_token": "session.token"}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+):(?=/|$)")
#: File systems whose rename replaces the target in one step; the others replace an object when it is closed.
_RENAMING = ("", "file", "hdfs", "viewfs")


def resolve(location: Any) -> str:
    """A path or URI as Spark takes it, from text, bytes or a path object. A location without a scheme is a path."""
    text = os.fsdecode(location) if isinstance(location, (bytes, os.PathLike)) else str(location)
    found = _SCHEME.match(text)
    scheme = found[1].lower() if found else ""
    if scheme and scheme != "file":
        if scheme not in REMOTE_SCHEMES + SPARK_SCHEMES:
            raise SourceError(f"no file system for {text!r}: the scheme {scheme} is none of file, {', '.join(REMOTE_SCHEMES + SPARK_SCHEMES)}")
        return HADOOP_NAMES.get(scheme, scheme) + text[found.end(1) :]
    return "file://" + re.sub(r"^file:(//[^/]*)?(?=/)", "", text) if scheme else text


def use(spark: SparkSession, location: Any, options: dict[str, Any]) -> str:
    """The resolved location, with store options (``region``, ``endpoint``, keys, ``skip_signature``) in force for its
    bucket alone; any other option is taken as a setting of Hadoop's file systems."""
    path = resolve(location)
    bucket = re.match(r"s3a://([^/]+)", path)
    conf = spark._jsc.hadoopConfiguration()
    for name, value in options.items():
        if value is None:
            continue
        if name in _BUCKET_SETTINGS or name in ("skip_signature", "anonymous"):
            if bucket is None:
                raise SourceError(f"the store option {name} has no meaning for {path}")
            if name in _BUCKET_SETTINGS:
                conf.set(f"fs.s3a.bucket.{bucket[1]}.{_BUCKET_SETTINGS[name]}", str(value))
            elif value:
                conf.set(f"fs.s3a.bucket.{bucket[1]}.aws.credentials.provider", "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider")
        elif name.startswith("fs."):
            conf.set(name, str(value))
        else:
            raise SourceError(f"unknown store option {name!r}")
    return path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null if there is none."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytearray(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def _put(fs: Any, p: Any, data: bytes) -> None:
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    p, fs = _fs(spark, path)
    _put(fs, p, data)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; at every moment readers see the old one or the new one, whole.

    Where rename replaces, the file is written beside its place and renamed over it in one call; object stores
    replace an object when its writing is closed.
    """
    p, fs = _fs(spark, path)
    if fs.getScheme() not in _RENAMING:
        _put(fs, p, text.encode("utf-8"))
        return
    part, _ = _fs(spark, f"{path}.part")
    _put(fs, part, text.encode("utf-8"))
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    p, part = fs.makeQualified(p), fs.makeQualified(part)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(part, p, over)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    p, fs = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def files(spark: SparkSession, path: str, recursive: bool = True) -> Iterator[tuple[str, int]]:
    """Paths (local ones without a scheme) and sizes of the files under a folder; nothing if it is none."""
    p, fs = _fs(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        raise SourceError(f"not a directory: {path}")
    found = fs.listFiles(p, recursive)
    while found.hasNext():
        one = found.next()
        uri = one.getPath().toString()
        yield (re.sub(r"^file:(//)?", "", uri), one.getLen())
