"""Folders for intermediate tables, where every executor and the driver see them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of this machine only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(frame: DataFrame, name: str) -> DataFrame:
    """frame written once to the shared folder and read back, so its lineage ends there."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def filesystem(path: str):
    """The store of a path and the path in it, for executors that open files themselves. Stores that Arrow doesn't know are an error."""
    import pyarrow.fs as pafs

    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", re.sub("^file:/(?!/)", "file:///", path)))


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """The content of a small file in any store, or None where there is none."""
    fs, where = _hadoop(spark, path)
    if not fs.exists(where):
        return None
    source = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    finally:
        source.close()


def put_if_absent(spark: SparkSession, path: str, content: bytes) -> bool:
    """Write a small file unless there is one of that name; whether it was written. Of several writers one succeeds.

    The content is written aside and put in place in one step: by a link on a local disk, else by a rename that doesn't
    overwrite, which is what the store has to offer.
    """
    fs, where = _hadoop(spark, path)
    aside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    fs.mkdirs(where.getParent())
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(aside), False)
    out.write(bytearray(content))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: Path(unquote(urlparse(p).path))
            os.link(local(aside), local(path))
        else:
            jvm = spark._jvm
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            files.rename(jvm.org.apache.hadoop.fs.Path(aside), where, options)
        return True
    except FileExistsError:
        return False
    except Exception as error:
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    finally:
        remove(spark, aside)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever store it is in."""
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)
