"""The folder that all executors share, and files of Python objects in it."""

from __future__ import annotations

import atexit
import pickle
import re
import shutil
import tempfile
import uuid
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new name in spark.checkpoint.dir, qualified by its store; a local session without that setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lexweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
    return f"{qualified(spark, found)}/{what}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """path as the session's own file systems read it: without a scheme it belongs to the default store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read back, so that it stays as it is whatever executor is lost."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, source: str) -> list[str]:
    """The paths of the files that a path, a pattern or a folder names, empty ones too, which Spark's readers pass over; names that begin
    with a dot or an underscore are not looked at in folders."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    held = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], list(held.globStatus(at) or [])
    while todo:
        status = todo.pop()
        if status.isDirectory():
            todo += [s for s in held.listStatus(status.getPath()) if s.getPath().getName()[0] not in "._"]
        else:
            out.append(status.getPath().toString())
    return sorted(out)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def opened(path: str):
    """A file at a path as Spark tells it, of which parts can be read."""
    from pyarrow import fs

    m = re.match(r"file:/*(?=/)", path)
    store, name = (fs.LocalFileSystem(), path[m.end() :]) if m else fs.FileSystem.from_uri(path)
    return store.open_input_file(name if m else unquote(name))


def put_object(folder: str, name: str, value: Any) -> None:
    """Writes an object as a file of a folder, beside and renamed, so that a repeated task does no harm."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(own := f"{root}/.{name}.{uuid.uuid4().hex}") as out:
        pickle.dump(value, out, protocol=5)
    try:
        store.move(own, f"{root}/{name}")
    except OSError:  # there is an equal one, of an earlier try
        store.delete_file(own)


def put_bytes(folder: str, suffix: str, data: bytes) -> str:
    """Writes a file of a new name to a folder and gives its path."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = uuid.uuid4().hex + suffix
    with store.open_output_stream(f"{root}/{name}") as out:
        out.write(data)
    return f"{folder}/{name}"


def objects(folder: str) -> list[Any]:
    """The objects of a folder, in the order of their names."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if not f.base_name.startswith("."))
    out = []
    for name in names:
        with store.open_input_stream(name) as held:
            out.append(pickle.loads(held.read()))
    return out
