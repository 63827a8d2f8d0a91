"""Shared folder, tables that cut lineage, and files written by executors.

A task never publishes a file by its name alone: it writes under a fresh random
name and returns that name as a row, and the rows become visible only when Spark
commits the manifest table.  A lost or repeated attempt leaves an orphan that no
manifest lists.

An operator makes its folders inside a ``scope``, which deletes them at its end but for
those that the lazy result still reads.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCOPE: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)
_PLACE = "_hanweave_folder"
#: Schemes of Hadoop's connectors that Arrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


class Scope:
    """Folders made while an operator runs, and which of them outlive it."""

    def __init__(self) -> None:
        self.made: list[str] = []
        self.kept: set[str] = set()

    def keep(self, *held: DataFrame | str) -> None:
        """Tables of ``materialise``, or folders, that the result reads."""
        self.kept |= {x if isinstance(x, str) else getattr(x, _PLACE) for x in held}


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Delete at the end what was made inside and isn't kept; the rest passes to the scope around."""
    outer, own = _SCOPE.get(), Scope()
    token = _SCOPE.set(own)
    try:
        yield own
    except BaseException:
        own.kept = set()
        raise
    finally:
        _SCOPE.reset(token)
        for path in own.made:
            if path not in own.kept:
                remove(spark, path)
            elif outer is not None:
                outer.made.append(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder, since there
    the driver and the executors are one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="hanweave-")
    return _LOCAL[key]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used; it goes with the scope around."""
    path = f"{shared_dir(spark)}/hanweave/{name}-{uuid.uuid4().hex}"
    if _SCOPE.get() is not None:
        _SCOPE.get().made.append(path)
    return path


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(out, _PLACE, path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(table: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    remove(table.sparkSession, getattr(table, _PLACE))


def make_dir(spark: SparkSession, path: str) -> None:
    """Create a folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def file_system(uri: str):
    """``(filesystem, path)`` for use inside a task; file, S3, GCS and HDFS folders work."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else "file://" + uri.removeprefix("file:"))


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write a whole file under a random name and return its URI."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex}"
    system, path = file_system(uri)
    with system.open_output_stream(path) as out:
        out.write(data)
    return uri


@contextlib.contextmanager
def new_file(folder: str, name: str):
    """``(URI, stream)`` of a file under a random name, for what is too large to hold."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex}"
    system, path = file_system(uri)
    with system.open_output_stream(path) as out:
        yield uri, out


def read_part(uri: str, at: int, size: int) -> bytes:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, at)


def read_file(uri: str) -> bytes:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        return f.read()
