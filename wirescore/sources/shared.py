"""Tables and marks in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: The folders made here for local sessions, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Only a session on one machine, such as that of a test, gets a temporary folder where
    that is unset: executors elsewhere could not read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="wirescore-")
    return _own[context.applicationId]


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path within it, for use in tasks."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: made once, and read again without its lineage."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table of a frame that written() made, once nothing will read it."""
    if path := getattr(df, "_shared_path", None):
        fs, inner = filesystem(path)
        fs.delete_dir(inner)


class Mark:
    """A sign that tasks on any machine can set and see: a file in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.path = new_path(spark, "mark")

    def set(self) -> None:
        fs, inner = filesystem(self.path)
        with fs.open_output_stream(inner):
            pass

    def seen(self) -> bool:
        fs, inner = filesystem(self.path)
        return fs.get_file_info(inner).type != pafs.FileType.NotFound
