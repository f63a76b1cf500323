"""Shared plumbing: reading tables, scratch tables that outlive executors, batching."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own switch: shuffle files go when the statement that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folders made here for local sessions, by application.
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a session on one machine, such as that of a test, gets a
    temporary folder where that is unset: executors elsewhere could not read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="wirescore-")
    return _own[context.applicationId]


def materialise(df: DataFrame, compression: str = "snappy", plain: tuple[str, ...] = (), by: str | None = None, tidy: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost
    executor costs nothing that was written. Columns in plain are not tried against a dictionary; the values of
    by, the last column, have folders of their own, so that reading one does not touch the others. If tidy, Spark deletes
    the shuffle files of the write once it is done, and not when the driver happens to collect what stands for them."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/scratch-{uuid.uuid4().hex}"
    options = {f"parquet.enable.dictionary#{c}": "false" for c in plain}
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true" if tidy else before)
    try:
        df.write.option("compression", compression).options(**options).parquet(path, partitionBy=by)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a frame made by materialise(), once nothing will read it."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to at most limit (one row at least)."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
