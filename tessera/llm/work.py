"""Shared work space: tables and files that every executor can read.

All intermediate state goes below ``spark.checkpoint.dir``, which every executor and the driver must share (see
``sources.shared`` for sessions without that setting).

The shuffle files behind a written table are removed once the table is there, and tables that have been read for the
last time are discarded, so that the disk holds what later steps still need and no more.
"""

from __future__ import annotations

import contextlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.shared import shared_folder


_SHIPPED: set[str] = set()
#: Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that Python workers find it wherever they start (once for an application)."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))  # served by the driver
    _SHIPPED.add(context.applicationId)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting that holds within the block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tessera_folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table._tessera_folder
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def file_system(uri: str):
    """(pyarrow file system, path) of a shared URI, on executors."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3://" + uri[len("s3a://"):]
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
