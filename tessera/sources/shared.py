"""What the driver and all executors share: a folder, and this package."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession, kind: str = "tessera") -> str:
    """A new folder name below ``spark.checkpoint.dir`` (not created yet), removed when the application ends.

    Where that setting is unset, a session of one machine (master ``local``) sets it to a fresh temporary folder; any
    other session raises, as a folder of one machine would be read as empty by the others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    with contextlib.suppress(Exception):  # tidying only: a file system may not offer it
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, records: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in a shared folder, computed once. ``records``: rows of an Arrow batch meanwhile, at most; packed
    rows hold a megabyte and more each, and Spark bounds a batch by its rows only."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    before = spark.conf.get(ARROW_ROWS)
    if records:
        spark.conf.set(ARROW_ROWS, str(records))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


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
