"""Session plumbing shared by the operators: shared-folder tables and code shipping."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (tests on one machine) is a local folder set.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.sparkContext.setCheckpointDir(there)
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


#: Spark's switch for dropping a query's shuffle files when it has ended; a settled table does not need them again.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation; the shuffle
    files of the writing go when it has ended.  The table goes by :func:`release`, or when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_KEY, "false")
    spark.conf.set(CLEAN_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_KEY, before)
    at, files = _place(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            at, files = _place(df.sparkSession, df.settled_at)
            files.delete(at, True)


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_SHIPPED: set[str] = set()
#: Bytes of a batch that goes to a Python worker, where the session has not set a bound of its own.
BATCH_KEY, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, 64 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application, and keep their batches small.

    A worker's memory follows the bytes of a batch, so these are bounded and not only its rows.
    """
    if spark.conf.get(BATCH_KEY, str(BATCH_DEFAULT)).rstrip("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[2]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((top / "millrace").rglob("*.py")):
            z.write(p, p.relative_to(top))
    folder = tempfile.mkdtemp(prefix="millrace-code-")
    path = os.path.join(folder, "millrace_code.zip")
    Path(path).write_bytes(held.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
