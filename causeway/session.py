"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name under the cluster's shared checkpoint folder, as a full URI. Only local sessions may do
    without that setting: a folder of this machine is no place that other executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    uri = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{uri.rstrip('/')}/causeway-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame) -> DataFrame:
    """``stored``, and joined by sorting: a few columns of well compressed files look small enough to send whole through the driver, and aren't."""
    return stored(df).hint("merge")


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers: where PYTHONPATH doesn't have it, the package is
    sent to the executors once a context, as any Spark job sends its own modules."""
    home = Path(__file__).resolve().parent
    sc = spark.sparkContext
    on_path = any(p and Path(p).resolve() == home.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if on_path or getattr(sc, "_causeway_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "causeway.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(target))
    sc._causeway_shipped = True


def values(column) -> list:
    """An Arrow column as Python values; by way of numpy, which takes a tenth of the time, where that keeps them as they are."""
    return column.to_pylist() if column.null_count and not column.type.equals("string") else column.to_numpy(zero_copy_only=False).tolist()


#: Bytes of an Arrow batch handed to Python, so that a run of very long texts fits a worker.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch (Spark's own bound is on rows); workers can import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")
