"""What a plan needs around it: cut lineage, and this package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def _base(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where it is unset, as in tests."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_siltstone_folder", None)
    if not base:
        base = sc._siltstone_folder = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path that the driver and all executors share; it goes when the session's Python ends."""
    path = f"{_base(spark)}/siltstone/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            pass

    atexit.register(clear)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder (``checkpoint`` would compute them twice)."""
    path = shared_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``checkpointed`` rows, and aggregates of them that the same pass collects."""
    seen = Observation()
    kept = checkpointed(df.observe(seen, *(c.alias(name) for name, c in measures.items())))
    return kept, seen.get


def shipped(spark: SparkSession) -> None:
    """Give Python workers this package, once for each Spark context; call it before any function of the package runs in one.

    Also safe where the executors have it installed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_siltstone_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="siltstone-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "siltstone_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for where, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._siltstone_shipped = True
