"""Helpers shared by the operators of this subpackage.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver can read them, so a
lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.lineage import shipped

Batches = Iterator[pa.RecordBatch]


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    ``spark.checkpoint.dir`` if the cluster sets it; a temporary folder of this
    machine only where it is unset, as in local tests.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(base)
    return base.rstrip("/") + "/siltstone"


class Scratch:
    """Intermediate tables of one run in the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._clear)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: the lineage ends at the files."""
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._siltstone_path = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            self._delete(t._siltstone_path)

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(where)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session may be gone at exit
            pass


def map_arrow(df: DataFrame, fn: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the executors."""
    shipped(df.sparkSession)
    return df.mapInArrow(fn, schema)


def plus(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` and further (name, type) fields."""
    more = [f for name, kind in fields for f in T.StructType().add(name, kind).fields]
    return T.StructType([*df.schema.fields, *more])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def where_of(docs: DataFrame, new: list[str], apply: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """The rows of ``docs`` for which the columns that ``apply`` adds meet a condition; own columns with the names of the ``new`` ones stay as they are."""
    own = {c: f"own of {c}" for c in docs.columns if c in new}
    return apply(docs.withColumnsRenamed(own)).where(condition).select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))
