"""Shared plumbing: the folder that all executors see, materialised tables, and shipping the package."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_scratch: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="quillon-zip-")
    target = os.path.join(folder, "quillon_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests, local runs)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _scratch:
        _scratch[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
    return _scratch[context.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    root = f"{shared_root(spark)}/quillon-{spark.sparkContext.applicationId}"
    if root not in _scratch:
        _scratch[root] = root
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone at exit; the folder then stays for the cluster's own cleaning
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: tuple[str, Any] | None = None


def worker_state(key: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks, of one operator at a time: another key drops what was held.

    Workers outlive stages; without this a vocabulary's cache would stay beside the arrays of the next operator.
    """
    global _held
    if _held is None or _held[0] != key:
        _held = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held = (key, make())
    return _held[1]


def smallest(df: DataFrame, order: Column, n: int) -> DataFrame:
    """n rows with the least ``order``, a hash. Only hashes are sorted; wide rows are then filtered by the n-th one."""
    hashes = df.select(order.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]  # one number
    return df.where(order <= F.lit(hashes)).limit(n) if hashes is not None else df.limit(0)
