"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir): they end lineage, and outlive executors."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="harvestry-")


def shared_path(spark) -> str:
    """A new path below spark.checkpoint.dir; in a temporary folder where that is unset and Spark is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        root = _own()
    return f"{root.rstrip('/')}/harvestry-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df from a Parquet table of its own, which goes when the program ends."""
    spark = df.sparkSession
    path, had = shared_path(spark), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # shuffle files go when the table is there
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if had is None else spark.conf.set(_CLEAN, had)
    atexit.register(forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone
        return
