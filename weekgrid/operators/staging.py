"""Cut points: write a frame once to the cluster's shared checkpoint folder and read it back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names; only a session inside one JVM may fall back to one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="weekgrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


# Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind, where the engine knows how."""
    before = {key: spark.conf.get(key, None) for key in CLEANUP}
    for key in CLEANUP:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def staged(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read from a written table: later steps may read them several times.

    A written table survives lost executors and keeps column pruning and filter pushdown, which
    cached or checkpointed rows would not. It goes with `discard`, or when the application ends.
    """
    spark = df.sparkSession
    name = f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(name)
    files, path = _path(spark, name)
    files.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(name)


def discard(table: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    spark = table.sparkSession
    folder = checkpoint_folder(spark)
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        files, path = _path(spark, name)
        root = files.makeQualified(_path(spark, folder)[1]).toString()
        if not files.makeQualified(path).toString().startswith(f"{root}/"):
            raise ValueError(f"not a staged table: {name}")
        files.delete(path, True)
