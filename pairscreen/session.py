"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def parallelism(spark: SparkSession) -> int:
    """Reduce-side width the session was sized for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out evenly by ``key``, for an expensive step to follow,
    however many tasks the scan gives."""
    return df.repartition(parallelism(df.sparkSession), key)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A local session that names none gets its own folder; a cluster session
    must name one, because a machine-local folder is lost with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    current = context.getCheckpointDir()
    if current is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pairscreen-"))
        current = context.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str = "stage", plain: bool = False) -> DataFrame:
    """Write once and read back, so expensive upstream work (Python plug-ins,
    wide joins) runs once however often the result is used. The written table
    survives the loss of executors. ``plain`` leaves numbers as they are, so a split of the
    file has its share of what tasks hold in memory."""
    return _written(df, scratch_path(df.sparkSession, name), plain)


def _written(df: DataFrame, path: str, plain: bool) -> DataFrame:
    writer = df.write
    if plain:
        writer = writer.option("compression", "none").option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing refers to any more; without memory
    pressure on the driver they would lie there until the job ends."""
    for _ in range(2):  # the first time, listeners may still be busy with the last job
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


class Scratch:
    """Written tables of one job by name, given up as soon as nothing reads
    them any more, so the shared folder holds what is still needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._written: dict[str, tuple[str, DataFrame]] = {}

    def table(self, name: str, df: DataFrame, plain: bool = False) -> DataFrame:
        """Write ``df`` and read it back, as ``materialize`` does."""
        path = scratch_path(self.spark, name)
        out = _written(df, path, plain)
        self._written[name] = (path, out)
        return out

    def drop(self, *names: str) -> None:
        """Empty tables by overwriting them. Whatever was derived from them must
        be written by now: a lost executor's work reads its own inputs again."""
        for name in names:
            path, table = self._written.pop(name)
            self.spark.createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(path)
