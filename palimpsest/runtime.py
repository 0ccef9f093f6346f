"""Session-level plumbing that every operator shares: lineage cuts, parallelism, table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (unit tests, a laptop) a folder of this machine is taken;
    on a cluster without the setting that would lose data with an executor, so it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"palimpsest-{os.getuid()}")


class Scratch:
    """Tables written in the shared folder to cut lineage; they survive the loss of an executor.

    Results are read from them, so the folder stays until the driver ends, which deletes it.
    ``lean`` is for plans of dozens of tables, whose steps else fill the driver: what is read back is joined by merging,
    never broadcast by way of the driver, and after each table the driver collects its garbage. Only then does Spark give
    back the shuffle files and broadcasts of steps that are over.
    """

    def __init__(self, spark: SparkSession, name: str, lean: bool = False):
        self.spark, self.lean = spark, lean
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n, self._marked = 0, False

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and go on from the files."""
        path = self.path(name)
        df.write.parquet(path)
        if not self._marked:
            root, fs = _hadoop(self.spark, self.root)
            self._marked = fs.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        if self.lean:
            self.spark.sparkContext._jvm.System.gc()
            out = out.hint("merge")
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables of ``cut`` that no later step reads."""
        for df in dfs:
            path = getattr(df, "_scratch_path", None)
            if path:
                remove(self.spark, path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file through Hadoop's file system, wherever the folder lies."""
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def width(spark: SparkSession) -> int:
    """Partitions for stages whose cost is CPU and not bytes, which AQE would coalesce too far."""
    return max(3 * cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame) -> DataFrame:
    """Repartition only a scan that has fewer partitions than the cluster has cores."""
    n = cores(df.sparkSession)
    return df.repartition(3 * n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
