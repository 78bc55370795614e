"""Shared scratch tables: how iterative jobs cut lineage so that a lost executor costs a re-read, not a replay."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Where it is unset a temporary one is made once per session, on a single machine only: on a cluster executors would write to their own disks."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Workspace:
    """Tables of one job under the shared folder. ``keep`` writes one and reads it again; ``drop`` frees those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def keep_dealt(self, df: DataFrame, by: str, name: str) -> DataFrame:
        """Like ``keep``, in as many buckets of ``by`` as a shuffle has partitions, so that joins and groups on it don't move the table."""
        path, table, n = self.path(name), f"{name}_{uuid.uuid4().hex}", shuffle_partitions(self.spark)
        df.repartition(n, by).write.option("path", path).bucketBy(n, by).format("parquet").saveAsTable(table)
        out = self.spark.table(table)
        out._scratch_path, out._scratch_table = path, table
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, table = getattr(t, "_scratch_path", None), getattr(t, "_scratch_table", None)
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            if path:
                jvm = self.spark._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
