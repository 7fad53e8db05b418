"""The folder that all executors share, and tables written to it."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoints(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: Rows of an Arrow batch: whole texts of this many documents are in memory at once.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Shared checkpoints, and Arrow batches whose size is bounded for rows of long texts (a setting of the session that stays)."""
    shared_checkpoints(spark)
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nobody refers to any more, before the next ones are written.

    Only disk is gained by it: results don't depend on it, and where the JVM ignores the request the files stay for longer.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Tables:
    """Intermediate tables as Parquet in the shared folder: they cut lineage, survive executors and have true sizes for the planner."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_checkpoints(spark)}/tables-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """The table, written and read again."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later plan reads."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
