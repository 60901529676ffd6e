"""Durable intermediate tables.

Iterative jobs (EM, Sinkhorn, cluster merging) cut their lineage by writing each
state to Parquet in the shared folder named by ``spark.checkpoint.dir``.  A lost
executor then only costs a re-read, and the next round starts from a plan of
depth one with exact size statistics.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from topicflow.batches import small_batches

# Rows and estimated bytes up to which a parameter-sized table (slices x topics x top words) is broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def _estimated_bytes(df: DataFrame) -> Column:
    """Of a row: eight bytes a plain column, and the written-out length of nested and text columns."""
    size = F.lit(8 * len(df.columns))
    for field in df.schema:
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
        elif isinstance(field.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
    return size


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if its counted rows and bytes are within the bounds; else leave it to a shuffle join.

    Call it on saved tables, so that counting is one cheap scan.
    """
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_estimated_bytes(df)).alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes else df


def _base_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the context's checkpoint folder, else (local mode) a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return tempfile.mkdtemp(prefix="topicflow-")


class Scratch:
    """A private sub-folder of the checkpoint folder for one job."""

    def __init__(self, spark: SparkSession, name: str = "job"):
        self.spark = spark
        self.path = f"{_base_dir(spark)}/topicflow-{name}-{uuid.uuid4().hex[:12]}"
        self._seq = 0

    def subpath(self, name: str) -> str:
        self._seq += 1
        return f"{self.path}/{self._seq:04d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df``, a folder per value of ``partition_by``, and return a scan of what was written."""
        path = self.subpath(name)
        # what Python workers hold of a table while it is written does not depend on the session's batches
        with small_batches(self.spark):
            df.write.parquet(path, partitionBy=partition_by)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._topicflow_saved = True
        return table

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` itself if it is what ``save`` returned, else saved: a large table is not written twice."""
        return df if getattr(df, "_topicflow_saved", False) else self.save(df, name)

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def forget(self, *tables: DataFrame) -> None:
        """Remove saved tables that nothing reads any more."""
        for table in tables:
            for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                if f"/{self.path.rsplit('/', 1)[1]}/" in f"{folder}/":
                    self._delete(folder)

    def drop(self) -> None:
        """Remove this job's tables (only its own sub-folder)."""
        self._delete(self.path)
