"""Durable intermediate results and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The configured folder every executor can reach; a temporary one only in local mode."""
    folder = spark.conf.get(_CONF, None)
    if not folder:
        folder = spark.sparkContext.getConf().get(_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_CONF} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="offertide-")
        spark.conf.set(_CONF, folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    table._written_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a table that `written` returned, after its last use."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table._written_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, rows: int, rows_per_task: int) -> DataFrame:
    """`df`, dealt to more partitions if each would otherwise give more than `rows_per_task` of the `rows` made from it.

    A stored table has partitions by its bytes, which is too few before a step that multiplies its rows.
    """
    parts = -(-rows // rows_per_task)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


def small_or_same(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """A driver-side copy of `df` if it has at most `limit` rows, else `df` itself.

    The copy carries exact size statistics, so Catalyst broadcasts it without a
    hint; a larger table keeps its plan and is marked to join by shuffle. Never more than
    `limit + 1` rows reach the driver.
    """
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        # The files of a table may be far smaller than its rows, so Catalyst might still broadcast it.
        return df.hint("merge"), False
    return df.sparkSession.createDataFrame(table, df.schema), True
