"""Materialised intermediate results and exact positions in long lists."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="tallywright-")
    context.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and go on from the stored rows.

    For small results of expensive scans that are read more than once: reading them again, or
    losing an executor, never repeats the scan.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def positions(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], slices: int | None = None
) -> DataFrame:
    """Number the rows of each group from 0 in ``order`` without gathering a group in one task.

    The rows are range-partitioned by group and order, so a long list spreads over many slices. The
    slices are stored, since their bounds come from a sample; a row's position is its place in its
    slice plus the sizes of the group's earlier slices. ``order`` must leave no ties.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = settle(
        df.repartitionByRange(slices, *by, *order).withColumn("_slice", F.spark_partition_id())
    )
    within = Window.partitionBy(*by, "_slice").orderBy(*order)
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("_slice").alias("_of"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
    )
    same = F.col("_slice") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (
        sliced.withColumn("_place", F.row_number().over(within))
        .join(offsets, same)
        .withColumn("position", F.col("_offset") + F.col("_place") - 1)
        .select(*df.columns, "position")
    )
