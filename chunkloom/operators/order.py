"""Row numbers and batches over an explicit order, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.sources.scratch import written

#: Rows of a batch, unless told otherwise.
BATCH_ROWS = 100_000


def _columns(order_by: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def numbered(df: DataFrame, order_by: list[str | Column], name: str = "row_idx", partitions: int | None = None) -> DataFrame:
    """df plus a long column that numbers its rows from 0 in the given (total) order.

    Rows are range-partitioned by the order, sorted in their partitions, and written with
    their places, as bounds that are sampled anew would move rows; a row's number is its
    place plus the sizes of the partitions before, of which there are few.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _columns(order_by)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # a row for each of n partitions
    return ranged.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_at", "_part", "_before")


def batched(df: DataFrame, order_by: list[str | Column], batch_rows: int = BATCH_ROWS) -> DataFrame:
    """df plus row_idx and batch_id, the number of its run of batch_rows rows."""
    return numbered(df, order_by).withColumn("batch_id", F.floor(F.col("row_idx") / batch_rows).cast("long"))


def in_batch() -> Window:
    """Rows of a batch in order: at most batch_rows rows, so no large group."""
    return Window.partitionBy("batch_id").orderBy("row_idx")
