"""Statistics that tell which encodings fit a column, as aggregations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import bits
from chunkloom.operators.order import in_batch

DISTINCT_MOST = 256
DELTA_DISTINCT_MOST = 8
ZEROS_LEAST = 0.4
SLOTS = 4096
LAGS_MOST = 256


def profile_columns(df: DataFrame, columns: list[str], stride: int = 1) -> DataFrame:
    """One row per batch and column of integers: constants, distinct values, bit widths, deltas, zeros, nulls.

    Deltas are taken among the valid values of a batch; a column without any has zeros.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("long").alias("x")) for c in columns]))
    long = df.select("batch_id", "row_idx", each.alias("e")).select("batch_id", "row_idx", "e.*")
    w = Window.partitionBy("batch_id", "column_name").orderBy("row_idx")
    valid = long.where("x is not null").withColumn("before", F.lag("x", stride).over(w)).withColumn("d", F.when(F.col("before").isNotNull(), bits.wrapped_minus(F.col("x"), F.col("before"))))
    nulls = long.groupBy("batch_id", "column_name").agg(F.count(F.lit(1)).alias("rows"), F.count("x").alias("valid"))
    stats = valid.groupBy("batch_id", "column_name").agg(
        (F.min("x") == F.max("x")).alias("is_constant"),
        F.count_distinct("x").alias("distinct_values"),
        F.max(bits.bit_width(bits.zigzag(F.col("x")))).alias("bit_width"),
        F.count_distinct("d").alias("delta_distinct"),
        F.max(bits.bit_width(bits.zigzag(F.col("d")))).alias("delta_bit_width"),
        F.sum((F.col("x") == 0).cast("long")).alias("zeros"),
    )
    out = nulls.join(stats, ["batch_id", "column_name"], "left")
    return out.select(
        "batch_id",
        "column_name",
        "rows",
        "valid",
        F.coalesce("is_constant", F.lit(False)).alias("is_constant"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        (F.coalesce("distinct_values", F.lit(0)) <= DISTINCT_MOST).alias("low_cardinality"),
        F.coalesce("bit_width", F.lit(0)).alias("bit_width"),
        F.coalesce("delta_distinct", F.lit(0)).alias("delta_distinct"),
        (F.coalesce("delta_distinct", F.lit(0)) <= DELTA_DISTINCT_MOST).alias("delta_low_cardinality"),
        F.coalesce("delta_bit_width", F.lit(0)).alias("delta_bit_width"),
        ((F.col("zeros") >= ZEROS_LEAST * F.col("valid")) & (F.col("zeros") < F.col("valid"))).alias("sparse"),
    )


def _all_lags(df: DataFrame, value: str) -> DataFrame:
    """batch_id, lag, acf for lags from 1 below a quarter of the batch's rows (3 at least, LAGS_MOST at most), by one FFT per batch."""

    def acf(batch: pa.Table) -> pa.Table:
        batch, none = batch.sort_by("row_idx"), pa.array([], pa.int32())
        n, y = batch.num_rows, batch["y"].to_numpy().astype(float)
        valid = ~batch["y"].is_null().to_numpy()
        lags, out = none, np.zeros(0)
        if n >= 8 and valid.any():
            with np.errstate(all="ignore"):
                y = np.where(valid, y - y[valid].mean(), 0.0)
                power = float(y @ y)
                if np.isfinite(power) and power >= 1e-9:
                    size = 1 << (2 * n - 1).bit_length()
                    f = np.fft.rfft(y, size)
                    out = np.fft.irfft(f * np.conj(f), size)[1 : min(max(n // 4, 3), LAGS_MOST)] / power
                    lags = pa.array(np.arange(1, len(out) + 1, dtype=np.int32))
        return pa.table({"batch_id": pa.array([batch["batch_id"][0].as_py()] * len(out), pa.int64()), "lag": lags, "acf": pa.array(out, pa.float64())})

    rows = df.select(F.col("batch_id").cast("long").alias("batch_id"), "row_idx", F.col(value).cast("double").alias("y"))
    return rows.groupBy("batch_id").applyInArrow(acf, "batch_id long, lag int, acf double")


def autocorrelation(df: DataFrame, value: str, lags: int | None = None) -> DataFrame:
    """batch_id, lag, acf for lags from 1 below ``lags``; batches that don't vary are left out.

    Without ``lags`` all that the planner looks at, by an FFT. Otherwise one window sort
    per batch; each lag is one aggregate over the sorted rows.
    """
    if lags is None:
        return _all_lags(df, value)
    mean = F.avg(value).over(Window.partitionBy("batch_id"))
    centred = df.select("batch_id", "row_idx", (F.col(value).cast("double") - mean).alias("y"))
    lagged = centred.select("batch_id", "y", *[F.lag("y", k).over(in_batch()).alias(f"y{k}") for k in range(1, lags)])
    sums = lagged.groupBy("batch_id").agg(F.sum(F.col("y") * F.col("y")).alias("power"), *[F.sum(F.col("y") * F.col(f"y{k}")).alias(f"s{k}") for k in range(1, lags)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.coalesce(F.col(f"s{k}"), F.lit(0.0)) / F.col("power")).alias("acf")) for k in range(1, lags)]))
    return sums.where("power >= 1e-9").select("batch_id", each.alias("e")).select("batch_id", "e.lag", "e.acf")


def stride(acf: DataFrame, least: float = 0.25) -> DataFrame:
    """batch_id, stride: the lag of the highest autocorrelation if that is above least, else 1; ties to the smaller lag."""
    best = F.max(F.struct(F.round("acf", 9).alias("a"), (-F.col("lag")).alias("l")))
    return acf.groupBy("batch_id").agg(best.alias("b")).select("batch_id", F.when(F.col("b.a") > least, -F.col("b.l")).otherwise(F.lit(1)).cast("int").alias("stride"))


def structure(df: DataFrame, value: str, multiplexed: bool, sample_rows: int = 2048, lags: int | None = None) -> DataFrame:
    """batch_id, structure, stride of the first sample_rows rows of each batch: Multiplexed by hint, FixedStride or Simple."""
    place = F.row_number().over(in_batch())
    head = df.where(F.col(value).isNotNull()).withColumn("_p", place).where(F.col("_p") <= sample_rows)
    counted = head.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    found = counted.join(stride(autocorrelation(head, value, lags)), "batch_id", "left")
    fixed = (F.col("n") > 100) & (F.coalesce("stride", F.lit(1)) > 1)
    kind = F.lit("Multiplexed") if multiplexed else F.when(fixed, "FixedStride").otherwise("Simple")
    return found.select("batch_id", kind.alias("structure"), F.when(fixed, F.col("stride")).otherwise(1).alias("stride"))


def symbol_frequencies(df: DataFrame, symbol: str, slots: int = SLOTS) -> DataFrame:
    """symbol, n, freq: counts scaled to sum to slots by largest remainders, at least 1 each.

    Meant for bytes: at most 256 rows remain after the aggregation. A symbol that would
    get nothing takes one slot from the most frequent one.
    """
    counts = df.groupBy(F.col(symbol).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    scaled = counts.withColumn("total", F.sum("n").over(every)).withColumn("base", F.floor(F.col("n") * slots / F.col("total")).cast("long"))
    scaled = scaled.withColumn("rest", F.col("n") * slots % F.col("total")).withColumn("left", slots - F.sum("base").over(every))
    scaled = scaled.withColumn("r", F.row_number().over(Window.orderBy(F.desc("rest"), "symbol")))
    scaled = scaled.withColumn("freq", F.col("base") + (F.col("r") <= F.col("left")).cast("long"))
    scaled = scaled.withColumn("none", F.sum((F.col("freq") == 0).cast("long")).over(every)).withColumn("top", F.row_number().over(Window.orderBy(F.desc("freq"), "symbol")))
    freq = F.when(F.col("freq") == 0, 1).when(F.col("top") == 1, F.col("freq") - F.col("none")).otherwise(F.col("freq"))
    return scaled.select("symbol", "n", freq.cast("long").alias("freq"))


def entropy_bytes(frequencies: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row: the bytes that an entropy coder with these frequencies needs, without its header."""
    return frequencies.agg((F.sum(-F.col("n") * F.log2(F.col("freq") / F.lit(float(slots)))) / 8).alias("bytes"))
