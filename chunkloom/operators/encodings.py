"""Reversible encodings as rewrites of DataFrames, in built-in functions only.

Tables have batch_id and row_idx (see order.batched); windows run over one batch, so
each batch can be encoded and decoded by itself, in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import bits
from chunkloom.operators.order import in_batch


def delta(df: DataFrame, value: str, order: int = 1, out: str = "d") -> DataFrame:
    """value minus the value ``order`` rows before, in two's complement; the first ones stay."""
    before = F.lag(value, order).over(in_batch())
    return df.withColumn(out, F.when(before.isNull(), F.col(value)).otherwise(bits.wrapped_minus(F.col(value), before)))


def undelta(df: DataFrame, d: str, order: int = 1, out: str = "x") -> DataFrame:
    """The inverse: running sums of every order-th row, in two's complement."""
    lane = Window.partitionBy("batch_id", F.col("row_in_batch") % order).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("row_idx").over(Window.partitionBy("batch_id"))
    return df.withColumn("row_in_batch", F.col("row_idx") - first).withColumn(out, bits.wrapped_sum(F.col(d), lane)).drop("row_in_batch")


def xor_delta(df: DataFrame, value: str, out: str = "d") -> DataFrame:
    """value xor the value before; the first stays."""
    return df.withColumn(out, F.col(value).bitwiseXOR(F.coalesce(F.lag(value).over(in_batch()), F.lit(0))))


def unxor_delta(df: DataFrame, d: str, out: str = "x") -> DataFrame:
    return df.withColumn(out, F.bit_xor(d).over(in_batch().rowsBetween(Window.unboundedPreceding, 0)))


def rle(df: DataFrame, value: str) -> DataFrame:
    """Runs of equal values: batch_id, start (row_idx), value, n. Nulls equal each other."""
    before = F.lag(value).over(in_batch())
    new = F.lag(F.lit(1)).over(in_batch()).isNull() | ~F.col(value).eqNullSafe(before)
    runs = df.withColumn("_run", F.sum(new.cast("int")).over(in_batch()))
    return runs.groupBy("batch_id", "_run").agg(F.min("row_idx").alias("start"), F.first(value).alias("value"), F.count(F.lit(1)).alias("n")).drop("_run")


def unrle(runs: DataFrame) -> DataFrame:
    """batch_id, row_idx, value of every row of the runs."""
    each = runs.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select("batch_id", (F.col("start") + F.col("_k")).alias("row_idx"), "value")


def dictionary(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(entries, codes): batch_id, code, value in order of first appearance; and df with each row's code."""
    firsts = df.groupBy("batch_id", value).agg(F.min("row_idx").alias("first_row"))
    code = F.row_number().over(Window.partitionBy("batch_id").orderBy("first_row")) - 1
    entries = firsts.withColumn("code", code.cast("long"))
    mine = entries.select(F.col("batch_id").alias("_b"), F.col(value).alias("_v"), "code")
    codes = df.join(mine, (F.col("batch_id") == F.col("_b")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_b", "_v")
    return entries.select("batch_id", "code", F.col(value).alias("value")), codes


def undictionary(entries: DataFrame, codes: DataFrame) -> DataFrame:
    """batch_id, row_idx, value."""
    return codes.select("batch_id", "row_idx", "code").join(entries, ["batch_id", "code"]).select("batch_id", "row_idx", "value")


def bitpacked(df: DataFrame, value: str, width: int) -> DataFrame:
    """Per batch: rows, packed bytes, and the packed bits as text, the last row's first (so the first bit is the last)."""
    digits = F.lpad(F.bin(F.col(value)), width, "0")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("row_idx")).alias("o"), digits.alias("b"))))
    packed = df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.transform(listed, lambda x: x["b"]), "").alias("packed_bits"))
    return packed.withColumn("packed_bytes", F.ceil(F.col("rows") * width / F.lit(8.0)).cast("long"))


def byte_shuffled(df: DataFrame, value: str, width: int = 8) -> DataFrame:
    """batch_id, plane, row_idx, byte: the bytes of integers by planes, the lowest first."""
    planes = df.withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return planes.select("batch_id", "plane", "row_idx", bits.byte_plane(F.col(value).cast("long"), F.col("plane")).alias("byte"))


def byte_unshuffled(planes: DataFrame) -> DataFrame:
    """batch_id, row_idx, x: the long that the planes make."""
    moved = F.call_function("shiftleft", F.col("byte").cast("long"), F.col("plane") * 8)
    return planes.groupBy("batch_id", "row_idx").agg(F.bit_or(moved).alias("x"))


def extract_nulls(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(mask, values): batch_id, row_idx, valid; and batch_id, pos, value of the valid rows, numbered from 0."""
    mask = df.select("batch_id", "row_idx", F.col(value).isNotNull().alias("valid"))
    pos = F.row_number().over(in_batch()) - 1
    return mask, df.where(F.col(value).isNotNull()).withColumn("pos", pos.cast("long")).select("batch_id", "pos", F.col(value).alias("value"))


def sparsify(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(mask, values): batch_id, row_idx, valid (value is not zero); and the values that are not, numbered from 0."""
    mask = df.select("batch_id", "row_idx", (F.col(value) != 0).alias("valid"))
    pos = F.row_number().over(in_batch()) - 1
    return mask, df.where(F.col(value) != 0).withColumn("pos", pos.cast("long")).select("batch_id", "pos", F.col(value).alias("value"))


def scattered(mask: DataFrame, values: DataFrame, fill: Column | None = None) -> DataFrame:
    """batch_id, row_idx, value: values in the places of the mask, fill (null) elsewhere."""
    upto = F.sum(F.col("valid").cast("long")).over(in_batch().rowsBetween(Window.unboundedPreceding, 0)) - 1
    placed = mask.withColumn("pos", F.when(F.col("valid"), upto))
    joined = placed.join(values, ["batch_id", "pos"], "left")
    return joined.select("batch_id", "row_idx", F.coalesce("value", fill).alias("value") if fill is not None else F.col("value"))
