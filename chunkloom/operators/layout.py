"""Orders of rows that make columns smaller: by series within a batch, or by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.errors import InvalidOption


def check_columns(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise InvalidOption(f"no column {c}")


def series_position(df: DataFrame, stream: str, time: str) -> DataFrame:
    """df plus pos: the row's place in its batch when that is sorted by series and time; nulls first, then arrival."""
    check_columns(df, stream, time)
    w = Window.partitionBy("batch_id").orderBy(F.asc_nulls_first(stream), F.asc_nulls_first(time), "row_idx")
    return df.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


def relinearized(df: DataFrame, stream: str, time: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, series): batch_id, row_idx, stream, time in order of arrival; and batch_id, pos, values in order of series."""
    check_columns(df, *values)
    return df.select("batch_id", "row_idx", stream, time), series_position(df, stream, time).select("batch_id", "pos", *values)


def delinearized(keys: DataFrame, series: DataFrame, stream: str, time: str) -> DataFrame:
    """The rows as they were: places come from the keys alone, and values from those places."""
    return series_position(keys, stream, time).join(series, ["batch_id", "pos"]).drop("pos")


def segments(df: DataFrame, key: str, flush_rows: int, order_by: list[str], null_keys: str = "keep") -> DataFrame:
    """df plus segment and pos: each key's rows in order, cut into segments of flush_rows rows.

    null_keys: rows without a key are a partition of their own (keep) or go (drop). A
    window holds one key; keys that hold much of the table are first cut by
    ``salted_segments``.
    """
    check_columns(df, key, *order_by)
    if null_keys not in ("keep", "drop"):
        raise InvalidOption(f"null_keys is keep or drop, not {null_keys}")
    kept = df.where(F.col(key).isNotNull()) if null_keys == "drop" else df
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order_by)) - 1
    return kept.withColumn("_at", at).withColumn("segment", F.floor(F.col("_at") / flush_rows).cast("long")).withColumn("pos", (F.col("_at") % flush_rows).cast("long")).drop("_at")


def salted_segments(df: DataFrame, key: str, flush_rows: int, row_idx: str = "row_idx", range_rows: int = 10_000_000) -> DataFrame:
    """As segments, for keys of any size: rows are ranked within ranges of row_idx, and the ranges' counts added up."""
    part = df.withColumn("_range", F.floor(F.col(row_idx) / range_rows).cast("long"))
    before = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = part.groupBy(F.col(key).alias("_k"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(key, "_range").orderBy(row_idx)) - 1
    at = F.col("_rank") + F.col("_before")
    joined = part.withColumn("_rank", rank).join(counts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("segment", F.floor(at / flush_rows).cast("long")).withColumn("pos", (at % flush_rows).cast("long")).drop("_range", "_k", "_r", "_n", "_before", "_rank")


def series(df: DataFrame, stream: str, time: str, values: list[str]) -> DataFrame:
    """One row per series: its rows' values as arrays in order of time. For series that fit into a row."""
    check_columns(df, stream, time, *values)
    rows = F.array_sort(F.collect_list(F.struct(time, "row_idx", *values)))
    listed = df.where(F.col(stream).isNotNull()).groupBy(stream).agg(rows.alias("_r"))
    return listed.select(stream, *[F.col(f"_r.{c}").alias(c) for c in [time, *values]])


def manifest(df: DataFrame, columns: list[str], widths: dict[str, int]) -> DataFrame:
    """One row per batch and column: rows, nulls, raw bytes, smallest and largest value as text."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("column_idx"), F.lit(c).alias("column_name"), F.lit(widths[c]).alias("width"), F.col(c).cast("long").alias("x")) for k, c in enumerate(columns)]))
    long = df.select("batch_id", each.alias("e")).select("batch_id", "e.*")
    return long.groupBy("batch_id", "column_idx", "column_name").agg(
        F.count(F.lit(1)).alias("num_rows"),
        (F.count(F.lit(1)) - F.count("x")).alias("null_count"),
        F.sum("width").cast("long").alias("raw_bytes"),
        F.min("x").alias("min_value"),
        F.max("x").alias("max_value"),
    )


def per_key_limit(df: DataFrame, key: str, order_by: list[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order_by))).where(F.col("_r") <= n).drop("_r")
