"""Shared helpers of the training-data operators: tables, sizes, seeded order."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.sources.scratch import forget, written

__all__ = ["TOLD_ROWS", "WORD", "few", "forget", "fresh", "give_back", "placed", "quoted", "seeded_key", "shuffle_partitions", "table", "told", "unpacked", "whole_rows", "word_count", "written"]

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of two numbers that are broadcast, at most; more are joined by a shuffle.
TOLD_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_key(seed: int, *cols: Column) -> Column:
    """Hex string that orders rows at random but the same way in every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their exact names, dots and back-ticks too."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def fresh(taken: Iterable[str], name: str) -> str:
    """A name like ``name`` that differs from all taken ones, whatever their case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def whole_rows(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of df as one struct ``row``, and columns worked out from them, so that no names can clash."""
    return df.select(F.struct(*quoted(df.columns)).alias("row"), *[c.alias(name) for name, c in more.items()])


def unpacked(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The columns of the struct ``row`` again."""
    return df.select(*[F.col("row").getField(name).alias(name) for name in names])


def _is_plain(plan) -> bool:  # noqa: ANN001
    """Whether a logical plan reads files and at most filters and projects their rows."""
    kind = plan.getClass().getSimpleName()
    return kind == "LogicalRelation" or (kind in ("Project", "Filter", "SubqueryAlias") and _is_plain(plan.child()))


def placed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns as a struct), ``file, at``: which file holds the row, and where, which is the same at every reading.

    Where docs are more than rows of files they are written once first.
    """

    def places(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select(F.struct(*quoted(df.columns)).alias("row"), F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at"))

    plan = docs._jdf.queryExecution().analyzed()
    if _is_plain(plan) and plan.deterministic():
        try:
            found = places(docs)
            if found.schema:  # analysed here: files of other formats have no places
                return found
        except AnalysisException:
            pass
    return places(written(docs, "placed"))


def few(places: DataFrame) -> bool:
    """Whether a written table of places or ids is small enough to be told to every task."""
    return places.count() <= TOLD_ROWS


def told(places: DataFrame) -> DataFrame:
    """A written table of places or ids, broadcast if it is counted to be small enough."""
    return F.broadcast(places) if few(places) else places


def give_back() -> None:
    """Returns what a Python worker has freed to the machine; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it has its own ways
        pass
