"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level groups only what the level before left in a group of two or more: most
rows never reach the shuffle on the full hash. Lengths and prefix hashes are taken where
the text is read, and only these few bytes move. ``exact_groups`` reports the digest of
every row, so it takes that in the same scan. ``exact_dedup``, which reports none, hashes
whole only the texts whose length and prefix occur more than once, and takes out the
losers by their place in the files: no text moves while the rows that are left are few
enough to be told to every task (they are counted first). Groups are aggregated before
the shuffle (a third of all rows may be one text); they are joined back by sort-merge
joins, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._common import few, forget, placed, table, told, unpacked, written


def _surviving(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys occur more than once."""
    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    return rows.join(written(often, "exact-level"), list(keys), "left_semi")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, sha256``.

    Texts are equal when identical after no change; null counts as empty. Of equal
    rows the one with the largest id stays; of rows that also share the id, one. A
    null id is smaller than any other. Other columns are not read; an empty table
    gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.octet_length(text).alias("len"),
            F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"),
            F.sha2(text, 256).alias("sha256"),
        ),
        "exact-slim",
    )
    same_len = _surviving(slim, "len")
    same_prefix = _surviving(same_len, "len", "prefix")
    best = F.max(F.struct(F.col("id"), F.col("row")))
    groups = written(
        same_prefix.groupBy("sha256").agg(best.alias("k"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1").select("sha256", F.col("k.id").alias("keep_id"), F.col("k.row").alias("keep_row"), "group_size"),
        "exact-groups",
    )
    alone = F.col("group_size").isNull()
    return slim.join(groups, "sha256", "left").select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """The rows of docs that stay, all columns unchanged, one of each group of equals.

    Which one stays is what ``exact_groups`` says. Names of columns don't matter, but no two
    may differ in case only; an empty table gives an empty result.
    """
    rows = placed(docs)
    row_id, text = F.col("row").getField(id_col), F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    slim = written(rows.select("file", "at", row_id.alias("id"), F.octet_length(text).alias("len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix")), "exact-slim")
    alike = written(_surviving(_surviving(slim, "len"), "len", "prefix").select("file", "at", "id"), "exact-alike")
    small = few(alike)
    # where the rows that are left are too many to be told, every text is hashed where it is read: to move it costs more
    left = rows.join(F.broadcast(alike.select("file", "at")), ["file", "at"], "left_semi") if small else rows
    digests = left.select("file", "at", F.sha2(text, 256).alias("sha256"))
    digests = written(digests if small else digests.join(alike.select("file", "at"), ["file", "at"], "left_semi"), "exact-digests")
    digests = digests.join(alike, ["file", "at"])
    order = F.struct("id", "file", "at")
    best = written(digests.groupBy("sha256").agg(F.max(order).alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha256", "k.file", "k.at"), "exact-best")
    lost = digests.select("file", "at", "sha256").join(best.select("sha256"), "sha256", "left_semi").select("file", "at").join(best, ["file", "at"], "left_anti")
    lost = written(lost, "exact-lost")
    forget(slim, alike)
    return unpacked(rows.join(told(lost), ["file", "at"], "left_anti"), docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_exact_dedup": op8_exact_dedup}

ORACLE_SQL = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
