"""Mixing sources to target weights by Sainte-Lague apportionment of token blocks.

The budget of words is cut into equal blocks. Sources get integer numbers of blocks
by the highest quotients of their targets (target / 1, / 3, / 5 ...), each source
hands its blocks on to its shards by the same rule, and each shard lays out its
documents in a seeded order and takes its first blocks, going round once more where
the quota is larger than the shard. Only DataFrame functions are used.

The number of blocks is never materialised. A seat number s of quotient
target / (2 s - 1) belongs to the result exactly if it is among the first ``blocks``
quotients, so each source starts from its rounded share (the divisor method at the
ideal divisor), and only the few quotients around it that can still move are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm._common import seeded_key, table, word_count, written

#: Words in a block, unless the corpus or a source is so small that this would be coarse.
BLOCK_WORDS = 2048
#: Blocks that the budget has at least for each source.
LEAST_BLOCKS = 2000
#: Blocks that the smallest target has at least, so that rounding moves no source by more than about half a hundredth.
LEAST_SEATS = 100
#: Rows of a shard, about.
SHARD_ROWS = 1000


def apportion(parties: DataFrame, by: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Lague seats: parties plus a long column ``won``.

    parties holds a row per party with votes (double) and its group's seats (long);
    by names the group's columns, party the numbers that break ties, smallest first. Votes
    must not be negative; a group without votes wins nothing.
    """
    group = Window.partitionBy(*by)
    share = F.when(F.col("_all") > 0, F.col(votes) * F.col(seats) / F.col("_all")).otherwise(F.lit(0.0))
    base = parties.withColumn("_all", F.sum(votes).over(group)).withColumn("_share", share).withColumn("_base", F.floor(F.col("_share") + 0.5).cast("long"))
    base = base.withColumn("_left", F.when(F.col("_all") > 0, F.col(seats)).otherwise(F.lit(0)) - F.sum("_base").over(group))
    # with n parties the right divisor is within a factor 1 + n / (2 seats) of the ideal one, as rounding moves each party by
    # half a seat at most: so many seats around its rounded share can be won or lost by a party, n / 2 + 2 n in the whole group
    reach = F.floor(F.try_divide(F.col("_share") * F.count(F.lit(1)).over(group), 2 * F.col(seats))).cast("long") + 2
    base = base.withColumn("_reach", F.when(F.col("_left") != 0, F.coalesce(reach, F.lit(2))).otherwise(0))
    near = base.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_reach"))))
    seat = F.when(F.col("_left") > 0, F.col("_base") + F.col("_turn")).otherwise(F.col("_base") - F.col("_turn") + 1)
    # turn 0 keeps a party's row and moves nothing
    near = near.withColumn("_seat", seat).where((F.col("_turn") == 0) | (F.col("_seat") >= 1))
    quotient = F.col(votes) / (2 * F.col("_seat") - 1)
    order = F.when(F.col("_turn") > 0, -quotient * F.signum("_left"))
    # seats go to the first party of equals, and are taken from the last
    ties = [F.col(p) * F.signum("_left") for p in party]
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order.asc_nulls_last(), *ties, "_turn")))
    moved = F.sum(F.when((F.col("_turn") > 0) & (F.col("_rank") <= F.abs("_left")), F.signum("_left")).otherwise(0.0)).cast("long")
    won = ranked.groupBy(*parties.columns, "_base").agg(moved.alias("_moved"))
    return won.withColumn("won", F.col("_base") + F.col("_moved")).drop("_base", "_moved")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources: sizes (src, source_size) plus ``ord, weight, target``.

    Sources in order of code points, null last, weigh ``weights`` repeating and share
    factor times all words; a target stops at most times its source's size and the
    excess goes to the others by weight until none is above. In closed form: sources
    saturate in order of most * size / weight, and what is left per unit of open weight
    rises while the next source saturates and falls after that, so its maximum over
    that order is the level that all open sources reach.
    """
    every = Window.partitionBy()
    ordered = sizes.withColumn("ord", F.row_number().over(Window.orderBy(F.col("src").isNull(), F.col("src"))))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("ord") - 1) % len(weights) + 1).cast("int"))
    w = ordered.withColumn("weight", pick).withColumn("_cap", F.col("source_size") * most)
    up = Window.orderBy(F.col("_cap") / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("_budget", F.sum("source_size").over(every) * factor)
    w = w.withColumn("_shut", F.coalesce(F.sum("_cap").over(up), F.lit(0.0))).withColumn("_open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0)))
    w = w.withColumn("_level", (F.col("_budget") - F.col("_shut")) / F.col("_open"))
    w = w.withColumn("_at", F.max("_level").over(every))
    return w.withColumn("target", F.least(F.col("_cap"), F.col("_at") * F.col("weight"))).select("src", "source_size", "ord", "weight", "target")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0, seed: int = 7, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: ``id, src, size, source_size, target, taken`` and the columns named by keep.

    taken is the number of words of the row that the mix takes, repeats counted; it is
    at most ``most`` (2) times the row's size. Null text has size 0; a null source is a
    source of its own. Rows that share an id are kept apart by size only, so equal rows
    share one place in the seeded order. Other columns are not read; those of ``keep`` must
    not have names of this function's own columns. An empty table gives an empty result.
    """
    slim = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), *keep), "mix-sizes")
    sizes = slim.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = written(source_targets(sizes.select("src", "source_size"), weights, factor, most).join(sizes.select(F.col("src").alias("_s"), "rows"), F.col("src").eqNullSafe(F.col("_s"))).drop("_s"), "mix-targets", 1)
    budget = F.sum("target").over(Window.partitionBy())
    rare = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(budget / (LEAST_BLOCKS * F.count(F.lit(1)).over(Window.partitionBy()))), F.floor(rare / LEAST_SEATS))).cast("long")
    sources = targets.withColumn("block", block).withColumn("blocks", F.floor(budget / block + 0.5).cast("long"))
    sources = apportion(sources.withColumn("all", F.lit(1)), ["all"], ["ord"], "target", "blocks").withColumnRenamed("won", "quota")
    sources = written(sources.withColumn("shards", F.ceil(F.col("rows") / SHARD_ROWS).cast("long")).select("src", "ord", "source_size", "target", "block", "quota", "shards"), "mix-sources", 1)

    # every row learns its source's few figures: the table of sources is small enough to broadcast only while it is counted to be so
    small = sources.count() <= 100_000
    told = sources.withColumnRenamed("src", "_s")
    rows = slim.join(F.broadcast(told) if small else told, F.col("src").eqNullSafe(F.col("_s")), "left").drop("_s")
    key = seeded_key(seed, F.col("id"), F.col("size"))
    rows = rows.withColumn("_key", key).withColumn("shard", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % F.col("shards"))
    place = Window.partitionBy("ord", "shard").orderBy("_key")
    rows = written(rows.withColumn("begin", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")), "mix-rows")
    shards = rows.groupBy("ord", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    shards = apportion(shards.withColumn("votes", F.col("shard_size").cast("double")), ["ord"], ["shard"], "votes", "quota")
    shards = written(shards.select("ord", "shard", "shard_size", F.col("won").alias("shard_blocks")), "mix-shards")

    out = rows.join(shards, ["ord", "shard"])
    stop = F.least(F.col("shard_blocks") * F.col("block"), (F.col("shard_size") * F.lit(most)).cast("long"))

    def lap(n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), stop - n * F.col("shard_size") - F.col("begin")))

    taken = sum((lap(n) for n in range(1, int(most))), lap(0))
    return out.select("id", "src", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return mixed(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_mixing": op3_mixing}

ORACLE_SQL = {
    "op3_mixing": f"""
WITH slim AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sized AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         row_number() OVER (ORDER BY source IS NULL, source) AS ord FROM slim GROUP BY source),
weighted AS (
  SELECT *, CASE (ord - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2.0::DOUBLE AS cap FROM sized),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER up, 0::DOUBLE))
            / (sum(w) OVER () - coalesce(sum(w) OVER up, 0))::DOUBLE AS lvl
  FROM weighted WINDOW up AS (ORDER BY cap / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, least(cap, (SELECT max(lvl) FROM levels) * w) AS target FROM levels),
blocked AS (
  SELECT *, sum(target) OVER () AS budget,
         greatest(1, least({BLOCK_WORDS}, floor(sum(target) OVER () / ({LEAST_BLOCKS} * count(*) OVER ())),
                  floor(min(target) FILTER (WHERE target > 0) OVER () / {LEAST_SEATS})))::BIGINT AS block FROM targets),
quotients AS (
  SELECT b.ord, b.target / (2 * s.s - 1) AS q
  FROM blocked b, unnest(range(1, greatest(2, floor(3 * b.target / b.block)::BIGINT + 4))) AS s(s)),
seats AS (
  SELECT ord, count(*) AS quota FROM (
    SELECT ord, row_number() OVER (ORDER BY q DESC, ord) AS r FROM quotients)
  WHERE r <= (SELECT floor(max(budget) / max(block) + 0.5)::BIGINT FROM blocked) GROUP BY ord),
keyed AS (
  SELECT d.doc_id, d.size, b.ord, b.source_size, b.target, b.block, coalesce(s.quota, 0) AS quota,
         md5('7:' || d.doc_id || ':' || d.size) AS k, ceil(b.n / {SHARD_ROWS}.0)::BIGINT AS shards
  FROM slim d JOIN blocked b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN seats s ON s.ord = b.ord),
sharded AS (SELECT *, ('0x' || substr(k, 1, 8))::BIGINT % shards AS shard FROM keyed),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY ord, shard ORDER BY k ROWS UNBOUNDED PRECEDING) - size AS beg,
         sum(size) OVER (PARTITION BY ord, shard) AS shard_size FROM sharded),
shard_sizes AS (SELECT DISTINCT ord, shard, shard_size, quota FROM placed),
shard_q AS (
  SELECT p.ord, p.shard, p.quota, p.shard_size::DOUBLE / (2 * s.s - 1) AS q
  FROM shard_sizes p, unnest(range(1, greatest(2, p.quota + 1))) AS s(s)),
shard_seats AS (
  SELECT ord, shard, count(*) AS won FROM (
    SELECT *, row_number() OVER (PARTITION BY ord ORDER BY q DESC, shard) AS r FROM shard_q)
  WHERE r <= quota GROUP BY ord, shard),
stops AS (
  SELECT p.*, least(coalesce(s.won, 0) * p.block, 2 * p.shard_size) AS stop
  FROM placed p LEFT JOIN shard_seats s ON s.ord = p.ord AND s.shard = p.shard)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, stop - beg)) + greatest(0, least(size, stop - shard_size - beg)))::BIGINT AS taken
FROM stops"""
}
