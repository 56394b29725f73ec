"""Connected components of a table of links.

Links are first thinned where they lie: each task keeps a spanning forest of its part.
Where what remains is counted to be at most ``SMALL`` links (32 MB), one task joins
the forests. Beyond that, alternating large and small stars relink every node to its
smallest neighbour, in joins and aggregations over written tables, so that no node's
neighbours and no unbounded set of links are ever in one task. No links or components
come to the driver in either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import forget, written

#: Links that one task may join.
SMALL = 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to one link from each node to the smallest of its component in this part."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
    ends = [x for x in parent if find(x) != x]
    for at in range(0, len(ends), 100_000):
        some = ends[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], ["a", "b"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b). Large star: larger neighbours to the smallest of all; small star: smaller ones and the node itself."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.where("b > a").join(written(low, "star-low"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        low = written(low, "star-low")
        joined = links.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return joined.where("a > b").distinct()


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """``id, component`` of every linked node: the smallest id that its links reach.

    links: columns a, b in any order, repeats and loops allowed, no nulls. Nodes
    without links are not listed.
    """
    parts = links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a > b")
    now = written(parts.mapInArrow(_forest, "a long, b long"), "star-links")
    if now.count() <= small:
        members = written(now.coalesce(1).mapInArrow(_forest, "a long, b long"), "star-members")
        forget(now)
        return _listed(members)

    def mark(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum("b")).first())

    before = mark(now)
    while before[0]:
        large = written(_star(now, True), "star-large")
        small_ = written(_star(large, False), "star-small")
        forget(now, large)
        now = small_
        after = mark(now)
        if after == before:
            break
        before = after
    return _listed(now)


def _listed(stars: DataFrame) -> DataFrame:
    members = stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct())
