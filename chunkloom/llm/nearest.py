"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Vectors are scaled to length one, so the largest cosine is the smallest distance. Equal
vectors are one entry of the index, with the few smallest ids that a result can name;
so a vector that a third of all rows share costs one entry. Coarse centroids and
codebooks are fitted on a bounded sample; every vector is indexed. A query visits the
cells of its nearest centroids, ranks their entries by asymmetric distances (tables of
what the query has in common with the codewords), and the best are ranked again by
the exact cosine of the original vectors.

How many cells a query visits is measured, not guessed: against brute force over the
sample, so many that ``RECALL`` of the true neighbours lie in them. A query goes only to
the lists of these cells. A cell that many vectors fall into has several lists, dealt by
a hash of the entry, so no list is large. A list answers a query with its best entries in
one row, fewer from the lists of farther cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm._common import table, written

#: Vectors that centroids and codebooks are fitted on, about.
FIT_ROWS = 20_000
#: Cells, at most; there are about as many as the root of the number of entries.
MOST_CELLS = 4096
#: Share of true neighbours, on the sample, whose cells a query must visit.
RECALL = 0.97
#: Entries that a query ranks exactly.
RERANKED = 150
#: Entries of a list, about, at most.
LIST = 20_000
_PARTS = 16


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    half = (centers**2).sum(1) / 2
    for at in range(0, len(points), 8192):
        out[at : at + 8192] = (points[at : at + 8192] @ centers.T - half).argmax(1)
    return out


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    points = points.astype(np.float32)
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        own = _nearest(points, centers)
        n = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers, np.float64)
        np.add.at(sums, own, points)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], points[rng.choice(len(points), len(centers))]).astype(np.float32)
    return centers


class Quantiser:
    """Coarse centroids, and codebooks for the parts of what remains of a vector."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.cells = _kmeans(sample, cells, rng)
        rest = sample - self.cells[_nearest(sample, self.cells)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(_PARTS, sample.shape[1]))
        self.books = [_kmeans(rest[:, p], 256, rng, 8) for p in self.parts]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(vectors, self.cells)
        rest = vectors - self.cells[cell]
        return cell, np.stack([_nearest(rest[:, p].astype(np.float32), b) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)

    def constant(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The part of an entry's distance that no query changes: |r|^2 + 2 c r for its centroid c and coded rest r."""
        out = np.zeros(len(codes))
        for k, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            out += (book**2).sum(1)[codes[:, k]] + 2 * (self.cells[cell][:, p] * book[codes[:, k]]).sum(1)
        return out

    def probes(self, sample: np.ndarray, k: int, share: float, asked: int = 200) -> int:
        """How many nearest cells hold ``share`` of the k true neighbours of some sample vectors."""
        asks = sample[:asked]
        alike = asks @ sample.T
        alike[np.arange(len(asks)), np.arange(len(asks))] = -np.inf
        true = np.argpartition(-alike, min(k, len(sample) - 1) - 1, axis=1)[:, :k] if len(sample) > 1 else np.zeros((len(asks), 1), int)
        order = np.argsort(((self.cells[None] - asks[:, None]) ** 2).sum(2), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None], axis=1)
        at = np.take_along_axis(rank, _nearest(sample, self.cells)[true], axis=1)
        return int(np.quantile(at, share, method="higher")) + 1


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column as rows of doubles."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _valid(vector: Column) -> Column:
    """Not null or empty, and every component finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def neighbours(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, reranked: int = RERANKED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row that queries (a condition on ``id``) holds for.

    Candidates are all rows but the query's own. Vectors that are null or zero, hold a
    null or non-finite component, or have another length than most take no part. Ids
    must be integers and not null (such rows take no part); a repeated id with one vector
    is one row. Ties go to the smaller id. With k candidates or fewer, all are found. Other
    columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where(F.col("id").isNotNull() & _valid(F.col("vec")))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return empty
    dim = dims["dim"]
    rows = rows.where(F.size("vec") == dim).select("id", F.transform("vec", lambda x: x + F.lit(0).cast("float")).alias("vec")) if dict(rows.dtypes)["vec"] == "array<float>" else rows.where(F.size("vec") == dim)
    # equal vectors: the k + 1 smallest ids are all that a result can name
    place = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("r", place).where(F.col("r") <= k + 1)
    entries = few.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vec")
    # rows whose id is repeated with several vectors could share a representative: keep entries apart by a number of their own
    entries = written(entries.withColumn("entry", F.xxhash64("vec", "rep")), "nearest-entries")
    total = entries.count()
    cells = max(1, min(MOST_CELLS, int(math.sqrt(total))))
    share = FIT_ROWS / max(1, total)
    sample = entries.where(F.pmod(F.xxhash64("entry"), F.lit(1_000_000)) < share * 1_000_000).select("vec").orderBy(F.xxhash64("vec")).limit(2 * FIT_ROWS).toArrow()
    if not sample.num_rows:
        sample = entries.select("vec").limit(1000).toArrow()
    fitted = _unit(_matrix(sample["vec"], dim))
    quantiser = Quantiser(fitted, cells)
    probes = quantiser.probes(fitted, k, recall)
    sent = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, code = sent.value.encode(_unit(_matrix(batch.column(1), dim)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["entry", "cell", "code"])

    index = written(entries.select("entry", "vec").mapInArrow(encode, "entry long, cell int, code binary"), "nearest-index")
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # a row for each cell
    count = np.array([sizes.get(c, 0) for c in range(len(quantiser.cells))])
    lists = np.maximum(1, -(-count // LIST))
    first = np.cumsum(lists) - lists
    sent_lists = spark.sparkContext.broadcast((count, first, lists))

    @F.arrow_udf("int")
    def list_of(cell: pa.Array, spread: pa.Array) -> pa.Array:
        _, first, lists = sent_lists.value
        cell = cell.to_numpy(zero_copy_only=False)
        return pa.array((first[cell] + spread.to_numpy(zero_copy_only=False) % lists[cell]).astype(np.int32))

    held = index.withColumn("list", list_of("cell", F.pmod(F.xxhash64("entry", F.lit(1)), F.lit(1 << 30))))
    asked = rows.where(queries).select("id", "vec").distinct()
    asked = written(asked.join(entries.select("entry", "vec"), "vec").select("id", "entry"), "nearest-asked")
    wanted = asked.select("entry").distinct()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each list that a query goes to, with the cell's rank among the query's."""
        q, (count, first, lists) = sent.value, sent_lists.value
        for batch in batches:
            row, where, rank = [], [], []
            for i, unit in enumerate(_unit(_matrix(batch.column(1), dim)) if batch.num_rows else ()):
                order = np.argsort(((q.cells - unit) ** 2).sum(1), kind="stable")
                # cells are visited until they hold some entries more than are asked for
                enough = int(np.searchsorted(np.cumsum(count[order]), 4 * (k + 1))) + 1
                seen = order[: max(probes, enough)]
                place = np.flatnonzero(count[seen])
                seen = seen[place]
                row.append(np.full(lists[seen].sum(), i))
                where.append(np.concatenate([np.arange(first[c], first[c] + lists[c]) for c in seen]) if len(seen) else np.zeros(0, int))
                rank.append(np.repeat(place, lists[seen]))
            row, where, rank = (np.concatenate([*x, np.zeros(0, int)]).astype(np.int32) for x in (row, where, rank))
            for at in range(0, len(row), 4096):
                some = slice(at, at + 4096)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[some])) for c in (0, 1)), pa.array(where[some]), pa.array(rank[some])], ["query", "vec", "list", "rank"])

    kind = entries.schema["vec"].dataType.simpleString()
    asks = entries.select("entry", "vec").join(wanted, "entry", "left_semi").mapInArrow(visit, f"query long, vec {kind}, list int, rank int")

    def search(held: pa.Table, asks: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if held.num_rows and asks.num_rows:
            q = sent.value
            held = held.sort_by([("entry", "ascending")])
            names, cell = held["entry"].to_numpy(), int(held["cell"][0].as_py())
            codes = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(len(names), -1)
            fixed = q.constant(np.full(len(names), cell), codes)
            for query, rank, unit in zip(asks["query"].to_pylist(), asks["rank"].to_pylist(), _unit(_matrix(asks["vec"], dim)), strict=True):
                far = ((q.cells[cell] - unit) ** 2).sum() + fixed
                for m, (p, book) in enumerate(zip(q.parts, q.books, strict=True)):
                    far -= 2 * (book @ unit[p])[codes[:, m]]
                part = min(reranked, 2 * (k + 1) + 2 * reranked // (1 + rank))
                best = np.argsort(far, kind="stable")[:part]
                out[0].append(query)
                out[1].append(names[best])
                out[2].append(far[best].astype(np.float32))
        return pa.table({"query": pa.array(out[0], pa.int64()), "entries": pa.array(out[1], pa.list_(pa.int64())), "far": pa.array(out[2], pa.list_(pa.float32()))})

    found = held.groupBy("list").cogroup(asks.groupBy("list")).applyInArrow(search, "query long, entries array<long>, far array<float>")

    def choose(answers: pa.Table) -> pa.Table:
        """The best entries of all lists that a query went to."""
        names, far = (answers[c].combine_chunks().flatten().to_numpy() for c in ("entries", "far"))
        best = np.lexsort((names, far))[:reranked]
        return pa.table({"query": pa.array(np.full(len(best), answers["query"][0].as_py())), "entry": pa.array(names[best])})

    near = found.groupBy("query").applyInArrow(choose, "query long, entry long")
    near = near.unionByName(wanted.select(F.col("entry").alias("query"), "entry")).distinct()
    pairs = near.join(entries.select("entry", "ids", F.col("vec").alias("c_vec")), "entry").join(entries.select(F.col("entry").alias("query"), F.col("vec").alias("q_vec")), "query")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column(2), dim), _matrix(batch.column(3), dim)
            score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query", "ids", "score"])

    scored = pairs.select("query", "ids", "c_vec", "q_vec").mapInArrow(measure, "query long, ids array<long>, score double")
    # of each query's entries, ids in the order of the result: k + 1 are enough, as only the query's own is left out
    named = scored.select("query", "score", F.explode("ids").alias("vec_id"))
    top = named.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    best = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("best"))
    mine = asked.join(written(best, "nearest-best"), F.col("entry") == F.col("query")).select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50: query_id, rank, vec_id, score."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_nearest": op5_nearest}
ORACLE_SQL: dict[str, str] = {}
