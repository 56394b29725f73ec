"""Word n-grams of whole texts by rolling hashes, and an exchange of their counts by chunks.

Rows are dealt into chunks of neighbouring ids by their measured bytes. A chunk's distinct
n-grams travel as packed 64-bit hashes, one row for each chunk and bucket, so a very
common n-gram costs one entry a chunk, not one a document, and the shuffle moves eight
bytes an entry. The bucket comes from a second, independent hash and so adds its bits to
the first. Chunks grow with the root of the corpus beyond ``GROWS_FROM``, so that a packet
still carries several hashes where there are millions of buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import forget, give_back, shuffle_partitions, written

#: Bytes of text in a chunk, at most, but for a longer text, which is alone.
CHUNK_BYTES = 2 << 20
#: Bytes of hashes in a bucket, at most about.
BUCKET_BYTES = 16 << 20
#: Bytes of a corpus from which chunks grow with its root, and buckets too, to four times their size.
GROWS_FROM = 64 << 30
#: Bits of a chunk's number that tell apart the parts of one id.
PART_OF_ID = 20
#: Bytes whose words are hashed at once.
HASHED_BYTES = 1 << 18

_U = np.uint64
#: Odd bases of the rolling hashes: over bytes, over words, over words for the bucket.
_BASES = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xDA942042E4DD58B5))
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def scramble(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = scramble(np.arange(1, 257, dtype=_U) * _BASES[0])
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: int, inverse: bool, n: int) -> np.ndarray:
    """base ** 0, 1, 2 ... modulo 2 ** 64, or of its inverse."""
    known = _powers.get((base, inverse))
    if known is None or len(known) < n:
        step = _BASES[base] if not inverse else _U(pow(int(_BASES[base]), -1, 1 << 64))
        known = np.full(n, step, _U)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= 1 << 19:
            _powers[base, inverse] = known
    return known[:n]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values times falling powers, from which the hash of any range follows."""
    out = np.zeros(len(values) + 1, _U)
    if len(values):
        np.cumsum(values * _power(base, True, len(values)), out=out[1:])
    return out


class Words:
    """The words of some texts: ``bounds[d]:bounds[d + 1]`` are the words of text d, ``hash`` their hashes."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            raw = _LOWER[raw]
        edge = np.diff((~_WHITE[raw]).view(np.int8))
        begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        self.hash = np.empty(len(begin), _U)
        a = 0
        while a < len(begin):
            b = max(a + 1, int(np.searchsorted(end, begin[a] + HASHED_BYTES, side="right")))
            low, high = begin[a], end[b - 1]
            x, y = begin[a:b] - low, end[a:b] - low
            sums = _sums(_BYTE[raw[low:high]], 0)
            self.hash[a:b] = scramble((sums[y] - sums[x]) * _power(0, False, high - low)[x] + (y - x).astype(_U))
            a = b
        at = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(begin, at)

    def grams(self, n: int, base: int = 1) -> np.ndarray:
        """Hash of the n words from each word on; only those that stay inside a text are meant to be read."""
        sums = _sums(self.hash, base)
        count = max(0, len(self.hash) - n + 1)
        if not count:
            return np.zeros(0, _U)
        return scramble((sums[n:] - sums[:count]) * _power(base, False, count))

    def starts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of n words inside a text, and the text of each."""
        first, last = self.bounds[:-1], np.maximum(self.bounds[1:] - n + 1, self.bounds[:-1])
        size = last - first
        text = np.repeat(np.arange(len(size)), size)
        return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[text], text


def cuts(sizes: DataFrame, target: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """First ids of chunks of at most ``target`` bytes, in order, and into how many parts each is split.

    sizes: id, bytes, a row for each row. Only an id whose rows together have more bytes
    is a chunk of its own in several parts. What comes to the driver is 16 bytes a chunk.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, split = [], []
        held, own, now = 0, 0, None  # bytes of the open chunk without the open id, of the open id, the open id

        def close() -> None:
            nonlocal held
            if own > target:
                first.append(now)
                split.append(-(-own // target))
                held = target  # whatever follows begins a new chunk
            elif not first or held + own > target:
                first.append(now)
                split.append(1)
                held = own
            else:
                held += own

        for batch in batches:
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != now and now is not None:
                    close()
                    own = 0
                now = i
                own += n
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(split, pa.int64())], ["first", "split"])

    ranged = sizes.where("id is not null").repartitionByRange(parts, "id").sortWithinPartitions("id")
    found = ranged.mapInArrow(cut, "first long, split long").toArrow()
    first, split = found["first"].to_numpy(), found["split"].to_numpy()
    order = np.argsort(first, kind="stable")
    return first[order], split[order]


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """``chunk, id, text`` (text as bytes, null as empty), the number of chunks about, and of buckets.

    Ids must be integers (of any type that casts to long). A chunk holds neighbouring ids
    and at most chunk_bytes bytes, or one longer text; smaller chunks hold smaller ids.
    Of an id with more bytes than that the rows are dealt into several chunks, whose
    numbers agree but for the last ``PART_OF_ID`` bits. Rows with a null id come after all
    others, dealt alike.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    sizes = written(rows.select("id", F.octet_length("text").cast("long").alias("bytes")), "gram-sizes")
    size, nameless = (x or 0 for x in sizes.agg(F.sum("bytes"), F.sum(F.when(F.col("id").isNull(), F.col("bytes")))).first())
    grown = max(1.0, math.sqrt(size / GROWS_FROM))
    target = int(chunk_bytes * grown)
    chunks = max(1, math.ceil(size / target))
    # every part of the range may end in a chunk that isn't full
    first, split = cuts(sizes, target, max(1, min(shuffle_partitions(spark), chunks // 16)))
    forget(sizes)
    split = np.append(split, max(1, math.ceil(nameless / target)))
    sent = spark.sparkContext.broadcast((first, split))

    @F.arrow_udf("long")
    def place(ids: pa.Array) -> pa.Array:
        """Order of the chunk, and above the bits of parts how many there are."""
        first, split = sent.value
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(first), np.maximum(np.searchsorted(first, known, side="right") - 1, 0))
        return pa.array((at << PART_OF_ID) | np.minimum(split[at], (1 << PART_OF_ID) - 1))

    rows = rows.select(place("id").alias("place"), "id", "text")
    many = F.col("place").bitwiseAND((1 << PART_OF_ID) - 1)
    chunk = F.col("place") - many
    if split.max() > 1:
        # rows of one id and text, however many, go to different parts
        chunk = chunk + F.when(many > 1, F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), many)).otherwise(0)
    buckets = max(4 * shuffle_partitions(spark), math.ceil(size / 6 * 8 / (BUCKET_BYTES * min(4.0, grown))))
    return rows.select(chunk.alias("chunk"), "id", "text"), chunks, buckets


def deal(grams: np.ndarray, second: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams in order of their buckets: positions of their first occurrence, counts, and where each bucket begins."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(ranked)))
    first = order[head]
    bucket = (second[first] % _U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return first[by], count[by], np.searchsorted(bucket[by], np.arange(buckets + 1))


def reduced(packets: DataFrame, reduce: Callable[[list, list], tuple[list, list]]) -> DataFrame:
    """Applies reduce to each bucket's packets: lists of chunks and packets in, the like out."""

    def one(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["chunk"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        chunks, out = reduce(rows["chunk"].to_numpy(), rows["packet"].to_pylist())
        if rows.nbytes > 1 << 22:
            give_back()
        bucket = np.full(len(out), rows["bucket"][0].as_py(), np.int32)
        return pa.table({"bucket": pa.array(bucket), "chunk": pa.array(chunks, pa.int64()), "packet": pa.array(out, pa.binary())})

    return packets.groupBy("bucket").applyInArrow(one, "bucket int, chunk long, packet binary")
