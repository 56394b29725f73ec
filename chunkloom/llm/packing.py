"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Pieces of
one length are interchangeable, so a solution is a table of bin patterns (the lengths
in a bin) with multiplicities: its size is bounded by the capacity and not by the
number of documents. Islands, one Spark task each, evolve populations of such
solutions on the histogram of lengths:

* crossover injects whole well-filled bins of one parent into the other, takes out
  the bins that now hold duplicates (more of a length than there is), and best-fits
  the displaced pieces, first into gaps and then into new bins;
* after each epoch every island sends its elite to the next island.

At last every piece finds its place by its rank among the pieces of its length, which
is counted in salted groups, so a length that a third of all pieces share is no group.
"""

from __future__ import annotations

import json
import math
import os
import pickle
import random
import re
import struct
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm._common import give_back, table, written

CAPACITY = 2048
#: Pieces of one length that are ranked together, about.
RANKED_ROWS = 4000

Pattern = tuple[int, ...]
Solution = dict[Pattern, int]


# ---------------------------------------------------------------- tokens


#: How a tokenizer file must normalise and split texts for words to be tokenised one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}


class WordTokens(dict):
    """Token ids of words, as little-endian unsigned 32-bit numbers; each word is tokenised once while it is remembered.

    This holds for a file that folds and splits texts as stated above and whose added
    tokens hold no white space: a text's ids are then those of its words one after the
    other. Words made of Latin letters and then ASCII marks are put together from these
    two, each remembered too, which goes straight to the tokenizer's model. Any other
    word, and one that holds an added token, goes through the whole tokenizer. With any
    other file every text does. remembered bounds the entries of each kind.
    """

    USUAL = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, remembered: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = [t.content for t in added]
        plain_tokens = all(not (t.normalized or t.lstrip or t.rstrip or t.single_word) and not re.search(r"\s", t.content) for t in added)
        whole = self.tokenizer.truncation is None and self.tokenizer.padding is None
        steps = [part and json.loads(part.__getstate__()) for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.by_word = steps == [_NORMALIZER, _PRE_TOKENIZER] and type(self.tokenizer.model).__name__ == "BPE" and plain_tokens and whole
        self.tokenize = self.tokenizer.model.tokenize
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.remembered = remembered
        self.parts: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            if len(self.parts) >= self.remembered:
                self.parts = {"": b""}
            level = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            found = [t.id for t in self.tokenize(level)]
            ids = self.parts[part] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _whole(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.remembered:
            self.clear()
        text = word.decode()
        usual = self.USUAL.fullmatch(text)
        if usual and not any(t in text for t in self.added):
            ids = self._part(usual[1].lower()) + self._part(usual[2])
        else:
            ids = self._whole(text)
        self[word] = ids
        return ids

    def forget(self) -> None:
        """Gives back the memory of what is remembered."""
        self.clear()
        self.parts = {"": b""}

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


_tokens: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents: ``id, piece, start, length, ids_crc32``.

    A document is its ids and then id 0; a null text is an empty one. Only documents
    of more than capacity ids are cut, into pieces of capacity ids and a rest.
    """
    kind = docs.schema[id_col].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokens:
            _tokens[tokenizer_path] = WordTokens(tokenizer_path)
        words = _tokens[tokenizer_path]
        step = 4 * capacity
        for batch in batches:
            of, number, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):  # one text at a time in Python's memory
                ids = words.ids(text.as_py() or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    of.append(row)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )
        words.forget()
        give_back()  # workers live on for other tasks

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the genetic algorithm, on a histogram of lengths


def lower_bound(counts: Counter, capacity: int) -> int:
    """No packing has fewer bins (Martello and Toth's L2)."""
    size = np.zeros(capacity + 1)
    for x, n in counts.items():
        size[x] = n
    tokens = size * np.arange(capacity + 1)
    n_up, t_up = np.cumsum(size[::-1])[::-1], np.cumsum(tokens[::-1])[::-1]  # of lengths >= i
    n_up, t_up = np.append(n_up, 0), np.append(t_up, 0)
    half, best = capacity // 2, math.ceil(t_up[0] / capacity)
    for a in range(half + 1):
        n1, n2 = n_up[capacity - a + 1], n_up[half + 1] - n_up[capacity - a + 1]
        t2, t3 = t_up[half + 1] - t_up[capacity - a + 1], t_up[a] - t_up[half + 1]
        best = max(best, int(n1 + n2 + max(0, math.ceil((t3 - (n2 * capacity - t2)) / capacity))))
    return best


def best_fit(counts: Counter, capacity: int, rng: random.Random | None = None) -> Solution:
    """Fills bins one pattern at a time: the longest piece, then always the longest that still fits.

    With rng, one of the three longest that fit is taken, so that solutions differ.
    """
    left = {x: n for x, n in counts.items() if n > 0}
    have = sorted(left)
    out: Solution = {}
    while have:
        space, items = capacity - have[-1], [have[-1]]
        used = Counter(items)
        while space > 0:
            k = bisect_right(have, space)
            if rng and k > 1 and len(items) > 0 and rng.random() < 0.3:
                k = max(1, k - rng.randrange(3))
            while k > 0 and used[have[k - 1]] >= left[have[k - 1]]:
                k -= 1
            if k == 0:
                break
            x = have[k - 1]
            items.append(x)
            used[x] += 1
            space -= x
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                have.remove(x)
                del left[x]
        pattern = tuple(sorted(items, reverse=True))
        out[pattern] = out.get(pattern, 0) + times
    return out


def into_gaps(kept: Solution, loose: Counter, capacity: int) -> Solution:
    """Best-fits loose pieces, longest first, into the fullest bins that still have room; loose keeps the rest."""
    gaps = sorted((capacity - sum(p), p) for p in kept if sum(p) < capacity)
    out = Counter(kept)
    for x in sorted(loose, reverse=True):
        while loose[x] and gaps:
            k = bisect_right(gaps, (x, ()))
            if k == len(gaps):
                break
            gap, pattern = gaps[k]
            times = min(loose[x], out[pattern])
            out[pattern] -= times
            if not out[pattern]:
                del out[pattern]
                gaps.pop(k)
            loose[x] -= times
            new = tuple(sorted((*pattern, x), reverse=True))
            if new not in out and gap > x:
                insort(gaps, (gap - x, new))
            out[new] += times
    return dict(out)


def crossover(into: Solution, donor: Solution, counts: Counter, capacity: int, rng: random.Random) -> Solution:
    """Whole well-filled bins of donor, the bins of into that hold no duplicates, and the displaced pieces best-fitted."""
    left, child = Counter(counts), Counter()
    full = sorted(donor, key=sum, reverse=True)
    bar = rng.choice((1.0, 0.99, 0.95)) * capacity
    for pattern in full:
        if sum(pattern) >= bar and rng.random() < 0.6:
            times = donor[pattern] if rng.random() < 0.5 else rng.randint(1, donor[pattern])
            child[pattern] += times
            for x in pattern:
                left[x] -= times
    for pattern in sorted(into, key=lambda p: (sum(p), p), reverse=True):
        if sum(pattern) < 0.9 * capacity and rng.random() < 0.5:
            continue  # mutation: badly filled bins are taken apart
        used = Counter(pattern)
        times = min(into[pattern], min(left[x] // n for x, n in used.items()))
        if times > 0:
            child[pattern] += times
            for x, n in used.items():
                left[x] -= n * times
    loose = Counter({x: n for x, n in left.items() if n > 0})
    out = Counter(into_gaps(dict(child), loose, capacity))
    for pattern, times in best_fit(loose, capacity, rng if rng.random() < 0.5 else None).items():
        out[pattern] += times
    return dict(out)


def fitness(solution: Solution, capacity: int) -> tuple[float, float]:
    """Bins, fewer are better, then how unevenly they are filled."""
    return sum(solution.values()), -sum(n * (sum(p) / capacity) ** 2 for p, n in solution.items())


def evolve(population: list[Solution], counts: Counter, capacity: int, generations: int, size: int, seed: int) -> list[Solution]:
    rng = random.Random(seed)
    bound = lower_bound(counts, capacity)
    while len(population) < size:
        population.append(best_fit(counts, capacity, rng if population else None))
    population.sort(key=lambda s: fitness(s, capacity))
    for _ in range(generations):
        if fitness(population[0], capacity)[0] <= bound:
            break
        a, b = (min(rng.sample(range(len(population)), 2)) for _ in range(2))
        population.append(crossover(population[a], population[b], counts, capacity, rng))
        population.sort(key=lambda s: fitness(s, capacity))
        population.pop()
    return population


def pack_histogram(spark: SparkSession, counts: Counter, capacity: int = CAPACITY, islands: int = 4, epochs: int = 2, generations: int = 30, size: int = 6, seed: int = 11) -> Solution:
    """The best solution that the islands find. What moves is bounded by capacity, islands and size."""
    if not counts:
        return {}
    bound = lower_bound(counts, capacity)
    states: list[list[Solution]] = [[] for _ in range(islands)]
    for epoch in range(epochs):
        rows = [(k, pickle.dumps(s)) for k, s in enumerate(states)]

        def live(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    grown = evolve(pickle.loads(state), counts, capacity, generations, size, seed * 1000 + epoch * 100 + k)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(grown)], pa.binary())], ["island", "state"])

        frame = spark.createDataFrame(rows, "island int, state binary").repartition(islands)
        grown = {r.island: pickle.loads(bytes(r.state)) for r in frame.mapInArrow(live, "island int, state binary").collect()}
        # elite migration: the best of each island takes the place of the worst of the next
        states = [[*grown[k][:-1], grown[(k - 1) % islands][0]] if len(grown[k]) > 1 else grown[k] for k in range(islands)]
        best = min((s for state in grown.values() for s in state), key=lambda s: (*fitness(s, capacity), sorted(s)))
        if fitness(best, capacity)[0] <= bound:
            break
    return best


# ---------------------------------------------------------------- places


def _blocks(solution: Solution) -> list[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """For each length, runs of ranks: (first rank, rank after the last, pieces a bin, offset of the first, first bin)."""
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    seen: Counter = Counter()
    first = 0
    for pattern in sorted(solution, key=lambda p: (-sum(p), p)):
        times, at = solution[pattern], 0
        for x, n in sorted(Counter(pattern).items(), reverse=True):
            runs.setdefault(x, []).append((seen[x], seen[x] + n * times, n, at, first))
            seen[x] += n * times
            at += n * x
        first += times
    return sorted(runs.items())


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **search: int) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null texts count as empty and are one piece of one id; repeated rows are packed
    each on their own; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, tokenizer_path, capacity), "pack-pieces")
    counts = Counter({r["length"]: r["count"] for r in cut.groupBy("length").count().collect()})  # at most capacity rows
    solution = pack_histogram(spark, counts, capacity, **search)
    salts = max(1, math.ceil(sum(counts.values()) / RANKED_ROWS))
    runs = spark.createDataFrame(_blocks(solution), "length long, runs array<struct<lo: long, hi: long, n: long, at: long, first: long>>")

    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", rank).join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the table of runs is bounded by capacity: a row per length, and a run per length and pattern
    run = ranked.join(F.broadcast(runs), "length").withColumn("run", F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0])
    at = F.col("rank") - F.col("run.lo")
    return run.select(
        "id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("run.first") + F.floor(at / F.col("run.n"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + at % F.col("run.n") * F.col("length")).cast("long").alias("offset"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_packing": op2_packing}
ORACLE_SQL: dict[str, str] = {}
