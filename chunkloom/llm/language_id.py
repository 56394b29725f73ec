"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to three preceding bytes. A byte that its
context has not seen escapes to the next shorter context (method C: a context of n
bytes and t distinct ones escapes with t / (n + t)), with exclusion of the bytes that
the longer context has seen, down to equal chances for all 256. Statistics are frozen
after training, so the code length of every byte in every context is worked out once,
into a table; scoring a text is then a look-up for each byte, and the language with
the shortest code wins. Where there are many languages, their tables are made and used
block by block, so a worker holds those of a few languages at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from chunkloom.llm._common import fresh, give_back, quoted, table

UNKNOWN = "und"
#: Training rows of a language, about; where it has more, so many are chosen by a hash of their id.
TRAIN_ROWS = 4000
#: Contexts with the byte behind them (four bytes) that a language keeps, the most frequent ones.
TREE_LEAVES = 200_000
#: Bytes of code lengths that a worker holds at a time, unless one language alone takes more.
TABLE_BYTES = 48 << 20
#: Bytes of text that are scored at once, and that wait for their turn where there are several blocks of languages.
SCORED_BYTES, WAITING_BYTES = 1 << 18, 32 << 20
#: Contexts whose code lengths are worked out at once.
_ROWS = 1024
_START = b"\n\n\n"


def four_byte_counts(texts: DataFrame) -> DataFrame:
    """``lang, gram, n``: how often each run of four bytes (big-endian number) occurs in texts (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(_START + text)
            for lang, some in by.items():
                total: dict[int, int] = {}
                for at in range(0, len(some), 500):
                    raw = np.frombuffer(b"".join(some[at : at + 500]), np.uint8).astype(np.uint32)
                    ends = np.cumsum([len(t) for t in some[at : at + 500]])
                    gram = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
                    inside = np.ones(len(gram), bool)
                    for back in range(1, 4):
                        inside[ends[:-1] - back] = False
                    for g, n in zip(*(x.tolist() for x in np.unique(gram[inside], return_counts=True)), strict=True):
                        total[g] = total.get(g, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["lang", "gram", "n"])
        give_back()

    parts = texts.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """The trees of all languages with their table of code lengths.

    counts: language -> (grams, numbers). ``bits`` has a row for every context of two
    or three bytes that some language has seen, and for every single byte; ``state``
    names the row of any three bytes: that of the longest context that has one.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        seen = np.unique(np.concatenate([g for g, _ in counts.values()] or [np.zeros(0, np.int64)]))
        split = [(seen >> s) & 255 for s in (24, 16, 8, 0)]
        used = np.unique(np.concatenate(split))
        # bytes that no training text has share symbol 0
        self.symbol = np.zeros(256, np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)
        size = self.size = len(used) + 1
        rare = 256 - len(used)
        sym = [self.symbol[x] for x in split]
        pairs = np.unique(sym[1] * size + sym[2])
        triples = np.unique((sym[0] * size + sym[1]) * size + sym[2])
        ones, twos = size, len(pairs)
        rows = ones + twos + len(triples)
        row_of_pair = (np.arange(size * size) % size).astype(np.int32)
        row_of_pair[pairs] = ones + np.arange(twos)
        self.state = np.tile(row_of_pair, size)
        self.state[triples] = ones + twos + np.arange(len(triples))
        up_pair, up_triple = pairs % size, row_of_pair[triples % (size * size)] - ones
        self.bits = np.zeros((rows, size, len(self.languages)), np.float32)
        for k, lang in enumerate(self.languages):
            g, n = counts[lang]
            s = [self.symbol[(g >> x) & 255] for x in (24, 16, 8, 0)]
            zero, one, two = np.zeros(size), np.zeros((size, size)), np.zeros((twos, size))
            np.add.at(zero, s[3], n)
            np.add.at(one, (s[2], s[3]), n)
            np.add.at(two, (np.searchsorted(pairs, s[1] * size + s[2]), s[3]), n)
            # chances without any context: equal for all 256 bytes that the language has not seen
            share = np.ones(size)
            share[0] = rare
            zeros = np.broadcast_to(zero, one.shape)
            self.bits[:ones, :, k] = self._chain([one, zeros], share)
            for lo in range(0, twos, _ROWS):
                above = up_pair[lo : lo + _ROWS]
                self.bits[ones + lo : ones + lo + len(above), :, k] = self._chain([two[lo : lo + _ROWS], one[above], zeros[above]], share)
            place = np.searchsorted(triples, (s[0] * size + s[1]) * size + s[2])
            by = np.argsort(place, kind="stable")
            place, last, times = place[by], s[3][by], n[by]
            for lo in range(0, len(triples), _ROWS):
                above = up_triple[lo : lo + _ROWS]
                own = slice(*np.searchsorted(place, (lo, lo + _ROWS)))
                three = np.zeros((len(above), size))
                np.add.at(three, (place[own] - lo, last[own]), times[own])
                row = ones + twos + lo
                self.bits[row : row + len(above), :, k] = self._chain([three, two[above], one[up_pair[above]], zeros[up_pair[above]]], share)

    @staticmethod
    def _chain(tables: list[np.ndarray], share: np.ndarray) -> np.ndarray:
        """Code lengths in bits. tables: counts of some contexts, a row each, and then of their shorter ones."""
        out = np.zeros_like(tables[0])
        open_ = np.ones_like(tables[0], bool)  # symbols whose code is not yet found, the same as those not excluded
        for t in tables:
            n, kinds = np.where(open_, t, 0).sum(1, keepdims=True), (open_ & (t > 0)).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit, escape = -np.log2(t / (n + kinds)), np.where(n > 0, -np.log2(kinds / (n + kinds)), 0.0)
            now = open_ & (t > 0)
            out += np.where(now, np.nan_to_num(hit, posinf=0), np.where(open_, escape, 0.0))
            open_ &= t == 0
        rest = np.where(open_, share, 0).sum(1, keepdims=True)
        # the symbol of the rare bytes stands for one of them, so its chance is one of theirs
        return out + np.where(open_, np.log2(np.maximum(rest, 1)), 0.0)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text under every language. A long text is taken in parts, each with the three bytes before it."""
        out = np.zeros((len(texts), len(self.languages)))
        parts, owner, waiting = [], [], 0

        def score() -> None:
            sym = self.symbol[np.frombuffer(b"".join(parts), np.uint8)]
            rows = self.state[(sym[:-3] * self.size + sym[1:-2]) * self.size + sym[2:-1]]
            cost = self.bits.reshape(-1, len(self.languages))[rows * self.size + sym[3:]]
            ends = np.cumsum([len(t) for t in parts])
            begins = np.concatenate(([0], ends[:-1]))
            # sums of [begin, end - 3) and, unread, of what lies between two texts
            places = np.stack((begins, ends - 3), 1).ravel()[:-1]
            np.add.at(out, owner, np.add.reduceat(cost, places, axis=0, dtype=np.float64)[::2])

        for k, text in enumerate(texts):
            for at in range(0, len(text), SCORED_BYTES):
                before = (_START + text[max(0, at - 3) : at])[-3:]
                parts.append(before + text[at : at + SCORED_BYTES])
                owner.append(k)
                waiting += len(parts[-1])
                if waiting >= SCORED_BYTES:
                    score()
                    parts, owner, waiting = [], [], 0
        if parts:
            score()
        return out


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, leaves: int = TREE_LEAVES) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts of four bytes by language, from rows (id, lang, text) with a language.

    Every language is learned, from about train_rows rows chosen by a hash of the id; it
    keeps its ``leaves`` most frequent runs, so what is sent is bounded by the languages.
    """
    clean = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a row for each language
    sizes = clean.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    sample = clean.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < F.lit(train_rows * 1_000_000) / F.col("rows"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = four_byte_counts(sample).withColumn("r", best).where(F.col("r") <= leaves).select("lang", "gram", "n").toPandas()
    return {lang: (part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.int64)) for lang, part in found.groupby("lang")}


def blocks(counts: dict[str, tuple[np.ndarray, np.ndarray]], most: int = TABLE_BYTES) -> list[list[str]]:
    """Languages in order of their names, dealt into blocks whose tables take at most about ``most`` bytes, or hold one language."""
    out: list[list[str]] = []
    for lang in sorted(counts):
        gram = counts[lang][0]
        used = np.unique(np.concatenate([(gram >> s) & 255 for s in (24, 16, 8, 0)])) if len(gram) else gram
        contexts = len(np.unique(gram >> 8)) + len(np.unique((gram >> 8) & 0xFFFF)) + 256
        if out:
            now_contexts, now_used = contexts + together[0], np.union1d(used, together[1])
            if now_contexts * (len(now_used) + 1) * (len(out[-1]) + 1) * 4 <= most:
                out[-1].append(lang)
                together = now_contexts, now_used
                continue
        out.append([lang])
        together = contexts, used
    return out


def identified(texts: DataFrame, counts: dict[str, tuple[np.ndarray, np.ndarray]], table_bytes: int = TABLE_BYTES) -> DataFrame:
    """texts plus ``lang_pred, score, bits_per_byte``; only the column text is looked at.

    lang_pred is the language with the shortest code, the first by name of equals, or
    ``und`` if the text is null or has no letter (or nothing was learned); score is the
    probability of that language, equal before, among those learned: 0 with ``und``.
    Every row is answered, repeated ones too; an empty table gives an empty result. Texts
    are read whole, long ones in parts. Columns of texts pass unchanged, but one that has
    the name of a result gives way to it.
    """
    sent = texts.sparkSession.sparkContext.broadcast(counts)
    turns = blocks(counts, table_bytes)
    results = ["lang_pred", "score", "bits_per_byte"]
    own = [c for c in texts.columns if c.lower() not in results]
    letter = fresh(own, "letter")

    def answer(batches: list[pa.RecordBatch], trees: list[ContextTrees | None]) -> Iterator[pa.RecordBatch]:
        every = sent.value
        languages = sorted(every)
        wanted = [[k for k, a in enumerate(b.column(letter).to_pylist()) if a and languages] for b in batches]
        bits = [np.zeros((len(w), len(languages))) for w in wanted]
        at = 0
        for turn, block in enumerate(turns):
            if trees[turn] is None:
                now = ContextTrees({lang: every[lang] for lang in block})
                if len(turns) == 1:  # the only table is kept while the task lasts
                    trees[turn] = now
            else:
                now = trees[turn]
            for b, w, found in zip(batches, wanted, bits, strict=True):
                texts_ = b.column("text").cast(pa.binary())
                for some in range(0, len(w), 256):
                    found[some : some + 256, at : at + len(block)] = now.code_lengths([texts_[k].as_py() for k in w[some : some + 256]])
            at += len(block)
            del now
        for b, w, found in zip(batches, wanted, bits, strict=True):
            size = pc.binary_length(b.column("text").cast(pa.binary())).to_pylist()
            lang, chance, each = [UNKNOWN] * len(size), [0.0] * len(size), [None] * len(size)
            best = found.argmin(1) if w else []
            for k, row, x in zip(w, found, best, strict=True):
                lang[k] = languages[x]
                chance[k] = float(1 / np.exp2(np.maximum(row[x] - row, -1000)).sum())
                each[k] = float(row[x] / max(1, size[k]))
            kept = b.drop_columns([letter])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lang, pa.string()), pa.array(chance, pa.float64()), pa.array(each, pa.float64())], [*kept.schema.names, *results])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: list[ContextTrees | None] = [None] * len(turns)
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if len(turns) <= 1 or size >= WAITING_BYTES:
                yield from answer(waiting, trees)
                waiting, size = [], 0
        if waiting:
            yield from answer(waiting, trees)
        trees.clear()
        give_back()

    told = texts.select(*quoted(own), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter))
    schema = StructType([*texts.select(*quoted(own)).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())])
    return told.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def learned(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts from the documents (doc_id, lang, text) that are not held out."""
    return fit(docs.where(~held_out()).select(F.col("doc_id").alias("id"), "lang", "text"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    return identified(docs.select("doc_id", "text"), learned(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
