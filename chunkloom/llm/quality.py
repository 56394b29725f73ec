"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, four at a time, for each language. Its counts are tables in
Spark: runs of four bytes of the trusted documents, and from them the numbers of
distinct left neighbours for the shorter runs, with the three discounts of each order
from its own counts of counts. Chances and back-off weights follow by joins and stay
sharded by language and middle bytes. Chunks of documents ask each shard once for the
distinct runs that they hold, so a run that every document has is asked for once a
chunk; the answers give every document its perplexity, and the quantile of the trusted
documents of its language decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm._common import shuffle_partitions, table, written
from chunkloom.llm._grams import chunked
from chunkloom.llm.language_id import _START, four_byte_counts

#: Share of the trusted documents of a language whose perplexity lies below the threshold.
QUANTILE = 0.998
#: A text is judged as if so many bytes of the language's usual perplexity came with it, so few bytes prove little.
USUAL_BYTES = 100
CHUNK_BYTES = 8 << 20


@contextmanager
def _filtered_early(spark: SparkSession) -> Iterator[None]:
    """Lets a join on few ids filter the large side by a Bloom filter before the shuffle, whatever its size."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _discounts(counts: DataFrame, c: str) -> DataFrame:
    """lang, d1, d2, d3: the modified Kneser-Ney discounts of a table of counts; 0.5 where counts of counts are missing."""
    n = [F.sum((F.col(c) == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def d(k: int) -> Column:
        value = k - F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.when((value > 0) & (value <= k), value).otherwise(0.5 * k).alias(f"d{k}")

    return counts.groupBy("lang").agg(*n).select("lang", d(1), d(2), d(3))


def _order(counts: DataFrame, c: str, width: int) -> DataFrame:
    """lang, gram, alpha, gamma: the discounted share of each run, and what its context leaves to shorter ones.

    counts: lang, gram (width bytes as a number), c. The context is all but the last byte.
    """
    context = F.shiftright("gram", 8) if width > 1 else F.lit(0)
    rows = counts.withColumn("ctx", context).join(F.broadcast(_discounts(counts, c)), "lang")  # a row for each language
    cut = F.when(F.col(c) == 1, F.col("d1")).when(F.col(c) == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = rows.withColumn("cut", F.least(cut, F.col(c)))
    # a context has at most 256 runs, so its window is no large group
    group = Window.partitionBy("lang", "ctx")
    total = F.sum(c).over(group)
    return rows.select("lang", "gram", "ctx", ((F.col(c) - F.col("cut")) / total).alias("alpha"), (F.sum("cut").over(group) / total).alias("gamma"))


def model(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables of a model: sharded rows (lang, kind, key, value) and a row of packed arrays for the two bytes of each language.

    counts: lang, gram (four bytes), n. Kinds: 4 and 3 chances of runs seen, interpolated
    down to equal chances; 14 and 13 back-off weights of contexts seen. The packed row has
    the chances p1 of a byte, the weights g2 of its 256 contexts, and the pairs seen with
    their own shares, so it is as large as what the language has shown.
    """
    four = counts.select("lang", "gram", F.col("n").cast("double").alias("c"))
    three = written(four.groupBy("lang", F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("c")), "quality-three")
    two = three.groupBy("lang", F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    one = two.groupBy("lang", F.col("gram").bitwiseAND(0xFF).alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    o2, o1 = written(_order(two, "c", 2), "quality-o2"), written(_order(one, "c", 1), "quality-o1")

    def pack(twos: pa.Table, ones: pa.Table) -> pa.Table:
        gram, alpha = ones["gram"].to_numpy(), ones["alpha"].to_numpy()
        p1 = np.full(256, (ones["gamma"][0].as_py() if len(gram) else 1.0) / 256)
        p1[gram.astype(np.int64)] += alpha
        g2 = np.ones(256)
        g2[twos["ctx"].to_numpy().astype(np.int64)] = twos["gamma"].to_numpy()
        by = np.argsort(twos["gram"].to_numpy())
        packed = [p1, g2, twos["gram"].to_numpy()[by].astype(np.uint16), twos["alpha"].to_numpy()[by]]
        return pa.table({"lang": ones["lang"][:1], **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("p1", "g2", "pairs", "shares"), packed, strict=True)}})

    # a group has at most 65,536 pairs
    lows = o2.groupBy("lang").cogroup(o1.groupBy("lang")).applyInArrow(pack, "lang string, p1 binary, g2 binary, pairs binary, shares binary")
    # every run of three seen ends in a pair seen, and that in a byte seen
    equal = o1.select("lang", F.col("gram").alias("last"), (F.col("alpha") + F.col("gamma") / 256).alias("p1"))
    p2 = o2.withColumn("last", F.col("gram").bitwiseAND(0xFF)).join(equal, ["lang", "last"]).select("lang", F.col("gram").alias("pair"), (F.col("alpha") + F.col("gamma") * F.col("p1")).alias("p2"))
    o3 = written(_order(three, "c", 3), "quality-o3")
    p3 = o3.withColumn("pair", F.col("gram").bitwiseAND(0xFFFF)).join(p2, ["lang", "pair"]).select("lang", "gram", "ctx", "gamma", (F.col("alpha") + F.col("gamma") * F.col("p2")).alias("p"))
    p3 = written(p3, "quality-p3")
    o4 = written(_order(four, "c", 4), "quality-o4")
    up = p3.select("lang", F.col("gram").alias("low"), F.col("p").alias("p_low"))
    p4 = o4.withColumn("low", F.col("gram").bitwiseAND(0xFFFFFF)).join(up, ["lang", "low"]).select("lang", "gram", (F.col("alpha") + F.col("gamma") * F.col("p_low")).alias("p"))

    def rows(df: DataFrame, kind: int, key: str, value: str) -> DataFrame:
        return df.select("lang", F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("value"))

    every = rows(p4, 4, "gram", "p").unionByName(rows(p3, 3, "gram", "p"))
    every = every.unionByName(rows(o4.select("lang", "ctx", "gamma").distinct(), 14, "ctx", "gamma")).unionByName(rows(o3.select("lang", "ctx", "gamma").distinct(), 13, "ctx", "gamma"))
    return every, lows


def _runs(texts: list[bytes], lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of four bytes with their language above them, and where each text's begin."""
    some = [_START + t for t in texts]
    raw = np.frombuffer(b"".join(some), np.uint8).astype(np.int64)
    ends = np.cumsum([0, *map(len, some)])
    if len(raw) < 4:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    gram = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    keep = np.ones(len(gram), bool)
    for back in range(1, 4):
        keep[np.maximum(ends[1:-1] - back, 0)] = False
    bounds = ends - 3 * np.arange(len(ends))
    return gram[keep] | (np.repeat(lang, np.diff(bounds)) << 32), bounds


def _asked(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs in order of their shards, and where each shard begins. A shard is told by language and middle bytes."""
    own = np.unique(gram)
    shard = (own >> 8 & 0xFFFF) + (own >> 32 << 16)
    shard = shard * 40503 % 65537 % buckets
    by = np.argsort(shard, kind="stable")
    return own[by], np.searchsorted(shard[by], np.arange(buckets + 1))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: ``id, lang, n_bytes, perplexity``.

    trusted: a column ``id`` of documents that the model learns from. perplexity (of a
    byte) is null for null or empty texts, for rows without a language and for
    languages in which no trusted text was found.
    """
    spark = docs.sparkSession
    # a line feed parts language and text on the way
    told = docs.select(F.col(id_col).alias("id"), F.translate(F.col(lang_col).cast("string"), "\n", " ").alias("lang"), F.col(text_col).alias("text"))
    with _filtered_early(spark):
        known = told.where("lang is not null and text is not null").join(trusted.select("id"), "id", "left_semi")
        counts = written(four_byte_counts(known), "quality-counts")
    sharded, lows = model(counts)
    packed = sorted(lows.collect(), key=lambda r: r["lang"])  # a row for each language
    number = {r["lang"]: k for k, r in enumerate(packed)}
    pairs = [(k << 16) | np.frombuffer(r["pairs"], np.uint16).astype(np.int64) for k, r in enumerate(packed)]
    kinds = [np.array([np.frombuffer(r[c]) for r in packed]).reshape(-1, 256) for c in ("p1", "g2")]
    shares = [np.frombuffer(r["shares"]) for r in packed]
    sent = spark.sparkContext.broadcast((*kinds, np.concatenate([*pairs, np.zeros(0, np.int64)]), np.concatenate([*shares, np.zeros(0)])))

    rows, _, _ = chunked(told.withColumn("text", F.concat_ws("\n", F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))), "id", "text", CHUNK_BYTES)
    buckets = 4 * shuffle_partitions(spark)

    def split(group: pa.Table) -> tuple[list[str | None], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, texts, the rows that can be scored, and their runs."""
        parts = [t.split(b"\n", 1) for t in group["text"].to_pylist()]
        lang, texts = [p[0].decode() or None for p in parts], [p[1] for p in parts]
        usable = np.array([k for k, (x, t) in enumerate(zip(lang, texts, strict=True)) if x in number and t], np.int64)
        gram, bounds = _runs([texts[k] for k in usable], np.array([number[lang[k]] for k in usable], np.int64))
        return lang, texts, usable, gram, bounds

    def ask(group: pa.Table) -> pa.Table:
        _, _, _, gram, _ = split(group)
        own, begin = _asked(gram, buckets)
        used = np.flatnonzero(np.diff(begin))
        return pa.table(
            {
                "bucket": pa.array(used.astype(np.int32)),
                "chunk": pa.array(np.full(len(used), group["chunk"][0].as_py(), np.int64)),
                "packet": pa.array([own[begin[b] : begin[b + 1]].tobytes() for b in used], pa.binary()),
            }
        )

    def answer(asks: pa.Table, shard: pa.Table) -> pa.Table:
        kind, key, value = shard["kind"].to_numpy(), shard["key"].to_numpy() | (shard["n"].to_numpy().astype(np.int64) << 32), shard["value"].to_numpy()
        held = {}
        for k in (4, 3, 14, 13):
            some = np.flatnonzero(kind == k)
            some = some[np.argsort(key[some])]
            held[k] = key[some], value[some]

        def find(k: int, wanted: np.ndarray, otherwise: np.ndarray | float) -> np.ndarray:
            keys, values = held[k]
            if not len(keys):
                return np.broadcast_to(np.asarray(otherwise, float), wanted.shape)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, values[at], otherwise)

        out = []
        for packet in asks["packet"].to_pylist():
            full = np.frombuffer(packet, np.int64)
            lang, gram = full >> 32 << 32, full & 0xFFFFFFFF
            p1, g2, pairs, shares = sent.value
            p2 = g2[full >> 32, (gram >> 8) & 255] * p1[full >> 32, gram & 255]
            pair = full >> 32 << 16 | (gram & 0xFFFF)
            at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            p2 += np.where(pairs[at] == pair, shares[at], 0.0)
            p3 = find(3, lang | (gram & 0xFFFFFF), find(13, lang | (gram >> 8 & 0xFFFF), 1.0) * p2)
            p4 = find(4, full, find(14, lang | (gram >> 8), 1.0) * p3)
            out.append(np.log(p4).astype("<f4").tobytes())
        return pa.table({"bucket": asks["bucket"], "chunk": asks["chunk"], "packet": pa.array(out, pa.binary())})

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        lang, texts, usable, gram, bounds = split(group)
        out: list[float | None] = [None] * len(texts)
        if len(gram):
            own, _ = _asked(gram, buckets)
            order = np.argsort(answers["bucket"].to_numpy(), kind="stable")
            packets = answers["packet"].to_pylist()
            logs = np.frombuffer(b"".join(packets[k] for k in order), "<f4").astype(np.float64)
            by = np.argsort(own)
            each = logs[by][np.searchsorted(own[by], gram)]
            sums = np.concatenate(([0.0], np.cumsum(each)))
            for k, a, b in zip(usable, bounds, bounds[1:], strict=False):
                out[k] = float(np.exp(-(sums[b] - sums[a]) / (b - a)))
        return pa.table({"id": group["id"], "lang": pa.array(lang, pa.string()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "perplexity": pa.array(out, pa.float64())})

    packets = rows.groupBy("chunk").applyInArrow(ask, "bucket int, chunk long, packet binary")
    numbers = F.broadcast(spark.createDataFrame(list(number.items()), "lang string, n int"))
    middle = F.when(F.col("kind") == 4, F.shiftright("key", 8)).when(F.col("kind") == 3, F.shiftright("key", 8)).otherwise(F.col("key")).bitwiseAND(0xFFFF)
    shards = sharded.join(numbers, "lang").withColumn("bucket", ((middle + F.shiftleft(F.col("n").cast("long"), 16)) * 40503 % 65537 % buckets).cast("int"))
    shards = written(shards.select("bucket", "n", "kind", "key", "value"), "quality-shards")
    answers = packets.groupBy("bucket").cogroup(shards.groupBy("bucket")).applyInArrow(answer, "bucket int, chunk long, packet binary")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, "id long, lang string, n_bytes long, perplexity double")


def judged(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, **columns: str) -> DataFrame:
    """One row per input row: ``id, lang, n_bytes, perplexity, judged, threshold, kept``.

    judged is the perplexity with USUAL_BYTES bytes of the median of the language's trusted
    documents; threshold is the quantile of what these documents are judged by. A document
    is kept unless it is judged above it; empty texts go, texts that can't be judged stay,
    with nulls for what is not known.
    """
    scored = written(perplexities(docs, trusted, **columns), "quality-scored")
    own = written(scored.where("perplexity is not null").join(trusted.select("id"), "id", "left_semi").select("lang", "n_bytes", "perplexity"), "quality-own")
    usual = written(own.groupBy("lang").agg(F.percentile_approx("perplexity", 0.5, 10_000).alias("usual")), "quality-usual", 1)

    def weighed(rows: DataFrame) -> DataFrame:
        # a row for each language
        n = F.col("n_bytes")
        joined = rows.join(F.broadcast(usual), "lang", "left")
        return joined.withColumn("judged", F.exp((n * F.log("perplexity") + USUAL_BYTES * F.log("usual")) / (n + USUAL_BYTES))).drop("usual")

    limits = written(weighed(own).groupBy("lang").agg(F.percentile_approx("judged", quantile, 10_000).alias("threshold")), "quality-limits", 1)
    kept = F.when(F.col("n_bytes") == 0, False).otherwise(F.coalesce(F.col("judged") <= F.col("threshold"), F.lit(True)))
    return weighed(scored).join(F.broadcast(limits), "lang", "left").select("id", "lang", "n_bytes", "perplexity", "judged", "threshold", kept.alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, perplexity, judged, threshold, kept. Trusted are documents labelled of quality 1."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return judged(table(spark, sf_dir, "documents"), trusted).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
