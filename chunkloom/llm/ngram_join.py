"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of hashes of its distinct 5-word shingles. Shingles are ordered
from rare to common over all documents; two sets with Jaccard similarity t share a
shingle among the first n - ceil(t n) + 1 of each. A shingle that only one document
has can't be shared, so only the others of a prefix are joined on.

Equal sets are one node of the join, a document whose id is repeated with several texts
links its nodes, and what matters are classes: documents that links reach. Families of near copies would give a number of pairs that grows with the
square of their size, so links are sought in turns. First every document is compared
with one hub for each of its rarest prefix shingles; after that whole families are
connected. Then, for each prefix shingle, only pairs whose documents are not yet in
one component are candidates: all pairs that could still join two classes, so no
class is missed. Candidates pass the length and positional filters where they are
made; each pair then passes the suffix filter and is verified once on the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._common import forget, give_back, table, written
from chunkloom.llm._components import components
from chunkloom.llm._grams import Words, chunked, deal, reduced

SHINGLE = 5
PERCENT = 75
#: Hubs that a document is compared with at most in each round, and rounds.
HUBS = 8
HUB_ROUNDS = 2
#: The suffix filter compares so many bits' number of parts of the range of hashes.
PART_BITS = 7


def _sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles, the text of each, and hashes for buckets; a text of fewer words is one shingle."""
    words = Words(texts, lower=True)
    start, text = words.starts(n)
    first, second = words.grams(n)[start], words.grams(n, 2)[start]
    size = np.diff(words.bounds)
    for d in np.flatnonzero((size > 0) & (size < n)):
        part = Words.__new__(Words)
        part.hash = words.hash[words.bounds[d] : words.bounds[d + 1]]
        first, second, text = np.append(first, part.grams(len(part.hash))), np.append(second, part.grams(len(part.hash), 2)), np.append(text, d)
    return first, text, second


def _pack(gram: np.ndarray, n: np.ndarray) -> bytes:
    """Upper 40 bits of grams and their numbers, each part apart, so that the many ones compress to nothing.

    With the bucket that is enough here: two grams that agree in both count as one in
    the order of grams, the same for all documents, and never as one when sets are
    compared.
    """
    top = gram.astype(np.uint64) >> np.uint64(24)
    return (top & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (top >> np.uint64(32)).astype("<u1").tobytes() + n.astype("<u4").tobytes()


def _unpack(packets: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The upper 40 bits as numbers, the numbers, and the entries of each packet."""
    size = [len(p) // 9 for p in packets]

    def part(kind: str, at: int) -> np.ndarray:
        return np.concatenate([np.frombuffer(p, kind, n, at * n) for p, n in zip(packets, size, strict=True)] or [np.zeros(0, kind)])

    return part("<u4", 0).astype(np.uint64) | (part("<u1", 4).astype(np.uint64) << np.uint64(32)), part("<u4", 5), size


def _shared(chunks: np.ndarray, packets: list[bytes]) -> tuple[list[int], list[bytes]]:
    """To each chunk its grams that more than one document has, with the number of documents."""
    gram, many, size = _unpack(packets)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(gram, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], gram[order][1:] != gram[order][:-1]))) if len(gram) else order
    sums = np.add.reduceat(many[order].astype(np.int64), head) if len(gram) else head
    total = np.empty(len(gram), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(head, len(gram))))
    keep = np.flatnonzero(total > 1)
    cut = np.searchsorted(owner[keep], np.arange(len(size) + 1))
    gram, total = gram[keep] << np.uint64(24), np.minimum(total[keep], 0xFFFFFFFF)
    found = [(int(c), _pack(gram[a:b], total[a:b])) for c, a, b in zip(chunks, cut, cut[1:], strict=False) if b > a]
    return [c for c, _ in found], [p for _, p in found]


def prefixes(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id, n, sig, first, toks, shared, parts``.

    n is the size of the set, sig a digest of it (null for the empty set), toks the
    prefix shingles that other documents have too, from rare to common, the first of
    them at place ``first`` of the ordered set; shared are all shingles that others
    have, and parts counts the set by ranges of the hash; both null without toks.
    """
    rows, _, buckets = chunked(docs, id_col, text_col)

    def send(group: pa.Table) -> pa.Table:
        gram, text, second = _sets(group["text"].to_pylist(), shingle)
        # one entry for each text that has a gram
        order = np.lexsort((text, gram))
        g, t = gram[order], text[order]
        single = order[np.concatenate(([True], (g[1:] != g[:-1]) | (t[1:] != t[:-1])))] if len(g) else order
        mine, other = gram[single], second[single]
        first, count, begin = deal(mine, other, buckets)
        sent = mine[first]
        used = np.flatnonzero(np.diff(begin))
        return pa.table(
            {
                "bucket": pa.array(used.astype(np.int32)),
                "chunk": pa.array(np.full(len(used), group["chunk"][0].as_py(), np.int64)),
                "packet": pa.array([_pack(sent[begin[b] : begin[b + 1]], count[begin[b] : begin[b + 1]]) for b in used], pa.binary()),
            }
        )

    packets = rows.groupBy("chunk").applyInArrow(send, "bucket int, chunk long, packet binary")
    answers = reduced(packets, _shared)
    kind = "id long, n long, sig binary, first int, toks array<long>, shared array<long>, parts array<int>"

    def finish(group: pa.Table, answer: pa.Table) -> pa.Table:
        ids, texts = group["id"].to_pylist(), group["text"].to_pylist()
        gram, text, second = _sets(texts, shingle)
        known, df, size = _unpack(answer["packet"].to_pylist())
        known |= np.repeat(answer["bucket"].to_numpy().astype(np.uint64), size) << np.uint64(40)
        by = np.argsort(known)
        known, df = known[by], df[by]
        order = np.lexsort((gram, text))
        gram, bounds = gram[order], np.searchsorted(text[order], np.arange(len(texts) + 1))
        place = (gram >> np.uint64(24)) | ((second[order] % np.uint64(buckets)) << np.uint64(40))
        # how many documents have each gram; 1 where no answer speaks of it
        at = np.minimum(np.searchsorted(known, place), max(0, len(known) - 1))
        many = np.where(known[at] == place, df[at], 1) if len(known) else np.ones(len(gram), np.int64)
        out: dict[str, list] = {c: [] for c in ("n", "sig", "first", "toks", "shared", "parts")}
        for a, b in zip(bounds, bounds[1:], strict=False):
            own = gram[a:b]
            new = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
            own, often = own[new], many[a:b][new]
            n = len(own)
            shared, often = own[often > 1], often[often > 1]
            alone = n - len(shared)
            length = n - -(-percent * n // 100) + 1 if n else 0
            toks = shared[np.lexsort((shared, often))][: max(0, length - alone)]
            out["n"].append(n)
            out["sig"].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
            out["first"].append(alone)
            out["toks"].append(toks.view(np.int64))
            out["shared"].append(shared.view(np.int64) if len(toks) else None)
            out["parts"].append(np.bincount((own >> np.uint64(64 - PART_BITS)).astype(np.int64), minlength=1 << PART_BITS) if len(toks) else None)
        fields = {"n": pa.int64(), "sig": pa.binary(), "first": pa.int32(), "toks": pa.list_(pa.int64()), "shared": pa.list_(pa.int64()), "parts": pa.list_(pa.int32())}
        give_back()
        return pa.table({"id": pa.array(ids, pa.int64())} | {c: pa.array(out[c], t) for c, t in fields.items()})

    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, kind)


def _could(a: str, b: str, percent: int) -> Column:
    """Length and positional filter of a candidate pair that shares a prefix shingle at places a.pos and b.pos."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    need = F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - 1e-9)
    length = (F.least(n, m) * 100) >= (F.greatest(n, m) * percent)
    # at the first shingle that a pair shares, at most the rest of either set can be shared as well; a pair that fails here
    # shares an earlier one, where it is a candidate too, or is not similar
    place = F.least(n - F.col(f"{a}_pos"), m - F.col(f"{b}_pos")) >= need
    return length & place


def _apart(a: str, b: str, percent: int) -> Column:
    """Suffix filter: shingles of which one set has more in a part of the range of hashes can't be shared."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    need = F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - 1e-9)
    apart = F.aggregate(F.zip_with(f"{a}_parts", f"{b}_parts", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return ((n + m - apart) / 2) >= need


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; each is looked at once."""
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("shared").alias("b_set"))
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("shared").alias("a_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(right, "b").join(left, "a").where(common * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent).select("a", "b")


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id, n, component``.

    n is the number of distinct shingles; component the smallest id reachable over
    links, the row's own included. Rows link when 100 * common >= percent * union of
    their sets. Null and empty texts have the empty set and link with nothing. Rows
    that share an id share all their links; rows with a null id link with nothing. Ids
    must be integers; other columns are not read; an empty table gives an empty result.
    A very long text is worked on whole, by one task.
    """
    every = written(prefixes(docs, id_col, text_col, shingle, percent), "join-prefixes")
    # equal sets are one node, with a number of its own and the smallest id that has it
    named = every.where(F.col("sig").isNotNull() & F.col("id").isNotNull())
    distinct = written(named.groupBy("sig").agg(F.min("id").alias("lo")), "join-distinct")
    nodes = written(distinct.select(F.monotonically_increasing_id().alias("node"), "sig", "lo"), "join-nodes")
    forget(distinct)
    sets = named.where(F.size("toks") > 0).join(nodes.withColumnRenamed("lo", "id"), ["id", "sig"]).select(F.col("node").alias("id"), "n", "first", "toks", "shared", "parts").dropDuplicates(["id"])
    sets = written(sets, "join-sets")
    # the nodes of an id with several texts are linked by that id
    several = named.groupBy("id").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").select("id", "low")
    told = named.select("id", "sig").join(several, "id").select("sig", "low").distinct()
    told = told.join(nodes.select("sig", F.col("node").alias("a")), "sig").join(nodes.select(F.col("sig").alias("low"), F.col("node").alias("b")), "low")
    linked = written(told.where("a <> b").select("a", "b"), "join-same-id")
    rows = sets.select("id", "n", F.posexplode("toks").alias("k", "tok"), "first").select("tok", "id", "n", (F.col("first") + F.col("k")).alias("pos"))
    # prefix shingles of one node alone are of no use
    common = rows.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("tok")
    common = written(common, "join-common")
    rows = written(rows.join(common, "tok", "left_semi"), "join-rows")
    forget(common)
    classes = written(components(linked), "join-classes")

    def labels() -> DataFrame:
        return written(sets.select("id").join(classes, "id", "left").select("id", F.coalesce("component", "id").alias("label")), "join-labels")

    label = labels()

    def side(x: str, df: DataFrame) -> DataFrame:
        return df.select("tok", *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c != "tok"])

    def checked(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), once each, that pass the suffix filter and are similar."""
        pairs = found = written(pairs.select("a", "b").distinct(), "join-pairs")
        for x in ("a", "b"):
            found = found.join(sets.select(F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("parts").alias(f"{x}_parts")), x)
        passed = written(found.where(_apart("a", "b", percent)).select("a", "b"), "join-passed")
        out = written(_verified(passed, sets, percent), "join-links")
        forget(pairs, passed)
        return out

    for turn in range(HUB_ROUNDS + 1):
        told = rows.join(label, "id")
        # shingles whose nodes are all in one class have nothing more to say
        open_ = written(told.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("tok"), "join-open")
        told = written(told.join(open_, "tok", "left_semi"), "join-told")
        used = [open_, told]
        if told.isEmpty():
            break
        if turn < HUB_ROUNDS:
            # the hub of a shingle: a node of it that is linked already, if there is one, chosen by a hash
            order = F.struct((F.col("label") == F.col("id")).cast("int"), F.xxhash64("id", "tok"), "id", "n", "pos", "label")
            hubs = told.groupBy("tok").agg(F.min(order).alias("h")).select("tok", *[F.col(f"h.{c}").alias(f"b_{c}") for c in ("id", "n", "pos", "label")])
            used.append(hubs := written(hubs, "join-hubs"))
            found = side("a", told).join(hubs, "tok").where("a_id <> b_id and a_label <> b_label").where(_could("a", "b", percent))
            few = found.groupBy("a_id").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("a_id", "b_id").alias("o"), "b_id"))), 1, HUBS).alias("take"))
            pairs = few.select(F.col("a_id").alias("x"), F.explode("take").alias("t")).select(F.least("x", "t.b_id").alias("a"), F.greatest("x", "t.b_id").alias("b"))
        else:
            # all pairs that could still join two classes: nodes outside a shingle's largest class against all others of it
            big = told.groupBy("tok", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("tok").agg(F.max(F.struct("c", "label")).alias("m"))
            used.append(big := written(big.select("tok", F.col("m.label").alias("big")), "join-big"))
            told = told.join(big, "tok").join(sets.select("id", "toks"), "id")
            # a pair is made where it meets first, with nothing shared before
            told = written(told.withColumn("before", F.slice("toks", F.lit(1), (F.array_position("toks", F.col("tok")) - 1).cast("int"))).drop("toks"), "join-sided")
            used.append(told)
            met = (F.col("a_label") != F.col("b_label")) & ((F.col("b_label") == F.col("b_big")) | (F.col("a_id") < F.col("b_id"))) & ~F.arrays_overlap("a_before", "b_before")
            found = side("a", told.where("label <> big")).alias("l").join(side("b", told).alias("r"), (F.col("l.tok") == F.col("r.tok")) & met & _could("a", "b", percent))
            pairs = found.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
        links = checked(pairs)
        forget(*used)
        linked = linked.unionByName(links)
        forget(classes, label)
        classes = written(components(linked), "join-classes")
        label = labels()

    named = written(nodes.join(classes.withColumnRenamed("id", "node"), "node", "left").select("sig", "lo", F.coalesce("component", "node").alias("class")), "join-named")
    least = named.groupBy("class").agg(F.min("lo").alias("component"))
    final = written(named.select("sig", "class").join(least, "class").select("sig", "component"), "join-final")
    forget(rows, sets, nodes, named, classes, label)
    return every.select("id", "n", "sig").join(final, "sig", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return similarity_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_ngram_join": op6_ngram_join}

ORACLE_SQL = {
    "op6_ngram_join": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM docs
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.lo AS component_id
FROM docs d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS lo FROM reach GROUP BY doc_id) r USING (doc_id)"""
}
