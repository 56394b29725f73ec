"""Substring dedup: Rabin-Karp hashes of every window of 50 words, counted in Spark.

Every chunk of neighbouring ids sends its distinct window hashes to their buckets; a
bucket answers which of them an earlier chunk has too. With that and the windows of
its own smaller ids, a chunk knows every window whose words also start in a document
with a smaller id; runs of such windows merge into maximal intervals, which go.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._common import give_back, table
from chunkloom.llm._grams import PART_OF_ID, Words, chunked, deal, reduced

WINDOW = 50


def _windows(texts: list[bytes], width: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    words = Words(texts)
    start, text = words.starts(width)
    return words, start, text, words.grams(width)[start]


def _later(chunks: np.ndarray, packets: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of each chunk's hashes those that a smaller chunk, not another part of its id, has too; chunks come in order."""
    parts = [np.frombuffer(p, "<u8") for p in packets]
    every = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(every, kind="stable")
    ranked, place = every[order], (np.asarray(chunks) >> PART_OF_ID)[owner[order]]
    head = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
    lead = place[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))] if len(ranked) else place
    hit = np.sort(order[place > lead])
    cut = np.searchsorted(owner[hit], np.arange(len(parts) + 1))
    found = [(int(c), every[hit[a:b]].tobytes()) for c, a, b in zip(chunks, cut, cut[1:], strict=False) if b > a]
    return [c for c, _ in found], [p for _, p in found]


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per input row: ``id, n_words, n_removed, kept, removed``.

    kept is the text of the words that stay, joined by one space; removed are the
    maximal intervals ``begin, end`` of words that go (end exclusive). A word goes if a
    window of width words that covers it also starts in a row with a smaller id; rows
    that share an id, or have none, do not count against each other, and rows with a null
    id come after all others. Ids must be integers. Null and short texts lose nothing; an
    empty table gives an empty result; other columns are not read. A very long text is
    worked on whole, by one task.
    """
    rows, _, buckets = chunked(docs, id_col, text_col)

    def send(group: pa.Table) -> pa.Table:
        words, start, _, window = _windows(group["text"].to_pylist(), width)
        if not len(window):
            return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "packet": pa.array([], pa.binary())})
        first, _, begin = deal(window, words.grams(width, 2)[start], buckets)
        used = np.flatnonzero(np.diff(begin))
        mine = window[first]
        return pa.table(
            {
                "bucket": pa.array(used.astype(np.int32)),
                "chunk": pa.array(np.full(len(used), group["chunk"][0].as_py(), np.int64)),
                "packet": pa.array([mine[begin[b] : begin[b + 1]].tobytes() for b in used], pa.binary()),
            }
        )

    packets = rows.groupBy("chunk").applyInArrow(send, "bucket int, chunk long, packet binary")
    answers = reduced(packets, _later)
    kind = "id long, n_words long, n_removed long, kept binary, removed array<struct<begin: long, end: long>>"

    def finish(group: pa.Table, answer: pa.Table) -> pa.Table:
        if group.num_rows:
            group = group.sort_by([("id", "ascending")])
        ids, texts = group["id"].to_pylist(), group["text"].to_pylist()
        words, start, text, window = _windows(texts, width)
        known = np.sort(np.frombuffer(b"".join(answer["packet"].to_pylist()), "<u8"))
        at = np.searchsorted(known, window)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == window[hit]
        # windows of smaller ids in this chunk: texts are in order of ids, so the first of equal windows has the smallest
        rank = np.cumsum([0, *(a != b for a, b in zip(ids, ids[1:], strict=False))]) if ids else np.zeros(0, int)
        order = np.argsort(window, kind="stable")
        ranked = window[order]
        head = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))] if len(ranked) else order
        hit[order] |= rank[text[order]] > rank[text[lead]]
        change = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(change, start[hit], 1)
        np.add.at(change, start[hit] + width, -1)
        gone = np.cumsum(change[:-1]) > 0
        out: dict[str, list] = {"id": ids, "n_words": [], "n_removed": [], "kept": [], "removed": []}
        for k, raw in enumerate(texts):
            a, b = words.bounds[k], words.bounds[k + 1]
            lost = gone[a:b]
            n = int(lost.sum())
            parts = raw.split()
            edge = np.flatnonzero(np.diff(np.concatenate(([False], lost, [False])).astype(np.int8))) if n else ()
            out["n_words"].append(b - a)
            out["n_removed"].append(n)
            out["kept"].append(b" ".join(compress(parts, ~lost) if n else parts))
            out["removed"].append([{"begin": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
        fields = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary(), "removed": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))}
        give_back()
        return pa.table({c: pa.array(out[c], t) for c, t in fields.items()})

    found = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, kind)
    return found.withColumn("kept", F.decode("kept", "UTF-8"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    found = repeated_windows(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_substring_dedup": op9_substring_dedup}

ORACLE_SQL = {
    "op9_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM docs WHERE len(words) >= 50)),
firsts AS (SELECT w, min(doc_id) AS lo FROM windows GROUP BY w HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p
  FROM windows JOIN firsts USING (w) WHERE lo < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM docs),
kept AS (
  SELECT doc_id, count(*) FILTER (g.p IS NOT NULL) AS n_removed,
         string_agg(word, ' ' ORDER BY p) FILTER (g.p IS NULL) AS t
  FROM placed LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""
}
