"""The corpus pipeline, stage by stage, against brute force."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from chunkloom.llm._common import written
from tests.llm.test_operators import SCHEMA, WORD, awkward, components_of, docs, nothing, shingle_sets  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages(spark, docs, sf_dir):  # noqa: F811
    assert list(STAGES) == ["language_id", "exact_dedup", "ngram_join", "mixing", "packing"]
    told = written(STAGES["language_id"](spark, docs, sf_dir), "t1")
    assert told.columns == docs.columns
    assert {r[0] for r in rows_of(docs)} - {r[0] for r in rows_of(told)} >= {0, 1, 2}

    once = written(STAGES["exact_dedup"](spark, told, sf_dir), "t2")
    best: dict[str, int] = {}
    for d, t, _ in rows_of(told):
        best[t] = max(best.get(t, d), d)
    assert Counter((d, t) for d, t, _ in rows_of(once)) == Counter((d, t) for t, d in best.items())

    thin = written(STAGES["ngram_join"](spark, once, sf_dir), "t3")
    classes = components_of(shingle_sets(rows_of(once)))
    assert {d for d, _, _ in rows_of(thin)} == set(classes.values())

    mixed = written(STAGES["mixing"](spark, thin, sf_dir), "t4")
    assert mixed.columns == docs.columns
    size = {}
    for d, t, _ in rows_of(thin):
        size.setdefault(d, []).append(t)
    taken = Counter()
    for d, t, _ in rows_of(mixed):
        words = WORD.findall(t)
        assert any(words == WORD.findall(x)[: len(words)] for x in size[d])
        taken[d] += len(words)
    assert all(n <= 2 * sum(len(WORD.findall(t)) for t in size[d]) for d, n in taken.items())
    total = sum(len(WORD.findall(t)) for ts in size.values() for t in ts)
    assert abs(sum(taken.values()) - 1.5 * total) <= 0.01 * total + 20

    packed = STAGES["packing"](spark, mixed, sf_dir).toPandas()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows_of(mixed))
    assert packed["length"].sum() == want


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_nothing_goes_through(spark, nothing, sf_dir):  # noqa: F811
    df = nothing
    for name, stage in corpus_pipeline.STAGES:
        df = written(stage(spark, df, sf_dir), f"empty-{name}")
    assert df.count() == 0


@pytest.mark.parametrize("column", ["doc_id", "lang", "source"])
def test_nulls(spark, docs, sf_dir, column):  # noqa: F811
    df = docs.withColumn(column, docs[column].substr(1, 0).cast(docs.schema[column].dataType) if column != "doc_id" else docs[column] * None).limit(12)
    for name, stage in corpus_pipeline.STAGES:
        df = written(stage(spark, df, sf_dir), f"nulls-{name}")
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert df.where("length < 1 or offset < 0 or offset + length > 2048").count() == 0
    assert df.groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).where("`sum(length)` > 2048").count() == 0


CLASHING = ["score", "lang_pred", "bits_per_byte", "taken", "size", "row", "file", "at", "_key", "_digest", "_gone", "_id", "_words", "id", "a.b", "sha256", "letter", "_text", "chunk", "component"]


def test_columns_of_any_name_pass_unchanged(spark, docs, sf_dir):  # noqa: F811
    df = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, df = df, written(stage(spark, df, sf_dir), f"clash-{name}")
        assert df.columns == before.columns, name
        assert 0 < df.count(), name
        for r in df.collect():
            assert [r[c] for c in CLASHING] == [f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for c in CLASHING], name
    assert STAGES["packing"](spark, df, sf_dir).count() > 0
