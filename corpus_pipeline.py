"""From raw documents to packed training sequences, by the operators for training data.

Each stage works on everything that the stage before kept, and is judged on that input:
language identification, exact dedup, near-duplicate removal by the n-gram Jaccard
join, mixing to source weights, packing into sequences. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import exact_dedup as exact
from chunkloom.llm import language_id, mixing, ngram_join, packing
from chunkloom.llm._common import WORD, placed, table, told, unpacked, whole_rows, written
from chunkloom.sources.shipping import ship

#: A document whose language is less probable than this is rejected.
LEAST_SCORE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without letters or with an unsure language go."""
    ship(spark)
    rows = placed(docs)
    found = language_id.identified(rows.select("file", "at", F.col("row").getField("text").alias("text")), language_id.learned(docs))
    gone = written(found.where((F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < LEAST_SCORE)).select("file", "at"), "pipeline-unknown")
    return unpacked(rows.join(told(gone), ["file", "at"], "left_anti"), docs.columns)


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact.exact_dedup(docs)


def thin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; documents without an id stay."""
    ship(spark)
    classes = ngram_join.similarity_classes(docs)
    gone = written(classes.where("id <> component").select(F.col("id").alias("gone")).distinct(), "pipeline-gone")
    rows = whole_rows(docs, id=F.col("doc_id"))
    return unpacked(rows.join(told(gone), F.col("id") == F.col("gone"), "left_anti"), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a document once, or its first words, or twice, the second time maybe its first words.

    A text that is taken whole is unchanged; the words of a part are joined by one space.
    """
    rows = placed(docs)
    own = F.col("row")
    text, words = own.getField("text"), F.col("size")
    slim = rows.select(own.getField("doc_id").alias("doc_id"), text.alias("text"), own.getField("source").alias("source"), "file", "at")
    taken = mixing.mixed(slim, keep=("file", "at")).select("file", "at", "size", "taken")
    # one row for each time round: how many of its words it takes
    rounds = F.when(F.col("taken") > words, F.array(words, F.col("taken") - words)).otherwise(F.array(F.col("taken")))
    each = rows.join(taken, ["file", "at"]).select("row", "size", F.explode(rounds).alias("take")).where("take > 0 or size = 0")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("take").cast("int")), " ")
    now = F.when(F.col("take") >= words, text).otherwise(part)
    new = {"text": now, "n_chars": F.length(now).cast("long")}
    return each.select(*[new.get(name, own.getField(name)).alias(name) for name in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    ship(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", identify), ("exact_dedup", dedupe), ("ngram_join", thin), ("mixing", mix), ("packing", pack)]

#: Language identification and packing are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stage's result written and read again.

    The stages keep all columns of documents, whatever their names, but no two names may
    differ in case only.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
