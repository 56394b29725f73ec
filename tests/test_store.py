from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.errors import InvalidOption, UnsupportedType
from chunkloom.operators import encodings, layout, profile
from chunkloom.operators.order import batched, numbered
from chunkloom.sources import datasource, store
from chunkloom.streaming import flows

SCHEMA = "id long, k long, t long, v double, b boolean, s short, d date, at timestamp"


@pytest.fixture(scope="module")
def rows(spark):
    def row(i):
        k = None if i % 17 == 0 else i % 5
        t = None if i % 13 == 0 else i // 5
        return i, k, t, None if i % 7 == 0 else i * 0.25, None if i % 11 == 0 else i % 3 == 0, i % 100, dt.date(2024, 1, 1) + dt.timedelta(i % 9), dt.datetime(2024, 1, 1, 0, 0, i % 60, i)

    return spark.createDataFrame([row(i) for i in range(500)], SCHEMA)


def equal(a, b):
    assert a.schema.names == b.schema.names
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


LAYOUTS = [
    {"strategy": "none"},
    {"strategy": "Per_Batch_Relinearize", "stream_id_column": "k", "timestamp_column": "t"},
    {"strategy": "partitioned", "partition_key_column": "k", "partition_flush_rows": 20},
]


@pytest.mark.parametrize("options", LAYOUTS, ids=lambda o: o["strategy"])
@pytest.mark.parametrize("size", [100, 99, 1000])
def test_round_trip(spark, rows, tmp_path, options, size):
    path = f"file://{tmp_path}/t"
    store.write_store(rows, path, ["id"], chunk_size_rows=size, **options)
    equal(store.read_store(spark, path), rows)
    equal(store.read_store(spark, path, ["v", "id"]), rows.select("v", "id"))
    assert store.describe_store(spark, path)["options"]["strategy"] == options["strategy"].lower()


def test_relinearized_columns_are_never_larger(spark, tmp_path):
    """A column takes the order by series only where that is smaller; both kinds come back."""
    rows = spark.range(4000).selectExpr("id", "abs(hash(id)) % 40 AS k", "id AS t").selectExpr("id", "CAST(k AS long) AS k", "t", "sqrt(k + 2) AS v")
    sizes = {}
    for options in LAYOUTS[:2]:
        path = f"file://{tmp_path}/{options['strategy']}"
        store.write_store(rows, path, ["id"], chunk_size_rows=1000, **options)
        equal(store.read_store(spark, path), rows)
        sizes[options["strategy"]] = {(r["batch_id"], r["column_name"]): r for r in store.read_manifest(spark, path).collect()}
    plain, sorted_ = sizes["none"], sizes["Per_Batch_Relinearize"]
    assert all(sorted_[at]["compressed_bytes"] <= plain[at]["compressed_bytes"] for at in plain)
    assert {r["by_series"] for at, r in sorted_.items() if at[1] == "id"} == {False}
    assert {r["by_series"] for at, r in sorted_.items() if at[1] == "v"} == {True}
    assert {r["by_series"] for r in plain.values()} == {None}


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_runs_span_batches(size):
    """Runs of equal keys, null keys among them, wherever batches end; empty batches are none."""
    keys = [None, None, 0, 0, 0, 0, 0, 3, 3, 4, 4, 4, 4, 4, 9]
    parts = [0, 1, 0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 2, 2]
    rows = pa.table({"k": pa.array(keys, pa.int64()), "s": pa.array(parts, pa.int64()), "at": list(range(len(keys)))})
    batches = [rows.slice(0, 0).to_batches(), *[rows.slice(at, size).to_batches() for at in range(0, len(keys), size)]]
    got = [t["at"].to_pylist() for t in store.runs([b for x in batches for b in x], ["k", "s"])]
    want: list[list[int]] = []
    for at in range(len(keys)):
        if at and (keys[at], parts[at]) == (keys[at - 1], parts[at - 1]):
            want[-1].append(at)
        else:
            want.append([at])
    assert got == want
    assert list(store.runs([], ["k"])) == []


def test_empty_table(spark, rows, tmp_path):
    for options in LAYOUTS:
        path = f"file://{tmp_path}/{options['strategy']}"
        store.write_store(rows.limit(0), path, ["id"], **options)
        assert store.read_store(spark, path).count() == 0


def test_partitions_and_pruning(spark, rows, tmp_path):
    path = f"file://{tmp_path}/p"
    store.write_store(rows, path, ["id"], **LAYOUTS[2])
    equal(store.read_store(spark, path, key=3), rows.where("k = 3"))
    sizes = {r["partition_key"]: r["rows"] for r in store.partition_keys(spark, path).collect()}
    assert sizes == {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    dropped = f"file://{tmp_path}/q"
    store.write_store(rows, dropped, ["id"], null_keys="drop", **LAYOUTS[2])
    equal(store.read_store(spark, dropped), rows.where("k is not null"))
    plain = f"file://{tmp_path}/n"
    store.write_store(rows, plain, ["id"], chunk_size_rows=50)
    assert store.read_store(spark, plain, ["id"], between=("id", 120, 130)).count() == 50
    with pytest.raises(InvalidOption):
        store.read_store(spark, plain, key=1)
    with pytest.raises(InvalidOption):
        store.read_store(spark, plain, ["nothing"])


def test_flush_boundary(spark, tmp_path):
    rows = spark.createDataFrame([(i, 101) for i in range(6)], "id long, k long")
    made = store.encoded(rows, store.Options(strategy="partitioned", partition_key_column="k", partition_flush_rows=3), ["id"])
    assert sorted(r["num_rows"] for r in made.where("column_name = 'id'").collect()) == [3, 3]


def test_options_are_checked(spark, rows, tmp_path):
    for bad in (
        {"strategy": "other"},
        {"profile": "best"},
        {"strategy": "partitioned"},
        {"strategy": "partitioned", "partition_key_column": "none"},
        {"strategy": "partitioned", "partition_key_column": "v"},
        {"strategy": "per_batch_relinearize", "stream_id_column": "k"},
        {"chunk_size_rows": 0},
    ):
        with pytest.raises(InvalidOption):
            store.write_store(rows, f"{tmp_path}/x", ["id"], **bad)
    with pytest.raises(UnsupportedType):
        store.write_store(rows.withColumn("text", F.lit("x")), f"{tmp_path}/x", ["id"])


def test_unsigned_columns(spark, tmp_path):
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("u", T.LongType(), True, {"chunk_type": "UInt64"}), T.StructField("w", T.IntegerType(), True, {"chunk_type": "UInt16"})])
    rows = spark.createDataFrame([(i, None if i == 3 else i - 5, 65535 - i) for i in range(20)], schema)
    path = f"file://{tmp_path}/u"
    store.write_store(rows, path, ["i"])
    equal(store.read_store(spark, path), rows)
    assert {r["original_type"] for r in store.read_manifest(spark, path).collect()} == {"Int64", "UInt64", "UInt16"}


def test_data_source(spark, rows, tmp_path):
    datasource.register(spark)
    for k, options in enumerate(LAYOUTS):
        path = f"{tmp_path}/{k}"
        spread = rows.repartition(3, "k") if options["strategy"] == "partitioned" else rows.repartition(3)
        spread.write.format("chunkloom").options(path=path, chunk_size_rows=40, **options).mode("overwrite").save()
        found = spark.read.format("chunkloom").option("path", path).load()
        equal(found, rows)
        equal(found.where("k = 2"), rows.where("k = 2"))
        equal(spark.read.format("chunkloom").options(path=path, columns="v, id").load(), rows.select("v", "id"))
        equal(store.read_store(spark, path), rows)
    rows.write.format("chunkloom").options(path=f"{tmp_path}/0", chunk_size_rows=40, strategy="none").mode("append").save()
    with pytest.raises(Exception, match="no such option: chunk_rows"):
        rows.write.format("chunkloom").options(path=f"{tmp_path}/9", chunk_rows=40).mode("append").save()
    assert spark.read.format("chunkloom").option("path", f"{tmp_path}/0").load().count() == 1000


def test_numbering(spark):
    rows = spark.range(0, 10_000).withColumn("x", F.col("id") * 7919 % 10_007)
    got = numbered(rows, ["x"], partitions=7).toPandas().sort_values("x")
    assert got["row_idx"].tolist() == list(range(10_000))


def test_known_rewrites(spark):
    rows = batched(spark.createDataFrame([(i, v) for i, v in enumerate([10, 20, 15, 28, 25])], "i long, v long"), ["i"], 100)
    assert [r["d"] for r in encodings.delta(rows, "v", 2).orderBy("i").collect()] == [10, 20, 5, 8, 10]
    xs = batched(spark.createDataFrame([(i, v) for i, v in enumerate([12, 13, 9, 11])], "i long, v long"), ["i"], 100)
    assert [r["d"] for r in encodings.xor_delta(xs, "v").orderBy("i").collect()] == [12, 1, 4, 2]
    runs = encodings.rle(batched(spark.createDataFrame([(i, v) for i, v in enumerate([4, 4, None, None, 4])], "i long, v long"), ["i"], 100), "v")
    assert [(r["value"], r["n"]) for r in runs.orderBy("start").collect()] == [(4, 2), (None, 2), (4, 1)]


def test_profile_of_nulls_and_constants(spark):
    rows = batched(spark.createDataFrame([(i, None, 7) for i in range(4)], "i long, a long, b long"), ["i"], 100)
    got = {r["column_name"]: r for r in profile.profile_columns(rows, ["a", "b"]).collect()}
    assert got["a"]["valid"] == 0 and not got["a"]["is_constant"] and not got["a"]["sparse"]
    assert got["b"]["is_constant"] and got["b"]["distinct_values"] == 1 and got["b"]["delta_distinct"] == 1


def test_structure(spark):
    rows = batched(spark.createDataFrame([(i, float([10 * (i // 5), -5 * (i // 5), 100, i // 5, 0][i % 5])) for i in range(1000)], "i long, v double"), ["i"], 1000)
    assert [(r["structure"], r["stride"]) for r in profile.structure(rows, "v", False).collect()] == [("FixedStride", 5)]
    assert profile.structure(rows, "v", True).first()["structure"] == "Multiplexed"


def test_structure_finds_long_periods(spark):
    """Every lag below a quarter of a batch of 1,000 rows is looked at, as the planner does."""
    rng = np.random.default_rng(4)
    periods = (24, 60, 100, 168, 249)
    rows = []
    for b, period in enumerate(periods):
        values = rng.normal(size=period)[np.arange(1000) % period].tolist()
        rows += [(b, 1000 * b + k, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "batch_id long, row_idx long, v double").repartition(3)
    acf = profile.autocorrelation(df, "v")
    assert {tuple(r) for r in acf.groupBy("batch_id").count().collect()} == {(b, 249) for b in range(len(periods))}
    assert dict(map(tuple, profile.stride(acf).collect())) == dict(enumerate(periods))
    assert {r["batch_id"]: (r["structure"], r["stride"]) for r in profile.structure(df, "v", False).collect()} == {b: ("FixedStride", p) for b, p in enumerate(periods)}



def test_series(spark):
    rows = spark.createDataFrame([(101, 2, 10.2), (102, 1, 20.1), (101, 1, 10.1), (102, 2, 20.2)], "unit long, frame long, vx double")
    got = {r["unit"]: (r["frame"], r["vx"]) for r in layout.series(numbered(rows, ["vx"]), "unit", "frame", ["vx"]).collect()}
    assert got == {101: ([1, 2], [10.1, 10.2]), 102: ([1, 2], [20.1, 20.2])}
    with pytest.raises(InvalidOption):
        layout.series(rows, "nothing", "frame", ["vx"])


def test_sink_replaces_an_epoch(spark, rows, tmp_path):
    sink = flows.chunk_sink(f"{tmp_path}/s/chunks", ["id"])
    sink(rows.where("id < 300").repartition(3), 0)
    sink(rows.where("id >= 300").repartition(2), 1)
    sink(rows.where("id >= 300"), 1)
    store.write_description(spark, f"{tmp_path}/s", rows.schema, store.Options())
    equal(store.read_store(spark, f"{tmp_path}/s"), rows)


def test_late_rows_and_the_rest_of_a_key(spark, tmp_path):
    """Append mode over four batches: a late row is dropped, a key's rest is flushed when the watermark passes it."""
    kind = "user int, at timestamp, x int"
    for k, rows in enumerate([[(1, "2024-01-01 00:00:00", 1), (1, "2024-01-01 00:01:00", 2), (1, "2024-01-01 00:02:00", 3), (2, "2024-01-01 00:03:00", 4)], [(3, "2024-01-01 05:00:00", 5)], [(3, "2024-01-01 05:01:00", 8)], [(2, "2024-01-01 00:04:00", 6), (4, "2024-01-01 09:00:00", 7)]]):
        spark.createDataFrame(rows, "user int, at string, x int").selectExpr("user", "timestamp(at) AS at", "x").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    segments = flows.finished(flows.key_segments(stream, "user", ["x"], 2, time="at"), f"{tmp_path}/segments")
    assert sorted((r["user"], r["segment"], r["n_rows"], r["x"]) for r in segments.collect()) == [(1, 0, 2, [1, 2]), (1, 1, 1, [3]), (2, 0, 1, [4]), (3, 0, 2, [5, 8])]
    windows = flows.finished(flows.windowed_sizes(stream, "at", "user", "x"), f"{tmp_path}/windows")
    assert sorted(r["rows"] for r in windows.collect()) == [2, 4]
