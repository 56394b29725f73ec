from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chunkloom.errors import InvalidOption
from chunkloom.functions.udfs import decode_chunk, encode_chunk, peek_chunk


def test_arrays_as_chunks(spark):
    rows = spark.createDataFrame([(1, [5, 6, None, 8]), (2, []), (3, None), (4, [7] * 100)], "id int, x array<bigint>")
    coded = rows.withColumn("c", encode_chunk("bigint")("x")).cache()
    back = {r["id"]: r["y"] for r in coded.withColumn("y", decode_chunk("bigint")("c")).collect()}
    assert back == {1: [5, 6, None, 8], 2: [], 3: None, 4: [7] * 100}
    seen = coded.where("c is not null").select("id", peek_chunk()("c").alias("p"), F.length("c").alias("n")).collect()
    assert all(r["p"]["total_size"] == r["n"] for r in seen)
    nothing = coded.where("c is null").select(peek_chunk()("c").alias("p")).collect()
    assert len(nothing) == 1 and (nothing[0]["p"] is None or set(nothing[0]["p"].asDict().values()) == {None})
    with pytest.raises(InvalidOption):
        encode_chunk("string")
