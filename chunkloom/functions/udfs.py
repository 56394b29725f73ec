"""Chunks as values of a column: arrays in, bytes out, and back; vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from chunkloom.errors import InvalidOption
from chunkloom.plans import chunk
from chunkloom.plans.planner import LEVELS

_ARRAYS = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_()}


def _known(element: str, profile: str = "balanced") -> pa.DataType:
    if element not in _ARRAYS:
        raise InvalidOption(f"no arrays of {element}")
    if profile not in LEVELS:
        raise InvalidOption(f"profile is one of {', '.join(LEVELS)}, not {profile}")
    return _ARRAYS[element]


def encode_chunk(element: str, profile: str = "balanced") -> Callable:
    """A function of an array column: each array as a chunk of bytes; null stays null."""
    kind = _known(element, profile)

    @F.pandas_udf("binary")
    def encode(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda x: None if x is None else chunk.compress(pa.array(x, kind, from_pandas=kind not in (pa.float32(), pa.float64())), profile))

    return encode


def decode_chunk(element: str) -> Callable:
    """The inverse: arrays of element from chunks of bytes."""
    kind = _known(element)

    @F.pandas_udf(f"array<{element}>")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else chunk.decompress(bytes(x)).cast(kind).to_pylist())

    return decode


def peek_chunk() -> Callable:
    """A function of chunks of bytes: their sizes, type and streams, without decoding any data; all null for a null."""
    names = ("header_size", "data_size", "total_size", "rows", "type")

    @F.pandas_udf("header_size long, data_size long, total_size long, rows long, type string, streams string")
    def peek(raw: pd.Series) -> pd.DataFrame:
        seen = [None if x is None else chunk.peek(bytes(x)) for x in raw]
        rows = [dict.fromkeys((*names, "streams")) if s is None else {**{n: s[n] for n in names}, "streams": ",".join(s["streams"])} for s in seen]
        return pd.DataFrame(rows, columns=[*names, "streams"]).astype(dict.fromkeys(names[:-1], "Int64"))

    return peek
