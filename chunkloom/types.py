"""The eleven types of chunk columns, and how Spark and numpy hold them.

Spark has no unsigned integers: unsigned columns travel in the next wider signed type
(64-bit ones as raw bits) and keep their width as the tag ``chunk_type`` in the field's
metadata.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T

from chunkloom.errors import UnsupportedType


@dataclass(frozen=True)
class ChunkType:
    name: str
    code: str
    spark: T.DataType

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.code)

    @property
    def width(self) -> int:
        return self.dtype.itemsize

    @property
    def kind(self) -> str:
        """signed, unsigned, float or bool."""
        return "bool" if self.name == "Boolean" else {"i": "signed", "u": "unsigned", "f": "float"}[self.dtype.kind]

    @property
    def unsigned(self) -> ChunkType:
        """The unsigned type of the same width, which bits of this type are seen as."""
        return TYPES[f"UInt{8 * self.width}"]

    @property
    def signed(self) -> ChunkType:
        return TYPES[f"Int{8 * self.width}"]


TYPES = {
    t.name: t
    for t in (
        ChunkType("Int8", "<i1", T.ByteType()),
        ChunkType("Int16", "<i2", T.ShortType()),
        ChunkType("Int32", "<i4", T.IntegerType()),
        ChunkType("Int64", "<i8", T.LongType()),
        ChunkType("UInt8", "<u1", T.ShortType()),
        ChunkType("UInt16", "<u2", T.IntegerType()),
        ChunkType("UInt32", "<u4", T.LongType()),
        ChunkType("UInt64", "<u8", T.LongType()),
        ChunkType("Float32", "<f4", T.FloatType()),
        ChunkType("Float64", "<f8", T.DoubleType()),
        ChunkType("Boolean", "<u1", T.BooleanType()),
    )
}

_SIGNED = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "boolean": "Boolean"}
#: Types that are stored as integers and come back as they were: dates as days, timestamps as microseconds.
LOGICAL = {"date": "Int32", "timestamp": "Int64", "timestamp_ntz": "Int64"}


def chunk_type(field: T.StructField) -> ChunkType:
    """The type of a column; ``chunk_type`` in its metadata tells unsigned columns."""
    if tag := (field.metadata or {}).get("chunk_type"):
        if tag not in TYPES:
            raise UnsupportedType(f"column {field.name}: no type {tag}")
        return TYPES[tag]
    name = field.dataType.simpleString()
    if found := _SIGNED.get(name) or LOGICAL.get(name):
        return TYPES[found]
    raise UnsupportedType(f"column {field.name}: {name} is not supported")
