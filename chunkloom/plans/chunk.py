"""One column of one batch as a self-describing chunk, and back.

A chunk holds named streams and a plan: nulls are taken out into a stream of their own,
floats lose -0.0 and go by their bits, values that are often zero may be split into a
mask and the rest, and every stream has the pipeline that made it smallest.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from chunkloom.errors import CorruptData, UnsupportedType
from chunkloom.functions import kernels as k
from chunkloom.plans import planner
from chunkloom.types import TYPES, ChunkType

#: The magic word and version of a chunk as one run of bytes.
MAGIC, VERSION = b"CLCK", 1
_TEXT_MOST = 16 << 20

_ARROW = {pa.int8(): "Int8", pa.int16(): "Int16", pa.int32(): "Int32", pa.int64(): "Int64", pa.uint8(): "UInt8", pa.uint16(): "UInt16", pa.uint32(): "UInt32", pa.uint64(): "UInt64", pa.float32(): "Float32", pa.float64(): "Float64", pa.bool_(): "Boolean"}
_TO_ARROW = {name: t for t, name in _ARROW.items()}


@dataclass
class Chunk:
    rows: int
    type: str
    plan: list[dict]
    streams: dict[str, bytes] = field(default_factory=dict)


def type_of(array: pa.Array) -> ChunkType:
    if array.type not in _ARROW:
        raise UnsupportedType(f"{array.type} is not supported")
    return TYPES[_ARROW[array.type]]


def _bytes(array: pa.Array, t: ChunkType) -> bytes:
    """Valid values, one after the other."""
    some = array.drop_null()
    if t.name == "Boolean":
        some = some.cast(pa.uint8())
    return np.ascontiguousarray(some.to_numpy(zero_copy_only=False), t.dtype).tobytes()


def encode_values(array: pa.Array, level: int) -> Chunk:
    """The chunk of an array; an array without any nulls has no mask."""
    t = type_of(array)
    chunk = Chunk(len(array), t.name, [])
    if not len(array):
        return chunk
    data, now, kind = _bytes(array, t), t, t.kind
    if kind == "float" and data:
        chunk.plan += [{"op": "CanonicalizeZeros"}, {"op": "BitCast", "to_type": t.unsigned.name}]
        data, now = planner.encode(chunk.plan, data, t), t.unsigned
    if array.null_count:
        mask = array.is_valid().cast(pa.uint8()).to_numpy(zero_copy_only=False).tobytes()
        pipeline, chunk.streams["null_mask"] = planner.planned(mask, TYPES["UInt8"], "bool", level)
        chunk.plan.append({"op": "ExtractNulls", "stream": "null_mask", "pipeline": pipeline})
    if not data:
        return chunk
    dense, main = planner.planned(data, now, kind, level)
    x = k.values(data, now)
    zeros = float((x == 0).mean())
    if kind != "bool" and planner.ZEROS_LEAST <= zeros < 1:
        mask, rest = k.sparsify(data, now)
        mask_plan, small_mask = planner.planned(mask, TYPES["UInt8"], "bool", level)
        rest_plan, small = planner.planned(rest, now, kind, level)
        if len(small) + len(small_mask) < len(main):
            chunk.plan.append({"op": "Sparsify", "stream": "sparsity_mask", "mask": mask_plan, "values": rest_plan})
            chunk.streams |= {"main": small, "sparsity_mask": small_mask}
            return chunk
    chunk.plan += dense
    chunk.streams["main"] = main
    return chunk


def decode_values(chunk: Chunk) -> pa.Array:
    """The array; raises CorruptData where streams and plan do not fit together."""
    if chunk.type not in TYPES:
        raise CorruptData(f"no type {chunk.type}")
    t, now, valid, rows = TYPES[chunk.type], TYPES[chunk.type], None, chunk.rows
    n, rest, sparse = rows, [], None
    for op in chunk.plan:
        if op["op"] == "ExtractNulls":
            valid = np.frombuffer(planner.decode(op["pipeline"], _stream(chunk, op["stream"]), TYPES["UInt8"], rows), np.uint8) != 0
            n = int(valid.sum())
        elif op["op"] == "Sparsify":
            sparse = op
        else:
            rest.append(op)
    cast = [op for op in rest if op["op"] in ("CanonicalizeZeros", "BitCast")]
    rest = [op for op in rest if op not in cast]
    if cast:
        now = t.unsigned
    if not n:
        data = b""
    elif sparse:
        mask = planner.decode(sparse["mask"], _stream(chunk, sparse["stream"]), TYPES["UInt8"], n)
        on = int((np.frombuffer(mask, np.uint8) != 0).sum())
        data = k.scatter(mask, planner.decode(sparse["values"], _stream(chunk, "main"), now, on), now)
    else:
        data = planner.decode(rest, _stream(chunk, "main"), now, n)
    x = np.frombuffer(data, t.dtype)
    if len(x) != n:
        raise CorruptData(f"{len(x)} values for {n} rows")
    kind = _TO_ARROW[t.name]
    values = x.astype(bool) if t.name == "Boolean" else x
    if valid is None:
        return pa.array(values, kind)
    full = np.zeros(rows, values.dtype)
    full[valid] = values
    return pa.array(full, kind, mask=~valid)


def _stream(chunk: Chunk, name: str) -> bytes:
    if name not in chunk.streams:
        raise CorruptData(f"no stream {name}")
    return chunk.streams[name]


# ---------------------------------------------------------------- as one run of bytes


def to_bytes(chunk: Chunk) -> bytes:
    """Magic, version, rows, header length; type, plan, stream names and sizes; streams, by name."""

    def text(x: str, size: str) -> bytes:
        raw = x.encode()
        return struct.pack(size, len(raw)) + raw

    names = sorted(chunk.streams)
    head = text(chunk.type, "<H") + text(json.dumps(chunk.plan, separators=(",", ":")), "<I") + struct.pack("<H", len(names))
    head += b"".join(text(s, "<H") + struct.pack("<Q", len(chunk.streams[s])) for s in names)
    return MAGIC + struct.pack("<HQI", VERSION, chunk.rows, len(head)) + head + b"".join(chunk.streams[s] for s in names)


def _header(raw: bytes) -> tuple[Chunk, list[tuple[str, int]], int]:
    if len(raw) < 18 or raw[:4] != MAGIC:
        raise CorruptData("no chunk")
    version, rows, size = struct.unpack_from("<HQI", raw, 4)
    if version != VERSION:
        raise CorruptData(f"version {version} is not known")
    if len(raw) < 18 + size:
        raise CorruptData("the header is cut off")
    at = 18

    def text(size: str) -> str:
        nonlocal at
        (n,) = struct.unpack_from(size, raw, at)
        at += struct.calcsize(size)
        if n > _TEXT_MOST or at + n > len(raw):
            raise CorruptData("a text is cut off")
        at += n
        return raw[at - n : at].decode()

    try:
        kind, plan = text("<H"), json.loads(text("<I"))
        (count,) = struct.unpack_from("<H", raw, at)
        at += 2
        sizes = []
        for _ in range(count):
            name = text("<H")
            sizes.append((name, struct.unpack_from("<Q", raw, at)[0]))
            at += 8
    except (struct.error, UnicodeDecodeError, ValueError) as e:
        raise e if isinstance(e, CorruptData) else CorruptData(f"the header can't be read: {e}") from e
    if at != 18 + size or at + sum(n for _, n in sizes) != len(raw):
        raise CorruptData("the streams have other sizes than the header says")
    return Chunk(rows, kind, plan), sizes, at


def from_bytes(raw: bytes) -> Chunk:
    chunk, sizes, at = _header(raw)
    for name, n in sizes:
        chunk.streams[name] = raw[at : at + n]
        at += n
    return chunk


def peek(raw: bytes) -> dict:
    """Sizes, type, plan and streams of a chunk, without decoding any data."""
    chunk, sizes, at = _header(raw)
    return {"header_size": at, "data_size": len(raw) - at, "total_size": len(raw), "rows": chunk.rows, "type": chunk.type, "plan": chunk.plan, "streams": dict(sizes)}


def compress(array: pa.Array, profile: str = "balanced") -> bytes:
    """An array as a chunk of bytes."""
    return to_bytes(encode_values(array, planner.LEVELS[profile]))


def decompress(raw: bytes) -> pa.Array:
    return decode_values(from_bytes(raw))


def analyze(array: pa.Array, profile: str = "balanced") -> dict:
    """compress, with what peek says about the result."""
    raw = compress(array, profile)
    return peek(raw) | {"artifact": raw}
