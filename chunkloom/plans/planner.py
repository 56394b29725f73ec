"""Chooses, for the values of one chunk, the pipeline of encodings that makes them smallest.

Profile the values (distinct values, bit widths, deltas at the period that their
autocorrelation shows), generate the pipelines that the profile admits, encode a
prefix with each, and the best of them again on more of the data. Ties keep the
earlier pipeline. A pipeline is a list of operations, plain dicts, that describe how
to invert it; types flow through it and are derived, not stored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from chunkloom.errors import ChunkloomError, CorruptData
from chunkloom.functions import kernels as k
from chunkloom.types import TYPES, ChunkType

Op = dict
Pipeline = list[Op]

LEVELS = {"fast": 1, "balanced": 3, "high": 19}
#: Bytes of the prefix on which all candidates are tried, and of the data for the best of them.
SAMPLE = 64 << 10
FINAL_SAMPLE = 512 << 10
BEST = 3
DICTIONARY_MOST = 256
DELTA_KINDS_MOST = 8
ZEROS_LEAST = 0.4


# ---------------------------------------------------------------- operations and their types


def _after(op: Op, t: ChunkType) -> ChunkType:
    """The type of what an operation makes of values of type t."""
    name = op["op"]
    if name == "BitCast":
        return TYPES[op["to_type"]]
    if name == "ZigZag":
        return t.unsigned
    if name in ("Delta", "XorDelta", "CanonicalizeZeros"):
        return t
    return TYPES["UInt8"]


def types_of(plan: Pipeline, t: ChunkType) -> list[ChunkType]:
    """The type before each operation, and at last the one after all."""
    out = [t]
    for op in plan:
        out.append(_after(op, out[-1]))
    return out


def _bit_cast(data: bytes, t: ChunkType, to: ChunkType) -> bytes:
    if t.kind != "float" or to != t.unsigned:
        raise ChunkloomError(f"no bit cast from {t.name} to {to.name}")
    return data


def _mask(t: ChunkType) -> ChunkType:
    return TYPES["UInt8"] if t.kind == "bool" else t


ENCODERS: dict[str, Callable[[bytes, ChunkType, Op], bytes]] = {
    "CanonicalizeZeros": lambda d, t, o: k.canonicalize(d, t),
    "BitCast": lambda d, t, o: _bit_cast(d, t, TYPES[o["to_type"]]),
    "Delta": lambda d, t, o: k.delta(d, t, o["order"]),
    "XorDelta": lambda d, t, o: k.xor_delta(d, t),
    "ZigZag": lambda d, t, o: k.zigzag(d, t),
    "Leb128": lambda d, t, o: k.leb128(d, t),
    "BitPack": lambda d, t, o: k.bitpack(d, t, o["bit_width"]),
    "Shuffle": lambda d, t, o: k.shuffle(d, t),
    "Rle": lambda d, t, o: k.rle(d, t),
    "Dictionary": lambda d, t, o: k.dictionary(d, t),
    "Zstd": lambda d, t, o: k.zstd(d, o["level"]),
    "Ans": lambda d, t, o: k.ans(d),
}

#: Inverses take the type before the operation and the number of values that it was given.
DECODERS: dict[str, Callable[[bytes, ChunkType, Op, int], bytes]] = {
    "CanonicalizeZeros": lambda d, t, o, n: d,
    "BitCast": lambda d, t, o, n: d,
    "Delta": lambda d, t, o, n: k.undelta(d, t, o["order"]),
    "XorDelta": lambda d, t, o, n: k.unxor_delta(d, t),
    "ZigZag": lambda d, t, o, n: k.unzigzag(d, t),
    "Leb128": lambda d, t, o, n: k.unleb128(d, t, n),
    "BitPack": lambda d, t, o, n: k.unbitpack(d, t, o["bit_width"], n),
    "Shuffle": lambda d, t, o, n: k.unshuffle(d, t),
    "Rle": lambda d, t, o, n: k.unrle(d, t, n),
    "Dictionary": lambda d, t, o, n: k.undictionary(d, t, n),
    "Zstd": lambda d, t, o, n: k.unzstd(d),
    "Ans": lambda d, t, o, n: k.unans(d) if d else b"",
}


def encode(plan: Pipeline, data: bytes, t: ChunkType) -> bytes:
    """data through all operations; values of type t come in."""
    for op, now in zip(plan, types_of(plan, t), strict=False):
        if op["op"] not in ENCODERS:
            raise ChunkloomError(f"no operation {op['op']}")
        data = ENCODERS[op["op"]](data, _mask(now), op)
    return data


def decode(plan: Pipeline, data: bytes, t: ChunkType, n: int) -> bytes:
    """The inverse, for n values of type t."""
    for op, before in reversed(list(zip(plan, types_of(plan, t), strict=False))):
        if op["op"] not in DECODERS:
            raise CorruptData(f"no operation {op['op']}")
        data = DECODERS[op["op"]](data, _mask(before), op, n)
    if len(data) != n * t.width:
        raise CorruptData(f"{len(data)} bytes for {n} values of {t.name}")
    return data


# ---------------------------------------------------------------- profiles


@dataclass
class Profile:
    """What the grammar of pipelines asks about a chunk."""

    distinct: int = 0
    constant: bool = False
    stride: int = 1
    width: int = 0
    delta_distinct: int = 0
    delta_width: int = 0


def stride_of(x: np.ndarray, most: int = 256, least: float = 0.25) -> int:
    """The lag of the highest autocorrelation, if it is high enough, else 1."""
    n = len(x)
    if n < 8:
        return 1
    with np.errstate(all="ignore"):
        y = x.astype(np.float64)
        y = y - y.mean()
        power = float(y @ y)
        if not np.isfinite(power) or power < 1e-9:
            return 1
        lags = min(max(n // 4, 3), most)
        size = 1 << (2 * n - 1).bit_length()
        f = np.fft.rfft(y, size)
        acf = np.fft.irfft(f * np.conj(f), size)[1:lags]
    if not len(acf) or not np.isfinite(acf).all():
        return 1
    best = int(np.argmax(np.round(acf / power, 12)))
    return best + 1 if acf[best] / power > least else 1


def _width(u: np.ndarray) -> int:
    return int(u.max()).bit_length() if len(u) else 0


def profile(x: np.ndarray, t: ChunkType, stride: int) -> Profile:
    """x: the values as integers of type t (floats by their bits)."""
    out = Profile(stride=stride)
    if len(x) < max(1, stride):
        return out
    out.distinct = len(np.unique(x))
    out.constant = out.distinct == 1
    with np.errstate(over="ignore"):
        if t.kind == "signed":
            out.width = _width(np.frombuffer(k.zigzag(x.tobytes(), t), t.unsigned.dtype))
            d = np.frombuffer(k.delta(x.tobytes(), t, stride), t.dtype)
            out.delta_distinct = len(np.unique(d[stride:]))
            # the first values stay raw in the delta and have to fit as well
            out.delta_width = _width(np.frombuffer(k.zigzag(d.tobytes(), t), t.unsigned.dtype))
        else:
            out.width = _width(x)
            d = np.frombuffer(k.xor_delta(x.tobytes(), t), t.dtype)
            out.delta_distinct = len(np.unique(d[1:]))
            out.delta_width = _width(d)
    return out


def candidates(p: Profile, kind: str, level: int) -> list[Pipeline]:
    """All pipelines that the profile admits; kind is signed, unsigned or float (bits of floats)."""
    prefixes: list[Pipeline] = [[]]
    if p.distinct <= DICTIONARY_MOST:
        prefixes.append([{"op": "Dictionary"}])
    prefixes.append([{"op": "Shuffle"}])
    if kind == "signed":
        by = {"op": "Delta", "order": p.stride}
        prefixes.append([by])
        if p.delta_distinct <= DELTA_KINDS_MOST:
            prefixes.append([by, {"op": "Dictionary"}])
        prefixes += [[by, {"op": "ZigZag"}], [by, {"op": "ZigZag"}, {"op": "Leb128"}]]
        if 0 < p.delta_width < p.width:
            prefixes.append([by, {"op": "ZigZag"}, {"op": "BitPack", "bit_width": p.delta_width}])
    else:
        by = {"op": "XorDelta"}
        prefixes.append([by])
        if p.delta_distinct <= DELTA_KINDS_MOST:
            prefixes.append([by, {"op": "Rle"}])
        if kind == "unsigned" and 0 < p.delta_width < p.width:
            prefixes.append([by, {"op": "BitPack", "bit_width": p.delta_width}])
    coders: Pipeline = [{"op": "Zstd", "level": level}, {"op": "Ans"}]
    return [[*prefix, coder] for prefix in prefixes if prefix for coder in coders] + [[coder] for coder in coders]


def _made(plan: Pipeline, data: bytes, t: ChunkType, memo: dict) -> tuple[bytes, ChunkType] | None:
    """What a pipeline makes of data, and its type; None where it can't take them. memo keeps what its beginnings made."""
    if not plan:
        return data, t
    key = tuple(tuple(op.items()) for op in plan)
    if key not in memo:
        memo[key] = None
        if (before := _made(plan[:-1], data, t, memo)) is not None:
            try:
                memo[key] = ENCODERS[plan[-1]["op"]](before[0], _mask(before[1]), plan[-1]), _after(plan[-1], before[1])
            except ChunkloomError:
                pass
    return memo[key]


def cost(plan: Pipeline, data: bytes, t: ChunkType, memo: dict | None = None) -> float:
    """Bytes that a pipeline makes of data; infinite where it can't take them."""
    made = _made(plan, data, t, {} if memo is None else memo)
    return float("inf") if made is None else len(made[0])


def cheapest(options: list[Pipeline], data: bytes, t: ChunkType, keep: int, memo: dict) -> list[Pipeline]:
    """The ``keep`` options that make data smallest, in order, ties by place; options that can't take the data are none.

    The entropy coder is the slow one: it is run only on what it could make small enough by its least size.
    """
    inf = float("inf")
    found, coded = [], []
    for at, option in enumerate(options):
        if option[-1]["op"] != "Ans":
            found.append((cost(option, data, t, memo), at))
        elif (before := _made(option[:-1], data, t, memo)) is not None:
            coded.append((k.ans_least(before[0]), at))
    found.sort()
    for least, at in sorted(coded):
        if len(found) < keep or least <= found[keep - 1][0]:
            found = sorted([*found, (cost(options[at], data, t, memo), at)])
    return [options[at] for size, at in found[:keep] if size < inf]


def scores(data: bytes, t: ChunkType, kind: str, level: int, stride: int) -> list[tuple[Pipeline, float, float | None]]:
    """Every candidate with its bytes on the prefix and, for the best, on more of the data."""
    p = profile(k.values(data, t), t, stride)
    if p.constant:
        return [([{"op": "Rle"}, {"op": "Zstd", "level": level}], 0.0, 0.0)]
    head = data[: SAMPLE // t.width * t.width]
    tried = sorted(((cost(c, head, t), at, c) for at, c in enumerate(candidates(p, kind, level))), key=lambda x: x[:2])
    more = data[: FINAL_SAMPLE // t.width * t.width] if kind == "signed" else data
    return [(c, small, cost(c, more, t) if at < BEST and small < float("inf") else None) for at, (small, _, c) in enumerate(tried)]


def planned(data: bytes, t: ChunkType, kind: str, level: int, stride: int | None = None) -> tuple[Pipeline, bytes]:
    """The best pipeline for data of type t (integers; floats by their bits, with kind "float"), and what it makes of them."""
    if not data:
        return [], b""
    fallback: Pipeline = [{"op": "Zstd", "level": level}]
    memo: dict = {}
    if kind == "bool":
        options: list[Pipeline] = [[{"op": "Rle"}], [{"op": "Rle"}, {"op": "Zstd", "level": level}], [{"op": "Rle"}, {"op": "Ans"}]]
        best, seen = cheapest(options, data, t, 1, memo), len(data)
    else:
        x = k.values(data, t)
        if stride is None:
            stride = stride_of(x.view(f"<f{t.width}") if kind == "float" else x)
        p = profile(x, t, stride)
        if p.constant:
            best, seen = [[{"op": "Rle"}, *fallback]], 0
        else:
            head = data[: SAMPLE // t.width * t.width]
            best, seen = cheapest(candidates(p, kind, level), head, t, 1 if len(head) == len(data) else BEST, memo), len(head)
            if seen < len(data):
                memo = {}
                more = data[: FINAL_SAMPLE // t.width * t.width] if kind == "signed" else data
                best, seen = cheapest(best, more, t, 1, memo), len(more)
    chosen = best[0] if best else fallback
    # what the last trial made of all the data is the result
    made = _made(chosen, data, t, memo if seen == len(data) else {})
    return chosen, encode(chosen, data, t) if made is None else made[0]


def plan(data: bytes, t: ChunkType, kind: str, level: int, stride: int | None = None) -> Pipeline:
    """The best pipeline for data of type t (integers; floats by their bits, with kind "float")."""
    return planned(data, t, kind, level, stride)[0]
