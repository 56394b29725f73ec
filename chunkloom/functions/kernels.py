"""Encodings of one chunk's values as bytes, in numpy; each has an inverse.

Values are arrays of one of the chunk types (booleans as 0 and 1), encoded forms are
bytes in little-endian order. Decoders check what they read and raise CorruptData.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

from chunkloom.errors import ChunkloomError, CorruptData, UnsupportedType
from chunkloom.types import ChunkType

#: A decoded block of the entropy coder is at most so long.
ANS_LIMIT = 1 << 30
_SLOT_BITS = 12
_SLOTS = 1 << _SLOT_BITS
_FLOOR = 1 << 16


def values(data: bytes, t: ChunkType) -> np.ndarray:
    if len(data) % t.width:
        raise CorruptData(f"{len(data)} bytes are no whole number of {t.name}")
    return np.frombuffer(data, t.dtype)


def _integers(t: ChunkType) -> None:
    if t.kind == "float":
        raise UnsupportedType(f"no {t.name} here")


def canonicalize(data: bytes, t: ChunkType) -> bytes:
    """-0.0 as 0.0; there is no way back."""
    if t.kind != "float":
        raise UnsupportedType(f"canonicalize takes floats, not {t.name}")
    x = values(data, t).copy()
    x[x == 0] = 0.0
    return x.tobytes()


def delta(data: bytes, t: ChunkType, order: int) -> bytes:
    """x[i] - x[i - order] in two's complement; the first ``order`` values stay."""
    if t.kind not in ("signed", "unsigned"):
        raise UnsupportedType(f"delta takes integers, not {t.name}")
    if order < 1:
        raise ChunkloomError("order must be 1 or more")
    x = values(data, t)
    out = x.copy()
    with np.errstate(over="ignore"):
        out[order:] = x[order:] - x[:-order]
    return out.tobytes()


def undelta(data: bytes, t: ChunkType, order: int) -> bytes:
    out = values(data, t).copy()
    with np.errstate(over="ignore"):
        for k in range(min(order, len(out))):
            out[k::order] = np.cumsum(out[k::order], dtype=out.dtype)
    return out.tobytes()


def xor_delta(data: bytes, t: ChunkType) -> bytes:
    """x[i] xor x[i - 1]; the first value stays."""
    if t.kind != "unsigned":
        raise UnsupportedType(f"xor_delta takes unsigned integers, not {t.name}")
    x = values(data, t)
    out = x.copy()
    out[1:] = x[1:] ^ x[:-1]
    return out.tobytes()


def unxor_delta(data: bytes, t: ChunkType) -> bytes:
    return np.bitwise_xor.accumulate(values(data, t)).astype(t.dtype).tobytes() if data else b""


def zigzag(data: bytes, t: ChunkType) -> bytes:
    if t.kind != "signed":
        raise UnsupportedType(f"zigzag takes signed integers, not {t.name}")
    x = values(data, t)
    return ((x << 1) ^ (x >> (8 * t.width - 1))).tobytes()


def unzigzag(data: bytes, t: ChunkType) -> bytes:
    """t: the signed type to come back to."""
    u = values(data, t.unsigned)
    with np.errstate(over="ignore"):
        return ((u >> 1) ^ (~(u & 1) + u.dtype.type(1))).tobytes()


def _leb_bytes(u: np.ndarray) -> bytes:
    u = u.astype(np.uint64)
    n = np.ones(len(u), np.int64)
    for k in range(1, 10):
        n += u >= np.uint64(1 << (7 * k))
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    begin = ends - n
    for k in range(10):
        some = np.flatnonzero(n > k)
        if not len(some):
            break
        low = (u[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[begin[some] + k] = low.astype(np.uint8) | np.where(n[some] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def _leb_values(raw: np.ndarray, bits: int) -> np.ndarray:
    """All numbers in raw; every one must end, and fit into bits."""
    if len(raw) and raw[-1] & 128:
        raise CorruptData("a varint is cut off")
    last = np.flatnonzero(raw < 128)
    begin = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    size = last - begin + 1
    if len(size) and size.max() > 10:
        raise CorruptData("a varint is too long")
    out = np.zeros(len(last), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        some = np.flatnonzero(size > k)
        part = raw[begin[some] + k].astype(np.uint64) & np.uint64(127)
        if k == 9 and (part > 1).any():
            raise CorruptData("a varint overflows")
        out[some] |= part << np.uint64(7 * k)
    if bits < 64 and len(out) and out.max() >> np.uint64(bits):
        raise CorruptData("a varint overflows")
    return out


def leb128(data: bytes, t: ChunkType) -> bytes:
    if t.kind != "unsigned":
        raise UnsupportedType(f"leb128 takes unsigned integers, not {t.name}")
    return _leb_bytes(values(data, t))


def unleb128(data: bytes, t: ChunkType, n: int) -> bytes:
    out = _leb_values(np.frombuffer(data, np.uint8), 8 * t.width)
    if len(out) != n:
        raise CorruptData(f"{len(out)} varints where {n} are due")
    return out.astype(t.dtype).tobytes()


def bitpack(data: bytes, t: ChunkType, width: int) -> bytes:
    """Numbers of ``width`` bits one after the other, the lowest bit first."""
    if t.kind != "unsigned":
        raise UnsupportedType(f"bitpack takes unsigned integers, not {t.name}")
    if not 1 <= width <= 8 * t.width:
        raise ChunkloomError(f"no width {width} for {t.name}")
    x = values(data, t)
    if width < 8 * t.width and len(x) and int(x.max()) >> width:
        raise ChunkloomError(f"{int(x.max())} does not fit into {width} bits")
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, t.width), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unbitpack(data: bytes, t: ChunkType, width: int, n: int) -> bytes:
    if len(data) != -(-n * width // 8):
        raise CorruptData(f"{len(data)} bytes for {n} numbers of {width} bits")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    full = np.zeros((n, 8 * t.width), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").tobytes()


def shuffle(data: bytes, t: ChunkType) -> bytes:
    """All lowest bytes, then all second ones, and so on."""
    return np.frombuffer(data, np.uint8).reshape(-1, t.width).T.tobytes()


def unshuffle(data: bytes, t: ChunkType) -> bytes:
    if len(data) % t.width:
        raise CorruptData("byte planes of different lengths")
    return np.frombuffer(data, np.uint8).reshape(t.width, -1).T.tobytes()


def rle(data: bytes, t: ChunkType) -> bytes:
    """Each run as its value and its length in base 128."""
    _integers(t)
    x = values(data, t)
    if not len(x):
        return b""
    head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    length = np.diff(np.append(head, len(x)))
    out = bytearray()
    for value, n in zip(x[head], length.tolist(), strict=True):
        out += value.tobytes()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def unrle(data: bytes, t: ChunkType, n: int) -> bytes:
    found, length, at, total = [], [], 0, 0
    while at < len(data):
        if at + t.width >= len(data):
            raise CorruptData("a run is cut off")
        found.append(data[at : at + t.width])
        at += t.width
        count = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise CorruptData("a run's length is cut off")
            byte = data[at]
            at += 1
            count |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        total += count
        if total > n:
            break
        length.append(count)
    if total != n:
        raise CorruptData(f"runs of {total} values where {n} are due")
    return np.repeat(np.frombuffer(b"".join(found), t.dtype), length).tobytes()


def dictionary(data: bytes, t: ChunkType) -> bytes:
    """The number of distinct values, these in order of first appearance, and each row's place among them."""
    _integers(t)
    x = values(data, t)
    distinct, first, which = np.unique(x, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    place = np.empty(len(order), "<u4")
    place[order] = np.arange(len(order))
    return struct.pack("<I", len(distinct)) + distinct[order].tobytes() + place[which].tobytes()


def undictionary(data: bytes, t: ChunkType, n: int) -> bytes:
    if len(data) < 4:
        raise CorruptData("no dictionary")
    (size,) = struct.unpack_from("<I", data)
    if len(data) != 4 + size * t.width + 4 * n:
        raise CorruptData("a dictionary of another size")
    distinct, place = np.frombuffer(data, t.dtype, size, 4), np.frombuffer(data, "<u4", n, 4 + size * t.width)
    if n and int(place.max()) >= size:
        raise CorruptData("an index beyond the dictionary")
    return distinct[place].tobytes() if n else b""


def zstd(data: bytes, level: int) -> bytes:
    """The length, and a Zstandard frame; nothing for nothing."""
    if not data:
        return b""
    return struct.pack("<Q", len(data)) + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def unzstd(data: bytes) -> bytes:
    if not data:
        return b""
    if len(data) < 8:
        raise CorruptData("a frame is cut off")
    (size,) = struct.unpack_from("<Q", data)
    if size > 1 << 34:
        raise CorruptData("a frame of an impossible length")
    try:
        out = pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True)
    except (OSError, pa.ArrowException) as e:
        raise CorruptData(f"no Zstandard frame: {e}") from e
    if len(out) != size:
        raise CorruptData("a frame of another length")
    return out


def ans_frequencies(counts: np.ndarray, slots: int = _SLOTS) -> np.ndarray:
    """Byte counts scaled to sum to ``slots`` by largest remainders, at least 1 for each byte that occurs."""
    total = int(counts.sum())
    used = np.flatnonzero(counts)
    if len(used) < 2:
        raise ChunkloomError("the entropy coder needs two distinct bytes")
    exact = counts[used].astype(np.int64) * slots
    freq, rest = exact // total, exact % total
    order = np.lexsort((used, -rest))
    freq[order[: slots - int(freq.sum())]] += 1
    for k in np.flatnonzero(freq == 0):
        freq[int(np.argmax(freq))] -= 1
        freq[k] = 1
    out = np.zeros(256, np.int64)
    out[used] = freq
    return out


def ans_lanes(n: int) -> int:
    """Lanes for n bytes: 64, and for long data as many as keep each lane at 2,048 bytes, so that steps don't grow with the data."""
    return max(64, -(-n // 2048))


def ans_least(data: bytes) -> int:
    """A size that ``ans`` can't go below, from the entropy of the bytes alone.

    A lane gives out a word for each 16 bits of information but the last 16, which stay
    in its state; rounding its state down costs less than a tenth of the information.
    """
    n, counts = len(data), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    used = counts[counts > 0]
    bits = float(used @ np.log2(n / used)) if n else 0.0
    return 10 + 3 * len(used) + 4 * ans_lanes(n) + max(0, int(0.9 * bits / 8) - 2 * ans_lanes(n))


def ans(data: bytes) -> bytes:
    """Order-0 range asymmetric numeral system over 4096 slots.

    Byte k is coded in lane k modulo the lanes, so that all lanes step together in numpy. Each
    step of a lane takes in or gives out at most one 16-bit word, in one common stream.
    Layout: length u64, symbols u16, (symbol u8, frequency u16) each, a state u32 a lane, words.
    """
    x = np.frombuffer(data, np.uint8)
    freq = ans_frequencies(np.bincount(x, minlength=256))
    start = np.concatenate(([0], np.cumsum(freq)[:-1]))
    used = np.flatnonzero(freq)
    head = struct.pack("<QH", len(x), len(used)) + b"".join(struct.pack("<BH", s, freq[s]) for s in used)
    lanes = ans_lanes(len(x))
    steps = -(-len(x) // lanes)
    state = np.full(lanes, _FLOOR, np.uint64)
    words = []
    f_of, s_of = freq.astype(np.uint64), start.astype(np.uint64)
    for step in range(steps - 1, -1, -1):
        row = x[step * lanes : (step + 1) * lanes]
        lane = state[: len(row)]
        f, s = f_of[row], s_of[row]
        full = lane >= (f << np.uint64(32 - _SLOT_BITS))
        if full.any():
            words.append((lane[full] & np.uint64(0xFFFF)).astype("<u2")[::-1])
            lane = np.where(full, lane >> np.uint64(16), lane)
        state[: len(row)] = ((lane // f) << np.uint64(_SLOT_BITS)) + lane % f + s
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u2")
    return head + state.astype("<u4").tobytes() + stream.astype("<u2").tobytes()


def unans(data: bytes) -> bytes:
    if len(data) < 10:
        raise CorruptData("no model")
    size, kinds = struct.unpack_from("<QH", data)
    at = 10 + 3 * kinds
    lanes = ans_lanes(size)
    if size > ANS_LIMIT or kinds < 2 or kinds > 256 or len(data) < at + 4 * lanes or (len(data) - at) % 2:
        raise CorruptData("no model")
    freq = np.zeros(256, np.int64)
    for k in range(kinds):
        s, f = struct.unpack_from("<BH", data, 10 + 3 * k)
        freq[s] = f
    if freq.sum() != _SLOTS:
        raise CorruptData("frequencies of another sum")
    start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    symbol = np.repeat(np.arange(256, dtype=np.uint8), freq)
    state = np.frombuffer(data, "<u4", lanes, at).astype(np.uint64)
    stream = np.frombuffer(data, "<u2", -1, at + 4 * lanes).astype(np.uint64)
    out, read, f_of = np.empty(size, np.uint8), 0, freq.astype(np.uint64)
    for step in range(-(-size // lanes)):
        n = min(lanes, size - step * lanes)
        lane = state[:n]
        slot = lane & np.uint64(_SLOTS - 1)
        got = symbol[slot.astype(np.int64)]
        out[step * lanes : step * lanes + n] = got
        lane = f_of[got] * (lane >> np.uint64(_SLOT_BITS)) + slot - start[got]
        low = np.flatnonzero(lane < _FLOOR)
        if len(low):
            if read + len(low) > len(stream):
                raise CorruptData("the stream is cut off")
            lane[low] = (lane[low] << np.uint64(16)) | stream[read : read + len(low)]
            read += len(low)
        state[:n] = lane
    if read != len(stream) or (state != _FLOOR).any():
        raise CorruptData("the stream does not end where it should")
    return out.tobytes()


def sparsify(data: bytes, t: ChunkType) -> tuple[bytes, bytes]:
    """A byte for each value (1 unless it is zero), and the values that are not."""
    x = values(data, t)
    mask = x != 0
    return mask.astype(np.uint8).tobytes(), x[mask].tobytes()


def scatter(mask: bytes, dense: bytes, t: ChunkType) -> bytes:
    """The inverse: dense values where the mask is set, zeros elsewhere."""
    on = np.frombuffer(mask, np.uint8) != 0
    x = values(dense, t)
    if len(x) != int(on.sum()):
        raise CorruptData(f"{len(x)} values for {int(on.sum())} places")
    out = np.zeros(len(on), t.dtype)
    out[on] = x
    return out.tobytes()
