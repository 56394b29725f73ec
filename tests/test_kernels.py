from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.errors import ChunkloomError, CorruptData, UnsupportedType
from chunkloom.functions import kernels as k
from chunkloom.types import TYPES


def raw(values, kind):
    return np.array(values, TYPES[kind].dtype).tobytes()


def back(data, kind):
    return np.frombuffer(data, TYPES[kind].dtype).tolist()


def test_known_vectors():
    t = TYPES
    assert back(k.delta(raw([100, 110, 115, 112, 122], "Int32"), t["Int32"], 1), "Int32") == [100, 10, 5, -3, 10]
    assert back(k.delta(raw([10, 20, 15, 28, 25], "Int32"), t["Int32"], 2), "Int32") == [10, 20, 5, 8, 10]
    assert back(k.xor_delta(raw([12, 13, 9, 11], "UInt32"), t["UInt32"]), "UInt32") == [12, 1, 4, 2]
    assert back(k.zigzag(raw([0, -1, 1, -2], "Int32"), t["Int32"]), "UInt32") == [0, 1, 2, 3]
    assert back(k.zigzag(raw([-5, 4], "Int16"), t["Int16"]), "UInt16") == [9, 8]
    assert k.leb128(raw([624485], "UInt32"), t["UInt32"]).hex() == "e58e26"
    assert k.shuffle(raw([0x0102, 0x0304, 0x0506], "UInt16"), t["UInt16"]).hex() == "020406010305"
    assert k.shuffle(raw([10.0, 20.0], "Float32"), t["Float32"]).hex() == "000000002 0a04141".replace(" ", "")
    mask, dense = k.sparsify(raw([0, 0, 100, 0, -50, 0, 0, 0, 200], "Int32"), t["Int32"])
    assert list(mask) == [0, 0, 1, 0, 1, 0, 0, 0, 1] and back(dense, "Int32") == [100, -50, 200]
    coded = k.dictionary(raw([100, 200, 100, 300, 200, 200, 100], "Int64"), t["Int64"])
    assert back(coded[4 : 4 + 24], "Int64") == [100, 200, 300]
    x = np.frombuffer(k.canonicalize(raw([1, -1, 0.0, -0.0, float("nan")], "Float64"), t["Float64"]))
    assert not np.signbit(x[3]) and np.isnan(x[4]) and x[1] == -1


INTS = [n for n, t in TYPES.items() if t.kind in ("signed", "unsigned")]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_round_trips(data):
    kind = data.draw(st.sampled_from(INTS))
    t = TYPES[kind]
    info = np.iinfo(t.dtype)
    values = data.draw(st.lists(st.one_of(st.integers(info.min, info.max), st.sampled_from([info.min, info.max, 0, 1])), max_size=200))
    d, n = raw(values, kind), len(values)
    for order in (1, 2, 5):
        assert k.undelta(k.delta(d, t, order), t, order) == d
    assert k.unrle(k.rle(d, t), t, n) == d
    assert k.undictionary(k.dictionary(d, t), t, n) == d
    assert k.unshuffle(k.shuffle(d, t), t) == d
    assert k.scatter(*k.sparsify(d, t), t) == d
    assert k.unzstd(k.zstd(d, 3)) == d
    if t.kind == "signed":
        assert k.unzigzag(k.zigzag(d, t), t) == d
    else:
        assert k.unxor_delta(k.xor_delta(d, t), t) == d
        assert k.unleb128(k.leb128(d, t), t, n) == d
        width = max([1, *(int(v).bit_length() for v in values)])
        assert k.unbitpack(k.bitpack(d, t, width), t, width, n) == d


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=2, max_size=3000))
def test_entropy_coder(data):
    if len(set(data)) < 2:
        with pytest.raises(ChunkloomError):
            k.ans(data)
    else:
        assert k.unans(k.ans(data)) == data
        assert k.ans_least(data) <= len(k.ans(data))


@pytest.mark.parametrize("share", [0.001, 0.02, 0.3, 0.9])
@pytest.mark.parametrize("n", [100, 5_000, 700_000])
def test_entropy_coder_least_size_and_lanes(share, n):
    """The least size holds, and long data take more lanes and come back."""
    rng = np.random.default_rng(n)
    data = np.where(rng.random(n) < share, rng.integers(0, 256, n), 7).astype(np.uint8)
    data[0], data[1] = 1, 2
    coded = k.ans(data.tobytes())
    assert k.ans_lanes(n) == max(64, -(-n // 2048))
    assert k.ans_least(data.tobytes()) <= len(coded)
    assert k.unans(coded) == data.tobytes()


def test_entropy_coder_size_and_truncation():
    skewed = bytes(b"ABBB" * 1000)
    coded = k.ans(skewed)
    assert len(coded) < len(skewed) / 2
    for cut in (1, 2, 10, len(coded) - 5, len(coded)):
        with pytest.raises(CorruptData):
            k.unans(coded[: len(coded) - cut])


def test_bad_input():
    t = TYPES["UInt32"]
    with pytest.raises(ChunkloomError):
        k.bitpack(raw([1, 2, 3, 8], "UInt32"), t, 3)
    with pytest.raises(CorruptData):
        k.unbitpack(k.bitpack(raw([1, 2, 3], "UInt32"), t, 3)[:-1], t, 3, 3)
    with pytest.raises(CorruptData):
        k.unleb128(b"\xff" * 9 + b"\x7f", TYPES["UInt64"], 1)
    with pytest.raises(CorruptData):
        k.unleb128(b"\x80", t, 1)
    with pytest.raises(CorruptData):
        k.unrle(k.rle(raw([5, 5, 8], "UInt32"), t)[:-1], t, 3)
    with pytest.raises(CorruptData):
        k.undictionary(k.dictionary(raw([1, 2], "UInt32"), t)[:-4] + b"\5\0\0\0", t, 2)
    with pytest.raises(CorruptData):
        k.scatter(b"\1\0", raw([1, 2], "UInt32"), t)
    with pytest.raises(CorruptData):
        k.unzstd(b"x" * 20)
    with pytest.raises(UnsupportedType):
        k.zigzag(b"", t)
    with pytest.raises(UnsupportedType):
        k.rle(b"", TYPES["Float64"])
    assert len(k.zstd(bytes([42]) * 10_000, 3)) < 50
