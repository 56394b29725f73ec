from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from chunkloom.errors import CorruptData, UnsupportedType
from chunkloom.plans import chunk, planner
from chunkloom.types import TYPES

SPARSE = [0] * 500
for _i in range(30):
    SPARSE[100 + _i] = _i * 10
SPARSE[400] = None

CASES = {
    "ints_nulls": pa.array([1000, 1001, None, 1003, 1003], pa.int64()),
    "ints_plain": pa.array(range(10, 90, 10), pa.int32()),
    "all_null": pa.array([None] * 4, pa.int64()),
    "empty": pa.array([], pa.int32()),
    "single": pa.array([42], pa.int32()),
    "floats_nulls": pa.array([10.5, None, -20.0, 30.1, None], pa.float32()),
    "drifting": pa.array([1.0, 1.0000001, None, 1.0000002], pa.float32()),
    "bools_nulls": pa.array([True, False, None, True]),
    "bool_one": pa.array([True]),
    "bool_one_null": pa.array([True, None]),
    "bools_null": pa.array([None] * 3, pa.bool_()),
    "bools_empty": pa.array([], pa.bool_()),
    "constant": pa.array([777, 777, 777, None, 777], pa.int64()),
    "sparse": pa.array(SPARSE, pa.int32()),
    "ends": pa.array([-(2**63), 2**63 - 1, 0, -1], pa.int64()),
    "unsigned": pa.array([2**64 - 1, 2**63, 0, None], pa.uint64()),
    "bytes": pa.array(np.arange(300) % 251, pa.uint8()),
    "ramp": pa.array(range(10, 1000), pa.int32()),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("profile", ["fast", "balanced", "high"])
def test_round_trip(name, profile):
    assert chunk.decompress(chunk.compress(CASES[name], profile)).equals(CASES[name])


def test_special_floats():
    got = chunk.decompress(chunk.compress(pa.array([float("nan"), float("inf"), float("-inf"), -0.0, 0.0]))).to_numpy()
    assert np.isnan(got[0]) and got[1] == np.inf and got[2] == -np.inf and not np.signbit(got[3:]).any()


def test_plans():
    def ops(array):
        return [o["op"] for o in chunk.encode_values(array, 3).plan]

    assert ops(pa.array([7] * 1024, pa.int32()))[0] == "Rle"
    assert "Sparsify" in ops(CASES["sparse"])
    assert "Sparsify" not in ops(pa.array([100, 101, None, 103]))
    assert "ExtractNulls" in ops(CASES["ints_nulls"])
    assert ops(CASES["empty"]) == [] and ops(CASES["all_null"]) == ["ExtractNulls"]


def test_ramp_is_near_its_best():
    t = TYPES["Int32"]
    data = np.arange(10, 1000, dtype=t.dtype).tobytes()
    best = planner.cost([{"op": "Delta", "order": 1}, {"op": "Rle"}, {"op": "Zstd", "level": 3}], data, t)
    assert planner.cost(planner.plan(data, t, t.kind, 3), data, t) <= best + 5


def test_skewed_bytes_take_the_entropy_coder():
    x = np.zeros(20_000, np.uint8)
    rng = np.random.default_rng(1)
    x[rng.random(len(x)) < 0.05] = 1
    x[rng.random(len(x)) < 0.02] = 2
    assert planner.plan(x.tobytes(), TYPES["UInt8"], "unsigned", 3)[-1]["op"] == "Ans"


@pytest.mark.parametrize("rows", [3, 200, 5_000, 90_000])
def test_plan_is_the_best_of_all_candidates(rows):
    """What is not run because it can't win changes no choice; the bytes are those of the plan."""
    rng = np.random.default_rng(rows)
    skewed = np.where(rng.random(rows) < 0.9, 3, rng.integers(0, 50, rows))
    for x, t in [(skewed, "UInt8"), (rng.integers(0, 1 << 40, rows), "Int64"), (np.cumsum(rng.integers(0, 3, rows)), "Int32"), (rng.permutation(rows), "UInt32")]:
        t = TYPES[t]
        x = x.astype(t.dtype)
        stride = planner.stride_of(x)
        every = planner.scores(x.tobytes(), t, t.kind, 3, stride)
        _, _, best = min((full, at, plan) for at, (plan, _, full) in enumerate(every) if full is not None and full < float("inf"))
        chosen, made = planner.planned(x.tobytes(), t, t.kind, 3)
        assert chosen == best and made == planner.encode(chosen, x.tobytes(), t)


def test_stride():
    x = np.array([v for i in range(200) for v in (10.0 * i, -5.0 * i, 100.0, float(i), 0.0)])
    assert planner.stride_of(x) == 5
    assert planner.stride_of(np.random.default_rng(3).random(1000)) == 1
    assert planner.stride_of(np.ones(100)) == 1 and planner.stride_of(np.arange(5)) == 1


def test_analyze_and_corruption():
    seen = chunk.analyze(pa.array([10, 20, None, 30, 40], pa.int32()))
    raw = seen["artifact"]
    assert seen["header_size"] + seen["data_size"] == seen["total_size"] == len(raw)
    assert seen["type"] == "Int32" and seen["plan"][0]["op"] == "ExtractNulls"
    assert chunk.to_bytes(chunk.from_bytes(raw)) == raw
    for bad in (b"", b"nope" + raw[4:], raw[:-1], raw + b"x", raw[:20]):
        with pytest.raises(CorruptData):
            chunk.decompress(bad)
    broken = chunk.from_bytes(raw)
    del broken.streams["main"]
    with pytest.raises(CorruptData):
        chunk.decode_values(broken)
    with pytest.raises(UnsupportedType):
        chunk.compress(pa.array(["text"]))


def test_errors_are_value_errors():
    assert issubclass(CorruptData, ValueError) and issubclass(UnsupportedType, ValueError)


def test_stored_plan_that_fits_nothing():
    bad = chunk.Chunk(3, "Int64", [{"op": "NoSuch"}], {"main": b"abc"})
    with pytest.raises(CorruptData):
        chunk.decode_values(bad)
