import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.operators import gear

MASK = (1 << 64) - 1


def walk(data: bytes, average: int) -> list[int]:
    """The rule, one byte at a time."""
    s, table, ends, p = gear.Sizes.of(average), [int(x) for x in gear.gear_table()], [], 0
    while p < len(data):
        left = len(data) - p
        if left <= s.least:
            ends.append(len(data))
            break
        most, h = min(left, s.most), 0
        cut = most
        for i in range(s.least, most):
            h = ((h << 1) + table[data[p + i]]) & MASK
            if not h & ((1 << (s.strict_bits if i < min(s.normal, most) else s.loose_bits)) - 1):
                cut = i
                break
        p += cut
        ends.append(p)
    return ends


def test_table():
    t = gear.gear_table()
    assert [f"{int(t[i]):016x}" for i in (0, 1, 2, 255)] == ["6e789e6aa1b965f4", "06c45d188009454f", "f88bb8a8724c81ec", "cbdc6d34b7c7534d"]


@pytest.mark.parametrize(("average", "count", "first", "last", "most"), [(1024, 208, [1514, 1828, 1358, 1403, 1377, 1426], 147, 3149), (4096, 55, [6347, 4803, 3148, 4435, 1505], 3742, 11561), (1000, 285, [1004, 1846, 492], 147, None), (0, 1, [262144], 262144, 262144)])
def test_known_cuts(random_bytes, average, count, first, last, most):
    data = random_bytes(0x123456789, 262144)
    sizes = [len(x) for x in gear.split_bytes(data, average)]
    assert len(sizes) == count and sizes[: len(first)] == first and sizes[-1] == last
    assert most is None or max(sizes) == most
    assert b"".join(gear.split_bytes(data, average)) == data


def test_bounds_and_repeats(random_bytes):
    data = random_bytes(0x123456789, 262144)
    s = gear.Sizes.of(1024)
    sizes = [len(x) for x in gear.split_bytes(data, 1024)]
    assert max(sizes) <= s.most and min(sizes[:-1]) >= s.least
    assert gear.split_bytes(data, 1024) == gear.split_bytes(data, 1024)


def test_insertion_keeps_most_chunks(random_bytes):
    data = random_bytes(0x123456789, 262144)
    changed = data[:131072] + b"x" * 64 + data[131072:]
    old, new = gear.split_bytes(data, 1024), set(gear.split_bytes(changed, 1024))
    assert sum(c in new for c in old) >= len(old) * 3 / 4


def test_periodic_data_is_one_chunk():
    assert len(gear.split_bytes(b"abcd" * 700_000)) == 1


def test_empty():
    assert gear.split_bytes(b"") == [] and list(gear.split(iter([]))) == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([1, 2, 3, 4, 5, 16, 64, 100]), st.integers(1, 700))
def test_same_as_the_walk(data, average, piece):
    assert gear.cuts(np.frombuffer(data, np.uint8), average) == walk(data, average)
    assert b"".join(gear.split(iter([data[i : i + piece] for i in range(0, len(data), piece)]), average)) == data


def test_streamed_cuts_do_not_depend_on_reads(random_bytes):
    data = random_bytes(5, 9_000_000)
    whole = [len(x) for x in gear.split_bytes(data, 65536)]
    for piece in (70_001, 1 << 20):
        assert [len(x) for x in gear.split(iter([data[i : i + piece] for i in range(0, len(data), piece)]), 65536)] == whole
