"""Exact sizes of small values. A list of several values takes an id and its length, and then the leaves of its values."""

import numpy as np
import pytest

from sheafwork.options import EncodeOptions, options
from sheafwork.plans import choose
from sheafwork.plans.encoding import stored_bytes
from sheafwork.plans.leaves import bool_leaves, float_leaves, int_leaves, read_leaf, text_leaves

PLAIN = EncodeOptions()


def size(leaves):
    return sum(stored_bytes(encoding, payload) for _, _, encoding, _, payload in leaves)


def listed(leaves, n):
    return 1 + choose.varint_size(n) + size(leaves)


def ints(*values):
    return np.array(values, np.uint64)


def texts(*values):
    return [v.encode() for v in values]


HUNDREDTHS = np.arange(50) * 0.01
RUNS = np.concatenate([np.append(np.ones(i, bool), False) for i in range(560, 570)])
DELTAS = ints(1_000_000_000, 1_000_000_001, 1_000_000_002, 1_000_000_010, 1_000_000_100, 100_000_050, 1_000_000_125, 1_000_000_122, 999_000_000, 998_001_000, 999_000_000, 1, 3_000_000_100, 1_000)


@pytest.mark.parametrize(
    ("leaves", "n", "expected"),
    [
        (int_leaves("p", ints(99, 100), PLAIN), 2, 6),
        (bool_leaves("p", np.array([0, 1, 1, 0, 1, 1, 1, 0, 0, 1, 0, 1], bool), PLAIN), 12, 6),
        (float_leaves("p", np.array([0.01, 0.02, 0.03, 0.04]), PLAIN), 4, 36),
        (float_leaves("p", np.array([0.01, 0.02, 0.03, 0.04], np.float32), PLAIN), 4, 20),
        (text_leaves("p", texts("abcd", "abcd", "def", "abcd", "abcd", "abcd", ""), PLAIN), 7, 21),
        (text_leaves("p", texts(*["abcd"] * 5), PLAIN), 5, 13),
        (text_leaves("p", texts(*["abcd"] * 5, *["def"] * 2), PLAIN), 7, 17),
        (text_leaves("p", texts(*["abcd"] * 6, "def"), PLAIN), 7, 17),
        (bool_leaves("p", RUNS, PLAIN), len(RUNS), 36),
        (int_leaves("p", DELTAS, PLAIN), 14, 49),
    ],
)
def test_golden_sizes(leaves, n, expected):
    assert listed(leaves, n) == expected


def test_nested_lists_of_bits():
    lengths, values = ints(5, 7, 7), ints(0, 0, 1, 1, 0, 1, 1, 1, 1, 1, 1, 0, 1, 0, 0, 0, 0, 0, 1)
    assert 1 + 1 + 1 + size(int_leaves("l", lengths, PLAIN)) + size(int_leaves("v", values, PLAIN)) == 14


def test_nullable_numbers():
    assert 1 + 1 + 1 + size(bool_leaves("o", np.ones(2, bool), PLAIN)) + size(int_leaves("v", ints(1, 2), PLAIN)) == 10


def test_lossy_floats():
    lossy = options(PLAIN, {"lossy_float_tolerance": -10})
    assert listed(list(float_leaves("p", HUNDREDTHS, PLAIN)), 50) == 376
    leaves = list(float_leaves("p", HUNDREDTHS, lossy))
    assert leaves[0][2] == "XOR Float" and listed(leaves, 50) == 104
    back = read_leaf("p", {"p": leaves[0][1:]}.get)
    assert np.abs(back - HUNDREDTHS).max() <= 0.001


def test_ties_go_to_the_first_declared():
    assert choose.smallest({"Simple16": 4, "U8 Fixed": 4}) == "Simple16"
    assert next(iter(int_leaves("p", ints(2, 3, 4), PLAIN)))[2] == "Simple16"


def test_runs_are_not_nested():
    values = np.repeat(np.arange(40, dtype=np.uint64) % 7, 30)
    kinds = {path: encoding for path, _, encoding, _, _ in int_leaves("p", values, PLAIN)}
    assert kinds["p"] == "RLE" and "RLE" not in {kinds[p] for p in kinds if p != "p"}


def test_dictionary_codes_may_be_runs():
    words = [w for w in ("apple", "pear", "plum", "fig") for _ in range(60)] * 3
    found = choose.text_candidates([w.encode() for w in words], PLAIN)
    assert found["RLE"] < found["UTF-8"]
