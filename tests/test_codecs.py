import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sheafwork.errors import InvalidFormat
from sheafwork.functions import codecs as K
from sheafwork.plans import choose

U64 = st.integers(0, 2**64 - 1)


@given(st.lists(U64, max_size=30))
def test_varints(values):
    a = np.array(values, np.uint64)
    assert K.read_prefix_varints(K.prefix_varints(a)).tolist() == values
    assert K.read_suffix_varints(K.suffix_varints(a)).tolist() == values
    assert len(K.prefix_varints(a)) == len(K.suffix_varints(a)) == int(K.varint_sizes(a).sum())


def test_varints_of_few_bits():
    bits = [1 << b for b in range(64)]
    values = sorted({0, 99, 127, 128, 2**56 - 1, 2**56, 2**64 - 1, *bits, *(a | b for a in bits for b in bits)})
    assert K.read_prefix_varints(K.prefix_varints(np.array(values, np.uint64))).tolist() == values
    sizes = dict(zip(values, K.varint_sizes(np.array(values, np.uint64)).tolist(), strict=True))
    assert (sizes[127], sizes[128], sizes[2**56 - 1 if 2**56 - 1 in sizes else 2**55], sizes[2**56], sizes[2**64 - 1]) == (1, 2, 8, 9, 9)


@given(st.lists(st.integers(0, 2**28 - 1), max_size=80))
def test_simple16(values):
    a = np.array(values, np.uint64)
    data = K.simple16(a)
    assert len(data) == 4 * len(K.simple16_layout(a)) and K.read_simple16(data, len(values)).tolist() == values


def test_simple16_limits():
    assert all(sum(layout) <= 28 for layout in K.LAYOUTS) and len(K.LAYOUTS) == 16
    with pytest.raises(ValueError):
        K.simple16(np.array([1 << 28]))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16, 17])
def test_packed_bools(n):
    values = np.arange(n) % 3 == 0
    data = K.pack_bools(values)
    assert len(data) == -(-n // 8) and K.unpack_bools(data, n).tolist() == values.tolist()


@given(st.lists(st.integers(0, 2**32 - 1), max_size=30))
def test_deltas(values):
    assert K.undo_delta_zigzag(K.delta_zigzag(np.array(values, np.uint64))).tolist() == values


def test_delta_fixtures():
    for values, deltas in (([1, 2, 4, 8], [1, 1, 2, 4]), ([9, 8], [9, -1]), ([0, 2**32 - 1], [0, -1])):
        assert K.unzigzag(K.delta_zigzag(np.array(values, np.uint64))).tolist() == deltas


@given(st.lists(st.floats(width=64, allow_nan=True), min_size=1, max_size=40))
def test_xor_floats(values):
    a = np.array(values, np.float64)
    data = K.xor_floats(a)
    assert K.read_xor_floats(data, len(a)).view(np.uint64).tolist() == a.view(np.uint64).tolist()
    assert abs(len(data) - K.xor_float_size(a)) <= 1


@given(st.lists(st.binary(max_size=200), max_size=10))
def test_texts(texts):
    assert K.read_length_prefixed(K.length_prefixed(texts), len(texts)) == texts
    assert K.read_text_block(K.text_block(texts), [len(t) for t in texts]) == texts


def test_broken_payloads():
    for read in (lambda: K.read_prefix_varints(b"\0\1"), lambda: K.read_simple16(b"", 1), lambda: K.unpack_bools(b"", 1), lambda: K.read_text_block(b"no", [2]), lambda: K.read_length_prefixed(b"\x0bab", 1), lambda: K.read_xor_floats(b"", 1)):
        with pytest.raises(InvalidFormat):
            read()


@given(st.floats(-1e6, 1e6), st.integers(-12, 3))
def test_quantize(value, tolerance):
    q = K.quantized(np.array([value]), tolerance)[0]
    assert 0 <= value - q <= 2.0**tolerance


def test_quantize_keeps_what_has_no_fraction():
    a = np.array([1.7e308, -1e300, np.inf, -np.inf, 2.0**52 + 1, 0.75])
    assert K.quantized(a, -10).tolist() == a.tolist()
    assert np.isnan(K.quantized(np.array([np.nan]), -10))[0]


def test_few_values_are_coded_as_many(monkeypatch):
    """What is done value by value gives what numpy gives, at every size of a value and for cut payloads."""
    rng = np.random.default_rng(3)
    few = K.FEW
    for n in [*range(1, 12), 28, 29, few]:
        for bits in (1, 2, 5, 9, 14, 28, 32, 56, 57, 64):
            values = rng.integers(0, 1 << bits, n, np.uint64, endpoint=False) if bits < 64 else rng.integers(0, (1 << 64) - 1, n, np.uint64, endpoint=True)
            values[::3] >>= np.uint64(bits // 2)
            texts = [bytes(int(v) % 200) for v in values]
            found = []
            for limit in (few, 0):
                monkeypatch.setattr(K, "FEW", limit)
                payload = K.prefix_varints(values)
                kept, lengths = choose.runs_of(values)
                words, times = choose.runs_of(texts)
                cut = []
                for data, count in ((payload[:-1], n), (payload[:-1], None), (payload, n + 1)):
                    try:
                        cut.append(K.read_prefix_varints(data, count).tolist())
                    except InvalidFormat as e:
                        cut.append(str(e))
                found.append((
                    payload, K.varints_size(values), K.read_prefix_varints(payload, n).tolist(), K.read_prefix_varints(payload).tolist(), cut, kept.tolist(), lengths.tolist(), words, times.tolist(),
                    K.length_prefixed(texts), K.delta_zigzag(values).tolist(), K.simple16_layout(values) if bits <= 28 else None,
                ))
            assert found[0] == found[1] and found[0][2] == values.tolist()
