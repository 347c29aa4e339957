"""Bit-level codecs over one chunk's values, in numpy. Each has an inverse."""

from __future__ import annotations

import zlib
from itertools import pairwise
from operator import le

import numpy as np

from sheafwork.errors import InvalidFormat

# The published Simple-16 layouts, as runs of (how many numbers, bits of each); a word has 28 bits of them.
SIMPLE16 = [
    [(28, 1)], [(7, 2), (14, 1)], [(7, 1), (7, 2), (7, 1)], [(14, 1), (7, 2)], [(14, 2)], [(1, 4), (8, 3)], [(1, 3), (4, 4), (3, 3)], [(7, 4)],
    [(4, 5), (2, 4)], [(2, 4), (4, 5)], [(3, 6), (2, 5)], [(2, 5), (3, 6)], [(4, 7)], [(1, 10), (2, 9)], [(2, 14)], [(1, 28)],
]
SIMPLE16_MAX = (1 << 28) - 1
LAYOUTS = [[bits for n, bits in layout for _ in range(n)] for layout in SIMPLE16]
#: Layouts whose first number may have so many bits.
FITTING = [[k for k, layout in enumerate(LAYOUTS) if layout[0] >= bits] for bits in range(29)]
#: Bytes of a variable-length integer by its significant bits.
VARINT_BYTES = [max(1, min(9, -(-bits // 7))) for bits in range(65)]
#: Up to so many values are coded one by one: for few of them numpy's calls take longer than that.
FEW = 64


def varint_sizes(values: np.ndarray) -> np.ndarray:
    """Bytes of each value as a variable-length integer."""
    limits = np.array([1 << (7 * n) for n in range(1, 9)], np.uint64)
    return np.searchsorted(limits, values.astype(np.uint64), "right") + 1


def varints_size(values: np.ndarray) -> int:
    """Bytes of all values as variable-length integers."""
    if len(values) <= FEW:
        return sum(VARINT_BYTES[v.bit_length()] for v in values.astype(np.uint64).tolist())
    return int(varint_sizes(values).sum())


def prefix_varint(v: int) -> bytes:
    n = VARINT_BYTES[v.bit_length()]
    return b"\0" + v.to_bytes(8, "little") if n == 9 else (v << n | 1 << (n - 1)).to_bytes(n, "little")


def prefix_varints(values: np.ndarray) -> bytes:
    """The first byte's trailing zeros tell how many bytes follow."""
    v = values.astype(np.uint64)
    if len(v) <= FEW:
        return b"".join(map(prefix_varint, v.tolist()))
    sizes = varint_sizes(v)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - sizes
    # Up to eight bytes hold the value and the mark below it; nine are a zero and the value.
    n = np.minimum(sizes, 8).astype(np.uint64)
    word = np.where(sizes == 9, v, (v << n) | (np.uint64(1) << (n - np.uint64(1))))
    shift = np.where(sizes == 9, 1, 0)
    for k in range(8):
        here = np.flatnonzero(sizes - shift > k)
        out[starts[here] + shift[here] + k] = (word[here] >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def varint_starts(data: bytes, count: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Where each value begins and its bytes."""
    raw = np.frombuffer(data, np.uint8)
    length_at = np.where(raw == 0, 9, trailing_zeros(raw) + 1).tolist()
    starts, at, size = [], 0, len(data)
    while at < size if count is None else len(starts) < count:
        if at >= size:
            raise InvalidFormat("a variable-length integer is cut off")
        starts.append(at)
        at += length_at[at]
    if at > size:
        raise InvalidFormat("a variable-length integer is cut off")
    found = np.array(starts, np.int64)
    return found, np.array([length_at[x] for x in starts], np.int64)


def read_few_varints(data: bytes, count: int | None) -> np.ndarray:
    out, at, size = [], 0, len(data)
    while at < size if count is None else len(out) < count:
        first = data[at] if at < size else 0
        n = (first & -first).bit_length() or 9
        if at + n > size:
            raise InvalidFormat("a variable-length integer is cut off")
        out.append(int.from_bytes(data[at + 1 : at + 9], "little") if n == 9 else int.from_bytes(data[at : at + n], "little") >> n)
        at += n
    return np.array(out, np.uint64)


def read_prefix_varints(data: bytes, count: int | None = None) -> np.ndarray:
    if len(data) <= 4 * FEW:
        return read_few_varints(data, count)
    starts, sizes = varint_starts(data, count)
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(9, np.uint8)))
    shift = np.where(sizes == 9, 1, 0)
    word = np.zeros(len(starts), np.uint64)
    for k in range(8):
        here = np.flatnonzero(sizes - shift > k)
        word[here] |= raw[starts[here] + shift[here] + k].astype(np.uint64) << np.uint64(8 * k)
    return np.where(sizes == 9, word, word >> np.minimum(sizes, 8).astype(np.uint64))


def suffix_varints(values: np.ndarray) -> bytes:
    """As prefix_varints, with the telling byte last, to be read from the end."""
    return prefix_varints(np.asarray(values)[::-1])[::-1]


def read_suffix_varints(data: bytes) -> np.ndarray:
    """Values in the order in which they were written."""
    return read_prefix_varints(data[::-1])[::-1]


def few_simple16(values: list[int]) -> list[tuple[int, int]]:
    widths, out, at = [v.bit_length() or 1 for v in values], [], 0
    if max(widths, default=0) > 28:
        raise ValueError("a number doesn't fit in 28 bits")
    while at < len(widths):
        for k in FITTING[widths[at]]:
            layout = LAYOUTS[k]
            if all(map(le, widths[at : at + len(layout)], layout)):
                out.append((k, min(len(layout), len(widths) - at)))
                at += len(layout)
                break
    return out


def simple16_layout(values: np.ndarray) -> list[tuple[int, int]]:
    """(layout, numbers taken) of each word: the layout that takes the most, the first of equals."""
    n = len(values)
    if n <= FEW:
        return few_simple16(np.asarray(values, np.uint64).tolist())
    widths = np.maximum(1, bit_lengths(np.asarray(values, np.uint64)))
    if n and widths.max() > 28:
        raise ValueError("a number doesn't fit in 28 bits")
    ahead = np.lib.stride_tricks.sliding_window_view(np.concatenate((widths, np.zeros(28, np.int64))), 28)[:n]
    best = np.zeros(n, np.int64)
    for k in range(len(LAYOUTS) - 1, -1, -1):  # which layout fits from each place on
        best[(ahead[:, : len(LAYOUTS[k])] <= LAYOUTS[k]).all(axis=1)] = k
    best = best.tolist()
    out, at = [], 0
    while at < n:
        taken = min(len(LAYOUTS[best[at]]), n - at)
        out.append((best[at], taken))
        at += taken
    return out


def simple16(values: np.ndarray) -> bytes:
    layout, values, out, at = simple16_layout(values), values.tolist(), bytearray(), 0
    for k, n in layout:
        word, shift = k << 28, 0
        for v, bits in zip(values[at : at + n], LAYOUTS[k], strict=False):
            word |= v << shift
            shift += bits
        out += word.to_bytes(4, "little")
        at += n
    return bytes(out)


def read_simple16(data: bytes, count: int) -> np.ndarray:
    out: list[int] = []
    for word in np.frombuffer(data, "<u4").tolist():
        shift = 0
        for bits in LAYOUTS[word >> 28]:
            out.append(word >> shift & ((1 << bits) - 1))
            shift += bits
    if len(out) < count:
        raise InvalidFormat("too few numbers")
    return np.array(out[:count], np.uint64)


def pack_bools(values: np.ndarray) -> bytes:
    return np.packbits(values.astype(bool), bitorder="little").tobytes()


def unpack_bools(data: bytes, count: int) -> np.ndarray:
    if len(data) * 8 < count:
        raise InvalidFormat("too few bits")
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:count].astype(bool)


def zigzag(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.uint64)
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def delta_zigzag(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours modulo 2^32, as signed 32-bit numbers, zigzagged."""
    v = values.astype(np.uint32)
    d = v.copy()
    d[1:] -= v[:-1]
    d = d.view(np.int32).astype(np.int64)
    return zigzag(d) & np.uint64(0xFFFFFFFF)


def undo_delta_zigzag(values: np.ndarray) -> np.ndarray:
    return (np.cumsum(unzigzag(values)) & 0xFFFFFFFF).astype(np.uint64)


def quantized(values: np.ndarray, tolerance: int) -> np.ndarray:
    """Rounded down to a multiple of 2^tolerance. Values too large to have such a fraction stay as they are, and so do those that aren't finite."""
    scale = values.dtype.type(2.0**-tolerance)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = values * scale
        return np.where(np.abs(scaled) < 2.0 ** np.finfo(values.dtype).nmant, np.floor(scaled) / scale, values)


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """Significant bits of unsigned 64-bit values."""
    x = x.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(shift))
    return np.bitwise_count(x).astype(np.int64)


def trailing_zeros(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64)


def xor_plan(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each value after the first: XOR with the one before, whether the XOR before it gives the window of bits, leading and trailing zeros
    of its own window, and bits written."""
    bits = values.astype(np.float64).view(np.uint64)
    x = bits[1:] ^ bits[:-1]
    before = np.concatenate((bits[:1], x[:-1])) if len(x) else x
    leading, trailing = np.minimum(64 - bit_lengths(x), 31), trailing_zeros(x)
    old_leading = 64 - bit_lengths(before)
    old_trailing = np.where(before == 0, 0, trailing_zeros(before))
    reuse = (leading >= old_leading) & (trailing >= old_trailing)
    written = np.where(x == 0, 1, np.where(reuse, 66 - old_leading - old_trailing, 77 - leading - trailing))
    return x, reuse, np.where(reuse, old_leading, leading), np.where(reuse, old_trailing, trailing), written


def xor_float_size(values: np.ndarray) -> int:
    """Bytes: 8 for the first value and one at the end, and the bits of the others."""
    return -(-(72 + int(xor_plan(values)[4].sum())) // 8)


def xor_floats(values: np.ndarray) -> bytes:
    """The first value, then for each other one: 0 (equal), 10 and the bits of the last window, or 11, window and bits; last, how many bits fill the last byte."""
    bits = values.astype(np.float64).view(np.uint64)
    stream, n = 0, 0
    parts: list[bytes] = [bits[:1].tobytes()]
    x, reuse, leading, trailing, _ = (a.tolist() for a in xor_plan(values))

    for value, old, lead, trail in zip(x, reuse, leading, trailing, strict=True):
        if value == 0:
            stream, n = stream << 1, n + 1
        else:
            width = 64 - lead - trail
            head, size = (0b10, 2) if old else ((0b11 << 11) | (lead << 6) | (width - 1), 13)
            stream, n = (((stream << size) | head) << width) | (value >> trail), n + size + width
        if n >= 4096:
            keep = n % 8
            parts.append((stream >> keep).to_bytes((n - keep) // 8, "big"))
            stream, n = stream & ((1 << keep) - 1), keep
    pad = -n % 8
    parts.append((stream << pad).to_bytes((n + pad) // 8, "big"))
    parts.append(bytes([pad]))
    return b"".join(parts)


def read_xor_floats(data: bytes, count: int) -> np.ndarray:
    if len(data) < 9:
        raise InvalidFormat("too short for a float")
    first = int(np.frombuffer(data[:8], np.uint64)[0])
    body = data[8:-1]
    text = bin(int.from_bytes(b"\x01" + body, "big"))[3:]
    out, at, lead, trail, previous = [first], 0, 64 - first.bit_length(), (first & -first).bit_length() - 1 if first else 0, first
    while len(out) < count:
        if at >= len(text):
            raise InvalidFormat("too few floats")
        if text[at] == "0":
            at += 1
            out.append(out[-1])
            previous = 0
            lead, trail = 64, 0
            continue
        if text[at + 1] == "1":
            lead, width = int(text[at + 2 : at + 7], 2), int(text[at + 7 : at + 13], 2) + 1
            trail = 64 - lead - width
            at += 13
        else:
            lead, trail = 64 - previous.bit_length(), (previous & -previous).bit_length() - 1 if previous else 0
            width = 64 - lead - trail
            at += 2
        previous = int(text[at : at + width], 2) << trail
        at += width
        out.append(out[-1] ^ previous)
    return np.array(out, np.uint64).view(np.float64)


def text_block(texts: list[bytes]) -> bytes:
    return zlib.compress(b"".join(texts), 9)


def read_text_block(data: bytes, lengths: list[int]) -> list[bytes]:
    try:
        whole = zlib.decompress(data)
    except zlib.error as e:
        raise InvalidFormat(str(e)) from e
    if sum(lengths) != len(whole):
        raise InvalidFormat("lengths don't add up to the text")
    ends = np.cumsum([0, *lengths]).tolist()
    return [whole[a:b] for a, b in pairwise(ends)]


def length_prefixed(texts: list[bytes]) -> bytes:
    if len(texts) <= FEW:
        return b"".join([x for t in texts for x in (prefix_varint(len(t)), t)])
    lengths = np.array([len(t) for t in texts], np.uint64)
    heads, ends = prefix_varints(lengths), np.cumsum(varint_sizes(lengths)).tolist()
    return b"".join(x for t, a, b in zip(texts, [0, *ends], ends, strict=False) for x in (heads[a:b], t))


def read_length_prefixed(data: bytes, count: int) -> list[bytes]:
    out, at = [], 0
    for _ in range(count):
        if at >= len(data):
            raise InvalidFormat("too few texts")
        first = data[at]
        n = 9 if first == 0 else (first & -first).bit_length()
        size = int.from_bytes(data[at + 1 : at + 9], "little") if n == 9 else int.from_bytes(data[at : at + n], "little") >> n
        at += n
        if at + size > len(data):
            raise InvalidFormat("a text is cut off")
        out.append(data[at : at + size])
        at += size
    return out
