"""A chunk's leaf to encoded leaves, and back. An encoding of two parts makes two leaves, named after its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from sheafwork.errors import InvalidFormat, SchemaMismatch
from sheafwork.functions import codecs
from sheafwork.options import EncodeOptions
from sheafwork.plans import choose

#: path, type, encoding, number of values, payload
Leaf = tuple[str, str, str, int, bytes]
Lookup = Callable[[str], tuple[str, str, int, bytes] | None]


def bool_leaves(path: str, values: np.ndarray, options: EncodeOptions, in_runs: bool = False) -> Iterator[Leaf]:
    if not len(values):
        yield path, "Void", "Void", 0, b""
        return
    if choose.smallest(choose.bool_candidates(values[: options.sample_values], options, in_runs), options.only) == "RLE Boolean":
        yield path, "Boolean", "RLE Boolean", len(values), bytes([bool(values[0])])
        yield from int_leaves(f"{path}.runs", choose.runs_of(values)[1], options, True)
    else:
        yield path, "Boolean", "Packed Boolean", len(values), codecs.pack_bools(values)


def int_leaves(path: str, values: np.ndarray, options: EncodeOptions, in_runs: bool = False) -> Iterator[Leaf]:
    width = choose.width_of(values)
    if width == "void":
        yield path, "Void", "Void", 0, b""
        return
    if width == "bool":
        yield from bool_leaves(path, values == 1, options, in_runs)
        return
    top, head = int(values.max()), values[: options.sample_values]
    chosen = choose.smallest(choose.int_candidates(head, top, width, options, in_runs), options.only)
    n = len(values)
    if chosen == "RLE":
        kept, lengths = choose.runs_of(values)
        yield path, "Integer", "RLE", n, b""
        yield from sub_ints(f"{path}.values", kept, top, width, options)
        yield from int_leaves(f"{path}.runs", lengths, options, True)
        return
    yield path, "Integer", chosen, n, int_payload(chosen, values)


def sub_ints(path: str, values: np.ndarray, top: int, width: str, options: EncodeOptions) -> Iterator[Leaf]:
    """Values of runs: of the width of all values, and never runs themselves."""
    chosen = choose.smallest(choose.int_candidates(values[: options.sample_values], top, width, options, True), options.only)
    yield path, "Integer", chosen, len(values), int_payload(chosen, values)


#: These have no payload, or one that the id could hold, as the first value of runs of truth values.
ID_ONLY = {"Void", "RLE", "Dictionary", "RLE Boolean", "Nullable", "Object", "Union", "Variable Length", "Zigzag"}


def stored_bytes(encoding: str, payload: bytes) -> int:
    """Bytes of a leaf: its type id, its payload, and the payload's length where it has one."""
    if encoding in ID_ONLY:
        return 1
    if encoding == "Fixed Length":
        return 1 + choose.varint_size(int.from_bytes(payload, "little"))
    return 1 + len(payload) + choose.varint_size(len(payload))


def payload_of(encoding: str, values: np.ndarray) -> bytes:
    """Payload of numbers under a given encoding."""
    if encoding == "XOR Float":
        return codecs.xor_floats(values)
    if encoding.startswith("Fixed F"):
        return values.astype(values.dtype.newbyteorder("<")).tobytes()
    return int_payload(encoding, values)


def int_payload(chosen: str, values: np.ndarray) -> bytes:
    return {"Simple16": codecs.simple16, "DeltaZig": lambda v: codecs.prefix_varints(codecs.delta_zigzag(v)), "U8 Fixed": lambda v: v.astype(np.uint8).tobytes(), "Prefix Varint": codecs.prefix_varints}[chosen](values)


def float_leaves(path: str, values: np.ndarray, options: EncodeOptions) -> Iterator[Leaf]:
    if not len(values):
        yield path, "Void", "Void", 0, b""
        return
    chosen = choose.smallest(choose.float_candidates(values[: options.sample_values], options), options.only)
    kind = f"F{8 * values.dtype.itemsize}"
    if chosen == "XOR Float":
        lossy = values if options.lossy_float_tolerance is None else codecs.quantized(values, options.lossy_float_tolerance)
        yield path, kind, chosen, len(values), codecs.xor_floats(lossy)
    else:
        yield path, kind, chosen, len(values), values.astype(values.dtype.newbyteorder("<")).tobytes()


def text_leaves(path: str, values: list[bytes], options: EncodeOptions) -> Iterator[Leaf]:
    if not values:  # texts keep their encoding and a length, unlike numbers
        yield path, "String", "UTF-8", 0, b""
        return
    chosen = choose.smallest(choose.text_candidates(values[: options.sample_values], options), options.only)
    n = len(values)
    # The whole may have no repeats though its head has, or the other way round.
    if chosen == "RLE":
        kept, lengths = choose.runs_of(values)
        yield path, "String", "RLE", n, b""
        yield f"{path}.values", "String", "UTF-8", len(kept), codecs.length_prefixed(kept)
        yield from int_leaves(f"{path}.runs", lengths, options, True)
    elif chosen == "Dictionary":
        words, codes = choose.dictionary_of(values)
        yield path, "String", "Dictionary", n, b""
        yield f"{path}.values", "String", "UTF-8", len(words), codecs.length_prefixed(words)
        yield from int_leaves(f"{path}.indices", codes, options)
    elif chosen == "Text Block":
        yield path, "String", "Text Block", n, codecs.text_block(values)
        yield from int_leaves(f"{path}.lens", np.array([len(v) for v in values], np.uint64), options)
    else:
        yield path, "String", "UTF-8", n, codecs.length_prefixed(values)


def read_leaf(path: str, look: Lookup):
    """A leaf's values: an array of numbers or truth values, or a list of bytes."""
    found = look(path)
    if found is None:
        raise SchemaMismatch(f"nothing is stored at {path}")
    kind, encoding, n, payload = found
    if encoding == "Void":
        return np.zeros(0, np.uint64)
    if encoding == "Packed Boolean":
        return codecs.unpack_bools(payload, n)
    if encoding == "RLE Boolean":
        lengths = read_ints(f"{path}.runs", look).astype(np.int64) + 1
        return np.repeat((np.arange(len(lengths)) + payload[0]) % 2 == 1, lengths)
    if encoding == "RLE":
        values, lengths = read_leaf(f"{path}.values", look), read_ints(f"{path}.runs", look).astype(np.int64) + 1
        return np.repeat(values, lengths) if isinstance(values, np.ndarray) else [v for v, k in zip(values, lengths.tolist(), strict=True) for _ in range(k)]
    if encoding == "Dictionary":
        words, codes = read_leaf(f"{path}.values", look), read_ints(f"{path}.indices", look)
        if len(codes) and int(codes.max()) >= len(words):
            raise InvalidFormat(f"a code of {path} has no value")
        return [words[c] for c in codes.astype(np.int64).tolist()]
    if encoding == "Text Block":
        return codecs.read_text_block(payload, read_ints(f"{path}.lens", look).astype(np.int64).tolist())
    if encoding == "UTF-8":
        return codecs.read_length_prefixed(payload, n)
    if encoding == "Simple16":
        return codecs.read_simple16(payload, n)
    if encoding == "DeltaZig":
        return codecs.undo_delta_zigzag(codecs.read_prefix_varints(payload, n))
    if encoding == "U8 Fixed":
        return np.frombuffer(payload, np.uint8).astype(np.uint64)
    if encoding == "Prefix Varint":
        return codecs.read_prefix_varints(payload, n)
    if encoding == "XOR Float":
        return codecs.read_xor_floats(payload, n).astype(np.float32 if kind == "F32" else np.float64)
    if encoding in ("Fixed F64", "Fixed F32"):
        return np.frombuffer(payload, "<f8" if encoding == "Fixed F64" else "<f4")
    raise InvalidFormat(f"unknown encoding {encoding} at {path}")


def read_ints(path: str, look: Lookup) -> np.ndarray:
    found = read_leaf(path, look)
    if not isinstance(found, np.ndarray):
        raise InvalidFormat(f"{path} holds no integers")
    return found.astype(np.uint64)
