"""Which encoding a chunk's leaf gets: the smallest estimate over a head of its values, the first declared of equals.

Estimates leave out some length and id bytes on purpose: choices depend on it. Inside runs (`in_runs`) neither runs nor deltas
are candidates; dictionary codes may be runs.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

from sheafwork.functions import codecs
from sheafwork.options import EncodeOptions


def varint_size(n: int) -> int:
    return codecs.VARINT_BYTES[int(n).bit_length()]


def runs_of(values: list) -> tuple[list, np.ndarray]:
    """Values of runs and lengths less one."""
    if 0 < len(values) <= codecs.FEW:
        few = values.tolist() if isinstance(values, np.ndarray) else values
        new = [0, *(i for i, (a, b) in enumerate(pairwise(few), 1) if a != b)]
        lengths = np.array([b - a - 1 for a, b in pairwise([*new, len(few)])], np.uint64)
        return values[new] if isinstance(values, np.ndarray) else [few[i] for i in new], lengths
    if isinstance(values, np.ndarray):
        new = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        kept = values[new]
    else:
        new = np.array([i for i in range(len(values)) if i == 0 or values[i] != values[i - 1]], np.int64)
        kept = [values[i] for i in new]
    return kept, (np.diff(np.append(new, len(values))) - 1).astype(np.uint64)


def dictionary_of(values: list) -> tuple[list, np.ndarray]:
    """Different values in order of appearance, and each value's code."""
    codes: dict = {}
    found = [codes.setdefault(v, len(codes)) for v in values]
    return list(codes), np.array(found, np.uint64)


def width_of(values: np.ndarray) -> str:
    if not len(values):
        return "void"
    top = int(values.max())
    return "bool" if top < 2 else "u8" if top < 1 << 8 else "u16" if top < 1 << 16 else "u32" if top < 1 << 32 else "u64"


def int_candidates(values: np.ndarray, top: int, width: str, options: EncodeOptions, in_runs: bool) -> dict[str, int]:
    found = {}
    if width != "u64" and top <= codecs.SIMPLE16_MAX:
        found["Simple16"] = 4 * len(codecs.simple16_layout(values))
    if width == "u32" and len(values) >= 2 and not in_runs:
        found["DeltaZig"] = codecs.varints_size(codecs.delta_zigzag(values))
    if width == "u8" and "Prefix Varint" not in options.only:
        found["U8 Fixed"] = len(values) + varint_size(len(values))
    else:
        found["Prefix Varint"] = codecs.varints_size(values)
    if not in_runs and len(values) >= 2:
        kept, lengths = runs_of(values)
        if len(kept) < len(values):
            found["RLE"] = 2 + min(int_candidates(kept, top, width, options, True).values()) + int_size(lengths, options, True)
    return found


def bool_candidates(values: np.ndarray, options: EncodeOptions, in_runs: bool) -> dict[str, int]:
    size = -(-len(values) // 8)
    found = {"Packed Boolean": size + varint_size(size)}
    if not in_runs and len(values) >= 25:
        found["RLE Boolean"] = 1 + int_size(runs_of(values)[1], options, True)
    return found


def int_size(values: np.ndarray, options: EncodeOptions, in_runs: bool) -> int:
    width = width_of(values)
    if width == "void":
        return 0
    if width == "bool":
        return min(bool_candidates(values == 1, options, in_runs).values())
    return min(int_candidates(values, int(values.max()), width, options, in_runs).values())


def float_candidates(values: np.ndarray, options: EncodeOptions) -> dict[str, int]:
    size = values.dtype.itemsize * len(values)
    lossy = values if options.lossy_float_tolerance is None else codecs.quantized(values, options.lossy_float_tolerance)
    return {f"Fixed F{8 * values.dtype.itemsize}": size + varint_size(size), "XOR Float": codecs.xor_float_size(lossy)}


def text_candidates(values: list[bytes], options: EncodeOptions) -> dict[str, int]:
    def plain(texts: list[bytes]) -> int:
        total = sum(len(t) + varint_size(len(t)) for t in texts)
        return total + varint_size(total)

    found = {"UTF-8": plain(values)}
    if len(values) >= 2:
        kept, lengths = runs_of(values)
        if len(kept) < len(values):
            found["RLE"] = 2 + plain(kept) + int_size(lengths, options, True)
        words, codes = dictionary_of(values)
        if len(words) < len(values):
            found["Dictionary"] = 2 + plain(words) + int_size(codes, options, False)
    if options.measured_text_size:
        found["Text Block"] = len(codecs.text_block(values)) + int_size(np.array([len(v) for v in values], np.uint64), options, False)
    else:
        found["Text Block"] = max(len(values), 10) * 10
    return found


def smallest(found: dict[str, int], only: tuple[str, ...] = ()) -> str:
    """The first of equals, in order of declaration; only: the candidates that count, if there are some of them."""
    kept = {k: v for k, v in found.items() if k in only} or found
    return min(kept, key=kept.get)
