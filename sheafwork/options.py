"""Options of encoding and decoding; later settings override earlier ones, and what isn't set keeps its default."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EncodeOptions:
    lossy_float_tolerance: int | None = None  # a power of two; None keeps floats as they are
    chunk_rows: int = 4096
    sample_values: int = 256
    measured_text_size: bool = False  # choose text compression by its real size, not by the fixed estimate
    only: tuple[str, ...] = ()  # encodings that alone are candidates wherever a leaf has one of them as a candidate


@dataclass(frozen=True)
class DecodeOptions:
    parallel: bool = True
    void_ints_as_zero: bool = False  # a missing integer field reads as 0, not as an error


def options(base, *overrides: dict):
    for o in overrides:
        base = replace(base, **o)
    return base
