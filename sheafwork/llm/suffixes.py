"""Suffix arrays of bounded pieces, in numpy."""

from __future__ import annotations

import numpy as np


def ranks_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the keys, each key's dense rank, and the number of different keys."""
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    ahead = np.zeros(len(keys), np.int64)
    np.cumsum(found[1:] != found[:-1], out=ahead[1:])
    rank = np.empty(len(keys), np.int64)
    rank[order] = ahead
    return order, rank, int(ahead[-1]) + 1


def doubled(order: np.ndarray, rank: np.ndarray, kinds: int, step: int) -> np.ndarray:
    """From the order by the first `step` symbols to that of whole suffixes: pairs of ranks give ranks of twice the length. The end counts as smaller than any symbol."""
    n = len(rank)
    bits = (n + 1).bit_length()
    place = np.arange(n, dtype=np.int64)
    while kinds < n:
        second = np.zeros(n, np.int64)
        if step < n:
            second[: n - step] = rank[step:] + 1
        if 3 * bits <= 62:  # the place fits beside both ranks: sorting the numbers themselves is faster than finding their order
            packed = np.sort((((rank << bits) | second) << bits) | place)
            order = packed & ((1 << bits) - 1)
            found = packed >> bits
            ahead = np.zeros(n, np.int64)
            np.cumsum(found[1:] != found[:-1], out=ahead[1:])
            rank[order] = ahead
            kinds = int(ahead[-1]) + 1
        else:
            order, rank, kinds = ranks_of((rank << bits) | second)
        step *= 2
    return order


def suffix_array(seq: np.ndarray) -> np.ndarray:
    if len(seq) < 2:
        return np.arange(len(seq))
    return doubled(*ranks_of(seq.astype(np.int64)), 1)


def suffix_array_of_bytes(text: np.ndarray) -> np.ndarray:
    """As suffix_array, from the order by eight bytes at once. The last byte must be 0xFE, which occurs nowhere else."""
    if len(text) < 2:
        return np.arange(len(text))
    padded = np.concatenate((text, np.full(7, 0xFE, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)
    return doubled(*ranks_of(words), 8)
