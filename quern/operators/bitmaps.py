"""Compressed bitmaps of 65,536 bits, built and combined from Arrow batches.

A container holds the low 16 bits of integer codes that share their high
bits (the key range). It is stored in the smallest of three forms, told apart
by the first byte: sorted positions, plain bits, or runs of consecutive bits.
"""

from __future__ import annotations

import numpy as np

BITS = 1 << 16
POSITIONS, PLAIN, RUNS = 0, 1, 2


def pack(low: np.ndarray) -> bytes:
    """The container of some positions (any order, repeated or not)."""
    return pack_bits(bits_of(low))


def bits_of(low: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, dtype=bool)
    bits[low] = True
    return bits


def pack_bits(bits: np.ndarray) -> bytes:
    at = np.flatnonzero(bits)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], bits, [False]]).astype(np.int8)))
    if 2 * len(edges) < min(2 * len(at), BITS // 8):
        runs = edges.reshape(-1, 2)
        runs[:, 1] -= 1  # a run's end is kept as its last bit, so that it fits in 16 bits
        return bytes([RUNS]) + runs.astype("<u2").tobytes()
    if 2 * len(at) < BITS // 8:
        return bytes([POSITIONS]) + at.astype("<u2").tobytes()
    return bytes([PLAIN]) + np.packbits(bits).tobytes()


def unpack(container: bytes | None) -> np.ndarray:
    """The bits of a container; none for NULL."""
    bits = np.zeros(BITS, dtype=bool)
    if not container:
        return bits
    form, body = container[0], memoryview(container)[1:]
    if form == PLAIN:
        return np.unpackbits(np.frombuffer(body, dtype=np.uint8)).astype(bool)
    values = np.frombuffer(body, dtype="<u2").astype(np.int64)
    if form == POSITIONS:
        bits[values] = True
    else:
        for first, last in values.reshape(-1, 2):
            bits[first : last + 1] = True
    return bits


def and_not(left: bytes | None, right: bytes | None) -> np.ndarray:
    """Positions set in the left container and not in the right one."""
    return np.flatnonzero(unpack(left) & ~unpack(right))
