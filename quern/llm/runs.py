"""Sorted runs of 64-bit hashes, stored as delta-coded bytes.

A run is a sorted sequence of distinct unsigned 64-bit numbers. Each number is
stored as the difference to the one before it (the first as itself), seven
bits a byte, low bits first, the high bit set on all bytes but a number's
last. Both directions work on many runs at a time, without a loop over
numbers or runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def encode(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """values: uint64, sorted and distinct within each run; starts: positions where runs begin (the first is 0)."""
    if not len(values):
        return pa.array([], pa.binary())
    deltas = np.empty_like(values)
    deltas[0] = values[0]
    np.subtract(values[1:], values[:-1], out=deltas[1:])
    deltas[starts] = values[starts]
    size = np.ones(len(deltas), dtype=np.int64)
    for bits in range(7, 64, 7):
        size += deltas >= np.uint64(1 << bits)
    ends = np.cumsum(size)
    body = np.empty(ends[-1], dtype=np.uint8)
    first = ends - size
    rest, open_ = deltas.copy(), np.arange(len(deltas))
    for k in range(10):
        low = (rest & np.uint64(127)).astype(np.uint8)
        more = size[open_] > k + 1
        body[first[open_] + k] = low | (more.astype(np.uint8) << 7)
        open_, rest = open_[more], rest[more] >> np.uint64(7)
        if not len(open_):
            break
    offsets = np.concatenate([first[starts], [ends[-1]]])
    if offsets[-1] >= 1 << 31:
        raise ValueError("runs of more than 2 GB in a batch: use more segments")
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])


def decode(runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs, one after the other, and how many each run has."""
    if isinstance(runs, pa.ChunkedArray):
        runs = runs.combine_chunks()
    if not len(runs):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    wide = np.int64 if pa.types.is_large_binary(runs.type) else np.int32
    offsets = np.frombuffer(runs.buffers()[1], dtype=wide)[runs.offset : runs.offset + len(runs) + 1].astype(np.int64)
    body = np.frombuffer(runs.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    last = np.flatnonzero(body < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    deltas = np.zeros(len(last), dtype=np.uint64)
    size = last - first + 1
    open_ = np.arange(len(last))
    for k in range(10):
        deltas[open_] |= (body[first[open_] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
        open_ = open_[size[open_] > k + 1]
        if not len(open_):
            break
    ends = np.searchsorted(last, offsets[1:], side="left")  # numbers that end before a run's end
    counts = np.diff(np.concatenate([[0], ends]))
    total = np.cumsum(deltas)  # wraps around, and so do the differences taken from it
    starts = ends - counts
    base = np.zeros(len(counts), dtype=np.uint64)
    inner = (counts > 0) & (starts > 0)
    base[inner] = total[starts[inner] - 1]
    return total - np.repeat(base, counts), counts


def union(values: np.ndarray, counts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """k-way union of the sorted runs of each group (numbered 0, 1, ... in ascending order): values, and how many each group has.

    The runs of a group follow one another, so a natural merge (numpy's stable
    sort of 64-bit numbers is one) finds them as they are and merges k of them
    in log2(k) passes; a group of one run is passed over.
    """
    if not len(group):
        return values, counts
    first = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(np.cumsum(counts)[first[1:] - 1], len(values))
    starts = np.append(0, ends[:-1])
    values = values.copy()
    several = np.diff(np.append(first, len(group))) > 1
    for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
        values[a:b].sort(kind="stable")
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[starts] = True
    return values[fresh], np.add.reduceat(fresh, starts, dtype=np.int64)
