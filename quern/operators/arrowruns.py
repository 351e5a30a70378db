"""Vectorised helpers over Arrow batches whose rows arrive sorted."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array; a column that is NULL throughout may come as chunks."""
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def differs(column: pa.Array) -> np.ndarray:
    """For each row after the first: does it differ from the row before it? NULL equals NULL."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
    if column.null_count:
        unequal = unequal | (pc.is_null(here).to_numpy(zero_copy_only=False) != pc.is_null(before).to_numpy(zero_copy_only=False))
    return unequal


class Boundaries:
    """Finds where groups start in sorted batches, across batch borders."""

    def __init__(self) -> None:
        self._last: list[pa.Array] | None = None

    def starts(self, columns: Sequence[pa.Array]) -> np.ndarray:
        """True where a row's values differ from those of the row before it."""
        rows = len(columns[0])
        if self._last is None:
            found = np.zeros(rows, dtype=bool)
            found[0] = True
            for column in columns:
                found[1:] |= differs(column)
        else:
            found = np.zeros(rows, dtype=bool)
            for last, column in zip(self._last, columns, strict=True):
                found |= differs(pa.concat_arrays([last, column]))
        self._last = [column.slice(rows - 1, 1) for column in columns]
        return found
