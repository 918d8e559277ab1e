"""Arrow list columns as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width (rows of that width, their vectors as doubles); null vectors and those with null or non-finite components are in none."""
    widths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for width in np.unique(widths[widths >= 0]):
        rows = np.flatnonzero(widths == width)
        values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
        usable = np.isfinite(values).all(axis=1)
        yield rows[usable], values[usable]
