"""Vectors of a table as integer matrices, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_ROWS = 4096
BLOCK_BYTES = 32 << 20


def _flat(column: pa.Array, kind: pa.DataType, missing) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column; missing values are ``missing``."""
    return column.offsets.to_numpy(), column.values.cast(kind).fill_null(missing).to_numpy(zero_copy_only=False)


def matrix(column: pa.Array, rows: np.ndarray, width: int, dtype=np.int64) -> np.ndarray:
    """The lists of ``rows``, with zeros behind those that are shorter than ``width``."""
    whole = pa.types.is_integer(column.type.value_type)
    offsets, values = _flat(column, pa.int64() if whole else pa.float64(), 0)
    starts, lengths = offsets[:-1][rows], np.diff(offsets)[rows]
    if len(rows) and (lengths == width).all():
        return values[starts[:, None] + np.arange(width)].astype(dtype, copy=False)
    out = np.zeros((len(rows), width), dtype)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(rows)), lengths), place] = values[np.repeat(starts, lengths) + place]
    return out


def quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which rows have a vector of finite components only, the lengths, and ``floor(scale * x)`` of every component.

    Components are taken as doubles; a whole number of a double is exact up to 2^53, and the callers bound it.
    """
    offsets, values = _flat(column, pa.float64(), float("nan"))
    floor = np.floor(scale * values)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(floor))))
    lengths = np.diff(offsets)
    usable = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
    return usable, lengths, pa.ListArray.from_arrays(column.offsets, pa.array(floor))


def blocks(batch: pa.RecordBatch, rows: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """``rows`` of a batch in blocks of bounded size, each with the width of its longest vector."""
    width = int(lengths[rows].max()) if len(rows) else 0
    step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        yield part, int(lengths[part].max())
