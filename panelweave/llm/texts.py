"""Text columns of Arrow tables as NumPy byte arrays, and flat arrays as Arrow lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the bounds between them. A missing text is empty."""
    array = flat(column.cast(pa.large_binary()).fill_null(b""))
    if len(array) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes of the column; a longer value stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    low, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > low and total + size > limit:
            yield batch.slice(low, i - low)
            low, total = i, 0
        total += size
    if low < len(sizes):
        yield batch.slice(low)


def numbers(column: pa.ChunkedArray, dtype=np.int64) -> np.ndarray:
    return flat(column).to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def list_items(column: pa.ChunkedArray, dtype=np.int64) -> np.ndarray:
    """The items of a list column, one list after another."""
    return flat(column).flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def list_sizes(column: pa.ChunkedArray) -> np.ndarray:
    return flat(column).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def lists(values, cuts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Lists of consecutive ``values``; list i holds those from ``cuts[i]`` to ``cuts[i + 1]``."""
    items = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values, both ends included."""
    if len(sorted_values) == 0:
        return np.zeros(1, np.int64)
    change = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    return np.concatenate(([0], change, [len(sorted_values)]))


def found(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value whether it is in the ordered array, and where."""
    if len(ordered) == 0:
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values, at


def ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The integers of all ranges ``low .. low + count - 1``, one range after another."""
    total = int(count.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count - low, count)
