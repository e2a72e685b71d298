"""Windows of fixed length over symbol sequences, grouped by an anchor that their content alone decides.

A document is a sequence of 64-bit symbols (hashed words, or bytes). Among the k-grams of a
window the one with the smallest hash, leftmost on ties, is its anchor. Equal windows have equal
anchors, so windows that can be equal meet when they are dealt out by the anchor's hash.
Consecutive windows with one anchor make a *piece*: one record instead of one per window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Symbols handled at once; working arrays of this size stay in a core's cache.
BATCH = 1 << 18

_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BYTES = np.arange(256)
SPACES = np.isin(_BYTES, [32, 9, 10, 11, 12, 13])
ASCII_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_LETTERS = ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: All that is no lower-case letter; all that is neither such a letter nor a digit.
NO_LETTER = ~_LETTERS
NO_SIGN = ~(_LETTERS | ((_BYTES >= 48) & (_BYTES <= 57)))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def _power_table(base: int, n: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """The first powers of a base; the table of a batch's size is kept for the next batch."""
    if base not in known or len(known[base]) < n:
        out = np.full(max(n, BATCH), base, dtype=np.uint64)
        out[0] = 1
        table = np.multiply.accumulate(out)
        if n > 4 * BATCH:
            return table
        known[base] = table
    return known[base]


_known: dict[int, np.ndarray] = {}


def powers(n: int) -> np.ndarray:
    return _power_table(_BASE, n, _known)[:n]


def inverse_powers(n: int) -> np.ndarray:
    return _power_table(pow(_BASE, -1, 1 << 64), n, _known)[:n]


def lowered(data: np.ndarray) -> np.ndarray:
    """Letters A to Z and the capitals of Latin-1 in lower case."""
    out = ASCII_LOWER[data]
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    out[1:][capital] += 0x20
    return out


def word_symbols(
    data: np.ndarray, bounds: np.ndarray, spaces: np.ndarray = SPACES
) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word (a run of bytes that are no ``spaces``) of the texts between ``bounds``."""
    if len(data) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~spaces[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.empty(0, np.uint64), starts
    # Offset of each byte in its word; the spaces behind a word count as nothing.
    origin = np.zeros(len(data), np.int64)
    origin[starts] = np.diff(starts, prepend=0)
    offset = np.arange(len(data)) - np.cumsum(origin)
    np.clip(offset, 0, None, out=offset)
    values = _TABLE[data] * powers(int(offset.max()) + 1)[offset]
    values[~inside] = 0
    return mix(np.add.reduceat(values, starts)), starts


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` symbols, built by joining runs of doubled length."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run, length = symbols, 1
    total, covered = None, 0
    rest = k
    while rest:
        if rest & 1:
            part = run[covered : covered + n]
            total = part.copy() if total is None else total * np.uint64(pow(_BASE, length, 1 << 64)) + part
            covered += length
        rest >>= 1
        if rest:
            run = run[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + run[length:]
            length *= 2
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    run, length = values, 1
    while length * 2 <= width:
        run = np.minimum(run[:-length], run[length:])
        length *= 2
    if length < width:
        n = len(values) - width + 1
        run = np.minimum(run[:n], run[width - length : width - length + n])
    return run


@dataclass(frozen=True)
class Pieces:
    """Runs of windows with one anchor. ``first`` window and ``anchor``: symbol positions in the batch."""

    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    key: np.ndarray


def pieces(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Pieces:
    """Pieces of documents whose symbols lie between consecutive ``bounds``; none crosses a document."""
    empty = np.empty(0, np.int64)
    n = len(symbols) - window + 1
    if n <= 0:
        return Pieces(empty, empty, empty, empty, np.empty(0, np.uint64))
    hashes = gram_hashes(symbols, gram)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    ranked = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_min(ranked, window - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    lengths = np.diff(bounds)
    valid = np.zeros(n + 1, np.int8)
    long = lengths >= window
    valid[bounds[:-1][long]] += 1
    valid[bounds[1:][long] - window + 1] -= 1
    valid = np.cumsum(valid[:n]).astype(bool)
    starts = np.flatnonzero(valid)
    anchor = anchor[starts]
    # Pieces end where the anchor changes or a document ends (then the starts have a gap).
    cut = np.ones(len(starts), bool)
    cut[1:] = (np.diff(anchor) != 0) | (np.diff(starts) != 1)
    at = np.flatnonzero(cut)
    first = starts[at]
    return Pieces(
        doc=np.searchsorted(bounds, first, side="right") - 1,
        first=first,
        count=np.diff(np.append(at, len(starts))),
        anchor=anchor[at],
        # Hashes of anchors are minima, so they crowd near 0; mixed again, they spread evenly.
        key=mix(hashes[anchor[at]] ^ np.uint64(_BASE)),
    )


def batches(sizes: np.ndarray, limit: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes together; a longer row stands alone."""
    low, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > low and total + size > limit:
            yield low, i
            low, total = i, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes)
