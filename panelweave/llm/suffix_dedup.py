"""Substring deduplication over bytes by suffix arrays of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelweave.llm import texts
from panelweave.llm.grouping_sort import suffix_array
from panelweave.llm.repeats import Windowing, remove_repeats

WINDOW = 50
GRAM = 24
#: Symbols sorted at once; whole anchors only.
BLOCK = 100_000


def joined(data, low, size, anchor, key, gram: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces in a row as symbols, each anchor as one symbol of its own kind, 0 between pieces."""
    begins = np.concatenate(([0], np.cumsum(size - gram + 2)))
    piece = np.repeat(np.arange(len(size)), size)
    inside = texts.ranges(np.zeros(len(size), np.int64), size)
    at = anchor[piece]
    kept = (inside <= at) | (inside >= at + gram)
    shift = np.where(inside > at, gram - 1, 0)
    out = np.zeros(begins[-1] + pad, np.int64)
    out[(begins[piece] + inside - shift)[kept]] = data[texts.ranges(low, size)[kept]].astype(np.int64) + 1
    out[begins[:-1] + anchor] = 257 + np.unique(key, return_inverse=True)[1]
    return out, begins


def shared_reach(data, first, last, step: int, width: int, key) -> np.ndarray:
    """How far each piece agrees with another piece of its key, from ``first`` on towards ``last``."""
    away = np.arange(width) * step
    at = first[:, None] + away
    inside = at < last[:, None] if step > 0 else at >= last[:, None]
    sides = np.where(inside, data[np.clip(at, 0, len(data) - 1)].astype(np.uint8) + np.uint8(1), np.uint8(0))
    rank = np.unique(key, return_inverse=True)[1].astype(">u4").view(np.uint8).reshape(-1, 4)
    rows = np.ascontiguousarray(np.concatenate((rank, sides), axis=1))
    order = np.argsort(rows.view(f"S{4 + width}").ravel(), kind="stable")
    rows = rows[order]
    same = rows[1:] == rows[:-1]
    same[:, 4:] &= rows[1:, 4:] != 0
    reach = np.where(same.all(axis=1), 4 + width, same.argmin(axis=1)) - 4
    best = np.zeros(len(order), np.int64)
    best[1:] = reach
    best[:-1] = np.maximum(best[:-1], reach)
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(best, 0)
    return out


def resolver(window: int, gram: int):
    short = window - gram + 1  # a window's length once its anchor is one symbol

    def first_docs(data, low, count, anchor, key, doc) -> np.ndarray:
        """For every window of the pieces, the smallest document that holds it."""
        symbols, begins = joined(data, low, count + window - 1, anchor, key, gram, short)
        owner = np.full(len(symbols), -1, np.int64)
        starts = texts.ranges(begins[:-1], count)
        owner[starts] = np.repeat(np.arange(len(count)), count)
        order = suffix_array(symbols[: begins[-1]])
        order = order[owner[order] >= 0]
        # Equal windows are neighbours in the order of suffixes.
        rows = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.int32), short)[order]
        new = np.ones(len(order), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        heads = np.flatnonzero(new)
        smallest = np.minimum.reduceat(doc[owner[order]], heads)
        result = np.empty(len(symbols), np.int64)
        result[order] = np.repeat(smallest, np.diff(np.append(heads, len(order))))
        return result[starts]

    def resolve(payloads, anchor, count, key, doc, start):
        data, bounds = texts.text_bytes(pa.chunked_array([payloads]))
        heads = np.concatenate(([0], np.cumsum(count)))
        docs = np.repeat(doc, count)  # of every window; its own document, if no smaller one has it
        # A window is worth sorting if its part on either side of the anchor is somewhere else too.
        middle = bounds[:-1] + anchor
        left = shared_reach(data, middle - 1, bounds[:-1], -1, window - gram, key)
        right = shared_reach(data, middle + gram, bounds[1:], 1, window - gram, key)
        low = np.maximum(0, anchor - left)
        high = np.minimum(count, anchor + right - (window - gram) + 1)
        order = np.flatnonzero(high > low)
        order = order[np.argsort(key[order], kind="stable")]
        sizes = (high - low + window - gram + 1)[order]
        keys = texts.runs(key[order])
        begin, total = 0, 0
        for j, size in enumerate(np.add.reduceat(sizes, keys[:-1]).tolist() if len(order) else ()):
            total += size
            if total >= BLOCK or j == len(keys) - 2:
                at = order[keys[begin] : keys[j + 1]]
                many = (high - low)[at]
                found = first_docs(data, (bounds[:-1] + low)[at], many, (anchor - low)[at], key[at], doc[at])
                docs[texts.ranges((heads[:-1] + low)[at], many)] = found
                begin, total = j + 1, 0
        owner = np.repeat(np.arange(len(count)), count)
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (owner[1:] != owner[:-1])
        offset = np.arange(len(docs)) - np.repeat(heads[:-1], count)
        return np.bincount(owner[new], minlength=len(count)), offset[new], docs[new], np.zeros(new.sum(), np.int64)

    return resolve


def suffix_dedup(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = False
) -> DataFrame:
    """Remove every byte covered by ``window`` bytes that also start in a document with a smaller id.

    Texts are UTF-8 bytes; matches never cross documents. The pieces that may repeat (``repeats``)
    are sorted block by block with a suffix array built by linear grouping; windows that are equal
    for their whole length stand together there. Result per row: ``doc``, ``n`` bytes,
    ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``, the spans in bytes
    (``span_starts``, ``span_ends``), and with ``keep_text`` the kept text (bytes of a cut
    character show as U+FFFD there).

    A missing text is empty. A missing id counts as larger than all others. Rows with one id
    remove nothing from each other. Other columns are ignored; an empty table gives an empty result.
    """
    gram = min(GRAM, window)
    return remove_repeats(docs, Windowing(False, window, gram, False, resolver(window, gram), keep_text), doc, text)
