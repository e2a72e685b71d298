"""Substring deduplication over words by relative Lempel-Ziv factors."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from panelweave.llm.repeats import Windowing, remove_repeats

WINDOW = 20
GRAM = 8


class ReferenceBlock:
    """Pieces of text in order of appearance, with every window of them indexed."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.texts: list[tuple[list[bytes], int, int]] = []
        self.index: dict[bytes, tuple[int, int]] = {}

    def factor(self, words: list[bytes], doc: int, start: int) -> list[tuple[int, int, int]]:
        """Greedy factors of the words against the block, which then takes in what is new.

        Returns (offset, doc, start) of runs of windows: a factor of ``window`` words or more
        stands for the windows inside it and names their place in the reference; windows that
        no factor holds name their own place. Windows over a factor's end are in no factor,
        so each of them is looked up by itself before the next factor begins.
        """
        width, index = self.window, self.index
        joined = b" ".join(words)
        ends = [0, *accumulate(len(w) + 1 for w in words)]
        number = len(self.texts)
        self.texts.append((words, doc, start))
        out: list[tuple[int, int, int]] = []
        i, fresh, count = 0, False, len(words) - width + 1
        while i < count:
            window = joined[ends[i] : ends[i + width] - 1]
            hit = index.get(window)
            if hit is None:
                index[window] = (number, i)
                if not fresh:
                    out.append((i, doc, start + i))
                fresh, i = True, i + 1
                continue
            source, at = hit
            reference, its_doc, its_start = self.texts[source]
            length = width
            while (
                i + length < len(words)
                and at + length < len(reference)
                and words[i + length] == reference[at + length]
            ):
                length += 1
            out.append((i, its_doc, its_start + at))
            fresh, i = False, i + length - width + 1
        return out


def resolver(window: int):
    def resolve(payloads, anchor, count, key, doc, start):
        payloads = payloads.to_pylist()
        segments = np.zeros(len(payloads), np.int64)
        parsed: dict[int, list[tuple[int, int, int]]] = {}
        block, current = None, None
        # Windows of pieces with one anchor keep their order when the anchors are in order.
        for i in np.lexsort((start + anchor, doc, key)).tolist():
            if current != key[i]:
                block, current = ReferenceBlock(window), key[i]
            words = payloads[i].split()[: count[i] + window - 1]
            parsed[i] = block.factor(words, int(doc[i]), int(start[i]))
            segments[i] = len(parsed[i])
        rows = [row for i in range(len(payloads)) for row in parsed[i]]
        offset, where, begin = np.array(rows, np.int64).reshape(-1, 3).T
        return segments, offset, where, begin

    return resolve


def rlz_dedup(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = False
) -> DataFrame:
    """Remove every word covered by ``window`` words that also start earlier in the corpus.

    Earlier: in a document with a smaller id, or before in the same one. The pieces that may
    repeat (``repeats``) are factored, in corpus order, against the reference block of their
    anchor; each block indexes all pieces that came before. Result per row: ``doc``, ``n`` words,
    ``n_removed``, ``n_spans``, ``kept_sha256`` of the kept words joined by one space, the spans in
    words (``span_starts``, ``span_ends``), and with ``keep_text`` the kept text.

    A missing or empty text has no words. A missing id counts as larger than all others. Rows
    with one id are taken as one document at the same positions, so a repeated row removes
    nothing from its twin. Other columns are ignored; an empty table gives an empty result.
    """
    how = Windowing(True, window, min(GRAM, window), True, resolver(window), keep_text)
    return remove_repeats(docs, how, doc, text)
