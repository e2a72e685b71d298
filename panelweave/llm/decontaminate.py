"""Benchmark passages in documents, found by spaced seeds that overlook replaced words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from panelweave.llm import texts, windows

# Word positions that a seed compares (1) or ignores (0). Whichever two of 13 words
# are replaced, one of these seeds fits somewhere between the replaced words.
MASKS = ("11101011", "1101001101")
#: Words of a window, and how many of them must be equal.
WINDOW, EQUAL = 13, 11
#: Shorter items than this are no evidence, unless the caller lowers it. Items below ``WINDOW`` words must
#: occur whole, those from ``ONE_LOST`` words on with at most one word replaced, shorter ones unchanged.
LEAST_WORDS, ONE_LOST = 8, 10
#: Bytes of benchmark text that are broadcast at once. A larger benchmark goes in several passes.
BLOCK_BYTES = 8 << 20

#: Hits of seeds, and words of items laid along documents, that are handled at once.
HITS = 1 << 21

_FACTOR = 0x9E3779B97F4A7C15


def seeds(symbols: np.ndarray, mask: str) -> np.ndarray:
    n = len(symbols) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, len(mask), np.uint64)
    for at, used in enumerate(mask):
        if used == "1":
            total = total * np.uint64(_FACTOR) + symbols[at : at + n]
    return windows.mix(total)


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without case and punctuation, and the bounds of the texts in words."""
    symbols, starts = windows.word_symbols(windows.lowered(data), bounds, windows.NO_SIGN)
    return symbols, np.searchsorted(starts, bounds)


class SeedIndex:
    """Every seed of a block of items, in order, with a table of bits that most other seeds miss."""

    def __init__(self, item_ids: list, item_texts: list, least_words: int) -> None:
        data, bounds = texts.text_bytes(pa.chunked_array([pa.array(item_texts, pa.string())]))
        self.symbols, self.bounds = words_of(data, bounds)
        self.ids = item_ids
        lengths = np.diff(self.bounds)
        # Items shorter than every mask are found by all their words.
        short = np.unique(lengths[(lengths >= max(1, least_words)) & (lengths < min(map(len, MASKS)))])
        self.masks = []
        for mask in (*MASKS, *("1" * n for n in short.tolist())):
            usable = lengths == len(mask) if len(mask) in short else lengths >= least_words
            each = seeds(self.symbols, mask)
            at = np.arange(len(each))
            item = np.searchsorted(self.bounds, at, side="right") - 1
            inside = usable[item] & (at + len(mask) <= self.bounds[item + 1]) if len(at) else np.empty(0, bool)
            each, at, item = each[inside], at[inside], item[inside]
            order = np.argsort(each, kind="stable")
            each, at, item = each[order], at[order] - self.bounds[item[order]], item[order]
            bits = min(24, 5 + max(1, len(each)).bit_length())
            table = np.zeros(1 << bits, bool)
            table[each >> np.uint64(64 - bits)] = True
            self.masks.append((mask, bits, table, each, at, item))

    def diagonals(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where items meet documents: item, document, and document word that the item's first word falls on, each once.

        A seed that many items share meets every repeat of it in a text; hits are made unique in
        portions, so memory follows the places and not the hits.
        """
        n, longest = len(self.ids), int(np.diff(self.bounds).max(initial=0))
        span = len(symbols) + longest + 1
        places = [np.empty(0, np.int64)]
        for mask, bits, table, each, at, item in self.masks:
            mine = seeds(symbols, mask)
            maybe = np.flatnonzero(table[mine >> np.uint64(64 - bits)])
            low = np.searchsorted(each, mine[maybe], side="left")
            count = np.searchsorted(each, mine[maybe], side="right") - low
            doc = np.searchsorted(bounds, maybe, side="right") - 1
            portion = np.cumsum(count) // HITS
            for i, j in zip(cuts := texts.runs(portion), cuts[1:]):
                hit = texts.ranges(low[i:j], count[i:j])
                first = np.repeat(maybe[i:j], count[i:j]) - at[hit] + longest
                places.append(np.unique((item[hit] * (len(bounds) + 1) + np.repeat(doc[i:j], count[i:j])) * span + first))
        place = np.unique(np.concatenate(places))
        rest, first = place // span, place % span - longest
        return rest // (len(bounds) + 1), rest % (len(bounds) + 1), first

    def verified(self, symbols: np.ndarray, bounds: np.ndarray, item: int, doc: np.ndarray, first: np.ndarray):
        """The places of an item that overlap a document closely enough: which ones, and the words that do."""
        length = int(self.bounds[item + 1] - self.bounds[item])
        width = min(WINDOW, length)
        least = EQUAL if length >= WINDOW else width - (length >= ONE_LOST)
        own = self.symbols[self.bounds[item] : self.bounds[item + 1]]
        for low in range(0, len(first), max(1, HITS // length)):
            part = slice(low, low + max(1, HITS // length))
            words = first[part, None] + np.arange(length)
            inside = (words >= bounds[doc[part], None]) & (words < bounds[doc[part] + 1, None])
            same = inside & (symbols[np.where(inside, words, 0)] == own)
            sums = [np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1) for x in (same, inside)]
            equal, within = (x[:, width:] - x[:, :-width] for x in sums)
            good = (equal >= least) & (within == width)
            # Every word of a good window: windows that began and have not ended.
            steps = np.zeros((len(words), length + 1), np.int64)
            steps[:, : good.shape[1]] += good
            steps[:, width : width + good.shape[1]] -= good
            place, word = np.nonzero(np.cumsum(steps[:, :-1], axis=1) > 0)
            yield low + place, words[place, word]

    def overlaps(self, symbols: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], list[np.ndarray]]:
        """Overlapping words by (document, item)."""
        out: dict[tuple[int, int], list[np.ndarray]] = {}
        item, doc, first = self.diagonals(symbols, bounds)
        for low, high in zip(cuts := texts.runs(item), cuts[1:]):
            for place, words in self.verified(symbols, bounds, int(item[low]), doc[low:high], first[low:high]):
                of = doc[low:high][place]  # ascending
                for a, b in zip(ends := texts.runs(of), ends[1:]):
                    if b > a:
                        out.setdefault((int(of[a]), int(item[low])), []).append(words[a:b] - bounds[of[a]])
        return out


def _found(index: SeedIndex, column: pa.Array) -> Iterator[tuple[int, dict[tuple[int, int], list[np.ndarray]]]]:
    """Overlaps of some texts at a time, and the row of the first of them."""
    data, ends = texts.text_bytes(pa.chunked_array([column]))
    for low, high in windows.batches(np.diff(ends)):
        symbols, bounds = words_of(data[ends[low] : ends[high]], ends[low : high + 1] - ends[low])
        yield low, index.overlaps(symbols, bounds)


def _cleaner(index: SeedIndex, text: str):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            for low, found in _found(index, batch[text]):
                kept[[low + d for d, _ in found]] = False
            yield batch.filter(pa.array(kept))

    return clean


def _scanner(index: SeedIndex, kinds: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, items, sizes, begins, stops = [], [], [], [], []
            for low, overlaps in _found(index, batch["_text"]):
                for (d, item), found in sorted(overlaps.items()):
                    words = np.unique(np.concatenate(found))
                    cuts = np.flatnonzero(np.diff(words) > 1)
                    rows.append(low + d)
                    items.append(index.ids[item])
                    sizes.append(len(words))
                    begins.append([words[0], *words[cuts + 1]])
                    stops.append([*(words[cuts] + 1), words[-1] + 1])
            taken = batch["_doc"].take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken, *(pa.array(x, kinds.field(i + 1).type) for i, x in enumerate((items, sizes, begins, stops)))],
                schema=kinds,
            )

    return scan


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    least_words: int = LEAST_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and benchmark item that overlap: ``n_words`` and the spans, in words.

    Words are compared without case and punctuation. Seeds of both sides are hashed under fixed
    masks; where they meet, the item is laid along the document and windows of 13 words count
    that have at least 11 equal ones. The masks find every such window (tests prove it). Items of
    10 to 12 words count whole with one word replaced; those of 8 and 9, and shorter ones down to
    ``least_words``, only whole and unchanged. Text without spaces is one word.

    The benchmark, not the corpus, is broadcast, and only in blocks of ``block_bytes`` of text;
    documents are read once per block and never shuffled. Missing texts have no words; documents
    and items with missing ids keep them; repeated rows are reported each (repeated items too).
    An empty table on either side gives an empty result; other columns are ignored.
    """
    picked = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    item_kind = benchmark.schema[item].dataType
    kinds = StructType(
        [
            StructField("_doc", picked.schema["_doc"].dataType),
            StructField("item", item_kind),
            StructField("n_words", LongType()),
            StructField("span_starts", ArrayType(LongType())),
            StructField("span_ends", ArrayType(LongType())),
        ]
    )
    result = None
    for index in _indexes(benchmark, item, item_text, least_words, block_bytes):
        part = picked.mapInArrow(_scanner(index, to_arrow_schema(kinds)), kinds)
        result = part if result is None else result.unionByName(part)
    return result.withColumnsRenamed({"_doc": doc, "item": item})


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    least_words: int = LEAST_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item (see ``decontaminate``), all columns kept."""
    for index in _indexes(benchmark, item, item_text, least_words, block_bytes):
        docs = docs.mapInArrow(_cleaner(index, text), docs.schema)
    return docs


def _indexes(benchmark: DataFrame, item: str, item_text: str, least_words: int, block_bytes: int) -> Iterator[SeedIndex]:
    items = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    for number in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).collect()
        yield SeedIndex([r["item"] for r in block], [r["text"] for r in block], least_words)
