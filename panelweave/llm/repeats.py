"""Which windows of a corpus occur earlier in it: the shared frame of the two exact deduplicators.

Four steps, each a grouped Arrow function, so Spark partitions, shuffles and recomputes the work:

1. Texts are dealt into *chunks* by a hash of the text. Exact copies meet there and only the copy
   with the smallest id goes on (map tasks drop their own copies first, so a text that fills a
   third of the corpus reaches its chunk once per map task).
2. Each chunk sends a 32-bit print of every anchor (see ``windows``) to the anchor's bucket. The
   bucket returns the prints that came from two places; only windows at such anchors can repeat.
3. Chunks send the pieces at returned anchors, once per content, to the bucket. There a *resolver*
   finds the earliest place of each window. This is the part in which the deduplicators differ.
   Anchors with very many pieces are dealt out by window instead, so no bucket receives them whole.
4. Chunks get the earliest places back, compare them with their own, and cut the texts.

Chunks and buckets keep their size; their number grows with the corpus. The chunked texts are
shuffled once: Spark reuses that exchange in steps 2, 3 and 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm import texts, windows

#: Bytes of text in a chunk, at least and at most; larger corpora take larger chunks.
CHUNK_BYTES = (2 << 20, 8 << 20)
CHUNKS_WANTED = 2000
#: An anchor with more occurrences than this is dealt out by window.
HOT = 4096
#: Stands for a missing id, later than all others.
LAST = 2**63 - 1

#: (payloads, anchor offsets, window counts, keys, docs, starts) -> (segments per content, offsets, docs, starts)
Resolver = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Windowing:
    """``window`` symbols count as a repeat; ``gram`` symbols make an anchor.

    ``within``: a window may also repeat inside its own document.
    """

    words: bool
    window: int
    gram: int
    within: bool
    resolver: Resolver
    keep_text: bool = False


@dataclass
class Chunk:
    """The distinct texts of a chunk, each with its smallest id."""

    data: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray
    hashes: tuple[np.ndarray, np.ndarray]


def read_chunk(table: pa.Table) -> Chunk:
    one, two, ids = (texts.numbers(table[c]) for c in ("h1", "h2", "doc"))
    order = np.lexsort((ids, two, one))
    if len(order):
        a, b = one[order], two[order]
        order = order[np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))]
    data, bounds = texts.text_bytes(table["text"].cast(pa.large_string()).take(pa.array(order)))
    return Chunk(data, bounds, ids[order], (one[order], two[order]))


@dataclass
class Found:
    """Pieces of one batch with all that later steps need; positions count from the chunk's start."""

    symbols: np.ndarray
    pieces: windows.Pieces
    places: np.ndarray | None
    first_symbol: np.ndarray
    low: int
    data_low: int
    data_high: int
    prefix: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.symbols)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.symbols * windows.powers(n), out=self.prefix[1:])

    def contents(self, p: windows.Pieces, window: int) -> np.ndarray:
        """Hash of what each piece holds, the same wherever it stands."""
        length = p.count + window - 1
        shift = windows.inverse_powers(len(self.symbols))[p.first]
        body = (self.prefix[p.first + length] - self.prefix[p.first]) * shift
        return windows.mix(body + length.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def cut_points(self, at: np.ndarray) -> np.ndarray:
        """Byte position in the chunk of a symbol, or of the end of the batch."""
        if self.places is None:
            return at + self.data_low
        ends = np.append(self.places, self.data_high - self.data_low)
        return ends[at] + self.data_low


def scan(chunk: Chunk, how: Windowing) -> Iterator[Found]:
    for low, high in windows.batches(np.diff(chunk.bounds)):
        begin, end = int(chunk.bounds[low]), int(chunk.bounds[high])
        data = chunk.data[begin:end]
        bounds = chunk.bounds[low : high + 1] - begin
        places = None
        if how.words:
            symbols, places = windows.word_symbols(data, bounds)
            bounds = np.searchsorted(places, bounds)
        else:
            symbols = windows.byte_symbols(data)
        p = windows.pieces(symbols, bounds, how.window, how.gram)
        yield Found(symbols, p, places, bounds, low, begin, end)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Range of the key space, so keys in order are also buckets in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def codes_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and print of a key in one number."""
    return (bucket_of(keys, buckets) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def each_window(p: windows.Pieces) -> windows.Pieces:
    """Pieces of one window each."""
    source = np.repeat(np.arange(len(p.first)), p.count)
    first = texts.ranges(p.first, p.count)
    return windows.Pieces(p.doc[source], first, np.ones(len(first), np.int64), p.anchor[source], p.key[source])


def pick(p: windows.Pieces, at: np.ndarray) -> windows.Pieces:
    return windows.Pieces(p.doc[at], p.first[at], p.count[at], p.anchor[at], p.key[at])


def drop_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass on a text when it is new to the task or comes with a smaller id than before."""
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        keep = []
        rows = zip(batch["h1"].to_pylist(), batch["h2"].to_pylist(), batch["doc"].to_pylist())
        for i, (one, two, doc) in enumerate(rows):
            if doc < seen.get((one, two), LAST + 1):
                seen[one, two] = doc
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


_PRINTS = "bucket long, chunk long, prints array<int>"
_CANDIDATES = "chunk long, codes array<long>, hot array<long>"
_PIECES = (
    "bucket long, chunk long, key array<long>, content array<long>, doc array<long>, start array<long>, "
    "anchor array<int>, windows array<int>, many array<boolean>, single array<boolean>, payload array<binary>"
)
_PLACES = (
    "chunk long, content array<long>, segments array<int>, offset array<int>, doc array<long>, "
    "start array<long>, hot array<long>"
)
_RESULTS = (
    "h1 long, h2 long, first long, n long, n_removed long, n_spans long, kept_sha256 string, "
    "span_starts array<long>, span_ends array<long>, kept string"
)


def _anchor_prints(how: Windowing, buckets: int):
    def prints(table: pa.Table) -> pa.Table:
        keys = []
        for f in scan(read_chunk(table), how):
            key = f.pieces.key
            if not how.within:
                # A document counts once per anchor.
                order = np.lexsort((f.pieces.doc, key))
                k, d = key[order], f.pieces.doc[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
                key = k[new]
            keys.append(key)
        key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
        bucket = bucket_of(key, buckets).astype(np.int64)
        cuts = texts.runs(bucket)
        heads = bucket[cuts[:-1]]
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        chunk = table["chunk"][0].as_py()
        return pa.table(
            {"bucket": heads, "chunk": np.full(len(heads), chunk, np.int64), "prints": texts.lists(low, cuts)}
        )

    return prints


def repeated_prints(hot: int):
    def repeated(table: pa.Table) -> pa.Table:
        prints = texts.list_items(table["prints"], np.int32).view(np.uint32)
        sizes = texts.list_sizes(table["prints"])
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(prints, kind="stable")
        cuts = texts.runs(prints[order])
        counts = np.diff(cuts)
        count = np.empty(len(prints), np.int64)
        count[order] = np.repeat(counts, counts)
        chosen = count > 1
        # The rows are sorted by print, so a repeat inside a row stands next to its like.
        same = np.zeros(len(prints), bool)
        same[1:] = (prints[1:] == prints[:-1]) & (row[1:] == row[:-1])
        chosen &= ~same
        code = (np.uint64(table["bucket"][0].as_py()) << np.uint64(32)) | prints.astype(np.uint64)
        code = code.view(np.int64)
        chunk = texts.numbers(table["chunk"])
        warm = chosen & (count > hot)

        def cut(mask):
            return np.concatenate(([0], np.cumsum(np.bincount(row[mask], minlength=len(sizes)))))

        out = pa.table(
            {"chunk": chunk, "codes": texts.lists(code[chosen], cut(chosen)), "hot": texts.lists(code[warm], cut(warm))}
        )
        return out.filter(pa.array(np.diff(cut(chosen)) > 0))

    return repeated


def _candidate_pieces(how: Windowing, buckets: int):
    def emit(docs: pa.Table, answers: pa.Table) -> pa.Table:
        codes = np.unique(texts.list_items(answers["codes"]).view(np.uint64))
        hot = np.unique(texts.list_items(answers["hot"]).view(np.uint64))
        columns: list[list] = [[] for _ in range(9)]
        chunk = read_chunk(docs) if len(codes) else None
        for f in scan(chunk, how) if chunk else ():
            code = codes_of(f.pieces.key, buckets)
            chosen, _ = texts.found(code, codes)
            warm, _ = texts.found(code, hot)
            for p, by_window in ((pick(f.pieces, chosen & ~warm), False), (each_window(pick(f.pieces, chosen & warm)), True)):
                if len(p.first) == 0:
                    continue
                content = f.contents(p, how.window)
                last = p.first + p.count + how.window - 1
                high = f.cut_points(last)
                if how.words:
                    high = np.minimum(high, chunk.bounds[f.low + p.doc + 1])
                values = (
                    p.key,
                    content,
                    chunk.ids[f.low + p.doc],
                    p.first - f.first_symbol[p.doc],
                    p.anchor - p.first,
                    p.count,
                    np.stack((f.cut_points(p.first), high), axis=1),
                    bucket_of(content if by_window else p.key, buckets),
                    np.full(len(p.first), by_window),
                )
                for column, value in zip(columns, values):
                    column.append(value)
        if not columns[0]:
            return _PIECES_SCHEMA.empty_table()
        key, content, doc, start, anchor, count, cuts, bucket, single = (np.concatenate(c) for c in columns)
        order = np.lexsort((start, doc, content, key, bucket))
        k, c, b = key[order], content[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        heads = np.flatnonzero(new)
        many = np.diff(np.append(heads, len(order))) > 1
        at = order[heads]
        payload = [chunk.data[low:high].tobytes() for low, high in cuts[at].tolist()]
        bucket = bucket[at].astype(np.int64)
        rows = texts.runs(bucket)
        return pa.table(
            {
                "bucket": bucket[rows[:-1]],
                "chunk": np.full(len(rows) - 1, docs["chunk"][0].as_py(), np.int64),
                "key": texts.lists(key[at].view(np.int64), rows),
                "content": texts.lists(content[at].view(np.int64), rows),
                "doc": texts.lists(doc[at], rows),
                "start": texts.lists(start[at], rows),
                "anchor": texts.lists(anchor[at].astype(np.int32), rows),
                "windows": texts.lists(count[at].astype(np.int32), rows),
                "many": texts.lists(many, rows),
                "single": texts.lists(single[at], rows),
                "payload": texts.lists(payload, rows, pa.binary()),
            }
        )

    return emit


def _earliest_places(how: Windowing, buckets: int):
    def resolve(table: pa.Table) -> pa.Table:
        key = texts.list_items(table["key"]).view(np.uint64)
        content = texts.list_items(table["content"]).view(np.uint64)
        doc, start, anchor, count = (
            texts.list_items(table[c]) for c in ("doc", "start", "anchor", "windows")
        )
        many, single = (texts.list_items(table[c], bool) for c in ("many", "single"))
        row = np.repeat(np.arange(table.num_rows), texts.list_sizes(table["key"]))
        order = np.lexsort((start, doc, content, key))
        k, c = key[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        at = order[new]  # the first occurrence of each content
        together = np.diff(texts.runs(key[at]))
        # A content that is a single window equals no other content, whatever its anchor holds.
        alone = np.repeat(together == 1, together) | single[at]
        segments = np.ones(len(at), np.int64)
        offset, where, begin = np.zeros(len(at), np.int64), doc[at], start[at]
        if not alone.all():
            mixed = np.flatnonzero(~alone)
            source = at[mixed]
            payloads = texts.flat(table["payload"]).flatten().take(pa.array(source))
            found = how.resolver(
                payloads, anchor[source], count[source], key[source], doc[source], start[source]
            )
            owner = np.concatenate((np.flatnonzero(alone), np.repeat(mixed, found[0])))
            by_owner = np.argsort(owner, kind="stable")
            segments[mixed] = found[0]
            offset, where, begin = (
                np.concatenate((x[alone], y))[by_owner]
                for x, y in zip((offset, where, begin), found[1:])
            )
        heads = np.concatenate(([0], np.cumsum(segments)))
        # An occurrence needs an answer if one of its windows, or a copy in its chunk, stands earlier.
        size = segments[group]
        item = texts.ranges(heads[group], size)
        own = np.repeat(np.arange(len(group)), size)
        earlier = where[item] < doc[own]
        if how.within:
            earlier |= (where[item] == doc[own]) & (begin[item] < start[own] + offset[item])
        asked = many | (np.bincount(own[earlier], minlength=len(group)) > 0)
        chosen = np.flatnonzero(asked)
        item = texts.ranges(heads[group[chosen]], segments[group[chosen]])
        rows = np.concatenate(([0], np.cumsum(np.bincount(row[chosen], minlength=table.num_rows))))
        parts = np.concatenate(([0], np.cumsum(segments[group[chosen]])))[rows]
        warm = single[chosen]
        codes = codes_of(key[chosen], buckets).view(np.int64)
        warm_rows = np.concatenate(([0], np.cumsum(np.bincount(row[chosen][warm], minlength=table.num_rows))))
        out = pa.table(
            {
                "chunk": texts.numbers(table["chunk"]),
                "content": texts.lists(content[chosen].view(np.int64), rows),
                "segments": texts.lists(segments[group[chosen]].astype(np.int32), rows),
                "offset": texts.lists(offset[item].astype(np.int32), parts),
                "doc": texts.lists(where[item], parts),
                "start": texts.lists(begin[item], parts),
                "hot": texts.lists(codes[warm], warm_rows),
            }
        )
        return out.filter(pa.array(np.diff(rows) > 0))

    return resolve


def _cut_texts(how: Windowing, buckets: int):
    def apply(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return _RESULTS_SCHEMA.empty_table()
        chunk = read_chunk(docs)
        content = texts.list_items(answers["content"]).view(np.uint64)
        order = np.argsort(content, kind="stable")
        ordered = content[order]
        segments = texts.list_items(answers["segments"])
        offset, where, begin = (texts.list_items(answers[c]) for c in ("offset", "doc", "start"))
        heads = np.concatenate(([0], np.cumsum(segments)))
        hot = np.unique(texts.list_items(answers["hot"]).view(np.uint64))
        out = _Results(how, chunk)
        for f in scan(chunk, how):
            marks = np.zeros(len(f.symbols) + 1, np.int64)
            warm = texts.found(codes_of(f.pieces.key, buckets), hot)[0] if len(hot) else np.zeros(len(f.pieces.key), bool)
            for p in (f.pieces, each_window(pick(f.pieces, warm))):
                if len(ordered) == 0 or len(p.first) == 0:
                    continue
                hit, at = texts.found(f.contents(p, how.window), ordered)
                p, answer = pick(p, hit), order[at[hit]]
                # One row per segment of each piece: windows low .. high share an earliest place.
                item = texts.ranges(heads[answer], segments[answer])
                own = np.repeat(np.arange(len(answer)), segments[answer])
                low = offset[item]
                high = np.append(low[1:], 0)
                last = np.append(own[1:] != own[:-1], True) if len(own) else np.empty(0, bool)
                high[last] = p.count[own[last]]
                doc = chunk.ids[f.low + p.doc[own]]
                earlier = where[item] < doc
                if how.within:
                    start = p.first[own] - f.first_symbol[p.doc[own]] + low
                    earlier |= (where[item] == doc) & (begin[item] < start)
                np.add.at(marks, p.first[own[earlier]] + low[earlier], 1)
                np.add.at(marks, p.first[own[earlier]] + high[earlier] - 1 + how.window, -1)
            out.add(f, np.cumsum(marks[:-1]) > 0)
        return out.table()

    return apply


class _Results:
    """Cuts the covered symbols out of the texts of a chunk."""

    def __init__(self, how: Windowing, chunk: Chunk) -> None:
        self.how, self.chunk = how, chunk
        self.rows: list[tuple] = []

    def add(self, f: Found, covered: np.ndarray) -> None:
        edges = np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))
        total = np.concatenate(([0], np.cumsum(covered)))
        bounds = f.first_symbol
        for d in range(len(bounds) - 1):
            low, high = int(bounds[d]), int(bounds[d + 1])
            removed = int(total[high] - total[low])
            raw = self.chunk.data[self.chunk.bounds[f.low + d] : self.chunk.bounds[f.low + d + 1]]
            begins = ends = np.empty(0, np.int64)
            if removed:
                # A span never crosses documents: at a bound both edges are taken apart.
                begins = np.flatnonzero(edges[low:high] == 1)
                ends = np.flatnonzero(edges[low + 1 : high + 1] == -1) + 1
                if covered[low] and (len(begins) == 0 or begins[0] != 0):
                    begins = np.concatenate(([0], begins))
                if covered[high - 1] and (len(ends) == 0 or ends[-1] != high - low):
                    ends = np.concatenate((ends, [high - low]))
            if self.how.words:
                words = raw.tobytes().split()
                if removed:
                    words = [w for w, gone in zip(words, covered[low:high].tolist()) if not gone]
                kept = b" ".join(words)
            else:
                kept = (raw[~covered[low:high]] if removed else raw).tobytes()
            self.rows.append(
                (high - low, removed, len(begins), hashlib.sha256(kept).hexdigest(), begins.tolist(), ends.tolist(),
                 kept.decode("utf-8", "replace") if self.how.keep_text else None)
            )

    def table(self) -> pa.Table:
        columns = list(zip(*self.rows)) or [()] * 7
        names = [f.name for f in _RESULTS_SCHEMA][3:]
        first = {"h1": self.chunk.hashes[0], "h2": self.chunk.hashes[1], "first": self.chunk.ids}
        return pa.table(first | dict(zip(names, columns)), schema=_RESULTS_SCHEMA)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(),
        "string": pa.string(),
        "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()),
        "array<boolean>": pa.list_(pa.bool_()),
        "array<binary>": pa.list_(pa.binary()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


_PIECES_SCHEMA = _arrow_schema(_PIECES)
_RESULTS_SCHEMA = _arrow_schema(_RESULTS)


def chunked(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """All rows by id and text hash, the distinct texts by chunk, and the number of chunks."""
    base = docs.select(
        F.col(doc).alias("doc"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).select("doc", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 1 + total // min(max(total // CHUNKS_WANTED, CHUNK_BYTES[0]), CHUNK_BYTES[1])
    ranked = base.withColumn("doc", F.coalesce(F.col("doc").cast("long"), F.lit(LAST)))
    distinct = ranked.mapInArrow(drop_copies, "doc long, h1 long, h2 long, text string").select(
        F.pmod("h1", F.lit(chunks)).alias("chunk"), "doc", "h1", "h2", "text"
    )
    return base.select("doc", "h1", "h2"), distinct, chunks


def remove_repeats(docs: DataFrame, how: Windowing, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: size, what was removed, spans, and the digest of what is kept."""
    base, distinct, buckets = chunked(docs, doc, text)
    by_chunk = distinct.groupBy("chunk")
    prints = by_chunk.applyInArrow(_anchor_prints(how, buckets), _PRINTS)
    answers = prints.groupBy("bucket").applyInArrow(repeated_prints(HOT), _CANDIDATES)
    pieces = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_candidate_pieces(how, buckets), _PIECES)
    places = pieces.groupBy("bucket").applyInArrow(_earliest_places(how, buckets), _PLACES)
    results = by_chunk.cogroup(places.groupBy("chunk")).applyInArrow(_cut_texts(how, buckets), _RESULTS)

    # A later copy of a text that holds a window is covered from end to end; others stay whole.
    copy = (F.coalesce(F.col("doc"), F.lit(LAST)) != F.col("first")) & (F.col("n") >= how.window)
    whole = F.array(F.lit(0).cast("long")), F.array(F.col("n"))

    def told(column, of_copy):
        return F.when(copy, of_copy).otherwise(F.col(column)).alias(column)

    kept = [told("kept", F.lit(""))] if how.keep_text else []
    return base.join(results, ["h1", "h2"]).select(
        F.col("doc").alias(doc),
        "n",
        told("n_removed", F.col("n")),
        told("n_spans", F.lit(1).cast("long")),
        told("kept_sha256", F.sha2(F.lit("").cast("binary"), 256)),
        told("span_starts", whole[0]),
        told("span_ends", whole[1]),
        *kept,
    )
