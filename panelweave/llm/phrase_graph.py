"""Collocations from a weighted de Bruijn graph of words.

Edges are runs of four words, nodes the three words that two edges overlap in; an edge weighs as
much as its run occurs. Every word of a piece of text starts one edge, or near the piece's end a
shorter *tail*. So shorter runs need no counting of their own: a run of three words occurs as often
as the edges that leave its node weigh together, plus its tails; a run of two likewise by the
runs of three that begin with it, a word by its runs of two.

Only runs that occur ``least`` times are asked for, and no such run begins with a rarer one. So
words and pairs, then triples, then whole edges are first counted in cells that several may share. An
edge in a rarer cell is sent as the tail of its first three words, if their cell is rarer too of
two or one, and a rarer word only counts as any word. Sharing a cell leaves a run longer than it need
be and changes no count. Most of a text's edges occur once and so never leave their task.

Nodes that one edge enters and one edge leaves, with nothing lost between, say nothing new: such
unary paths are joined into single rows of many words, and their inner nodes, which occur
only inside longer runs, are no candidates.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.llm.texts import slices, text_bytes
from panelweave.llm.windows import ASCII_LOWER, mix
from panelweave.sources import stage

#: Words of an edge.
LONGEST = 4
#: Cells come in rows of this many. There is about one for each ``CELL_BYTES`` bytes of text, and at most
#: 2 ** 30, whose bits take 128 MB; with more than some 10 ** 10 words cells fill up and the filter fades.
ROW_BITS, CELL_BYTES, CELL_BITS = 16, 16, (20, 30)
#: Runs that a task counts before it sends their cells.
COUNTED = 1 << 22
#: Counts of a task stop here; a cell that reaches it is frequent.
FULL = 255
#: Bytes of text handled at once, unless one text is longer.
SLICE = 1 << 22
#: Edges of a compacted path in one row; a longer path takes several.
PATH_EDGES = 1024
NO_LANG = "und"

_BYTES = np.arange(256)
_BLANK = np.isin(_BYTES, [0x20, 0x09])
_STOP = np.isin(_BYTES, [*b".,;:!?", *range(0x0A, 0x0E)])
WORDS = [f"w{i + 1}" for i in range(LONGEST)]


class _Words:
    """The words of some texts: numbers into ``names``, languages, and whether the next word continues the piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, bounds = text_bytes(pa.chunked_array([batch.column("text")]))
        data = ASCII_LOWER[data]
        stop = _STOP[data]
        inside = ~(stop | _BLANK[data])
        heads = bounds[:-1][bounds[:-1] < len(data)]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[heads] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[heads[heads > 0] - 1] = False
        sizes = np.flatnonzero(inside & ~after) + 1 - starts
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))]
        ).dictionary_encode()
        self.names, self.word = words.dictionary, words.indices.to_numpy().astype(np.int64)
        doc = np.searchsorted(bounds, starts, side="right") - 1
        langs = batch.column("lang").fill_null(NO_LANG).dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy().astype(np.int64)[doc]
        stops = np.cumsum(stop)[starts] if len(starts) else starts
        self.joined = (np.diff(stops) == 0) & (np.diff(doc) == 0)

    def hashes(self) -> Iterator[np.ndarray]:
        """Of the runs of one word, two, three and so on that begin at each word, whether they fit there or not."""
        names = np.array([xxhash.xxh3_64_intdigest(w) for w in self.names.to_pylist()], np.uint64)[self.word]
        langs = np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs.to_pylist()], np.uint64)[self.lang]
        run = mix(langs + names)
        while True:
            yield run
            names = np.append(names[1:], np.uint64(0))[: len(run)]
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + names)

    def reaches(self) -> Iterator[np.ndarray]:
        """Whether a run of one word, two, three and so on that begins at a word stays in its piece."""
        fits, joined = np.ones(len(self.word), bool), np.append(self.joined, False)[: len(self.word)]
        while True:
            yield fits
            fits = fits & joined
            joined = np.append(joined[1:], False)[: len(fits)]


def _cells(run: np.ndarray, bits: int) -> np.ndarray:
    return (run >> np.uint64(64 - bits)).astype(np.int64)


def _is_frequent(cells: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    return (frequent[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))


def _count_cells(bits: int, lengths: Sequence[int], known: Sequence):
    """Cells of runs of some lengths and their counts; runs whose shorter beginning is rare are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = _Words(part)
                going = np.ones(len(words.word), bool)
                for length, run, fits in zip(range(1, max(lengths) + 1), words.hashes(), words.reaches()):
                    going &= fits
                    cells = _cells(run[going], bits)
                    if length in lengths:
                        held.append(cells)
                        size += len(cells)
                    else:
                        going[going] = _is_frequent(cells, known[length - 1].value)
                if size >= COUNTED:
                    yield from _packed(held)
                    held, size = [], 0
        yield from _packed(held)

    return count


def _packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of cells that occur, as places within the row and their counts."""
    places, n = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_counts=True)
    n = np.minimum(n, FULL).astype(np.uint8)
    rows = places >> ROW_BITS
    cuts = np.flatnonzero(np.diff(rows, prepend=-1, append=-1)) if len(rows) else np.empty(0, np.int64)
    within = places & ((1 << ROW_BITS) - 1)
    out = [(int(rows[a]), _steps(within[a:b]), n[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
    if out:
        kinds = (pa.int32(), pa.binary(), pa.binary())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["row", "places", "counts"])


def _steps(places: np.ndarray) -> bytes:
    """Ascending places as steps of one byte each, or of two where one is too long."""
    steps = np.diff(places, prepend=0)
    return (b"\1" if steps.max() < 256 else b"\2") + steps.astype("<u1" if steps.max() < 256 else "<u2").tobytes()


def _places(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64))


def _frequent_rows(least: int):
    """Sums of the tasks' counts, which come row by row, as bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, total = None, np.zeros(1 << ROW_BITS, np.int64)

        def bits() -> pa.RecordBatch:
            packed = zlib.compress(np.packbits(total >= min(least, FULL)).tobytes(), 1)
            return pa.record_batch([pa.array([row], pa.int32()), pa.array([packed], pa.binary())], ["row", "bits"])

        for batch in batches:
            for r, places, counts in zip(*(batch.column(c).to_pylist() for c in ("row", "places", "counts"))):
                if r != row:
                    if row is not None:
                        yield bits()
                    row, total[:] = r, 0
                total[_places(places)] += np.frombuffer(counts, np.uint8)
        if row is not None:
            yield bits()

    return add


def cell_bits(docs: DataFrame, text: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    return min(max((size // CELL_BYTES).bit_length(), CELL_BITS[0]), CELL_BITS[1])


def frequent_cells(
    docs: DataFrame, least: int, bits: int, lengths: Sequence[int], known: Sequence = (), text: str = "text", lang: str = "lang"
) -> np.ndarray:
    """A bit per cell: whether runs of some lengths in it occur ``least`` times together.

    ``known`` (broadcasts) has the bits of each shorter length: only runs that begin with frequent ones are counted.
    """
    counted = _texts(docs, text, lang).mapInArrow(_count_cells(bits, lengths, known), "row int, places binary, counts binary")
    rows = counted.repartition("row").sortWithinPartitions("row").mapInArrow(_frequent_rows(least), "row int, bits binary")
    size = 1 << ROW_BITS - 3
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in rows.collect():  # a bounded number of rows
        out[r["row"] * size : (r["row"] + 1) * size] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def phrase_edges(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``run`` and ``n``: edges of four words and shorter tails, joined by spaces; rare words count without a name."""
    context, bits = docs.sparkSession.sparkContext, cell_bits(docs, text)
    known = [context.broadcast(frequent_cells(docs, least, bits, (1, 2), (), text, lang))] * 2
    for length in range(3, LONGEST + 1):
        known.append(context.broadcast(frequent_cells(docs, least, bits, (length,), tuple(known), text, lang)))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = _Words(part)
                if len(words.word):
                    yield _edges_of(words, bits, [b.value for b in known])

    found = _texts(docs, text, lang).mapInArrow(edges, "lang string, run string, n long")
    return found.groupBy("lang", "run").agg(F.sum("n").alias("n"))


def _edges_of(words: _Words, bits: int, frequent: Sequence[np.ndarray]) -> pa.RecordBatch:
    """Every word's run of up to ``LONGEST`` words, as far as its beginnings of known lengths are frequent."""
    going, size = np.ones(len(words.word), bool), np.zeros(len(words.word), np.int64)
    for length, (run, fits) in enumerate(zip(words.hashes(), words.reaches())):
        if length == LONGEST:
            break
        going &= fits
        if length < len(frequent):
            going[going] = _is_frequent(_cells(run[going], bits), frequent[length])
        size += going
    # Runs of at most one word first: most of all rows.
    n_names = len(words.names)
    name = np.where(size == 0, n_names, words.word)
    single = np.bincount((words.lang * (n_names + 1) + name)[size < 2], minlength=1)
    one = np.flatnonzero(single)
    columns = [[one // (n_names + 1)], [one % (n_names + 1)], *([np.full(len(one), -1)] for _ in WORDS[1:]), [single[one]]]
    columns[1][0][columns[1][0] == n_names] = -1
    at = np.flatnonzero(size > 1)
    if len(at):
        padded = np.append(words.word, np.zeros(LONGEST, np.int64))
        runs = [np.where(size[at] > i, padded[at + i], -1) for i in range(LONGEST)]
        keys = {"lang": words.lang[at], **dict(zip(WORDS, runs))}
        grouped = pa.table({k: pa.array(v.astype(np.int32)) for k, v in keys.items()}).group_by(list(keys)).aggregate([([], "count_all")])
        for column, name in zip(columns, [*keys, "count_all"]):
            column.append(grouped.column(name).to_numpy())
    lang, *runs, n = (np.concatenate(c) for c in columns)
    names = [*(name.decode() for name in words.names.to_pylist()), None]  # the last one stands for -1
    run = pa.array(names, pa.string()).take(pa.array(np.where(runs[0] < 0, len(names) - 1, runs[0])))
    longer = np.flatnonzero(runs[1] >= 0)
    if len(longer):  # they stand behind the single words
        joined = [" ".join([names[i] for i in numbers if i >= 0]) for numbers in zip(*(r[longer].tolist() for r in runs))]
        run = pa.concat_arrays([run[: len(run) - len(longer)], pa.array(joined, pa.string())])
    return pa.record_batch([words.langs.take(pa.array(lang)), run, pa.array(n, pa.int64())], ["lang", "run", "n"])


def _parted(runs: DataFrame, length: int) -> DataFrame:
    """Runs of a length with a column per word."""
    part = F.split("run", " ")
    return runs.select("lang", *[part[i].alias(w) for i, w in enumerate(WORDS[:length])], "n")


def unary_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (``v1`` to ``v3``) that one edge enters, from ``before``, and one edge leaves, to ``after``, all of one weight."""
    node = ["lang", "v1", "v2", "v3"]
    named = lambda first: [F.col("lang"), *[F.col(f"w{i + first}").alias(f"v{i + 1}") for i in range(3)]]
    entering = edges.select(*named(1 + 1), F.col("w1").alias("before"), "n").groupBy(*node)
    leaving = edges.select(*named(1), F.col("w4").alias("after"), "n").groupBy(*node)
    entered = entering.agg(F.count("n").alias("ins"), F.max("before").alias("before"), F.max("n").alias("in_n"))
    left = leaving.agg(F.count("n").alias("outs"), F.max("after").alias("after"), F.max("n").alias("out_n"))
    flows = nodes.select(*named(1), F.col("n").alias("flow"))
    whole = entered.where("ins = 1").join(left.where("outs = 1"), node).join(flows, node)
    return whole.where("in_n = out_n AND in_n = flow").select(*node, "before", "after")


def compact_paths(edges: DataFrame, unary: DataFrame) -> DataFrame:
    """``lang``, ``words`` and ``n``: edges joined over unary nodes, up to ``PATH_EDGES`` of them to a row.

    Every edge looks for the first edge of its path by doubling: each round it takes over what the
    edge it has reached knows, so the number of rounds grows with the logarithm of the path's
    length. An edge on a cycle has no first one and stays alone.
    """
    key = ["lang", *WORDS]
    numbered = stage(edges.withColumn("e", F.monotonically_increasing_id()), "edges")
    over = unary.select(
        "lang",
        *[F.col(c).alias(w) for c, w in zip(("v1", "v2", "v3", "after"), WORDS)],
        *[F.col(c).alias(f"p{i + 1}") for i, c in enumerate(("before", "v1", "v2", "v3"))],
    )
    known = numbered.select(*key, "e").join(over, key, "left")
    before = numbered.select("lang", *[F.col(w).alias(f"p{i + 1}") for i, w in enumerate(WORDS)], F.col("e").alias("p"))
    linked = known.join(before, ["lang", *[f"p{i + 1}" for i in range(LONGEST)]], "left")
    steps = stage(
        linked.select(
            "e",
            F.coalesce("p", "e").alias("at"),
            F.col("p").isNotNull().cast("long").alias("steps"),
            F.col("p").isNull().alias("done"),
        ),
        "steps",
    )
    open_, left = None, steps.where("NOT done").count()
    while left and left != open_:
        reached = steps.select(F.col("e").alias("at"), F.col("at").alias("further"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        moved = steps.where("NOT done").join(reached, "at").select(
            "e", F.col("further").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done")
        )
        steps = stage(steps.where("done").unionByName(moved), "steps")
        open_, left = left, steps.where("NOT done").count()
    placed = steps.select(
        "e", F.when(F.col("done"), F.col("at")).otherwise(F.col("e")).alias("head"), F.when(F.col("done"), F.col("steps")).otherwise(0).alias("place")
    )
    row = F.floor(F.col("place") / PATH_EDGES).alias("row")
    parts = numbered.join(placed, "e").groupBy("lang", "head", row).agg(
        F.sort_array(F.collect_list(F.struct("place", *WORDS))).alias("run"), F.max("n").alias("n")
    )
    first = F.array(*[F.col("run")[0][w] for w in WORDS[:-1]])
    return parts.select("lang", F.concat(first, F.col("run")[WORDS[-1]]).alias("words"), "n")


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def phrase_counts(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs that occur ``least`` times (``lang``, ``words``, ``a``, ``inner``), words per language, and the compacted paths.

    ``inner`` marks runs of three words inside a unary path.
    """
    edges = stage(phrase_edges(docs, least, text, lang).withColumn("k", F.size(F.split("run", " "))), "phrase-edges")
    # Flows: what leaves a node, tails included, from the longest runs down.
    flows, longer = [], edges.where(F.col("k") == LONGEST).select("lang", "run", "n")
    for k in range(LONGEST - 1, 0, -1):
        leaving = longer.select("lang", F.substring_index("run", " ", k).alias("run"), "n")
        longer = leaving.union(edges.where(F.col("k") == k).select("lang", "run", "n")).groupBy("lang", "run").agg(F.sum("n").alias("n"))
        flows.append(longer.where(F.col("n") >= least).withColumn("k", F.lit(k)))
    shorter = stage(reduce(DataFrame.union, flows), "phrase-nodes")
    # Every word begins one edge or tail, or is counted without its name.
    totals = edges.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = _parted(edges.where((F.col("k") == LONGEST) & (F.col("n") >= least)), LONGEST)
    unary = stage(unary_nodes(frequent, _parted(shorter.where(f"k = {LONGEST - 1}"), LONGEST - 1)), "unary-nodes")
    paths = stage(compact_paths(frequent, unary), "phrase-paths")
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - (LONGEST - 1)))
    longest = paths.select("lang", "words", "n", starts.alias("at")).select(
        "lang", F.expr(f"slice(words, at, {LONGEST})").alias("words"), F.col("n").alias("a"), F.lit(False).alias("inner")
    )
    inside = unary.select("lang", F.array("v1", "v2", "v3").alias("words"), F.lit(True).alias("inner"))
    rest = shorter.select("lang", F.split("run", " ").alias("words"), F.col("n").alias("a"))
    rest = rest.join(inside, ["lang", "words"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    return stage(longest.unionByName(rest), "phrase-counts"), totals, paths


def collocations(
    docs: DataFrame, *, least: int = 30, first: int = 2000, cover: int = 80, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Each language's ``first`` phrases of two to four words by how firmly their words hold together.

    A phrase occurs ``a`` >= ``least`` times within pieces of text between ``.,;:!?`` and line
    breaks; cut in two anywhere it scores 2,000,000 a / (l + r), rounded down, with the counts of
    its two parts, and the lowest cut counts (the earliest among equals). A phrase goes if a
    longer candidate holds it and occurs at least ``cover`` percent as often. ``n`` counts the
    language's words. Ties go to the more frequent phrase, then by code points.

    Letters A to Z are lowered. A missing text has no words, a missing language is ``und``, rows
    need no id, repeated rows count again, other columns are not read, an empty table gives no rows. A
    text longer than ``SLICE`` is handled by itself, with about 60 bytes of memory a byte.
    """
    counts, totals, _ = phrase_counts(docs, least, text, lang)
    named = counts.withColumns({"phrase": _phrase(F.col("words")), "k": F.size("words")})
    candidates = named.where("k > 1")
    # A run inside a unary path lies in an edge that occurs as often.
    judged = candidates.where("NOT inner") if cover <= 100 else candidates
    parts = judged.select("lang", "phrase", "words", "a", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "lang", "phrase", "a", "cut",
        _phrase(F.expr("slice(words, 1, cut)")).alias("head"),
        _phrase(F.expr("slice(words, cut + 1, k - cut)")).alias("rest"),
    )
    sizes = named.select("lang", F.col("phrase").alias("part"), F.col("a").alias("size"))
    cuts = (
        parts.join(sizes.select("lang", F.col("part").alias("head"), F.col("size").alias("l")), ["lang", "head"])
        .join(sizes.select("lang", F.col("part").alias("rest"), F.col("size").alias("r")), ["lang", "rest"])
    )
    # Whole numbers of up to 27 digits; ``div`` rounds down.
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    cuts = cuts.withColumn("score", score)
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    longer = candidates.where("k > 2").select("lang", "words", "a", "k", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    longer = longer.select("lang", "words", "a", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("at"))
    within = longer.groupBy("lang", _phrase(F.expr("slice(words, at, size)")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = lowest.join(within, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * cover)
    )
    best = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score").withColumn("rank", best).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
