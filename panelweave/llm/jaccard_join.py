"""Near-duplicate documents: exact Jaccard links of word shingles, found by T-occurrence search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm import repeats, texts, windows
from panelweave.llm.components import components
from panelweave.llm.occurrence_search import OverlapIndex
from panelweave.sources import stage

SHINGLE = 5
#: Least similarity in percent.
PERCENT = 75
#: Share of a set's tokens beyond the plain prefix that the first filter looks at; it then asks
#: for as many shared ones.
EXTRA = 0.1
#: Documents of a group that one task compares; larger groups are split.
GROUP = 4000
#: Tokens of all groups in one bucket, on average.
BUCKET_TOKENS = 1 << 19


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Overlap without which a set of this size cannot reach the similarity with any other."""
    return -(-percent * size // 100)


def shingle_sets(chunk: repeats.Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text in ascending order, and the bounds of the sets."""
    sets, sizes = [], []
    for low, high in windows.batches(np.diff(chunk.bounds)):
        begin, end = int(chunk.bounds[low]), int(chunk.bounds[high])
        bounds = chunk.bounds[low : high + 1] - begin
        symbols, starts = windows.word_symbols(windows.ASCII_LOWER[chunk.data[begin:end]], bounds)
        bounds = np.searchsorted(starts, bounds)
        words = np.diff(bounds)
        doc = [np.repeat(np.arange(high - low), np.maximum(words - shingle + 1, 0))]
        first = texts.ranges(bounds[:-1], np.maximum(words - shingle + 1, 0))
        token = [windows.gram_hashes(symbols, shingle)[first]]
        for few in range(1, shingle):  # a text with fewer words is one shingle
            small = np.flatnonzero(words == few)
            if len(small):
                doc.append(small)
                token.append(windows.gram_hashes(symbols, few)[bounds[small]])
        doc, token = np.concatenate(doc), np.concatenate(token)
        order = np.lexsort((token, doc))
        doc, token = doc[order], token[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
        sets.append(token[new])
        sizes.append(np.bincount(doc[new], minlength=high - low))
    if not sets:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(sets), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def _spread(tokens: np.ndarray) -> np.ndarray:
    """Tokens in prefixes are the smallest hashes; mixed again they fall evenly into buckets."""
    return windows.mix(tokens ^ np.uint64(0x9E3779B97F4A7C15))


def _print_rows(keys: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    keys = np.sort(keys)
    bucket = repeats.bucket_of(keys, buckets).astype(np.int64)
    cuts = texts.runs(bucket)
    heads = bucket[cuts[:-1]]
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return pa.table({"bucket": heads, "chunk": np.full(len(heads), chunk, np.int64), "prints": texts.lists(low, cuts)})


def _prefix(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in the first filter's prefix of a set, and how many of them a partner must share."""
    least = needed(sizes, percent)
    extra = np.maximum(1, np.ceil(EXTRA * sizes)).astype(np.int64)
    share = np.maximum(1, np.ceil(EXTRA * least)).astype(np.int64)
    return np.minimum(sizes, sizes - least + extra), share


def _prefix_prints(shingle: int, percent: int, buckets: int):
    def prints(table: pa.Table) -> pa.Table:
        tokens, bounds = shingle_sets(repeats.read_chunk(table), shingle)
        length, _ = _prefix(np.diff(bounds), percent)
        keys = _spread(tokens[texts.ranges(bounds[:-1], length)])
        return _print_rows(keys, table["chunk"][0].as_py(), buckets)

    return prints


_SETS = "chunk long, h1 long, h2 long, first long, n long, tokens array<long>"
_PROBES = "first long, probes array<long>"
_COUNTS = "chunk long, codes array<long>, counts array<int>"


def _possible_sets(shingle: int, percent: int, buckets: int):
    """Sizes of all sets; the tokens of those whose prefix meets others often enough."""

    def sets(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = repeats.read_chunk(docs)
        tokens, bounds = shingle_sets(chunk, shingle)
        sizes = np.diff(bounds)
        length, share = _prefix(sizes, percent)
        codes = np.unique(texts.list_items(answers["codes"]).view(np.uint64))
        keys = _spread(tokens[texts.ranges(bounds[:-1], length)])
        shared, _ = texts.found(repeats.codes_of(keys, buckets), codes)
        own = np.repeat(np.arange(len(sizes)), length)
        hits = np.bincount(own[shared], minlength=len(sizes))
        possible = (hits >= share) & (sizes > 0) & (chunk.ids != repeats.LAST)
        kept = np.where(possible, sizes, 0)
        return pa.table(
            {
                "chunk": np.full(len(sizes), docs["chunk"][0].as_py() if docs.num_rows else 0, np.int64),
                "h1": chunk.hashes[0],
                "h2": chunk.hashes[1],
                "first": chunk.ids,
                "n": sizes,
                "tokens": texts.lists(
                    tokens[texts.ranges(bounds[:-1], kept)].view(np.int64), np.concatenate(([0], np.cumsum(kept)))
                ),
            }
        )

    return sets


def _token_prints(buckets: int):
    def prints(table: pa.Table) -> pa.Table:
        keys = _spread(texts.list_items(table["tokens"]).view(np.uint64))
        return _print_rows(keys, table["chunk"][0].as_py(), buckets)

    return prints


def _print_counts(table: pa.Table) -> pa.Table:
    """For each chunk its prints that more than one set holds, and how many sets hold them."""
    prints = texts.list_items(table["prints"], np.int32).view(np.uint32)
    row = np.repeat(np.arange(table.num_rows), texts.list_sizes(table["prints"]))
    order = np.lexsort((row, prints))
    ordered, row = prints[order], row[order]
    cuts = texts.runs(ordered)
    sets = np.repeat(np.diff(cuts), np.diff(cuts))
    new = np.ones(len(order), bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (row[1:] != row[:-1])
    kept = np.flatnonzero(new & (sets > 1))
    kept = kept[np.argsort(row[kept], kind="stable")]
    code = (np.uint64(table["bucket"][0].as_py()) << np.uint64(32)) | ordered[kept].astype(np.uint64)
    rows = np.concatenate(([0], np.cumsum(np.bincount(row[kept], minlength=table.num_rows))))
    return pa.table(
        {
            "chunk": texts.numbers(table["chunk"]),
            "codes": texts.lists(code.view(np.int64), rows),
            "counts": texts.lists(np.minimum(sets[kept], 2**31 - 1).astype(np.int32), rows),
        }
    ).filter(pa.array(np.diff(rows) > 0))


def _rare_probes(percent: int, buckets: int):
    """The shared tokens among each set's rarest ones, of which linked sets have one in common."""

    def probes(sets: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = texts.list_items(sets["tokens"]).view(np.uint64)
        sizes = texts.list_sizes(sets["tokens"])
        codes = texts.list_items(answers["codes"]).view(np.uint64)
        order = np.argsort(codes)
        hit, at = texts.found(repeats.codes_of(_spread(tokens), buckets), codes[order])
        counts = texts.list_items(answers["counts"])[order]
        count = np.ones(len(tokens), np.int64)
        count[hit] = counts[at[hit]]
        own = np.repeat(np.arange(len(sizes)), sizes)
        least = needed(sizes, percent)
        alive = np.bincount(own[count > 1], minlength=len(sizes)) >= least
        order = np.lexsort((tokens, count, own))
        rank = texts.ranges(np.zeros(len(sizes), np.int64), sizes)
        chosen = order[(rank < (sizes - least + 1)[own]) & alive[own]]
        chosen = chosen[count[chosen] > 1]
        n = np.bincount(own[chosen], minlength=len(sizes))
        rows = np.concatenate(([0], np.cumsum(n)))
        out = pa.table(
            {"first": texts.numbers(sets["first"]), "probes": texts.lists(tokens[chosen].view(np.int64), rows)}
        )
        return out.filter(pa.array(n > 0))

    return probes


_GROUPS = "bucket long, hub long, part long, doc long, asks boolean, tokens array<long>"
_LINKS = "hub long, part long, a long, b long"


class Part:
    """Sets that one task compares."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sets, self.percent = sets, percent
        self._fill(list(range(len(sets))))

    def _fill(self, numbers: list[int]) -> None:
        self.index, self.numbers = OverlapIndex([self.sets[i] for i in numbers]), numbers

    def ask(self, tokens: np.ndarray) -> list[int]:
        """Indexed sets that are similar enough."""
        size, percent = len(tokens), self.percent
        found = self.index.search(tokens, -(-percent * size // 100))
        return [
            self.numbers[i] for i, n in found if 100 * n >= percent * (size + self.index.sizes[i] - n)
        ]

    def connected(self) -> list[int]:
        """For each set the first one that links lead to.

        Whoever was reached asks for those that nobody reached so far. They get fewer all the
        time, and the lists are made anew without the others whenever half of them are gone.
        """
        root = [-1] * len(self.sets)
        free = len(root)
        for seed in range(len(root)):
            if root[seed] >= 0:
                continue
            root[seed], free, waiting = seed, free - 1, [seed]
            while waiting and free:
                for other in self.ask(self.sets[waiting.pop()]):
                    if root[other] < 0:
                        root[other], free = seed, free - 1
                        waiting.append(other)
                if 2 * free < len(self.numbers):
                    self._fill([i for i in self.numbers if root[i] < 0])
        return root


def _links(percent: int):
    """Links that connect the documents of each part of a group.

    Where a part gets no questions, its documents are connected among themselves, from the hub on;
    the ones that the hub does not reach come back with ``b`` null, for in a group of several
    parts they must ask the other parts. Those questions are answered by the whole part.
    """

    def links(table: pa.Table) -> pa.Table:
        hubs, parts, docs = (texts.numbers(table[c]) for c in ("hub", "part", "doc"))
        asks = texts.numbers(table["asks"], bool)
        bounds = np.concatenate(([0], np.cumsum(texts.list_sizes(table["tokens"]))))
        tokens = texts.list_items(table["tokens"])
        order = np.lexsort((docs, asks, parts, hubs))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(hubs[order]) != 0) | (np.diff(parts[order]) != 0)
        cuts = np.append(np.flatnonzero(new), len(order))
        out: list[tuple] = []
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows = order[low:high].tolist()
            hub, part = int(hubs[rows[0]]), int(parts[rows[0]])
            questions = [row for row in rows if asks[row]]
            members = [row for row in rows if not asks[row]]
            group = Part([tokens[bounds[row] : bounds[row + 1]] for row in members], percent)
            ids = [int(docs[row]) for row in members]
            for row in questions:
                out += [(hub, part, int(docs[row]), ids[i]) for i in group.ask(tokens[bounds[row] : bounds[row + 1]])]
            if not questions:
                for i, root in enumerate(group.connected()):
                    if root != i:
                        out.append((hub, part, ids[i], ids[root]))
                    if ids[root] != hub:
                        out.append((hub, part, ids[i], None))
        columns = list(zip(*out)) or [()] * 4
        return pa.table(dict(zip(("hub", "part", "a", "b"), (pa.array(c, pa.int64()) for c in columns))))

    return links


def jaccard_links(sets: DataFrame, probes: DataFrame, percent: int) -> DataFrame:
    """Edges that connect all documents whose sets are similar enough.

    Two such documents share a probe. All documents of a probe meet in the group of the smallest
    of them, its hub; a document with many probes shared by the same others goes there once.
    """
    pairs = probes.select("first", F.explode("probes").alias("token"))
    hubs = pairs.groupBy("token").agg(F.min("first").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1")
    routes = stage(
        pairs.join(hubs.select("token", "hub"), "token").select("hub", F.col("first").alias("doc")).distinct(), "routes"
    )
    sizes = routes.groupBy("hub").agg(F.count(F.lit(1)).alias("k"))
    parted = routes.join(sizes, "hub").select(
        "hub",
        "doc",
        F.ceil(F.col("k") / GROUP).cast("long").alias("parts"),
    )
    # The hub is in every part of its group.
    placed = parted.select(
        "hub",
        "doc",
        "parts",
        F.explode(
            F.when(F.col("doc") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(
                F.array(F.pmod(F.xxhash64("doc"), F.col("parts")))
            )
        ).alias("part"),
    )
    by_doc = sets.where(F.size("tokens") > 0).select(F.col("first").alias("doc"), "n", "tokens")
    total = placed.join(by_doc.select("doc", "n"), "doc").agg(F.sum("n")).first()[0] or 0
    members = placed.join(by_doc.drop("n"), "doc")
    buckets = 1 + total // BUCKET_TOKENS

    def bucketed(rows: DataFrame, asks: bool) -> DataFrame:
        bucket = F.pmod(F.xxhash64("hub", "part"), F.lit(buckets)).alias("bucket")
        return rows.select(bucket, "hub", "part", "doc", F.lit(asks).alias("asks"), "tokens")

    found = stage(bucketed(members, False).groupBy("bucket").applyInArrow(_links(percent), _LINKS), "links")
    edges = found.where("b is not null").select("a", "b")
    # Documents that a split group's hub does not reach ask the group's other parts.
    left = found.where("b is null").select("hub", F.col("part").alias("own"), F.col("a").alias("doc"))
    if placed.where("parts > 1").limit(1).count():
        split = members.where("parts > 1").join(left.select("hub").distinct(), "hub", "left_semi")
        asking = (
            left.join(split.select("hub", "part", "doc", "parts", "tokens").withColumnRenamed("part", "own"), ["hub", "own", "doc"])
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .where("part != own")
        )
        rows = bucketed(split, False).unionByName(bucketed(asking, True))
        across = rows.groupBy("bucket").applyInArrow(_links(percent), _LINKS)
        edges = edges.union(across.where("b is not null").select("a", "b"))
    return edges


def jaccard_join(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``docs``: ``n_shingles`` and ``component_id``.

    Words are lower-cased (A to Z only); a set holds the distinct runs of ``shingle`` words, or
    the whole text if it has fewer. Sets whose overlap is ``percent`` of their union or more are
    linked, and so are equal texts; ``component_id`` is the smallest id that links lead to.

    No link is lost: sets are dropped only if their tokens prove that they have no partner, and
    groups are split, not capped. Only documents that may have a partner have their sets moved.

    A text that is missing or has no word has no shingle and is linked with nothing. A row without
    an id is linked with nothing and has no component. Each row follows its own text; texts whose
    smallest id is the same count as linked. Other columns are ignored; an empty table gives an
    empty result.
    """
    base, distinct, buckets = repeats.chunked(docs, doc, text)
    by_chunk = distinct.groupBy("chunk")
    prints = by_chunk.applyInArrow(_prefix_prints(shingle, percent, buckets), "bucket long, chunk long, prints array<int>")
    answers = prints.groupBy("bucket").applyInArrow(
        repeats.repeated_prints(2**62), "chunk long, codes array<long>, hot array<long>"
    )
    sets = stage(
        by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_possible_sets(shingle, percent, buckets), _SETS), "sets"
    )
    possible = sets.where(F.size("tokens") > 0).select("chunk", "first", "tokens").groupBy("chunk")
    counts = (
        possible.applyInArrow(_token_prints(buckets), "bucket long, chunk long, prints array<int>")
        .groupBy("bucket")
        .applyInArrow(_print_counts, _COUNTS)
    )
    probes = possible.cogroup(counts.groupBy("chunk")).applyInArrow(_rare_probes(percent, buckets), _PROBES)
    roots = components(jaccard_links(sets, probes, percent)).withColumnRenamed("node", "first")
    told = sets.select("h1", "h2", "first", "n").join(roots, "first", "left")
    component = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.coalesce("root", "first"))
    return base.join(told, ["h1", "h2"]).select(
        F.col("doc").alias(doc),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), component).alias("component_id"),
    )
