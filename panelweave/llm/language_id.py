"""Language of a text by unigrams of vocabulary pieces, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from panelweave.llm import texts, windows

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bound of the training sample: about so many labelled rows of each language.
SAMPLE_ROWS = 200
#: Longest piece in bytes, and bytes of a word that are scored together (a longer word is cut).
LONGEST, CUT = 8, 32
ROUNDS = 3
#: Share of each language's mass that goes to the pieces of all languages together, and to any piece.
POOLED, FLAT = 1e-3, 1e-4
UNKNOWN = "und"
#: Bytes of text whose words are scored together.
BATCH = 1 << 20
#: Bytes after which a batch of rows on its way to Python ends, and the session's setting for that.
ROWS_BATCH, ROWS_SETTING = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Letter pieces of a public vocabulary in lower case; a piece that begins a word begins with a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).lower().replace("▁", " ")
            body = piece.removeprefix(" ")
            if body == "" or body.isalpha():
                pieces.add(piece.encode())
    return sorted(p for p in pieces if 0 < len(p) <= LONGEST)


@dataclass(frozen=True)
class Pieces:
    """Hashes of the vocabulary in order, and a table of bits that most other strings miss."""

    hashes: np.ndarray
    order: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(vocabulary: list[bytes]) -> Pieces:
        hashes = np.array([_hash(np.frombuffer(p, np.uint8)) for p in vocabulary], np.uint64)
        order = np.argsort(hashes)
        table = np.zeros(1 << 20, bool)
        table[hashes >> np.uint64(44)] = True
        return Pieces(hashes[order], order, table)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose hash is a piece's, and the pieces."""
        rows = np.flatnonzero(self.table[hashes >> np.uint64(44)])
        hit, at = texts.found(hashes[rows], self.hashes)
        return rows[hit], self.order[at[hit]]


def _hash(data: np.ndarray) -> np.uint64:
    total = np.zeros(1, np.uint64)
    for symbol in windows.byte_symbols(data):
        total = total * _BASE + symbol
    return windows.mix(total)[0]


_BASE = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """All places of all pieces in a list of words, by the byte where they end and their length.

    Words are sorted by length, longest first, so the words that reach a byte are the first ones.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> None:
        self.order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[self.order], sizes[self.order] + 1  # a space goes before each word
        self.reach = [len(sizes)]
        prefix = [np.zeros(len(sizes), np.uint64)]
        self.spots: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        powers = windows.powers(LONGEST + 1)
        for end in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            n = int(np.searchsorted(-sizes, -end, side="right"))
            self.reach.append(n)
            symbol = windows.byte_symbols(np.full(n, 32, np.uint8) if end == 1 else data[starts[:n] + end - 2])
            prefix.append(prefix[-1][:n] * _BASE + symbol)
            for size in range(1, min(end, LONGEST) + 1):
                part = prefix[end] - prefix[end - size][:n] * powers[size]
                rows, piece = pieces.find(windows.mix(part))
                if len(rows):
                    self.spots.append((end, size, rows, piece))
            if end > LONGEST:
                prefix[end - LONGEST] = prefix[0][:0]

    def forward(self, chances: np.ndarray) -> list[np.ndarray]:
        """For every byte and word the chance of the word up to there, over all segmentations."""
        out = [np.zeros((n, chances.shape[1])) for n in self.reach]
        out[0][:] = 1.0
        for end, size, rows, piece in self.spots:
            out[end][rows] += out[end - size][rows] * chances[piece]
        return out

    def totals(self, forward: list[np.ndarray]) -> np.ndarray:
        """Chance of every whole word, in the order in which the words were given."""
        out = np.empty((len(self.order), forward[0].shape[1]))
        for end in range(len(self.reach)):
            low = self.reach[end + 1] if end + 1 < len(self.reach) else 0
            out[self.order[low : self.reach[end]]] = forward[end][low:]
        return out

    def expected(self, chances: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations of the weighted words."""
        forward = self.forward(chances)
        totals = self.totals(forward)[self.order]
        scale = np.divide(weights[self.order], totals, out=np.zeros_like(totals), where=totals > 0)
        backward = [np.zeros((n, chances.shape[1])) for n in self.reach]
        for end in range(len(self.reach)):
            low = self.reach[end + 1] if end + 1 < len(self.reach) else 0
            backward[end][low:] = scale[low : self.reach[end]]
        used = np.zeros_like(chances)
        for end, size, rows, piece in reversed(self.spots):
            after = backward[end][rows] * chances[piece]
            backward[end - size][rows] += after
            share = forward[end - size][rows] * after
            for k in range(chances.shape[1]):
                used[:, k] += np.bincount(piece, share[:, k], minlength=len(chances))
        return used


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of the texts, and start, size and text of every word; long words in parts."""
    data = windows.lowered(data)
    inside = np.concatenate((~windows.NO_LETTER[data], [False]))
    head = np.zeros(len(data) + 1, bool)
    head[bounds] = True
    begins = inside[:-1] & (head[:-1] | ~np.concatenate(([False], inside[:-2])))
    stops = inside[:-1] & (head[1:] | ~inside[1:])
    starts, sizes = np.flatnonzero(begins), np.flatnonzero(stops) + 1 - np.flatnonzero(begins)
    parts = -(-sizes // CUT)
    offset = texts.ranges(np.zeros(len(parts), np.int64), parts) * CUT
    starts = np.repeat(starts, parts) + offset
    sizes = np.minimum(CUT, np.repeat(sizes, parts) - offset)
    return data, starts, sizes, np.searchsorted(bounds, starts, side="right") - 1


def _distinct(data, starts, sizes) -> tuple[np.ndarray, np.ndarray]:
    """First of each different word, and for every word which of them it is."""
    if len(starts) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = texts.ranges(starts, sizes)
    within = texts.ranges(np.zeros(len(sizes), np.int64), sizes)
    values = windows.byte_symbols(data[at]) * windows.powers(CUT)[within]
    hashes = windows.mix(np.add.reduceat(values, np.cumsum(sizes) - sizes))
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    return first, which


@dataclass(frozen=True)
class Model:
    languages: list[str]
    pieces: Pieces
    chances: np.ndarray
    #: Mean log chance of a sign in words of each language that the chances were not learned from.
    usual: np.ndarray

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log chance of every text in every language, and the signs that it was given for."""
        data, starts, sizes, text = words_of(data, bounds)
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        signs = np.bincount(text, _signs(data, starts, sizes), minlength=len(out))
        first, which = _distinct(data, starts, sizes)
        if len(first):
            lattice = Lattice(data, starts[first], sizes[first], self.pieces)
            logs = np.log(np.maximum(lattice.totals(lattice.forward(self.chances)), 1e-300))
            for k in range(out.shape[1]):
                out[:, k] = np.bincount(text, logs[which, k], minlength=len(out))
        return out, signs


def _signs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Characters of every word, and one for the space before it."""
    ends = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return ends[starts + sizes] - ends[starts] + 1.0


def fit(counts: pa.Table, pieces: Pieces, size: int) -> Model:
    """Piece chances of each language by expectation and maximisation over its counted words.

    What a sign usually costs is measured across two halves of the texts, each with the chances of
    the other; copies are in one half. So few or equal texts make nothing look strange.
    """
    languages = sorted(set(counts["lang"].to_pylist()))
    words = counts["word"].combine_chunks().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    data, bounds = texts.text_bytes(pa.chunked_array([words.dictionary]))
    weights = np.zeros((2, len(words.dictionary), len(languages)))
    lang = np.array([languages.index(x) for x in counts["lang"].to_pylist()], np.int64)
    np.add.at(weights, (texts.numbers(counts["half"]), words.indices.to_numpy(), lang), texts.numbers(counts["n"], float))
    if not weights.size:
        return Model(languages, pieces, np.full((size, len(languages)), 1.0 / size), np.full(len(languages), -1.0))
    lattice = Lattice(data, bounds[:-1], np.diff(bounds), pieces)
    signs, total, cost = _signs(data, bounds[:-1], np.diff(bounds)), 0.0, 0.0
    for half in (0, 1):
        logs = np.log(np.maximum(lattice.totals(lattice.forward(_learned(lattice, weights[half], size))), 1e-300))
        cost = cost + (weights[1 - half] * logs).sum(axis=0)
        total = total + (weights[1 - half] * signs[:, None]).sum(axis=0)
    return Model(languages, pieces, _learned(lattice, weights.sum(axis=0), size), cost / np.maximum(total, 1e-300))


def _learned(lattice: Lattice, weights: np.ndarray, size: int) -> np.ndarray:
    chances = np.full((size, weights.shape[1]), 1.0 / size)
    for _ in range(ROUNDS):
        used = lattice.expected(chances, weights)
        own = used / np.maximum(used.sum(axis=0), 1e-300)
        pooled = own.mean(axis=1, keepdims=True)
        chances = (1 - POOLED - FLAT) * own + POOLED * pooled + FLAT / size
    return chances


def held_out(doc: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = texts.text_bytes(pa.chunked_array([batch["text"]]))
        for i in range(batch.num_rows):
            raw, starts, sizes, _ = words_of(data[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]))
            first, which = _distinct(raw, starts, sizes)
            words = [raw[a : a + n].tobytes() for a, n in zip(starts[first].tolist(), sizes[first].tolist())]
            lang = pa.array([batch["lang"][i].as_py()] * len(words), pa.string())
            half = pa.array([batch["half"][i].as_py()] * len(words), pa.int32())
            count = pa.array(np.bincount(which, minlength=len(words)), pa.int64())
            yield pa.RecordBatch.from_arrays([lang, half, pa.array(words, pa.binary()), count], ["lang", "half", "word", "n"])


def train(labelled: DataFrame, path: str = VOCABULARY, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from columns ``key`` (picks the sample), ``text`` and ``lang``; rows without either are left out.

    About ``sample_rows`` rows of each language are used, those with the smallest hashes of the
    key. Their words are counted by Spark; distinct words and counts are what reaches the driver.
    """
    known = labelled.where("text is not null and lang is not null")
    # A model has a column for each language, so a count of each language is no more than it is.
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.lit(0.0)
    if sizes:
        rates = [F.lit(x) for name, n in sizes.items() for x in (name, (1.5 * sample_rows + 10) / n)]
        rate = F.element_at(F.create_map(*rates), F.col("lang"))
    likely = known.where(chance < rate)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))
    sample = likely.withColumn("_nth", nth).where(F.col("_nth") <= sample_rows).select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))
    counts = (
        sample.mapInArrow(_count_words, "lang string, half int, word binary, n long")
        .groupBy("lang", "half", "word")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    listed = vocabulary(path)
    return fit(counts.sort_by([("lang", "ascending"), ("half", "ascending"), ("word", "ascending")]), Pieces.of(listed), len(listed))


def _predict(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts.text_bytes(pa.chunked_array([batch["_text"]]))
            scores, signs = [np.zeros((0, len(model.languages)))], [np.zeros(0)]
            for low, high in windows.batches(np.diff(bounds), BATCH):
                begin, end = bounds[low], bounds[high]
                for out, found in zip((scores, signs), model.scores(data[begin:end], bounds[low : high + 1] - begin)):
                    out.append(found)
            logs, size = np.concatenate(scores), np.concatenate(signs)
            letters = texts.numbers(pa.chunked_array([batch["_letters"]]), bool) & bool(model.languages)
            best = logs.argmax(axis=1) if model.languages else np.zeros(len(logs), np.int64)
            if model.languages:
                shares = np.exp(logs - logs.max(axis=1, keepdims=True))
                score = shares.max(axis=1) / shares.sum(axis=1)
                strange = logs.max(axis=1) / np.maximum(size, 1) / model.usual[best]
            else:
                score = strange = np.zeros(len(logs))
            names = [model.languages[k] if known else UNKNOWN for k, known in zip(best.tolist(), letters.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_doc"],
                    pa.array(names, pa.string()),
                    pa.array(np.where(letters, score, 0.0)),
                    pa.array(strange, pa.float64(), mask=~(letters & (size > 0))),
                ],
                ["_doc", "lang_pred", "score", "strangeness"],
            )

    return predict


def _bound_batches(spark: SparkSession) -> None:
    """End batches by bytes where the session names no bound of its own; results are the same.

    Spark's 10,000 rows or 64 MB of texts lie in Python, in Arrow's buffers and, for the results, in both again.
    """
    if spark.conf.get(ROWS_SETTING, None) is None:
        spark.conf.set(ROWS_SETTING, ROWS_BATCH)


def language_id(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    doc: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    path: str = VOCABULARY,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``lang_pred``, ``score``, the chance of that language among all, ``strangeness``.

    ``labelled`` (by default ``docs`` without the held-out rows) gives the training texts. Of every
    text all words count, as lower-case letter runs; each word's chance in a language is the sum
    over all its segmentations into vocabulary pieces. Languages are equally likely beforehand.

    The score compares the learned languages only. ``strangeness`` tells how well the best one
    fits at all: the mean log chance of the text's signs, as a multiple of what it is in labelled
    texts of that language that were not learned from. It is about 1 for texts like those, 2 to 3 for other texts of
    the language or close relatives, more for other languages, scripts and letter junk; it does not
    grow with the length. A text without words has none.

    A text that is missing or has no letter is ``und`` with score 0, and so is every text if
    nothing is labelled. Equal chances go to the first language by name. Missing ids are kept,
    repeated rows are judged each; other columns are ignored; an empty table gives an empty result.
    """
    if labelled is None:
        labelled = docs.where(~held_out(F.col(doc)))
    _bound_batches(docs.sparkSession)
    model = train(
        labelled.select(F.col(doc).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")), path, sample_rows
    )
    picked = docs.select(
        F.col(doc).alias("_doc"),
        F.col(text).alias("_text"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"),
    )
    kinds = StructType(
        [
            StructField("_doc", picked.schema["_doc"].dataType),
            StructField("lang_pred", StringType()),
            StructField("score", DoubleType()),
            StructField("strangeness", DoubleType()),
        ]
    )
    return picked.mapInArrow(_predict(model), kinds).withColumnRenamed("_doc", doc)
