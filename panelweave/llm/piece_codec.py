"""Encoding into the pieces of a merge-type (BPE) SentencePiece model, and decoding.

The merge procedure joins the adjacent symbols whose piece has the best score, leftmost on ties,
until none is left. Its result is found here without running it over the text: a sequence of
pieces is the merge procedure's result exactly if every two neighbours are, that is, if merging
their joint text anew gives the same two pieces. So a word is read from the left with the longest
pieces that fit behind their neighbour, shorter ones on failure, and positions from which no
reading goes on are marked in a bit field and never tried again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from panelweave.llm.texts import slices

SPACE = "▁"
INF = float("inf")
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Entries of each worker's tables of words and of pairs; a full table is emptied. Results never depend on it.
KEPT = 400_000


class _Table(dict):
    """A dictionary that computes what it lacks and holds ``KEPT`` entries at most."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        if len(self) >= KEPT:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class PieceCodec:
    """Encodes and decodes as the library does for BPE models without a character map."""

    def __init__(self, model: bytes):
        spec = proto.ModelProto.FromString(model)
        norm, kinds = spec.normalizer_spec, proto.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("not a merge-type model")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("models that rewrite their text are not supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces) or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined or unused pieces and spaces as suffixes are not supported")
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.pieces = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        # What each id decodes to. A byte's character is put together from its neighbours; a control
        # sign becomes no text, and is no character here so that it parts the bytes around it.
        self.surface = [
            bytes([int(p.piece[3:5], 16)])
            if p.type == kinds.BYTE
            else b"\xff"
            if p.type == kinds.CONTROL
            else (spec.trainer_spec.unk_surface if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ")).encode()
            for p in spec.pieces
        ]
        self.is_byte = [p.type == kinds.BYTE for p in spec.pieces]
        self.is_control = [p.type == kinds.CONTROL for p in spec.pieces]
        # A piece that its own text does not merge into never comes out.
        last = {p: self.merge(p, 2) for p in self.pieces if len(p) > 1}
        self.halves = {p: parts for p, parts in last.items() if len(parts) == 2 and self.merge(p) == [p]}
        reached = [p for p in self.pieces if len(p) == 1 or p in self.halves]
        # Whether better pieces are always merged before those made of them (runs of spaces aside).
        self.ordered = all(
            len(half) == 1 or self.scores[half] > self.scores[p]
            for p, parts in self.halves.items()
            if SPACE * 2 not in p
            for half in parts
        )
        self.automaton = ahocorasick.Automaton()
        for p in reached:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.automaton), None) for p in reached}
        # No merge crosses a place between two signs that no piece holds side by side. Where spaces only
        # lead pieces, and Latin letters never meet other signs in one, texts are cut there into words.
        sides = {(_kind(a), _kind(b)) for p in self.pieces for a, b in zip(p, p[1:])}
        if not sides & {("w", "o"), ("o", "w"), ("w", "s"), ("o", "s")}:
            words = f"{SPACE}*[{LATIN}]+|{SPACE}*[^{LATIN}{SPACE}]+|{SPACE}+"
        else:
            words = "(?s:.+)"
        self.words = re.compile(words).findall
        self.packed = _Table(lambda word: np.array(self.encode_word(word), "<u4").tobytes())
        self.fits = _Table(self.compatible)
        self.edges = _Table(lambda key: self._edge(key[1], key[0]))

    def merge(self, text: str, least: int = 1) -> list[str]:
        """The merge procedure itself, for the text of one piece or two, down to ``least`` parts."""
        parts = list(text)
        while len(parts) > least:
            best = max(
                ((self.scores[p], -i) for i, p in enumerate(map("".join, zip(parts, parts[1:]))) if p in self.scores),
                default=None,
            )
            if best is None:
                break
            at = -best[1]
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
        return parts

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The parts that end on one side of a piece, from the sign up, each with the score of what it is merged into."""
        steps, score = [], -INF
        while piece is not None:
            steps.append((piece, score))
            score, piece = self.scores.get(piece, -INF), self.halves[piece][side] if piece in self.halves else None
        return steps[::-1]

    def compatible(self, pair: tuple[str, str]) -> bool:
        """Whether the merge procedure leaves two neighbouring pieces as they are.

        Their inner merges are run again in order of their scores; the pair breaks if at any time
        the two parts at the border make a piece that would be merged first.
        """
        if not self.ordered or SPACE * 2 in pair[0] or SPACE * 2 in pair[1]:
            return self.merge("".join(pair)) == list(pair)
        lefts, rights = self.edges[1, pair[0]], self.edges[0, pair[1]]
        i = j = 0
        while True:
            (a, left), (b, right) = lefts[i], rights[j]
            joined = self.scores.get(a + b, -INF)
            if joined > left and joined >= right:
                return False
            if left == right == -INF:
                return True
            if left >= right:
                i += 1
            else:
                j += 1

    def encode_word(self, word: str) -> list[int]:
        if word in self.shorter:
            return [self.pieces[word]]
        longest: list[str | None] = [None] * len(word)
        for last, piece in self.automaton.iter(word):
            at = last + 1 - len(piece)
            if longest[at] is None or len(longest[at]) < len(piece):
                longest[at] = piece
        failed = bytearray(len(word) // 8 + 1)
        chosen: list[str] = []
        at, piece = 0, longest[0] or word[0]
        while at < len(word):
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not chosen or self.fits[chosen[-1], piece]):
                    break
                piece = self.shorter.get(piece)
            if piece is not None:
                chosen.append(piece)
                at = end
                # A sign that starts no piece merges with nothing and stands alone.
                piece = longest[at] or word[at] if at < len(word) else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = chosen.pop()  # the merge procedure's result is one of the readings, so there is one
                at -= len(last)
                piece = self.shorter.get(last)
        return [i for p in chosen for i in self.ids_of(p)]

    @staticmethod
    def mark(i: int) -> bytes:
        return int(i).to_bytes(4, "little")

    def ids_of(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        if known is not None:
            return [known]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        words = self.words(self.prefix + text.replace(" ", SPACE))
        return b"".join([self.packed[w] for w in words])

    def decode(self, ids: list[int]) -> bytes:
        """The text in UTF-8. Bytes that make no character become U+FFFD each, the prefixed space goes."""
        low, high = 0, len(ids)
        while low < high and self.is_control[ids[low]]:
            low += 1
        while low < high and self.is_control[ids[high - 1]]:
            high -= 1
        ids = ids[low:high]
        whole = b"".join([self.surface[i] for i in ids])
        try:
            whole.decode()
        except UnicodeDecodeError:  # bytes that make no character, or a control sign between others
            whole = "".join(
                "".join(_characters(b"".join(map(self.surface.__getitem__, run))))
                if byte
                else "".join(self.surface[i].decode() for i in run if not self.is_control[i])
                for byte, run in groupby(ids, self.is_byte.__getitem__)
            ).encode()
        if self.prefix and ids and not self.is_byte[ids[0]] and ids[0] != self.unknown:
            return whole.removeprefix(b" ")
        return whole


def _characters(data: bytes) -> Iterator[str]:
    at = 0
    while at < len(data):
        size = next((n for n in (1, 2, 3, 4) if _is_character(data[at : at + n])), 0)
        yield data[at : at + size].decode() if size else "\ufffd"
        at += size or 1


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def _kind(sign: str) -> str:
    return "s" if sign == SPACE else "w" if re.match(f"[{LATIN}]", sign) else "o"


@lru_cache(maxsize=4)
def _codec(model: bytes) -> PieceCodec:
    return PieceCodec(model)


def encode_pieces(docs: DataFrame, model: str, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``ids`` with begin and end, and ``decoded``, the text that they stand for, of every row.

    ``ids`` are packed as little-endian unsigned 32-bit integers, as training data is stored.
    ``model`` is the path of a SentencePiece BPE model; the driver reads it and tasks get its bytes
    (half a megabyte for 32,000 pieces). A missing text counts as empty: only begin and end. Rows
    are independent: repeated rows, ties, missing ids and other columns of any name do no harm,
    an empty table gives an empty one. A text of many megabytes is encoded word by word; a word
    of any length costs time in proportion to it. Memory per task is a batch of rows (a very long
    text and its ids at a time) and two tables of at most ``KEPT`` entries.
    """

    def encode(codec: PieceCodec, value: str | None) -> tuple:
        ids = codec.mark(codec.begin) + codec.encode(value or "") + codec.mark(codec.end)
        return ids, codec.decode(np.frombuffer(ids, "<u4").tolist()).decode()

    return _coded(docs, model, doc, text, "string", {"ids": "binary", "decoded": "string"}, encode)


def decode_pieces(docs: DataFrame, model: str, *, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc`` and ``decoded``, the text of packed ``ids``; missing ids give an empty text, unknown ones fail the job."""

    def decode(codec: PieceCodec, value: bytes | None) -> tuple:
        return (codec.decode(np.frombuffer(value or b"", "<u4").tolist()).decode(),)

    return _coded(docs, model, doc, ids, "binary", {"decoded": "string"}, decode)


def _coded(docs: DataFrame, model: str, doc: str, column: str, kind: str, out: dict[str, str], code) -> DataFrame:
    content = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    rows = docs.select(F.col(f"`{doc}`").alias("key"), F.col(f"`{column}`").cast(kind).alias("value"))
    types = [pa.binary() if k == "binary" else pa.string() for k in out.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in batches:
            for part in slices(batch, "value"):
                coded = [code(codec, value.as_py()) for value in part.column("value")]
                columns = [pa.array([row[i] for row in coded], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column("key"), *columns], names=["key", *out])

    key = rows.schema["key"].dataType.simpleString()
    schema = ", ".join([f"key {key}", *(f"{name} {k}" for name, k in out.items())])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", doc)
