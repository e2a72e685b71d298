import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from panelweave.llm.piece_codec import PieceCodec, decode_pieces, encode_pieces
from panelweave.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return PieceCodec(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def check(codec, library, text):
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == library.encode(text), text
    assert codec.decode([1, *ids, 2]).decode() == library.decode([1, *ids, 2])


def test_encodes_like_the_library(codec, library):
    random.seed(3)
    pieces = list(codec.pieces)
    signs = ["ab", "the in of ", "aeiou  ▁t\n", "é ß ü\tçаб中文字\u0000😀²", "01 .,-", "  ", "Ωx.́ "]
    for _ in range(4000):
        check(codec, library, "".join(random.choices(random.choice(signs), k=random.randint(0, 50))))
        check(codec, library, "".join(random.choices(pieces, k=random.randint(0, 6))).replace("▁", " "))


def test_reads_back_when_the_longest_piece_fails(codec, library):
    # Greedy longest pieces alone are wrong on most of these words.
    greedy = 0
    for word in ["inthe", "reattion", "whenening", "theinging", "ofthereon", "stherein", "ationer"] * 2:
        check(codec, library, word * 3)
        greedy += codec.merge(word)[0] != max((p for p in codec.shorter if word.startswith(p)), key=len)
    assert greedy > 0


def test_neighbours_are_judged_by_merging_again(codec):
    random.seed(4)
    pieces = [p for p in codec.shorter if p.isascii() and p.isalpha()]
    assert codec.ordered
    for _ in range(5000):
        pair = (random.choice(pieces), random.choice(pieces))
        assert codec.compatible(pair) == (codec.merge("".join(pair)) == list(pair))


def test_very_long_words(codec, library):
    for text in ("a" * 30000, "ab" * 20000, " " * 30000, "中" * 20000, "ß😀" * 5000):
        check(codec, library, text)


def test_any_ids_decode_like_the_library(codec, library):
    random.seed(5)
    for _ in range(2000):
        ids = [random.randrange(260 if random.random() < 0.5 else 32000) for _ in range(random.randint(0, 12))]
        assert codec.decode(ids).decode() == library.decode(ids), ids


def test_odd_rows(spark, library):
    rows = [(1, None, "x"), (None, "", "x"), (2, "a b", None), (2, "a b", None), (3, " lead\n\ttabs ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_pieces(docs, MODEL)
    got = sorted((str(r.doc_id), list(np.frombuffer(r.ids, "<u4")), r.decoded) for r in out.collect())
    want = sorted((str(i), library.encode(t or "", add_bos=True, add_eos=True), t or "") for i, t, _ in rows)
    assert got == want
    assert sorted(map(str, decode_pieces(out, MODEL).collect())) == sorted(map(str, out.drop("ids").collect()))
    assert encode_pieces(docs.limit(0), MODEL).count() == 0


def test_query_equals_the_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op12_piece_codec"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
