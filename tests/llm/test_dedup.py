import hashlib
import random

import numpy as np
import pytest

from panelweave.llm import repeats
from panelweave.llm.grouping_sort import suffix_array
from panelweave.llm.rlz_dedup import rlz_dedup
from panelweave.llm.suffix_dedup import suffix_dedup


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(1)
    for _ in range(400):
        text = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))
        listed = text.tolist()
        assert suffix_array(text).tolist() == sorted(range(len(listed)), key=lambda i: listed[i:])


def brute(rows, words, window):
    """By all windows of all texts; within one document only words repeat."""
    rows = [(repeats.LAST if d is None else d, (t or "").encode()) for d, t in rows]
    rows = [(d, t.split() if words else t) for d, t in rows]
    place = lambda d, i: (d, i) if words else (d, 0)
    first = {}
    for d, s in rows:
        for i in range(len(s) - window + 1):
            w = tuple(s[i : i + window])
            first[w] = min(first.get(w, place(d, i)), place(d, i))
    out = []
    for d, s in rows:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if first[tuple(s[i : i + window])] < place(d, i):
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(s, gone) if not g]
        kept = b" ".join(kept) if words else bytes(kept)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((None if d == repeats.LAST else d, len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    random.seed(3)
    base = [random.choice(["a", "bb", "ccc", "d"]) for _ in range(300)]
    rows = []
    for i in range(120):
        at = random.randrange(200)
        text = " ".join(base[at : at + random.randrange(90)])
        if random.random() < 0.5:
            text = " ".join(random.choice("ab") for _ in range(random.randrange(60))) + " " + text
        if random.random() < 0.1:
            text = "a " * random.randrange(100)
        rows.append((random.choice([None, i, i, i, i - 1]), None if random.random() < 0.05 else text))
    long = " ".join(random.choice(["x", "yy", "z"]) for _ in range(30_000))
    return [*rows, (500, "é" * 70), (501, "xé" * 70 + "é" * 40), (9, ""), (700, long), (701, long[:5000] + "!" + long[5000:])]


@pytest.mark.parametrize("hot", [5, 4096])
def test_removed_windows_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n int")
    for operator, words, window in ((rlz_dedup, True, 20), (suffix_dedup, False, 50)):
        got = [tuple(r)[:5] for r in operator(docs).collect()]
        assert sorted(got, key=str) == brute(rows, words, window)


def test_kept_text_and_spans(spark):
    rows = [(1, " ".join(map(str, range(40)))), (2, "new " + " ".join(map(str, range(30))) + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    second = rlz_dedup(docs, keep_text=True).where("doc_id = 2").first()
    assert (second["kept"], second["span_starts"], second["span_ends"]) == ("new end", [1], [31])
    assert rlz_dedup(docs.limit(0)).count() == 0 == suffix_dedup(docs.limit(0)).count()
