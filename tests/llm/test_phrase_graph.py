import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelweave.llm import phrase_graph
from panelweave.llm.phrase_graph import cell_bits, collocations, compact_paths, frequent_cells, phrase_counts, phrase_edges, unary_nodes

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs_of(rows):
    runs = defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3, 4):
                for i in range(len(words) - k + 1):
                    runs[lang if lang is not None else "und"][tuple(words[i : i + k])] += 1
    return runs


def brute(rows, least, first, cover):
    out = []
    for lang, runs in runs_of(rows).items():
        n = sum(a for p, a in runs.items() if len(p) == 1)
        candidates = {p: a for p, a in runs.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            cuts = [(2000000 * a // (runs[p[:k]] + runs[p[k:]]), k, runs[p[:k]], runs[p[k:]]) for k in range(1, len(p))]
            inside = [
                b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if not any(100 * b >= cover * a for b in inside):
                score, _, left, right = min(cuts)
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def some_rows(n=120):
    random.seed(7)
    words = ["the", "The", "of", "a", "woods", "Étude", "sea", "x-y", "ÀB"]
    passage = " ".join(f"p{i}" for i in range(40))
    loop = "u v w " * 9
    rows = [
        (i, "".join(random.choice(words) + random.choice([" ", "  ", "\t", ", ", ". ", "\r\n", " "]) for _ in range(60)), random.choice(["en", "fr", None, "und"]))
        for i in range(n)
    ]
    rows += [(None, f"the {passage} of {passage}.", "en")] * 8 + [(1, loop, "fr")] * 6
    return [*rows, (2, None, "en"), (3, "", None), (4, " . ,, \t\n", "de"), (5, "lone", "xx"), (5, "lone", "xx")]


def test_against_all_runs(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", w1 int, words string").repartition(5)
    for least, first, cover in ((5, 2000, 80), (3, 7, 100), (300, 50, 80)):
        got = sorted(map(tuple, collocations(docs, least=least, first=first, cover=cover).collect()))
        assert got == brute(rows, least, first, cover), (least, first, cover)
    assert collocations(docs.limit(0)).count() == 0


def test_counts_are_exact_and_paths_are_compacted(spark):
    rows = some_rows()
    counts, totals, paths = phrase_counts(spark.createDataFrame(rows, SCHEMA), least=5)
    want = {(lang, p): a for lang, runs in runs_of(rows).items() for p, a in runs.items() if a >= 5}
    assert {(r.lang, tuple(r.words)): r.a for r in counts.collect()} == want
    assert {r.lang: r.n for r in totals.collect()}["xx"] == 2
    longest = max(paths.collect(), key=lambda r: len(r.words))
    # The passage is one row: 40 words; its neighbours differ.
    assert (longest.lang, longest.words, longest.n) == ("en", [f"p{i}" for i in range(40)], 16)
    inner = {tuple(r.words) for r in counts.where("inner").collect()}
    assert ("p1", "p2", "p3") in inner and ("p0", "p1", "p2") not in inner
    # Every edge lies on exactly one path.
    windows = Counter((r.lang, tuple(r.words[i : i + 4])) for r in paths.collect() for i in range(len(r.words) - 3))
    assert windows == Counter(k for k in want if len(k[1]) == 4)


def test_edges_on_a_cycle_stay_alone(spark):
    cycle = [("en", *[f"c{(i + j) % 5}" for j in range(4)], 9) for i in range(5)]
    chain = [("en", *[f"d{i + j}" for j in range(4)], 9) for i in range(2000)]
    edges = spark.createDataFrame(cycle + chain, "lang string, w1 string, w2 string, w3 string, w4 string, n long")
    nodes = edges.select("lang", "w1", "w2", "w3", "n")
    paths = compact_paths(edges, unary_nodes(edges, nodes)).collect()
    assert sorted(len(r.words) for r in paths) == [4] * 5 + [2000 - 1024 + 3, 1024 + 3]


def test_rare_edges_stay_in_their_task(spark):
    rows = some_rows()
    runs = {(lang, p): a for lang, runs in runs_of(rows).items() for p, a in runs.items()}
    edges = phrase_edges(spark.createDataFrame(rows, SCHEMA), least=5).collect()
    for r in edges:
        run = tuple(r.run.split(" ")) if r.run is not None else ()
        assert all(runs[r.lang, run[:k]] >= 5 for k in range(1, len(run) + 1))
    assert sum(r.n for r in edges) == sum(a for (_, p), a in runs.items() if len(p) == 1)


def test_a_shared_cell_changes_no_count(spark):
    rows = some_rows(20)
    batch = pa.record_batch([pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["text", "lang"])
    words = phrase_graph._Words(batch)
    out = phrase_graph._edges_of(words, 20, [np.full(1 << 17, 255, np.uint8)] * 4).to_pylist()
    got = Counter()
    for r in out:
        run = tuple(r["run"].split(" ")) if r["run"] is not None else ()
        for k in range(1, len(run) + 1):
            got[r["lang"], run[:k]] += r["n"]
    assert got == Counter({(lang, p): a for lang, runs in runs_of(rows).items() for p, a in runs.items()})
    docs = spark.createDataFrame(rows, SCHEMA)
    assert frequent_cells(docs, 5, cell_bits(docs), (1, 2)).nbytes == 1 << 17
