import random

import numpy as np
import pytest

from panelweave.llm import jaccard_join as join
from panelweave.llm import occurrence_search
from panelweave.llm.components import components


def test_search_equals_counting(monkeypatch):
    random.seed(1)
    for _ in range(300):
        monkeypatch.setattr(occurrence_search, "HEAP_ITEMS", random.choice([0, 50, 10_000]))
        monkeypatch.setattr(occurrence_search, "FEW", random.choice([0, 8]))
        sets = [set(random.sample(range(40), random.randrange(1, 25))) for _ in range(random.randrange(1, 40))]
        index = occurrence_search.OverlapIndex([np.array(sorted(s)) for s in sets])
        asked = set(random.sample(range(45), random.randrange(1, 30)))
        for least in (1, 2, 5, 10):
            want = [(i, len(s & asked)) for i, s in enumerate(sets) if len(s & asked) >= least]
            assert sorted(index.search(np.array(sorted(asked)), least)) == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def brute(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            named = rows[i][0] is not None and rows[j][0] is not None
            if named and a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("group", [3, 4000])
def test_links_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(join, "GROUP", group)
    random.seed(7)
    base = [[random.choice("abcdefgh") + random.choice("xyz") for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(150):
        words = list(random.choice(base))
        for _ in range(random.randrange(5)):
            words[random.randrange(60)] = random.choice(["Q", "r", f"s{i}"])
        words = words[: random.choice([60, 60, random.randrange(60), random.randrange(6)])]
        text = " ".join(words)
        rows.append((i if random.random() < 0.97 else None, text.upper() if random.random() < 0.2 else text))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "É é"), (204, "é É")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    assert sorted((tuple(r) for r in join.jaccard_join(docs).collect()), key=str) == brute(rows)
    assert join.jaccard_join(docs.limit(0)).count() == 0
