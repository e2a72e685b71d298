import numpy as np
import pytest

from panelweave.llm.topk_search import NONE, CoverTree, DualSearch, bound, topk_search

SCHEMA = "vec_id long, embedding array<double>"


def brute(queries, query_ids, rows, row_ids, k):
    out = []
    for q, own in zip(queries, query_ids):
        scored = [(-sum(int(a) * int(b) for a, b in zip(q, r)), int(i)) for r, i in zip(rows, row_ids) if i != own]
        out.append(sorted(scored)[:k])
    return out


def searched(queries, rows, k=5):
    ids, asked = np.arange(len(rows)), np.arange(len(queries)) + 10**6
    done = DualSearch(queries, asked, rows, ids, k, np.full(len(queries), float(NONE)))
    assert done.best == brute(queries, asked, rows, ids, k)
    assert done.pruned + done.compared == len(queries) * len(rows)
    return done


def clustered(rng, n, clusters=20, dim=24):
    centers = rng.normal(size=(clusters, dim))
    centers *= 256 / np.linalg.norm(centers, axis=1, keepdims=True)
    return np.floor(centers[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * 3).astype(np.int64)


def test_most_pairs_of_clustered_vectors_are_pruned():
    rng = np.random.default_rng(1)
    rows = clustered(rng, 2400)
    done = searched(rows[:200], rows)
    assert done.pruned > 0.6 * 200 * 2400


def test_vectors_without_structure_are_compared_as_blocks():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(600, 48)) * 40).astype(np.int64)
    assert searched(rows[:50], rows).pruned == 0


def test_a_node_covers_its_rows_and_parts_its_children():
    rng = np.random.default_rng(3)
    rows = np.concatenate([clustered(rng, 700), clustered(rng, 3).repeat(60, axis=0)])
    waiting, seen = [CoverTree.of(rows)], 0
    while waiting:
        node = waiting.pop()
        away = np.linalg.norm(rows[node.members] - node.center, axis=1)
        assert away.max() <= node.radius + 1e-9 and node.radius <= 2.0**node.level + 1e-9
        centers = [c.center for c in node.children]
        for i, c in enumerate(node.children):
            assert c.radius <= 2.0 ** (node.level - 1) + 1e-9
            for other in centers[:i]:
                assert np.linalg.norm(c.center - other) > 2.0 ** (node.level - 1)
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)
        waiting += node.children
        seen += 1
    assert seen > 10


def test_no_pair_exceeds_its_bound():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (rng.normal(size=(rng.integers(1, 6), 3)) * rng.choice([1, 100]) + rng.normal(size=3) * 50 for _ in range(2))
        one, two = CoverTree.of(a), CoverTree.of(b)
        ball = lambda n: (n.center, n.norm, n.radius, n.longest, n.angle)
        assert bound(ball(one), ball(two)) >= (a @ b.T).max()


def test_products_beyond_floats_and_64_bits_are_exact():
    rng = np.random.default_rng(5)
    for size in (2**26, 2**30, 2**40):
        rows = rng.integers(-size, size, (80, 3))
        rows[1] = rows[0] + 1  # products that differ in their last digits
        searched(rows[:20], rows)


def test_empty_vectors_and_numbers_that_are_too_large(spark):
    rows = [(i, []) for i in range(0, 70)] + [(100, [1.0]), (150, [2.0])]
    got = sorted(map(tuple, topk_search(spark.createDataFrame(rows, SCHEMA), lambda i: i % 50 == 0).collect()))
    assert got == [(0, r, r, 0) for r in range(1, 6)] + [(50, r, r - 1, 0) for r in range(1, 6)] + [(100, 1, 150, 256 * 512), (150, 1, 100, 256 * 512)]
    wide = spark.createDataFrame([(0, [1e8, 1.0]), (1, [1e8, 3.0])], SCHEMA)
    want = (256 * 10**8) ** 2 + 256 * 768
    assert want > 2**63
    with pytest.raises(Exception, match="64 bits"):
        topk_search(wide, lambda i: i % 50 == 0).collect()
    with pytest.raises(Exception, match="64 bits"):
        topk_search(spark.createDataFrame([(0, [1e18])], SCHEMA), lambda i: i % 50 == 0).collect()
    large = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e6, 3.0]), (2, [1e6, 4.0])], SCHEMA)
    (a, b) = sorted(map(tuple, topk_search(large, lambda i: i % 50 == 0).collect()))
    assert a == (0, 1, 2, 256 * 10**7 * 256 * 10**6 + 256 * 1024) and b[3] == a[3] - 256 * 256
