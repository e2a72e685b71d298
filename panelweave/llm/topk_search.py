"""Exact nearest rows by inner product: cover trees over queries and rows, searched together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm import texts
from panelweave.sources import stage

K = 5
#: Rows from which centres of cells are chosen, and the most cells.
SAMPLE_ROWS, CELLS = 1000, 256
#: Rows of a cell, and queries, that one task searches together.
BLOCK, ASKED = 4096, 8192
#: Rows of a leaf. A level that parts more than half of a node's rows from all others has no groups to
#: prune, so the node stays a leaf, whose rows are compared as a block.
LEAF = 32
NONE = -(2**63)


class CoverTree:
    """A node of level l holds rows within 2**l of its centre, itself a row.

    Its children's centres are more than 2**(l - 1) apart, and each of its rows is in the child of
    the nearest centre, so within 2**(l - 1) of it. Levels without a second centre are skipped.
    """

    def __init__(self, rows: np.ndarray, members: np.ndarray, center: int) -> None:
        self.members = members
        self.center = rows[center].astype(float)
        away = rows[members] - self.center
        self.radius = float(np.sqrt(np.einsum("ij,ij->i", away, away).max(initial=0.0)))
        self.norm = float(np.sqrt(self.center @ self.center))
        lengths = np.sqrt(np.einsum("ij,ij->i", rows[members].astype(float), rows[members].astype(float)))
        self.longest = float(lengths.max(initial=0.0))
        self.angle = _widest_angle(rows[members].astype(float), lengths, self.center, self.norm)
        self.children: list[CoverTree] = []
        self.level = int(np.ceil(np.log2(self.radius))) if self.radius else 0
        if len(members) <= LEAF or self.radius == 0:
            return
        for level in range(self.level - 1, self.level - 64, -1):
            centers, nearest = _apart(rows, members, center, 2.0**level)
            if len(centers) > len(members) // 2:
                return
            if len(centers) > 1:
                self.level = level + 1
                self.children = [CoverTree(rows, members[nearest == i], c) for i, c in enumerate(centers)]
                return

    @staticmethod
    def of(rows: np.ndarray) -> CoverTree:
        return CoverTree(rows, np.arange(len(rows)), 0)


def _apart(rows: np.ndarray, members: np.ndarray, first: int, distance: float) -> tuple[list[int], np.ndarray]:
    """Centres more than ``distance`` apart that cover the members within it, and each member's nearest one."""
    centers, nearest = [], np.zeros(len(members), np.int64)
    least = np.full(len(members), np.inf)
    new = first
    while new is not None and len(centers) <= len(members) // 2:
        away = rows[members] - rows[new].astype(float)
        squares = np.einsum("ij,ij->i", away, away)
        closer = squares < least
        nearest[closer], least[closer] = len(centers), squares[closer]
        centers.append(new)
        left = np.flatnonzero(least > distance * distance)
        new = int(members[left[0]]) if len(left) else None
    if new is not None:
        centers.append(new)  # one too many: nothing is covered
    return centers, nearest


def _widest_angle(rows: np.ndarray, lengths: np.ndarray, center: np.ndarray, norm: float) -> float:
    """The largest angle between the centre and a row; a straight one where a vector has no direction."""
    if norm == 0 or (lengths == 0).any():
        return float(np.pi)
    cosines = rows @ center / (lengths * norm)
    return float(np.arccos(np.clip(cosines.min(initial=1.0), -1, 1))) + 1e-7


def bound(q, r) -> float:
    """No inner product of a vector around one centre and a vector around the other is larger.

    Both are given by ``center, norm, radius, longest, angle``: the smaller of what the balls allow
    and of what the longest vectors at the least possible angle reach.
    """
    (q_center, q_norm, q_radius, q_longest, q_angle), (r_center, r_norm, r_radius, r_longest, r_angle) = q, r
    product = float(q_center @ r_center)
    value = product + q_radius * r_norm + r_radius * q_norm + q_radius * r_radius
    if q_norm and r_norm:
        between = float(np.arccos(np.clip(product / (q_norm * r_norm), -1, 1))) - q_angle - r_angle - 1e-7
        if between > 0:
            cosine = np.cos(min(between, np.pi))
            # Where even the least angle is blunt, the shortest vectors would come nearest: 0 is safe.
            value = min(value, max(q_longest * r_longest * cosine, 0.0))
    return value + 1e-9 * (abs(value) + q_norm * r_norm) + 1e-6


def _ball(node: CoverTree) -> tuple:
    return node.center, node.norm, node.radius, node.longest, node.angle


def at_most(score: int) -> float:
    """The score as a float, or the next smaller one where floats skip whole numbers."""
    return float(score) if abs(score) < 2**53 else float(np.nextafter(float(score), -np.inf))


class DualSearch:
    """Best ``k`` rows of every query; ``floor`` is a score that each query's answers must reach.

    ``pruned`` and ``compared`` count pairs of a query and a row.
    """

    def __init__(self, queries, query_ids, rows, row_ids, k: int, floor: np.ndarray) -> None:
        self.queries, self.query_ids, self.rows, self.row_ids, self.k = queries, query_ids, rows, row_ids, k
        self.worst = floor.copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(len(queries))]
        self.pruned = self.compared = 0
        most = int(np.abs(queries.astype(object)).max(initial=0)) * int(np.abs(rows.astype(object)).max(initial=0)) * rows.shape[1]
        # Floats are exact up to 2**53; beyond 64 bits Python's own integers are.
        self.kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
        if len(queries) and len(rows):
            self.descend(CoverTree.of(queries), CoverTree.of(rows))

    def descend(self, q: CoverTree, r: CoverTree) -> None:
        waiting = [(q, r)]
        while waiting:
            q, r = waiting.pop()
            if bound(_ball(q), _ball(r)) < self.worst[q.members].min():
                self.pruned += len(q.members) * len(r.members)
                continue
            if not q.children and not r.children:
                self.compared += len(q.members) * len(r.members)
                self.compare(q.members, r.members)
            elif r.children and (r.radius >= q.radius or not q.children):
                promising = sorted(r.children, key=lambda c: float(q.center @ c.center) + q.norm * c.radius)
                waiting += [(q, c) for c in promising]
            else:
                waiting += [(c, r) for c in q.children]

    def compare(self, queries: np.ndarray, rows: np.ndarray) -> None:
        table = self.rows[rows].astype(self.kind).T
        for low in range(0, len(queries), 256):
            part = queries[low : low + 256]
            scores = self.queries[part].astype(self.kind) @ table if len(table) else np.zeros((len(part), len(rows)))
            good = (scores >= self.worst[part][:, None]).astype(bool)
            good &= self.query_ids[part][:, None] != self.row_ids[rows][None, :]
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                self.keep(int(part[i]), scores[i], np.flatnonzero(good[i]), rows)

    def keep(self, query: int, scores: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
        """Take the best of some scores; ties at the k-th go on to the comparison of ids."""
        if len(at) > self.k:
            kth = np.sort(scores[at])[-self.k] if self.kind is object else np.partition(scores[at], -self.k)[-self.k]
            at = at[(scores[at] >= kth).astype(bool)]
        found = zip((-scores[at]).tolist(), self.row_ids[rows[at]].tolist())
        best = sorted(self.best[query] + [(int(score), row) for score, row in found])[: self.k]
        self.best[query] = best
        if len(best) == self.k:
            self.worst[query] = max(self.worst[query], at_most(-best[-1][0]))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    items = texts.list_items(column)
    return items.reshape(n, len(items) // n)


def _search(k: int):
    def search(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asks.num_rows:
            done = DualSearch(
                _matrix(asks["q_vec"], asks.num_rows), texts.numbers(asks["q_id"]),
                _matrix(rows["vec"], rows.num_rows), texts.numbers(rows["id"]), k,
                np.array([at_most(x) for x in asks["q_floor"].to_pylist()]),
            )
            for row, own, best in zip(asks["q_row"].to_pylist(), asks["q_id"].to_pylist(), done.best):
                if any(not NONE <= -score < -NONE for score, _ in best):
                    raise OverflowError(f"a score of query {own} does not fit into 64 bits")
                out += [(row, own, found, -score) for score, found in best]
        columns = list(zip(*out)) or [()] * 4
        names = ("row", "query_id", "vec_id", "score")
        return pa.table(dict(zip(names, (pa.array(c, pa.int64()) for c in columns))))

    return search


def _cells(centers: dict[int, np.ndarray]):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch["vec"]
            dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
            cell, away = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            length, angle = np.zeros(len(dims)), np.full(len(dims), np.pi)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                mine = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim).astype(float)
                known = centers.get(dim, np.zeros((1, dim)))
                norms = np.sqrt((known**2).sum(axis=1))
                far = np.stack([np.sqrt(((mine - c) ** 2).sum(axis=1)) for c in known], axis=1)
                cell[at], away[at] = far.argmin(axis=1), far.min(axis=1)
                length[at] = np.sqrt((mine**2).sum(axis=1))
                both = length[at] * norms[cell[at]]
                cosine = np.divide((mine * known[cell[at]]).sum(axis=1), both, out=np.full(len(at), -1.0), where=both > 0)
                angle[at] = np.arccos(np.clip(cosine, -1, 1)) + 1e-7
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["id"], vectors, *map(pa.array, (dims.astype(np.int32), cell, away, length, angle))],
                ["row", "id", "vec", "dim", "cell", "away", "length", "angle"],
            )

    return cells


def _spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres: always the row that is farthest from the ones chosen before."""
    chosen, away = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        away = np.minimum(away, ((sample - sample[chosen[-1]].astype(float)) ** 2).sum(axis=1))
        if away.max() == 0:
            break
        chosen.append(int(away.argmax()))
    return sample[chosen].astype(float)


def topk_search(
    vectors: DataFrame,
    asked: Callable[[Column], Column],
    id_column: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    k: int = K,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's ``k`` best rows, its own id excepted.

    Queries are the rows whose id ``asked`` picks; every row is searched.
    Components become floor(scale * x); scores are exact integer inner products, ties go to the
    smaller id. All rows are dealt into cells around centres from a bounded sample; a cell's
    covering radius is that of all its rows. Queries first search their own cell. Then pairs of a
    query cell and a row cell are dropped whose balls cannot reach the worst k-th score among the
    queries, and the rest is searched block by block, with a cover tree on either side.

    Rows without id or vector, or with missing or non-finite components, take no part. Vectors of
    different lengths are not compared; those of length 0 score 0. Rows that share a query's id are not its answers; other
    repeated ids are. Queries get all they can if there are fewer than ``k`` rows. Scores are exact
    at any size; a component or a score of an answer beyond 64 bits fails the job. Other columns
    are ignored; an empty table gives an empty result.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    times = lambda x: x.cast("double") * scale
    too_large = F.raise_error(F.lit("a component does not fit into 64 bits")).cast("long")
    whole = lambda x: F.when(F.abs(times(x)) >= 2.0**63, too_large).otherwise(F.floor(times(x)))
    valid = vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, odd))
    scaled = valid.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("id"),
        F.transform(vector, whole).alias("vec"),
    )
    total = scaled.count()
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = scaled.where(chance * total <= SAMPLE_ROWS).select("id", "vec").orderBy("id", "vec").limit(2 * SAMPLE_ROWS).collect()
    wanted = int(min(CELLS, 8 + total**0.5 / 8))
    centers = {
        dim: _spread_out(np.array([r["vec"] for r in picked if len(r["vec"]) == dim], np.int64).reshape(-1, dim) if dim else np.zeros((1, 0)), wanted)
        for dim in {len(r["vec"]) for r in picked}
    }
    ddl = "row long, id long, vec array<long>, dim int, cell long, away double, length double, angle double"
    dealt = stage(scaled.mapInArrow(_cells(centers), ddl), "cells")
    asks = dealt.where(asked(F.col("id")))

    reach = [F.max(c).alias(c) for c in ("away", "length", "angle")]
    sizes = dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), *reach).collect()
    asking = {(r["dim"], r["cell"]): r for r in asks.groupBy("dim", "cell").agg(*reach).collect()}
    asked_rows = {(r["dim"], r["cell"]): r["n"] for r in asks.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    session = vectors.sparkSession

    def answers(asks: DataFrame, pairs: list[tuple[int, int, int]]) -> DataFrame:
        """Search each query (with its ``floor``) in all blocks of the cells that its cell is paired with."""
        load: dict[tuple[int, int], int] = {}
        for dim, own, cell in pairs:
            load[dim, cell] = load.get((dim, cell), 0) + asked_rows[dim, own]
        known = [(r["dim"], r["cell"], r["n"]) for r in sizes if (r["dim"], r["cell"]) in load]
        parts = session.createDataFrame(
            [(dim, cell, -(-n // BLOCK), -(-load[dim, cell] // ASKED)) for dim, cell, n in known],
            "dim int, cell long, blocks long, turns long",
        )
        first = F.lit(0).cast("long")
        rows = dealt.join(parts, ["dim", "cell"]).select(
            "dim", "cell", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"),
            F.explode(F.sequence(first, F.col("turns") - 1)).alias("turn"), "row", "id", "vec",
        )
        table = session.createDataFrame(pairs, "dim int, own long, cell long")
        each = (
            asks.withColumnRenamed("cell", "own")
            .join(table, ["dim", "own"])
            .join(parts, ["dim", "cell"])
            .withColumn("turn", F.pmod(F.xxhash64("row"), F.col("turns")))
            .withColumn("block", F.explode(F.sequence(first, F.col("blocks") - 1)))
            .select(*[F.col(c).alias(f"q_{c}") for c in ("dim", "cell", "block", "turn", "row", "id", "vec", "floor")])
        )
        return (
            rows.groupBy("dim", "cell", "block", "turn")
            .cogroup(each.groupBy("q_dim", "q_cell", "q_block", "q_turn"))
            .applyInArrow(_search(k), "row long, query_id long, vec_id long, score long")
        )

    by_score = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    nearby = answers(asks.withColumn("floor", F.lit(NONE)), [(dim, cell, cell) for dim, cell in asking])
    first = stage(nearby.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "nearby")
    kth = first.where(F.col("rank") == k).select("row", F.col("score").alias("kth"))
    ready = stage(asks.join(kth, "row", "left").withColumn("floor", F.coalesce("kth", F.lit(NONE))).drop("kth", "away", "length", "angle"), "asks")
    worst = {(r["dim"], r["cell"]): r["w"] for r in ready.groupBy("dim", "cell").agg(F.min("floor").alias("w")).collect()}

    def ball(r) -> tuple:
        center = centers[r["dim"]][r["cell"]] if r["dim"] in centers else np.zeros(r["dim"])
        return center, float(np.sqrt(center @ center)), r["away"], r["length"], r["angle"]

    pairs = [
        (dim, own, r["cell"])
        for (dim, own), ask in asking.items()
        for r in sizes
        if r["dim"] == dim and r["cell"] != own and bound(ball(ask), ball(r)) >= at_most(worst[dim, own])
    ]
    merged = first.drop("rank").unionByName(answers(ready, pairs))
    return merged.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
