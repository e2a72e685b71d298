"""The trie of all prefixes of conversations, built by truncation peeling.

A conversation is a *path*: one mark of 20 bytes per turn (16 of a digest of role and text, 4 of
the text's length), one behind the other; texts themselves stay where they are. From the greatest
depth down, conversations that end at a depth join the nodes that survive from below, equal
prefixes are grouped into nodes with their totals, and every node strips its last turn and goes on
as a survivor of the depth above. So nodes are found and summed up in one pass.

Paths are dealt out by ranges of their order and peeled task by task, in blocks of bounded size.
All nodes but those on a task's first and last path lie within it and are finished there. The
others leave as partial sums along those two paths, and are peeled again with the partial sums of
all tasks. Ranges also cut a group of equal paths, so no prefix or copy is too common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.sources import stage

#: Bytes of a mark, and of a prefix's key.
MARK, KEY = 20, 16
#: Bytes of paths peeled at once, and of ids in one piece of a long list.
BLOCK, LIST = 1 << 22, 1 << 16
#: Paths with partial sums that one task may take; each task sends on two at most, so rounds end if it is over 4.
PATHS = 20_000
NOBODY = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Sums of a node, of what is finished below it: members, the smallest of them, children, leaves, saved tokens.
SUMS = ("n", "least", "kids", "leaves", "saved")

_LONGS = pa.list_(pa.int64())
_SCHEMA = pa.schema(
    [
        ("kind", pa.string()),
        ("pid", pa.int32()),
        ("key", pa.binary()),
        ("parent_key", pa.binary()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends", pa.string()),
        ("path", pa.binary()),
        ("keys", pa.list_(pa.binary())),
        ("sums", pa.list_(_LONGS)),
        ("end_hashes", pa.list_(pa.string())),
    ]
)
_DDL = (
    "kind string, pid int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string, path binary, keys array<binary>, "
    "sums array<array<long>>, end_hashes array<string>"
)


def conversation_marks(
    turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id`` and ``marks``, one for every turn in order, as hexadecimal text.

    Turns go by number, missing numbers first; turns with one number go by their marks, and all
    of them stay, equal ones too. A missing role or text counts as empty. Rows without a
    conversation id belong to no conversation. A conversation is one row of 40 bytes a turn.
    """
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    said = F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)
    mark = F.concat(F.substring(F.sha2(said.cast("binary"), 256), 1, 2 * KEY), F.lpad(F.hex(F.length(text_)), 8, "0"))
    rows = turns.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), mark.alias("mark"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "mark")))["mark"]
    return rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(ordered.alias("marks"))


def with_shared_heads(conversations: DataFrame, group: int = 100, longest: int = 5) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their group of ids.

    Conversation c takes the first h turns of c - c % group, and its own turns after its first h;
    h is the unsigned CRC-32 of c in decimal, modulo ``longest`` + 1.
    """
    conversations = stage(conversations, "marks")
    heads = conversations.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_base"), F.slice("marks", 1, longest).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("int")
    own = F.when(F.size("marks") > h, F.slice("marks", h + 1, F.size("marks"))).otherwise(F.array().cast("array<string>"))
    head = F.coalesce(F.when(h > 0, F.slice("_head", 1, F.greatest(h, F.lit(1)))), F.array().cast("array<string>"))
    based = conversations.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "_base", "left")
    return based.select("conv_id", F.concat(head, own).alias("marks"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations (``conv_id``, ``marks``), the empty one included.

    A node is named by its smallest member and its depth: it is the first ``depth`` turns of
    conversation ``conv_id``. ``parent_conv_id`` is the parent's smallest member (of the root:
    null), ``n_convs`` counts members, ``n_children`` children, ``n_leaves`` childless nodes from
    the node down, ``saved_tokens`` what storing each prefix once saves from the node down: for
    each node (members - 1) times its last text's length. ``ends_sha256`` is the SHA-256 of the
    comma-joined ids, ascending, of members that end here. No conversations give no rows, a
    conversation without turns ends at the root; repeated ids count as often as they occur.
    A very long conversation costs one path of 20 bytes a turn and a pass over its own depths.
    """
    path = F.unhex(F.array_join("marks", ""))
    paths = stage(conversations.select("conv_id", path.alias("path")), "paths")
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    rounds = [stage(dealt.select("path", "conv_id").mapInArrow(_peel_conversations, _DDL), "trie")]
    last = False
    while not last:
        partial = rounds[-1].where("kind = 'path'").select("path", "sums", "end_hashes")
        n = -(-partial.count() // PATHS)
        last = n <= 1
        ranges = partial.repartition(1) if last else partial.repartitionByRange(n, "path")
        rounds.append(stage(ranges.sortWithinPartitions("path").mapInArrow(_peel_partial(last), _DDL), "trie"))
    return _assembled(rounds)


def _assembled(rounds: list[DataFrame]) -> DataFrame:
    """Nodes of all rounds, with the parents and lists of ends that were not known in their own."""
    numbered = [r.withColumn("round", F.lit(i)) for i, r in enumerate(rounds)]
    nodes = reduce(DataFrame.union, [r.where("kind = 'node'") for r in numbered])
    lists = (
        rounds[0].where("kind = 'ends'").select("key", F.col("conv_id").alias("first"), "ends")
        .repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hash_lists, "key binary, list_hash string")
    )
    shared = nodes.where("round > 0").select("key", F.col("conv_id").alias("parent"))
    # A task's partial nodes under the task's number: a parent of very many nodes meets them task by task.
    parents = (
        reduce(DataFrame.union, [r.where("kind = 'path'") for r in numbered])
        .select("round", "pid", F.explode("keys").alias("key")).join(shared, "key")
        .select("round", "pid", F.col("key").alias("parent_key"), "parent")
    )
    hashed = nodes.where("round > 0").join(lists, "key", "left")
    known = [nodes.where("round = 0").withColumn("list_hash", F.lit(None).cast("string")), hashed]
    whole = known[0].unionByName(known[1])
    columns = [
        "conv_id",
        "depth",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", "list_hash", F.lit(NO_ENDS)).alias("ends_sha256"),
    ]
    done = whole.where("parent_key IS NULL").select(*columns, "parent_conv_id")
    rest = whole.where("parent_key IS NOT NULL").join(parents, ["round", "pid", "parent_key"], "left")
    both = done.union(rest.select(*columns, "parent"))
    return both.select("conv_id", "depth", "parent_conv_id", *columns[2:6], "ends_sha256")


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each key's pieces of text, which come one behind the other; nothing is put together."""
    key, running = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], ["key", "list_hash"])

    for batch in batches:
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if running is not None and k == key:
                running.update(b"," + piece.encode())
            else:
                if running is not None:
                    yield row()
                key, running = k, hashlib.sha256(piece.encode())
    if running is not None:
        yield row()


@dataclass
class _Path:
    """Partial sums along a path, for the depths that end with its own; ``ends``: hashes of lists of ids, or empty."""

    path: bytes
    sums: np.ndarray
    ends: list[str]


def _peel_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path, conv_id) to nodes, lists of ids of paths that other tasks may hold too, and partial sums."""
    pid = TaskContext.get().partitionId()
    pending: list[dict] = []

    def copies() -> Iterator[tuple[bytes, list[str], int, int]]:
        """Equal paths: their ids in pieces, their number and the smallest id."""
        path, ids, pieces, n, least = None, [], [], 0, 0
        for batch in batches:
            for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
                if p != path:
                    if path is not None:
                        yield path, [*pieces, ",".join(ids)], n, least
                    path, ids, pieces, n, least = p, [], [], 0, c
                ids.append(str(c))
                n += 1
                if len(ids) >= LIST // 8:
                    pieces.append(",".join(ids))
                    ids = []
        if path is not None:
            yield path, [*(p for p in pieces if p), *([",".join(ids)] if ids else [])], n, least

    def listed() -> Iterator[_Path]:
        held = None
        for at, run in enumerate(copies()):
            if held is not None:
                yield _ended(*held, at == 1, pending)
            held = run
        if held is not None:
            yield _ended(*held, True, pending)

    for batch in _peeled(listed(), pid, False, False):
        yield batch
        if pending:
            yield _rows(pending, pid)
            pending.clear()
    if pending:
        yield _rows(pending, pid)


def _ended(path: bytes, pieces: list[str], n: int, least: int, open_: bool, pending: list[dict]) -> _Path:
    """Conversations of one path. Where more of them may lie in another task, the ids leave as text."""
    pieces = [p for p in pieces if p]
    ends = ""
    if open_:
        key = _keys(path, len(path) // MARK)[0]
        pending.extend({"kind": "ends", "key": key, "conv_id": int(p.split(",", 1)[0]), "ends": p} for p in pieces)
    else:
        running = hashlib.sha256(pieces[0].encode())
        for piece in pieces[1:]:
            running.update(b"," + piece.encode())
        ends = running.hexdigest()
    return _Path(path, np.array([[n], [least], [0], [0], [0]]), [ends])


def _peel_partial(last: bool):
    """Peel partial sums again. With ``last`` all of them are here, and every node is finished."""

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            _Path(path, np.array(sums, np.int64), ends)
            for batch in batches
            for path, sums, ends in zip(*(batch.column(c).to_pylist() for c in ("path", "sums", "end_hashes")))
        )
        yield from _peeled(rows, TaskContext.get().partitionId(), True, last)

    return peel


def _peeled(rows: Iterator[_Path], pid: int, keyed: bool, whole: bool) -> Iterator[pa.RecordBatch]:
    """Peel paths that come in order, block by block; the first and the last path stay open between blocks.

    ``whole``: what is left in the end is finished too. ``keyed``: nodes carry their keys.
    """
    carried: list[_Path] = []
    block: list[_Path] = []
    size = 0
    for row in rows:
        block.append(row)
        size += len(row.path) + 64
        if size >= BLOCK:
            nodes, carried = _peel(carried + block, pid, keyed, open_=True)
            block, size = [], 0
            yield nodes
    if carried or block:
        nodes, carried = _peel(carried + block, pid, keyed, open_=not whole)
        yield nodes
    if carried:
        yield _rows(
            [
                {
                    "kind": "path",
                    "path": p.path,
                    "keys": _keys(p.path, len(p.path) // MARK - len(p.ends) + 1),
                    "sums": p.sums.tolist(),
                    "end_hashes": p.ends,
                }
                for p in carried
            ],
            pid,
        )


def _peel(rows: list[_Path], pid: int, keyed: bool, open_: bool) -> tuple[pa.RecordBatch, list[_Path]]:
    """Nodes of paths in order, and with ``open_`` the partial sums along the first and the last path."""
    paths = [r.path for r in rows]
    last = len(paths) - 1
    data = np.frombuffer(b"".join(paths) + bytes(MARK), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(p) for p in paths[:-1]]))).astype(np.int64)
    shared = np.array([-1] + [_shared(a, b) for a, b in zip(paths, paths[1:])])
    # What ends or arrives at each depth: path, sums, place of its hash.
    of = np.repeat(np.arange(len(rows)), [len(r.ends) for r in rows])
    depth = np.concatenate([len(r.path) // MARK - np.arange(len(r.ends))[::-1] for r in rows])
    sums = np.concatenate([r.sums for r in rows], axis=1)
    hashes = [h for r in rows for h in r.ends]
    hashed = np.where([bool(h) for h in hashes], np.arange(len(hashes)), -1)
    order = np.argsort(-depth, kind="stable")
    cuts = np.searchsorted(-depth[order], -np.arange(int(depth.max()), -2, -1))

    low = high = np.empty(0, np.int64)
    alive = np.empty((len(SUMS), 0), np.int64)
    # Per depth: rows of nodes, their parents' places in the depth above.
    found: list[dict] = []
    edges: tuple[list, list] = ([], [])
    for d, (a, b) in zip(range(int(depth.max()), -1, -1), zip(cuts, cuts[1:])):
        new = order[a:b]
        low, high = np.concatenate((low, of[new])), np.concatenate((high, of[new]))
        each = np.concatenate((alive, sums[:, new]), axis=1)
        hash_at = np.concatenate((np.full(alive.shape[1], -1), hashed[new]))
        came = np.concatenate((np.arange(alive.shape[1]), np.full(len(new), -1)))
        sort = np.argsort(low, kind="stable")
        low, high, each, hash_at, came = low[sort], np.maximum.accumulate(high[sort]), each[:, sort], hash_at[sort], came[sort]
        # Equal prefixes lie side by side: paths that overlap, or neighbours that share the depth.
        same = (low[1:] <= high[:-1]) | ((low[1:] == high[:-1] + 1) & (shared[low[1:]] >= d))
        heads = np.flatnonzero(np.concatenate(([True], ~same)))
        if found:
            group = np.cumsum(np.concatenate(([True], ~same))) - 1
            found[-1]["parent"] = group[np.argsort(came, kind="stable")[len(new) :]]
        first, end = low[heads], high[np.append(heads[1:], len(low)) - 1]
        n, kids, leaves, saved = (np.add.reduceat(each[i], heads) for i in (0, 2, 3, 4))
        least = np.minimum.reduceat(each[1], heads)
        hash_at = np.maximum.reduceat(hash_at, heads)
        side = np.where(open_ & (first == 0), 0, np.where(open_ & (end == last), 1, -1))
        for g in np.flatnonzero(side >= 0):
            edges[side[g]].append((d, [n[g], least[g], kids[g], leaves[g], saved[g]], hash_at[g]))
        closed = side < 0
        leaves = np.where(closed & (kids == 0), 1, leaves)
        if d:
            at = begin[first] + MARK * d - 4
            length = sum(data[at + i].astype(np.int64) << (24 - 8 * i) for i in range(4))
            saved = np.where(closed, saved + (n - 1) * length, saved)
        found.append(
            {"depth": d, "first": first, "side": side, "least": least, "n": n, "kids": kids, "leaves": leaves, "saved": saved, "hash": hash_at}
        )
        low, high = first, end
        alive = np.where(closed, np.stack((n, least, np.ones_like(n), leaves, saved)), np.array([[0], [NOBODY], [0], [0], [0]]))
    carried = []
    for path, levels in zip((paths[0], paths[last]), edges):
        if levels:
            carried.append(
                _Path(path, np.array([s for _, s, _ in levels[::-1]]).T, [hashes[h] if h >= 0 else "" for _, _, h in levels[::-1]])
            )
    return _nodes(found, paths, hashes, pid, keyed), carried


def _nodes(found: list[dict], paths: list[bytes], hashes: list[str], pid: int, keyed: bool) -> pa.RecordBatch:
    """The finished nodes. A parent that is not finished is named by its key."""
    known: dict[int, list[bytes]] = {}

    def key(row: int, depth: int) -> bytes:
        if row not in known:
            known[row] = _keys(paths[row], 0)
        return known[row][depth]

    out: dict[str, list] = {name: [] for name in ("depth", "least", "n", "kids", "leaves", "saved", "hash", "parent", "parent_key", "key")}
    for level, above in zip(found, [*found[1:], None]):
        closed = np.flatnonzero(level["side"] < 0)
        for name in ("least", "n", "kids", "leaves", "saved", "hash"):
            out[name].append(level[name][closed])
        d = level["depth"]
        out["depth"].append(np.full(len(closed), d))
        out["key"].extend([key(r, d) for r in level["first"][closed].tolist()] if keyed else [None] * len(closed))
        if above is None:
            out["parent"].extend([None] * len(closed))
            out["parent_key"].extend([None] * len(closed))
            continue
        parent = level["parent"][closed]
        done = above["side"][parent] < 0
        out["parent"].extend(np.where(done, above["least"][parent], 0).astype(object))
        waiting = {g: key(above["first"][g], d - 1) for g in np.unique(parent[~done]).tolist()}
        out["parent_key"].extend([None if ok else waiting[g] for ok, g in zip(done.tolist(), parent.tolist())])
    size = len(out["key"])
    longs = {name: np.concatenate(out[name]) for name in ("depth", "least", "n", "kids", "leaves", "saved", "hash")}
    none = {c: pa.nulls(size, _SCHEMA.field(c).type) for c in ("path", "keys", "sums", "end_hashes")}
    columns = none | {
        "kind": pa.array(["node"] * size),
        "pid": pa.array(np.full(size, pid), pa.int32()),
        "key": pa.array(out["key"], pa.binary()),
        "parent_key": pa.array(out["parent_key"], pa.binary()),
        "conv_id": pa.array(longs["least"]),
        "depth": pa.array(longs["depth"], pa.int64()),
        "parent_conv_id": pa.array([None if k else p for p, k in zip(out["parent"], out["parent_key"])], pa.int64()),
        "n_convs": pa.array(longs["n"]),
        "n_children": pa.array(longs["kids"]),
        "n_leaves": pa.array(longs["leaves"]),
        "saved_tokens": pa.array(longs["saved"]),
        "ends": pa.array([hashes[h] if h >= 0 else None if keyed else NO_ENDS for h in longs["hash"].tolist()], pa.string()),
    }
    return pa.RecordBatch.from_arrays([columns[c] for c in _SCHEMA.names], schema=_SCHEMA)


def _rows(rows: list[dict], pid: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"pid": pid, **row} for row in rows], schema=_SCHEMA)


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their beginnings."""
    low, high = 0, min(len(a), len(b)) // MARK
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * MARK : middle * MARK] == b[low * MARK : middle * MARK]:
            low = middle
        else:
            high = middle - 1
    return low


def _keys(path: bytes, top: int) -> list[bytes]:
    """Digests of the path's prefixes of ``top`` turns and more."""
    running = hashlib.sha256(path[: top * MARK])
    keys = [running.digest()[:KEY]]
    for at in range(top * MARK, len(path), MARK):
        running.update(path[at : at + MARK])
        keys.append(running.digest()[:KEY])
    return keys
