import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from panelweave.llm import prefix_trie as trie
from panelweave.llm.prefix_trie import conversation_marks, prefix_trie, with_shared_heads

SCHEMA = "conv_id long, turn int, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32] + f"{len(text):08X}"
            own[conv].append(((turn is not None, turn or 0), mark, (role, text)))
    turns = {c: [t for *_, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def brute(conversations):
    members = defaultdict(list)
    for c, turns in conversations:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns) == d))
    out = set()
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c, ended in sorted(who) if ended)
        parent = min(members[p[:-1]])[0] if p else None
        out.add((min(who)[0], len(p), parent, len(who), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def built(spark, rows, shuffled=True):
    random.shuffle(rows)
    return prefix_trie(with_shared_heads(conversation_marks(spark.createDataFrame(rows, SCHEMA))))


@pytest.mark.parametrize("paths", [20_000, 8])
def test_against_all_prefixes(spark, monkeypatch, paths):
    # With few paths to a task, partial sums go through several rounds.
    monkeypatch.setattr(trie, "PATHS", paths)
    random.seed(1)
    ids = [*range(95, 130), 200, 250, 299, -3, -100, -150]
    rows = [(c, t, random.choice("uv"), random.choice(["a", "bb", "ccc", "😀é"])) for c in ids for t in range(random.randint(1, 7))]
    got = rows_of(built(spark, rows))
    assert got == sorted(brute(rebuilt(rows).items()), key=lambda r: r)


def test_odd_rows(spark):
    rows = [
        (None, 0, "u", "x"),
        (100, None, None, None),
        (100, 2, "u", "x"),
        (100, 2, "u", "x"),
        (100, 1, "", "y" * 5000),
        (7, 3, "u", ""),  # its group has no first conversation
        (101, None, "u", "x"),
        (101, None, "a", "b"),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", marks int, path int")
    got = prefix_trie(with_shared_heads(conversation_marks(df)))
    assert rows_of(got) == sorted(brute(rebuilt(rows).items()))
    assert prefix_trie(with_shared_heads(conversation_marks(df.limit(0)))).count() == 0


def test_many_copies_and_a_long_conversation(spark):
    rows = [(c, t, "u", f"turn {t}") for c in range(0, 3000, 3) for t in range(3)]
    rows += [(1, t, "u", f"turn {t}") for t in range(2000)] + [(2, 0, "u", "turn 0")]
    conversations = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        conversations[c].append((role, text))
    out = {r.depth: r for r in prefix_trie(conversation_marks(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(out) == 2001 and {r.n_convs for r in out.values()} == {1002, 1001, 1}
    ends = ",".join(map(str, range(0, 3000, 3)))
    assert out[3].ends_sha256 == hashlib.sha256(ends.encode()).hexdigest()
    assert (out[3].conv_id, out[4].conv_id, out[4].parent_conv_id, out[0].n_leaves) == (0, 1, 0, 1)
    assert out[0].saved_tokens == 6 * (1001 + 1000 + 1000)


@pytest.mark.parametrize("block", [1, 300, 1 << 22])
def test_blocks_of_any_size(monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    random.seed(block)
    for _ in range(20):
        conversations = [(c, [("u", random.choice("ab") * 3) for _ in range(random.randint(0, 6))]) for c in range(60)]
        marks = lambda turns: b"".join(hashlib.sha256(repr(t).encode()).digest()[:16] + (3).to_bytes(4, "big") for t in turns)
        paths = sorted((marks(turns), c) for c, turns in conversations)
        equal = defaultdict(list)
        for p, c in paths:
            equal[p].append(c)
        rows = (trie._ended(p, [",".join(map(str, cs))], len(cs), cs[0], False, []) for p, cs in equal.items())
        got = []
        for batch in trie._peeled(rows, 0, True, True):
            for r in batch.to_pylist():
                assert r["kind"] == "node"
                got.append(r)
        by_key = {r["key"]: r["conv_id"] for r in got}
        assert len(by_key) == len(got)
        found = {
            (
                r["conv_id"], r["depth"], by_key.get(r["parent_key"], r["parent_conv_id"]), r["n_convs"], r["n_children"],
                r["n_leaves"], r["saved_tokens"], r["ends"] or trie.NO_ENDS,
            )
            for r in got
        }
        assert found == brute(conversations)
