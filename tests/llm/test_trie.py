"""The prefix trie against dictionaries of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from spreadlab.llm import trie

TURNS = "conv_id long, turn int, role string, text string, key string, depth int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += children[p] == 0
        if p:
            saved[p] += (len(members[p]) - 1) * len(p[-1][1])
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = lambda p: ",".join(str(c) for c in members[p] if len(built[c]) == len(p))
    return [(members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), children[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p in members]


def conversations(seed):
    r, rows = random.Random(seed), []
    for c in r.sample(range(-250, 900), 400):
        n = 16 if seed == 1 and r.random() < 0.5 else r.choice([1, 2, 3, 4, 5, 8, 20, 45])
        for t in range(n):
            if seed == 1:  # one conversation, again and again
                rows.append((c, t, "user", "same"))
            else:
                rows.append((c, r.choice([t, t, t, t, None, 0]), r.choice(["user", "assistant", None]), r.choice(["a", "b", None, "", "漢字😀"])))
    return rows + rows[:5] + [(None, 1, "user", "x"), (None, None, None, None)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("shards", [1, 3, 17])
def test_nodes_match_brute_force(spark, seed, shards, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(trie, "CHUNK", 8)
    rows = conversations(seed)
    got = trie.prefix_trie(spark.createDataFrame([(*r, "clash", 5) for r in rows], TURNS), shards=shards)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_few_rows_and_none(spark):
    for rows in ([], [(None, 1, "user", "x")], [(5, 0, "user", "only")], [(101, 0, "user", "base is absent")], [(100, None, None, None), (101, None, None, None)]):
        got = trie.prefix_trie(spark.createDataFrame([(*r, "clash", 5) for r in rows], TURNS))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_one_long_conversation(spark):
    """A path of 1500 nodes, half of it shared."""
    rows = [(c, t, "user", f"{t}" if t < 700 else f"{c} {t}") for c in (200, 300, 301) for t in range(1500)]
    got = trie.prefix_trie(spark.createDataFrame([(*r, "clash", 5) for r in rows], TURNS), shards=2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)
