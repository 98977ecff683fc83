"""The conversation trie against a brute-force trie in memory, on whole given tables and on odd ones."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from cartwise.llm.prefix_trie import conversation_trie

SMALL_SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        built[c] = (own.get(c - int(math.fmod(c, 100)), [])[:h] if rebuild else []) + ts[h:]
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                kids[tuple(ts[:d - 1])].add(tuple(ts[:d]))
        ends[tuple(ts)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in kids[node])
    return {(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()}


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_given_table(spark):
    df = spark.read.parquet(f"{SMALL_SF}/conversations.parquet")
    assert found(conversation_trie(df)) == brute([tuple(r) for r in df.collect()])


def test_deep_and_shared(spark):
    """Paths of over two band levels, shared for most of their length; hot first turns; copies."""
    rng = random.Random(4)
    long = [(("user", "assistant")[i % 2], f"turn {i} " + "x" * rng.randrange(9)) for i in range(150)]
    rows = []
    for c in range(0, 1200, 7):
        turns = long[:rng.choice([1, 3, 8, 9, 63, 64, 65, 149])] + [("user", f"own {rng.randrange(3)}")] * rng.randrange(3)
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for rebuild in (True, False):
        assert found(conversation_trie(df, rebuild)) == brute(rows, rebuild)


def test_odd_rows(spark):
    """Null turns, roles, texts and ids, tied and repeated turns, role and text that run into each other,
    conversations left without a turn, columns with clashing names."""
    rows = [(100, None, "user", "a"), (100, 1, "user", "b"), (100, 1, "user", "b"), (101, 2, None, None), (101, 2, "", "z"),
            (102, 1, "use", "ra"), (103, 1, "user", "a"), (None, 1, "user", "lost"), (305, 1, "user", "only"), (306, 1, "user", ""),
            (307, 1, "x", "é" * 40_000), (308, 1, "x", "é" * 40_000), (-7, 0, "user", "minus"), (-3, 0, "user", "minus")]
    more = [(*r, "k", 5, 7) for r in rows]
    df = spark.createDataFrame(more, "conv_id long, turn long, role string, text string, conv string, d int, k1 long")
    got = found(conversation_trie(df))
    assert got == brute(rows)  # the base of an id below zero: the remainder is cut towards zero, as in SQL
    assert conversation_trie(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [5000])
def test_many_end_at_one_node(spark, n):
    """Copies of one conversation over several pieces of the id list."""
    rows = [(c, 0, "user", "same") for c in range(0, n * 3, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {(r["depth"]): r for r in conversation_trie(df, rebuild=False).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
    assert (got[1]["n_convs"], got[1]["saved_tokens"], got[0]["n_leaves"]) == (n, (n - 1) * 4, 1)
