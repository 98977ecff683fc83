"""Importance resampling against a plain statement of it, and its CRCs against zlib's."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from cartwise.llm.resampling import crc32_all, resample

SMALL_SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, target, min_words=20, percent=10, buckets=10_000, longest=1):
    def runs(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    found = [(i, *runs(t)) for i, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for _, x in target for b in runs(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(order[:percent * len(order) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    return sorted(((r[0], *r[2:], ranks[r].pop() if ranks.get(r) else None) for r in out), key=repr)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_crc_matrices():
    rng = random.Random(2)
    items = [rng.randbytes(n) for n in [0, 1, 2, 3, 4, 5, 5, 5, 64, 511, 512, 512, 513, 1023, 1024, 1025, 5000, 5000, 100_001]]
    items += [rng.randbytes(rng.randrange(12)) for _ in range(500)] + [b"\0" * 600, b"\xff" * 2048]
    assert crc32_all(items).tolist() == [zlib.crc32(x) for x in items]
    assert crc32_all([]).tolist() == []


def test_given_tables(spark):
    docs, target = (spark.read.parquet(f"{SMALL_SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert found(resample(docs, target)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in target.collect()])


def test_longer_runs_and_small_buckets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("a b Straße ÉT 7 x-y").lower() for _ in range(rng.randrange(60)))) for i in range(300)]
    goal = [(1, "a b a b a b"), (2, "7 7 7"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame(goal, "item_id long, text string")
    got = found(resample(docs, target, runs=(1, 3), buckets=50, min_words=5, percent=33))
    assert got == brute(rows, goal, min_words=5, percent=33, buckets=50, longest=3)


def test_odd_rows(spark):
    """Nulls, empties, one very long word, Unicode, ties of one id and text (a third of the rows), clashing columns."""
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, None), (2, ""), (3, "  \t"), (4, "A" * 300_000), (5, "Ünïcode, Ünïcode; ünïcode x"), (6, text.upper())]
    rows += [(None, text)] * 20 + [(7, text)] * 10 + [(i, f"{text} {i % 5}") for i in range(10, 40)]
    docs = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], "doc_id long, text string, _row string, score int, n long").repartition(5)
    target = spark.createDataFrame([(1, "w1 w2 w2"), (None, None)], "item_id long, text string")
    for percent in (10, 60, 100):
        got = found(resample(docs, target, percent=percent))
        assert got == brute(rows, [(1, "w1 w2 w2")], percent=percent)
    assert all(r[4] is None for r in found(resample(docs, target, percent=0)))
    assert {r[2] is not None for r in found(resample(docs, target.limit(0)))} == {True}
    assert resample(docs.limit(0), target).collect() == []
