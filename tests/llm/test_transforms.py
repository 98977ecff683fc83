"""Merged transforms against a dictionary of all strings."""

import random
from collections import defaultdict

import numpy as np
import pytest

from cartwise.llm import transforms as T


def brute(strings, length):
    seen = defaultdict(list)
    at = 0
    for s in strings:
        for i in range(len(s) - length + 1):
            seen[s[i:i + length]].append(at + i)
        at += len(s)
    return {k: v for k, v in seen.items() if len(v) > 1}


@pytest.mark.parametrize("shard_bytes,letters,length", [(700, 2, 16), (1 << 18, 3, 16), (900, 200, 48), (300, 1, 48), (2000, 60_000, 400)])
def test_merged_intervals(monkeypatch, shard_bytes, letters, length):
    monkeypatch.setattr(T, "SHARD_BYTES", shard_bytes)
    rng = random.Random(shard_bytes + letters)
    def text(n):
        return b"".join(rng.randrange(letters).to_bytes(2, "big")[1 if letters < 257 else 0:] for _ in range(n))
    passage = text(3 * length)
    strings = [text(rng.randrange(length, 3 * length)) for _ in range(20)]
    strings += [text(rng.randrange(30)) + passage[rng.randrange(9):] + text(rng.randrange(30)) for _ in range(6)]
    strings += [passage * 2, passage[:length]]
    rng.shuffle(strings)
    want = brute(strings, length)
    c, places, interval = T.merged_intervals(strings, length)
    data = b"".join(strings)
    got = defaultdict(list)
    for p, i in zip(places.tolist(), interval.tolist()):
        got[i].append(p)
    assert sorted(sorted(v) for v in got.values()) == sorted(want.values())
    order = [data[p:p + length] for p in places.tolist()]
    assert order == sorted(order)  # the merged order is that of the strings
    assert all(len({data[p:p + length] for p in v}) == 1 for v in got.values())


def test_suffix_order_of_a_shard():
    rng = random.Random(1)
    for n, depth in ((160, 64), (160, 16), (700, 64), (20, 64)):
        data = bytes(rng.randrange(2) for _ in range(n))
        order = T.suffix_order(T.step_ranks(np.frombuffer(data, np.uint8)), depth)
        said = [(data + bytes(depth))[p:p + depth] for p in order.tolist()]
        assert said == sorted(said) and sorted(order.tolist()) == list(range(n))


def test_nothing_to_merge():
    c, places, interval = T.merged_intervals([], 400)
    assert len(places) == len(interval) == 0
    _, places, _ = T.merged_intervals([b"x" * 400], 400)
    assert len(places) == 0
    _, places, _ = T.merged_intervals([b"x" * 401], 400)
    assert np.sort(places).tolist() == [0, 1]
