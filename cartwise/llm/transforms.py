"""Burrows-Wheeler transforms of collections of byte strings, and their merge.

A string is read as a circle. A shard's transform lists, for its suffixes in sorted order,
the ``step`` bytes that stand before each, and where the suffix that begins with them
stands in that order. Transforms of several shards are merged by refining an interleave: at
depth 0 the suffixes of one shard after the other's are one interval; a turn sorts them
stably by the bytes before them and steps to the longer suffixes, so they are in order to
``step`` bytes more, and an interval splits where bytes or former intervals differ.
Suffixes of an interval at depth d have a common prefix of d bytes: repeated strings of a
length are the intervals of two or more at that depth. No suffixes are compared or sorted
anew, only the transforms are read. What is alone in its interval stays alone and leaves;
so does a suffix that is shorter than the depth.
"""

from __future__ import annotations

import numpy as np

#: Bytes of one shard.
SHARD_BYTES = 1 << 18
#: Bytes that a turn advances.
STEP = 16
#: Suffixes of a shard are sorted by so many bytes; what is equal that far keeps its place, and the
#: merge refines it like the rest.
SORTED = 64


class Circles:
    """Byte strings one behind the other, with the places of each."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.base = np.r_[0, np.cumsum(self.sizes)][:-1].astype(np.int64)
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.owner = np.repeat(np.arange(len(strings)), self.sizes)
        self.size = self.sizes[self.owner]
        self.place = np.arange(len(self.data))
        self.offset = self.place - self.base[self.owner]

    def back(self, by: int) -> np.ndarray:
        """For each place the one ``by`` back round its circle (strings have ``by`` bytes at least)."""
        return np.where(self.offset >= by, self.place - by, self.place - by + self.size)


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _ahead(rank: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(rank)
    out[:-by] = rank[by:]
    return out


def step_ranks(data: np.ndarray) -> np.ndarray:
    """For each place a number in the order of the STEP bytes from it (past the end: zeros)."""
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    word = np.zeros(len(data), np.uint64)
    for i in range(8):
        word |= padded[i:i + len(data)] << np.uint64(56 - 8 * i)
    rank = _ranks(word)
    return _ranks(rank << 32 | _ahead(rank, 8))


def suffix_order(rank: np.ndarray, depth: int) -> np.ndarray:
    """The places of a shard in the order of the ``depth`` bytes or more from each, from the ranks
    of their first STEP bytes (prefix doubling)."""
    have = STEP
    while 2 * have < min(depth, len(rank)):
        rank = _ranks(rank << 32 | _ahead(rank, have))
        have *= 2
    return np.lexsort((_ahead(rank, have), rank)) if have < len(rank) else np.argsort(rank, kind="stable")


def shards_of(strings: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of strings of SHARD_BYTES or somewhat more together."""
    out, first, held = [], 0, 0
    for i, s in enumerate(strings):
        held += len(s)
        if held >= SHARD_BYTES:
            out.append((first, i + 1))
            first, held = i + 1, 0
    return out + [(first, len(strings))] * (first < len(strings))


def _stable_order(rank: np.ndarray, most: int) -> np.ndarray:
    """Stable order of small whole numbers, by radix."""
    turn = np.argsort((rank & 0xFFFF).astype(np.uint16), kind="stable")
    return turn[np.argsort((rank >> 16).astype(np.uint16)[turn], kind="stable")] if most > 1 << 16 else turn


def merged_intervals(strings: list[bytes], length: int) -> tuple[Circles, np.ndarray, np.ndarray]:
    """(circles, places, intervals): the places whose ``length`` bytes (a multiple of STEP; within their
    string) stand at another place too, sorted by them, and a number for each interval of equal ones."""
    c = Circles(strings)
    if not strings:
        return c, np.zeros(0, np.int64), np.zeros(0, np.int32)
    rank = step_ranks(c.data)
    most = int(rank.max()) + 1
    # The shards' orders, one behind the other; a suffix is known by its index there.
    order = np.concatenate([
        lo + suffix_order(rank[lo:hi], SORTED) for lo, hi in
        ((int(c.base[a]), int(c.base[b - 1] + c.sizes[b - 1])) for a, b in shards_of(strings))])
    index = np.empty(len(order), np.int32)
    index[order] = np.arange(len(order), dtype=np.int32)
    before = c.back(STEP)
    transform = rank.astype(np.int32)[before][order]
    longer = index[before][order]
    rest = (c.size - c.offset)[order].astype(np.int32)  # bytes from the suffix to its string's end

    at, interval = np.arange(len(order), dtype=np.int32), np.zeros(len(order), np.int32)
    for depth in range(STEP, length + 1, STEP):
        at, said = longer[at], transform[at]
        keep = rest[at] >= depth  # its prefix ends in its own string
        at, interval, said = at[keep], interval[keep], said[keep]
        turn = _stable_order(said, most)
        at, interval, said = at[turn], interval[turn], said[turn]
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = (said[1:] != said[:-1]) | (interval[1:] != interval[:-1])
        several = ~(new[:-1] & new[1:])
        interval = np.cumsum(new[:-1], dtype=np.int32)[several]
        at = at[several]
        if not len(at):
            break
    return c, order[at], interval
