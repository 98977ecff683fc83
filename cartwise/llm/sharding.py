"""Histogram sort of documents into shards of near-equal bytes.

Sort key of a row: (hash of its text, doc_id, a number of the row's own), so equal texts
stand next to each other, a boundary falls inside a group only when the group is larger than
the tolerance allows, and even fully repeated rows can be cut anywhere. Candidate key boundaries are counted exactly (bytes and rows
below each, over all partitions), the probes around each target are refined until
the splitter meets its tolerance or a single row lies between its neighbours, and
the rows are exchanged once, by the bucket the splitters give them.

A shard is cut into buckets by the same splitters, so the numbering within a shard
is a row_number per bucket plus the exactly counted rows below the bucket: no
task ever holds a whole shard.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.common import partitions, texts
from cartwise.session import stage

LOW = -(1 << 63)
KEY = ["h", "id", "r"]
#: The rows' own numbers, spread evenly below this.
ROWS = 1 << 40


def _below(keys: list[np.ndarray], probes: list[np.ndarray]) -> np.ndarray:
    """For each row, how many of the probes are <= its key; both are given column by column."""
    n = len(probes[0])
    tag = np.r_[np.zeros(n, np.int8), np.ones(len(keys[0]), np.int8)]  # equal keys: the probe first
    order = np.lexsort((tag, *(np.concatenate(c) for c in reversed(list(zip(probes, keys))))))
    rows = order >= n
    out = np.empty(len(keys[0]), np.int64)
    out[order[rows] - n] = np.cumsum(~rows)[rows]
    return out


def _histogram(keys: DataFrame, probes: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each of the sorted probes."""
    columns = [np.array(x, dtype=np.int64) for x in zip(*probes)]

    def count(batches):
        n, size = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            cell = _below([b[c].to_numpy() for c in KEY], columns)
            n += np.bincount(cell, minlength=len(n))
            np.add.at(size, cell, b["size"].to_numpy())
        at = np.flatnonzero(n)
        yield pd.DataFrame({"cell": at, "n": n[at], "bytes": size[at]})

    got = (keys.select(*KEY, "size").mapInPandas(count, "cell long, n long, bytes long")
           .groupBy("cell").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect())
    n, size = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in got:
        n[r["cell"]], size[r["cell"]] = r["n"], r["bytes"]
    return np.cumsum(size)[:-1].tolist(), np.cumsum(n)[:-1].tolist()


def splitters(keys: DataFrame, parts: int, per_part: int, tolerance: float, probes: int = 16):
    """Boundaries that cut the keys (h, id, r, size) into parts * per_part buckets.

    Part boundaries meet ``tolerance`` (share of a part's bytes), those inside a part
    a fifth of a bucket. Returns the sorted distinct boundaries as (h, id, r), the rows
    below each, and the number of boundaries at or below the start of each part.
    """
    tot = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n"),
                   F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    if not tot["n"]:
        return [], [], [0] * parts
    span, total = (tot["hi"] - tot["lo"] + 1) * ROWS, tot["b"]
    # A key as one integer: hash-major, then id, then row; multiples of span are group starts.
    pair = lambda k: (k // span + LOW, k % span // ROWS + tot["lo"], k % ROWS)
    ends = (0, (1 << 64) * span)
    buckets = parts * per_part
    counted = {ends[0]: (0, 0), ends[1]: (total, tot["n"])}
    near = {k: ends for k in range(1, buckets)}
    best: dict[int, int] = {}
    while near:
        wanted = set()
        for (lo, hi), targets in Counter(near.values()).items():
            step = probes * targets
            for i in range(1, step):
                k = lo + (hi - lo) * i // step
                k = k // span * span if hi - lo > 2 * span else k  # between groups of equal hash
                if lo < k < hi:
                    wanted.add(k)
        new = sorted(wanted - counted.keys())
        if new:
            for k, b, n in zip(new, *_histogram(keys, [pair(k) for k in new])):
                counted[k] = (b, n)
        known = sorted(counted)
        sizes = [counted[k][0] for k in known]
        for t in list(near):
            target = total * t / buckets
            at = min(bisect_right(sizes, target) - 1, len(known) - 2)
            lo, hi = known[at], known[at + 1]
            pick = min((lo, hi), key=lambda k: (abs(counted[k][0] - target), k))
            allowed = tolerance * total / parts if t % per_part == 0 else 0.2 * total / buckets
            if (abs(counted[pick][0] - target) <= allowed or hi - lo <= 1
                    or counted[hi][1] - counted[lo][1] <= 1 or not new):
                best[t] = pick
                del near[t]
            else:
                near[t] = (lo, hi)
    cuts = sorted({k for k in best.values() if k not in ends})
    starts = [0]
    for p in range(1, parts):
        k = best[p * per_part]
        starts.append(len(cuts) + 1 if k == ends[1] else bisect_right(cuts, k))
    return [pair(k) for k in cuts], [counted[k][1] for k in cuts], starts


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Law ``bytes``: the shards' sums of size (UTF-8 bytes plus 1) differ by no more than
    the tolerance on either side, or by one row where a row is larger. Equal texts
    share a shard unless a boundary has to cut their group. Null texts count as
    empty, a null doc_id sorts as 0, repeated rows stand next to each other and may be cut
    like any others, an empty table gives no rows. Slots run without gaps from 0 in key order within a shard.
    """
    spark = docs.sparkSession
    keys = stage(texts(docs).select(
        F.col("doc_id").isNull().alias("no_id"), (F.octet_length("text").cast("long") + 1).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("h"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(ROWS)).alias("r")), "op4-keys")  # stored, so fixed
    per_part = max(4, -(-2 * partitions(spark) // shards))
    cuts, rows, starts = splitters(keys, shards, per_part, tolerance)
    columns = [np.array([c[i] for c in cuts], np.int64) for i in range(len(KEY))]
    first = np.array(starts)
    below = np.array([0, *rows], np.int64)

    def place(batches):
        for b in batches:
            bucket = _below([b[c].to_numpy() for c in KEY], columns)
            shard = np.searchsorted(first, bucket, "right") - 1
            b["bucket"], b["shard"] = bucket.astype(np.int32), shard.astype(np.int32)
            b["base"] = below[bucket] - below[first[shard]]
            yield b

    kinds = ", ".join(f"{c} {t}" for c, t in keys.dtypes)
    placed = keys.mapInPandas(place, f"{kinds}, bucket int, shard int, base long")
    order = Window.partitionBy("bucket").orderBy(*KEY)
    return placed.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
