"""Conflict-constrained best-fit packing of documents into fixed-capacity sequences.

Bins carry two bitmaps: the sources and the duplicate clusters they hold. A piece
goes to the bin with the least residual that takes it and whose bitmaps it does not
touch; bins are kept in residual order and the search goes on to the successor until
a compatible bin is found, else a new bin opens.

Rows are dealt by hash into chunks of about ``chunk_rows`` rows and each chunk is
packed by one task, largest piece first, so a hot source or a large group of copies is
spread over all chunks and no task grows with the data. Conflicts only concern pieces
of one bin, so chunks need not know each other.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import NO_ID, texts
from cartwise.session import stage

#: Repeats of a row that one array numbers.
REPEATS = 4096
SCHEMA = ("chunk long, bin long, slot int, doc_id long, copy long, piece int, first_word long, "
          "n_words long, bin_words long")


def best_fit(pieces, capacity: int, per_source: int):
    """pieces: (words, source, cluster, payload), any order. Returns bins as lists of payloads.

    ``per_source`` bits exist for each source: a bin holds at most so many pieces of it
    (0: sources don't conflict).
    Clusters with a single piece here cannot conflict and take no bit.
    """
    pieces = sorted(pieces, key=lambda p: (-p[0], p[3]))
    sources: dict = {}
    copies: dict = {}
    for _, s, c, _ in pieces:
        sources.setdefault(s, len(sources))
        copies[c] = copies.get(c, 0) + 1
    bit = {c: 1 << i for i, c in enumerate(c for c, n in copies.items() if n > 1)}
    least = pieces[-1][0] if pieces else 0
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins: list[list] = []
    for words, source, cluster, payload in pieces:
        lanes = [1 << (sources[source] * per_source + i) for i in range(per_source)]
        full = sum(lanes)
        mine = bit.get(cluster, 0)
        at = bisect_left(order, (words, -1))
        while at < len(order):
            b = order[at][1]
            if not cluster_bits[b] & mine and (not full or source_bits[b] & full != full):
                break
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(bins)
            bins.append([])
            source_bits.append(0)
            cluster_bits.append(0)
        bins[b].append(payload)
        source_bits[b] |= next((x for x in lanes if not source_bits[b] & x), 0)
        cluster_bits[b] |= mine
        if residual - words >= max(least, 1):
            insort(order, (residual - words, b))
    return bins


def pack_documents(docs: DataFrame, capacity: int = 2048, per_source: int = 2,
                   chunk_rows: int = 4096) -> DataFrame:
    """One row per placed piece: (bin_id, slot, doc_id, copy, piece, first_word, n_words, bin_words).

    Words are the maximal runs without white space, over the whole text. A document longer
    than ``capacity`` is cut into full pieces (each alone in its bin) and a rest. No bin
    holds two pieces of one duplicate cluster (equal lower-cased words) or more than
    ``per_source`` of one source. Documents without words (null or empty texts too) take one
    piece of 0 words. Repeated rows are separate pieces (``copy`` 0, 1, ...) that conflict.
    A null source is a source of its own, a table without ``source`` has one for all its
    rows with no bound on it. An empty table gives no rows.
    """
    has_source = "source" in docs.columns
    t = texts(docs, *["source"] * has_source)
    words = F.array_remove(F.split(F.lower("text"), r"\s+"), "")
    thin = stage(
        t.select("doc_id", (F.col("source").cast("string") if has_source else F.lit(None).cast("string"))
                 .alias("source"), words.alias("w"))
        .select("doc_id", "source", F.size("w").cast("long").alias("n_words"),
                F.xxhash64("w").alias("cluster")), "op10-sizes")
    chunks = max(1, -(-thin.count() // chunk_rows))
    rows = (thin.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).groupBy("doc_id", "source", "n_words", "cluster").agg(F.count("*").alias("copies"))
            # Repeats are numbered in two steps, so that no array holds them all.
            .withColumn("many", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / REPEATS))))
            .withColumn("copy", F.explode(F.sequence(F.col("many") * REPEATS, F.least(
                F.col("copies") - 1, F.col("many") * REPEATS + (REPEATS - 1))))).drop("many")
            .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(chunks))))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out, pieces, n_bins = [], [], 0
        for i, (n, source, cluster) in enumerate(zip(pdf["n_words"], pdf["source"], pdf["cluster"])):
            full, rest = divmod(int(n), capacity)
            for k in range(full):
                out.append((n_bins, 0, i, k, k * capacity, capacity, capacity))
                n_bins += 1
            if rest or not full:
                pieces.append((rest, source, cluster, (i, full, rest)))
        for b in best_fit(pieces, capacity, per_source if has_source else 0):
            held = sum(p[2] for p in b)
            for slot, (i, k, rest) in enumerate(b):
                out.append((n_bins, slot, i, k, k * capacity, rest, held))
            n_bins += 1
        o = pd.DataFrame(out, columns=["bin", "slot", "i", "piece", "first_word", "n_words", "bin_words"])
        o["chunk"] = int(pdf["chunk"].iloc[0])
        o["doc_id"], o["copy"] = pdf["doc_id"].to_numpy()[o["i"]], pdf["copy"].to_numpy()[o["i"]]
        return o[["chunk", "bin", "slot", "doc_id", "copy", "piece", "first_word", "n_words", "bin_words"]]

    return (rows.groupBy("chunk").applyInPandas(pack, SCHEMA)
            .select(F.concat_ws("-", "chunk", "bin").alias("bin_id"), "slot",
                    F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "copy", "piece",
                    "first_word", "n_words", "bin_words"))
