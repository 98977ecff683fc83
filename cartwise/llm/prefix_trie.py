"""The prefix trie of conversations, with subtree totals by depth-band rollup.

A conversation is a path of turns; equal first turns are one node. A node's key is the
depth and two 64-bit lanes, each the exclusive or of hashes of (position, role, text)
over the turns so far, so a path's keys are running aggregates of its sorted turns.

Totals over subtrees go up in bands of ``HEIGHT`` levels. Each node adds its own values
to its ancestors within its band only (at most ``HEIGHT`` rows, read off the path of its
smallest member). The band roots, with these sums as their values, are a trie that is
``HEIGHT`` times flatter; its totals come from the same procedure, and each root's
completed total then goes to its ancestors in the band above. A trie of depth D takes
log(D) / log(HEIGHT) levels, and no row meets more than ``HEIGHT`` others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.common import partitions
from cartwise.session import stage

HEIGHT = 8
KEY = ["d", "k1", "k2"]
VALUES = ["leaves", "saved"]
#: Ids of one node that are joined into one piece of text: 2 to this power.
PIECE_BITS = 12
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, c1, c2, len): turns numbered from 1 by turn (null first), role, text; two hashes and
    the code points of each. Null roles and texts are empty; rows without a conversation id have no place."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                             F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv IS NOT NULL")
    w = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return c.select("conv", F.row_number().over(w).cast("long").alias("pos"),
                    F.xxhash64(F.lit(1), "role", "text").alias("c1"), F.xxhash64(F.lit(2), "text", "role").alias("c2"),
                    F.char_length("text").cast("long").alias("len"))


def shared_openings(turns: DataFrame, group: int = 100, longest: int = 6) -> DataFrame:
    """Turns of the rebuilt conversations: the first h turns of conversation c - c % group, then the
    conversation's own turns after its first h, h = crc32(c as text) % longest. (conv, pos, ...)
    A conversation that gets no turn at all has one row with position 0."""
    convs = (turns.groupBy("conv").agg(F.max("pos").alias("n"))
             .withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % longest))
    base = turns.filter(F.col("pos") < longest).select(F.col("conv").alias("base"), *turns.columns[1:])
    links = convs.select("conv", "h", (F.col("conv") - F.col("conv") % group).alias("base"))
    opening = links.join(base, "base").filter("pos <= h").select("conv", *turns.columns[1:])
    given = (links.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("there")), "base", "left")
             .select("conv", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("given")))
    rest = (turns.join(given, "conv").filter("pos > h")
            .withColumn("pos", F.col("pos") - F.col("h") + F.col("given")).select("conv", *turns.columns[1:]))
    start = convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("c1"),
                         F.lit(0).cast("long").alias("c2"), F.lit(0).cast("long").alias("len"))
    return start.unionByName(opening).unionByName(rest)


def paths(turns: DataFrame) -> DataFrame:
    """(conv, d, k1, k2, p1, p2, len, ends): each conversation's nodes from the root (depth 0, keys 0)
    down, each with its parent's key; ``ends`` marks the last one."""
    def lane(n: int):
        return F.when(F.col("pos") == 0, 0).otherwise(F.xxhash64(F.lit(n), "pos", "c1", "c2"))
    w = Window.partitionBy("conv").orderBy("pos")
    return (turns.withColumns({"h1": lane(3), "h2": lane(4)})
            .select("conv", F.col("pos").alias("d"), F.bit_xor("h1").over(w).alias("k1"), F.bit_xor("h2").over(w).alias("k2"),
                    "h1", "h2", "len", F.lead("pos").over(w).isNull().alias("ends"))
            .withColumns({"p1": F.col("k1").bitwiseXOR(F.col("h1")), "p2": F.col("k2").bitwiseXOR(F.col("h2"))})
            .drop("h1", "h2"))


def subtree_totals(nodes: DataFrame, path: DataFrame, deepest: int) -> DataFrame:
    """Sums of VALUES over every node's subtree. ``nodes``: key, ``conv`` (smallest member), VALUES;
    ``path``: (conv, d, k1, k2); ``deepest``: the largest depth."""
    path = path.select("conv", F.col("d").alias("ad"), F.col("k1").alias("a1"), F.col("k2").alias("a2"),
                       F.floor(F.col("d") / HEIGHT).alias("band"))

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("ad").alias("d"), F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(
            F.min("conv").alias("conv"), *[F.sum(v).alias(v) for v in VALUES])

    own = nodes.select("conv", "d", *VALUES, F.floor(F.col("d") / HEIGHT).alias("band"))
    within = gathered(own.join(path, ["conv", "band"]).filter("ad <= d"))
    if deepest < HEIGHT:
        return within
    within = stage(within, "trie-band")
    flatter = {"d": F.floor(F.col("d") / HEIGHT)}
    roots = subtree_totals(within.filter(F.col("d") % HEIGHT == 0).withColumns(flatter),
                           path.filter(F.col("ad") % HEIGHT == 0).select("conv", F.col("band").alias("d"), F.col("a1").alias("k1"), F.col("a2").alias("k2")),
                           deepest // HEIGHT)
    above = roots.filter("d > 0").select("conv", *VALUES, (F.col("d") - 1).alias("band")).join(path, ["conv", "band"])
    return gathered(above.select("conv", "ad", "a1", "a2", *VALUES).unionByName(
        within.select("conv", F.col("d").alias("ad"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), *VALUES)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and piece: one digest per key, fed piece by piece."""
    at, digest, out = None, None, []

    def flush():
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], pa.int64()) for i in range(3)),
                                           pa.array([r[3] for r in out], pa.string())], names=[*KEY, "ends_sha256"])
    for b in batches:
        for d, k1, k2, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids"))):
            if (d, k1, k2) != at:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (d, k1, k2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield flush()
            out.clear()
    if at is not None:
        out.append((*at, digest.hexdigest()))
    yield flush()


def ending_hashes(path: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end: ids are joined into pieces of bounded
    size first; a node's pieces then pass one task in order, without being held."""
    pieces = (path.filter("ends").groupBy(*KEY, F.shiftright("conv", PIECE_BITS).alias("piece"))
              .agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))
    return (pieces.repartition(partitions(path.sparkSession), *KEY).sortWithinPartitions(*KEY, "piece")
            .mapInArrow(_hashed, "d long, k1 long, k2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of the given turns (conv, pos from 1 without gaps and a row 0 for each
    conversation, c1, c2, len): conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    path = stage(paths(turns), "trie-paths")
    members = (path.groupBy(*KEY, "p1", "p2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("len").alias("len")))
    members = stage(members, "trie-members")
    children = (members.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    nodes = stage(members.join(children, KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0).cast("long")),
        "leaves": F.col("n_children").isNull().cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("len")}), "trie-nodes")
    deepest = nodes.agg(F.max("d")).first()[0] or 0
    totals = subtree_totals(nodes, path, deepest)
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    return (nodes.join(totals.select(*KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), KEY)
            .join(ending_hashes(path), KEY, "left").join(parents, ["d", "p1", "p2"], "left")
            .select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
                    "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """The trie of all conversations, by default with their openings shared (``shared_openings``).

    Turns with equal numbers are ordered by role and text, repeated rows are turns of their own,
    null roles and texts are empty, rows without conversation id belong to no conversation. An
    empty table has no conversation, so no node.
    """
    turns = stage(ordered_turns(conversations), "trie-turns")
    if rebuild:
        turns = shared_openings(turns)
    else:
        turns = turns.unionByName(turns.select("conv").distinct().select(
            "conv", *[F.lit(0).cast("long").alias(c) for c in turns.columns[1:]]))
    return prefix_trie(turns)
