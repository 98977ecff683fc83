"""Exact n-gram Jaccard self-join by grouped prefixes, and its components.

A document is the set of its hashed word n-grams, in one global order: rare first. Two
sets with Jaccard at or over the limit share a member among their first few (the prefix
filter). Documents with equal sets are one class, classes with equal prefix and size one
group. Groups are joined on their prefix members; pairs of groups that pass the size and
position filters are expanded to their classes, pairs of classes pass a bitmap filter (the
bits in which two parity bitmaps differ bound the symmetric difference) and are verified on
their whole sets. Every filter is a bound, so no link is lost.

The order is the count of a member's cell in a fixed-size count sketch over all documents,
then its hash. Any order gives the same links; this one keeps common passages out of
the prefixes, so a hot passage doesn't bring its documents together. (The sketch tells
rare from common the less finely the more shingles there are for each of its cells.)

Components need far fewer links than there are: first classes meet hubs, a few pairs each,
turn by turn, and only pairs of different components are formed after that.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.common import NO_ID, batches_of, small, texts
from cartwise.session import stage

#: Cells of the count sketch, the same number for any input: 32 MB of counts in a task, 16 MB
#: of their logarithms on the driver and in tasks.
SKETCH_BITS = 24
SLICES = 64
BITMAP_WORDS = 8
#: Turns in which classes meet hubs go on while a turn joins more than this share of the
#: classes. It sets how many pairs are left for the exact turn after them, never the result.
HUB_SHARE = 0.03
#: Hubs of a prefix member or group in a turn.
HUBS = 4
#: Groups whose prefix a task remembers to have given out.
GIVEN = 100_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
S33, S29 = np.uint64(33), np.uint64(29)


class _Words(dict):
    """Word hashes, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S33)) * M1
    x = (x ^ (x >> S29)) * M2
    return x ^ (x >> S33)


def shingle_set(text: str, n: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; A-Z lower-cased, words between
    ASCII white space. Fewer words: the whole sequence is the one member; none: empty."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * M2 + h[i:len(h) - k + 1 + i])
    return np.unique(out)


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def order_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many (document, shingle) fall into each cell, over all documents, as an order: the
    counts' logarithms in 255 steps (counts of a task go up to 65,535)."""
    width = (1 << SKETCH_BITS) // SLICES

    def count(batches):
        words, total = _Words(), np.zeros(1 << SKETCH_BITS, np.uint16)
        for b in batches:
            for part in range(0, len(b), 500):
                found = [_cells(shingle_set(t, n, words)) for t in b["text"].iloc[part:part + 500]]
                at, c = np.unique(np.concatenate(found), return_counts=True)
                total[at] = np.minimum(total[at].astype(np.int64) + c, 65_535)
        if total.any():
            yield pd.DataFrame({"slice": range(SLICES), "counts": [
                zlib.compress(total[i * width:(i + 1) * width].tobytes(), 1) for i in range(SLICES)]})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b["slice"], b["counts"]):
                c = np.frombuffer(zlib.decompress(c), np.uint16).astype(np.int64)
                sums[s] = sums[s] + c if s in sums else c
        for s, c in sums.items():
            steps = np.minimum(255, np.ceil(8 * np.log2(c + 1.0))).astype(np.uint8)
            yield pd.DataFrame({"slice": [s], "counts": [steps.tobytes()]})

    per_task = docs.select("text").mapInPandas(count, "slice int, counts binary")
    with batches_of(docs.sparkSession):
        got = per_task.repartition(SLICES, "slice").mapInPandas(merge, per_task.schema).collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in got:
        out[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.uint8)
    return out


def _classes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row: its set's size and identity, its group (a hash of prefix and size) and bitmap. The
    prefix comes with the first row of a group that a task meets, so copies carry it once a task."""
    sketch = docs.sparkSession.sparkContext.broadcast(order_sketch(docs, n))

    def describe(batches):
        words, counts, given = _Words(), sketch.value, set()
        for b in batches:
            rows = []
            for i, t, h in zip(b["_id"], b["text"], b["_th"]):
                s = shingle_set(t, n, words)
                m = _mix(s)
                k = len(s)
                bits = np.zeros(BITMAP_WORDS, np.uint64)
                np.bitwise_xor.at(bits, (m >> np.uint64(58)).astype(np.int64) % BITMAP_WORDS,
                                  np.uint64(1) << (m & np.uint64(63)))
                ranked = s[np.lexsort((s, counts[_cells(s)]))][:k - -(-percent * k // 100) + 1] if k else s
                g = xxhash.xxh64_intdigest(ranked.tobytes(), k) - (1 << 63)
                first = g not in given
                if first and k:
                    given.add(g)
                    if len(given) > GIVEN:
                        given.clear()
                rows.append((i, h, k, int(m.sum(dtype=np.uint64).view(np.int64)),
                             int(np.bitwise_xor.reduce(_mix(m)).view(np.int64)) if k else 0,
                             g, ranked.view(np.int64) if first and k else None, bits.view(np.int64)))
            yield pd.DataFrame(rows, columns=["_id", "_th", "n", "s1", "s2", "g", "prefix", "bits"])

    return docs.select("_id", "_th", "text").mapInPandas(
        describe, "_id long, _th long, n int, s1 long, s2 long, g long, prefix array<long>, bits array<long>")


def _live_postings(rows: DataFrame) -> DataFrame:
    """(member, g, n, pos): the prefix members that two groups or more hold, one row per group and
    member. One exchange by member; the sorted rows are compared with their neighbours only, so a
    member that very many groups hold is never gathered."""
    postings = rows.filter("prefix IS NOT NULL").select("g", "n", F.posexplode("prefix").alias("pos", "member"))
    by = Window.partitionBy("member").orderBy("g")
    once = postings.withColumn("last", F.lag("g").over(by)).filter("last IS NULL OR last <> g").drop("last")
    return (once.withColumns({"before": F.lag("g").over(by), "after": F.lead("g").over(by)})
            .filter("before IS NOT NULL OR after IS NOT NULL").select("member", "g", "n", "pos"))


def _told_apart(live: DataFrame) -> DataFrame:
    """The postings (a stored frame) without the members that tell nothing: of members held by the same groups the first
    in the global order stays. It stands before the others in each of the groups, so every filter lets through with it
    what one of them lets through. Near copies share most of their prefixes, so this leaves few postings of them."""
    holders = live.groupBy("member").agg(
        F.count("*").alias("k"), F.min(F.struct("g", "pos")).alias("at"),
        *[F.bit_xor(F.xxhash64(F.lit(i), "g")).alias(f"x{i}") for i in (1, 2)])
    first = stage(holders.groupBy("k", "x1", "x2", "at.g").agg(F.min(F.struct("at.pos", "member")).alias("first"))
                  .select("first.member"), "op5-first")
    return live.join(small(first), "member", "left_semi")


def _sets(docs: DataFrame, wanted: DataFrame, n: int, repeated: bool) -> DataFrame:
    """(c, set): the whole sets of the wanted classes (c, _id, _th), a stored frame; ``repeated``: there are rows of
    equal id and text."""
    def pack(batches):
        words = _Words()
        for b in batches:
            yield pd.DataFrame({"c": b["c"], "set": [shingle_set(t, n, words).view(np.int64) for t in b["text"]]})

    found = docs.join(small(wanted), ["_id", "_th"]).select("c", "text").mapInPandas(pack, "c long, set array<long>")
    return found.dropDuplicates(["c"]) if repeated else found


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets meet the limit, with the columns they came with."""
    both = (pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("c").alias("b"), F.col("set").alias("sb")), "b")
            .withColumn("both", F.size(F.array_intersect("sa", "sb"))))
    return both.filter(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select(pairs.columns)


def components(edges: DataFrame) -> DataFrame:
    """(c, root) for every end of the edges (a, b); root is the smallest end reachable.

    Every end first keeps the edge to its smallest neighbour only, found by grouping. That
    forest is no larger than the ends and is joined up by stars; edges are then drawn
    between its roots, until none is left. So dense edges never meet in a join of edges."""
    e, known = edges.filter("a <> b").select("a", "b"), None
    while True:
        both = e.union(e.select("b", "a"))
        forest = _stars(both.groupBy("a").agg(F.min("b").alias("b")))
        known = forest if known is None else stage(
            known.join(forest.select(F.col("c").alias("root"), F.col("root").alias("to")), "root", "left")
            .select("c", F.coalesce("to", "root").alias("root")), "cc-known")
        end = lambda s: forest.select(F.col("c").alias(s), F.col("root").alias(f"r{s}"))
        e = stage(e.join(end("a"), "a").join(end("b"), "b").filter("ra <> rb")
                  .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "cc-left")
        if e.isEmpty():
            return known


def _stars(edges: DataFrame) -> DataFrame:
    """(c, root) for every end of an edge, by alternating large and small stars: a hub's
    neighbours are only ever grouped by minimum, never gathered."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
              .filter("u <> v").distinct(), "cc")
    seen = None
    while True:
        sym = e.union(e.select("v", "u"))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        e = stage(small, "cc")
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == seen:
            break
        seen = now
    low = stage(e.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
    return low.select(F.col("u").alias("c"), F.col("m").alias("root")).union(
        low.select(F.col("m").alias("c"), F.col("m").alias("root")).distinct())


def _limit(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of sets of these sizes at the limit."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def _words(sums: DataFrame, name: str) -> list[Column]:
    """The bitmap words of a summary as columns of their own (a join compares very many of them): the bits set in
    all and in any of its bitmaps."""
    return [F.col(f"{kind}{i}").alias(f"{kind}{name}{i}") for kind in ("all", "any") for i in range(BITMAP_WORDS)]


def _summed(nodes: DataFrame, *by: str) -> DataFrame:
    """Classes summed up: their number, least and greatest size, and the bits that all and any of their bitmaps hold."""
    return nodes.groupBy(*by).agg(
        F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"),
        *[F.bit_and(F.col("bits")[i]).alias(f"all{i}") for i in range(BITMAP_WORDS)],
        *[F.bit_or(F.col("bits")[i]).alias(f"any{i}") for i in range(BITMAP_WORDS)])


def _close(na: Column, nb: Column, percent: int, a: str = "a", b: str = "b") -> Column:
    """The bitmap filter for summaries of sets of at most these sizes: bits that all of one and none of the other
    hold bound the symmetric difference."""
    bits = lambda x, y, i: F.bit_count(F.col(f"all{x}{i}").bitwiseAND(F.bitwise_not(F.col(f"any{y}{i}"))))
    differ = sum((bits(a, b, i) + bits(b, a, i) for i in range(BITMAP_WORDS)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (na + nb)


def _alike(na: Column, bitsa: Column, nb: Column, bitsb: Column, percent: int) -> Column:
    """The size and bitmap filters for two sets."""
    differ = sum((F.bit_count(bitsa[i].bitwiseXOR(bitsb[i])) for i in range(BITMAP_WORDS)), F.lit(0))
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & ((100 + percent) * differ <= (100 - percent) * (na + nb)))


def _bounded(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that their sizes and parity bitmaps allow, with their rows."""
    side = lambda s: full.select(F.col("c").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("n", "bits", "size")])
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(_alike(F.col("na"), F.col("bitsa"), F.col("nb"), F.col("bitsb"), percent))
            .select("a", "b", "sizea", "sizeb").distinct())


def _fits(na: Column, pa: Column, nb: Column, pb: Column, percent: int) -> Column:
    """The size and position filters for groups that share a member at these places."""
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & (F.least(na - pa, nb - pb) >= _limit(na, nb, percent)))


def _mixed(live: DataFrame, nodes: DataFrame) -> DataFrame:
    """The postings with their groups' roots, of members that several roots hold."""
    posted = live.join(nodes.select("g", "root").distinct(), "g")
    mixed = posted.groupBy("member").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    return posted.join(mixed.select("member"), "member")


def _hub_pairs(live: DataFrame, nodes: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of classes to try first, a few for each class: a class with the hubs of its group, and a group's
    first hub with the hubs of each prefix member. Only different roots that size, position and bitmap filters allow."""
    pick = lambda i, *cols: F.min_by(F.struct(*cols), F.xxhash64("c", F.lit(turn * HUBS + i)))
    picked = lambda rows, by, *cols: (rows.groupBy(by).agg(F.array(*[pick(i, *cols) for i in range(HUBS)]).alias("hubs"))
                                      .select(by, F.explode(F.array_distinct("hubs")).alias("hub")))
    pair = [F.least("c", "hub.c").alias("a"), F.greatest("c", "hub.c").alias("b")]
    near = ((F.col("root") != F.col("hub.root"))
            & _alike(F.col("n"), F.col("bits"), F.col("hub.n"), F.col("hub.bits"), percent))
    shared = nodes.join(nodes.groupBy("g").count().filter("count > 1").select("g"), "g")
    inside = shared.join(picked(shared, "g", "c", "n", "root", "bits").withColumnRenamed("g", "hg"),
                         (F.col("g") == F.col("hg")) & near).select(*pair)
    first = nodes.groupBy("g").agg(pick(0, "c", "root", "bits").alias("top")).select("g", "top.*")
    posted = stage(_mixed(live, nodes).select("member", "g", "n", "pos").distinct().join(first, "g").drop("g"), "op5-hubs")
    across = posted.join(picked(posted, "member", "c", "n", "pos", "root", "bits").withColumnRenamed("member", "hm"),
                         (F.col("member") == F.col("hm")) & near & _fits(
                             F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent)).select(*pair)
    return inside.union(across).distinct()


def _group_pairs(live: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Every pair of classes that the prefix, size and position filters allow."""
    x, y = (live.select("member", F.col("g").alias(f"g{s}"), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"p{s}"))
            for s in "ab")
    groups = (x.join(y, "member").filter((F.col("ga") < F.col("gb")) & _fits(
        F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent)).select("ga", "gb").distinct())
    # Expand to classes; a group also meets itself.
    side = lambda s: nodes.select(F.col("g").alias(f"g{s}"), F.col("c").alias(s))
    across = groups.join(side("a"), "ga").join(side("b"), "gb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    own = nodes.join(nodes.groupBy("g").count().filter("count > 1").select("g"), "g")
    half = lambda s: own.select("g", F.col("c").alias(s))
    return across.union(half("a").join(half("b"), "g").filter("a < b").select("a", "b"))


def _cross_pairs(live: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Every pair of classes of different roots that the prefix, size, position and bitmap filters allow.

    Roots are paired first: for each member and size band a root is summed up by its range of sizes
    and its longest rest behind the member (and, if it is a single class, its bitmap), so no pair inside
    a root is formed and a pair of roots is dropped where it meets, before its groups are joined to it.
    Sizes that the limit allows lie in the same band or in neighbours."""
    posted = stage(_mixed(live, nodes), "op5-mixed")
    width = math.log(100 / percent * 1.0001)
    band = F.floor(F.log(F.col("n")) / F.lit(width)).cast("int")
    sums = stage(_summed(nodes, "root").drop("lo", "hi"), "op5-root-sums")
    roots = stage(posted.groupBy("member", "root", band.alias("band")).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"))
        .join(sums, "root"), "op5-roots-by-member")
    of = lambda s, b: roots.select("member", b, *[F.col(c).alias(f"{c}{s}") for c in ("root", "lo", "hi", "rest", "k")],
                                *_words(roots, s))
    # Of two sets the smaller one shares its shortest enough members only (its rest bounds the intersection).
    index = F.col("resta") >= _limit(F.col("loa"), F.col("loa"), percent)
    above = F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band")  # b is the larger one
    first = F.struct(F.col("ka"), F.col("roota")) < F.struct(F.col("kb"), F.col("rootb"))
    meet = (of("a", F.col("band")).filter(index).join(of("b", above), ["member", "band"])
            .filter((F.col("roota") != F.col("rootb")) & (F.col("loa") <= F.col("hib"))
                    & (100 * F.col("hia") >= percent * F.col("lob"))
                    & (F.least("resta", "restb") >= _limit(F.col("loa"), F.col("lob"), percent))
                    & _close(F.col("hia"), F.col("hib"), percent))
            .select("member", F.when(first, F.col("roota")).otherwise(F.col("rootb")).alias("ra"),
                    F.when(first, F.col("rootb")).otherwise(F.col("roota")).alias("rb"),
                    (F.greatest("ka", "kb") == 1).alias("plain")).distinct())
    meet = stage(meet, "op5-meet")
    # Two roots of one class each are a pair as they are; others meet group by group, the root of fewer classes
    # first, and what the groups' bitmaps don't allow is dropped where they meet.
    plain = meet.filter("plain").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    meet = meet.filter("NOT plain").select("member", "ra", "rb")
    parts = _summed(nodes, "g", "root").drop("k", "lo", "hi")
    side = lambda s: (posted.join(meet.select("member", F.col(f"r{s}").alias("root")).distinct(), ["member", "root"])
                      .join(parts, ["g", "root"])
                      .select(F.col("member").alias(f"m{s}"), *[F.col(c).alias(f"{c[0]}{s}") for c in ("root", "g", "n", "pos")],
                              *_words(parts, s)))
    b = side("b").withColumnRenamed("rb", "hb")
    groups = (meet.join(side("a").withColumnRenamed("ma", "member"), ["member", "ra"])
              .join(b, (F.col("member") == F.col("mb")) & (F.col("rb") == F.col("hb"))
                    & _fits(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent)
                    & _close(F.col("na"), F.col("nb"), percent))
              .select("ra", "ga", "rb", "gb").distinct())
    # Expand the groups' parts to their classes; a group of several roots also meets itself.
    end = lambda s: nodes.select(F.col("root").alias(f"r{s}"), F.col("g").alias(f"g{s}"), F.col("c").alias(s))
    across = groups.join(end("a"), ["ra", "ga"]).join(end("b"), ["rb", "gb"]).select("a", "b")
    split = nodes.join(nodes.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                       .filter("lo < hi").select("g"), "g")
    half = lambda s: split.select(F.col("g").alias(f"g{s}"), *[F.col(c).alias(f"{c}{s}") for c in ("c", "root", "n", "bits")])
    within = half("a").join(half("b"), (F.col("ga") == F.col("gb")) & (F.col("roota") < F.col("rootb")) & _alike(
        F.col("na"), F.col("bitsa"), F.col("nb"), F.col("bitsb"), percent)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    return plain.union(across).union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _merged(across: DataFrame) -> DataFrame:
    """(root, to) of linked roots (a, b): each joins its neighbour of most links, if that has more than itself (then the
    smaller one), so what a hub links goes to it in one turn; and that one's choice."""
    both = across.union(across.select("b", "a")).distinct()
    links = both.groupBy("a").agg(F.struct((-F.count("*")).alias("k"), F.col("a").alias("root")).alias("own"))
    best = (both.join(links.select(F.col("a").alias("b"), F.col("own").alias("other")), "b")
            .groupBy("a").agg(F.min("other").alias("other")).join(links, "a").filter("other < own")
            .select(F.col("a").alias("root"), F.col("other.root").alias("to")))
    step = best.select(F.col("root").alias("to"), F.col("to").alias("next"))
    return best.join(step, "to", "left").select("root", F.coalesce("next", "to").alias("to"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, _id, _th) for every row.

    Two rows link when 100 * intersection >= percent * union of their shingle sets.
    ``component_id`` is the smallest doc_id reachable by links, ``n_links`` the number of other
    rows linked directly. Rows without words (null and empty texts too) link with nothing.
    Repeated rows are rows with equal sets. A null doc_id counts as the smallest and gives a
    null component_id. An empty table gives no rows.

    A group of near copies has links in the square of its size, and their number takes
    them all. Without ``count_links`` (no ``n_links`` then) classes are verified with a few hubs
    first, and then only the pairs that no chain of links joins yet: components stay exact.
    """
    d = texts(docs).select("text", F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_th"))
    with batches_of(docs.sparkSession):
        rows = stage(_classes(d, words, percent).withColumn("c", F.xxhash64("n", "s1", "s2")), "op5-rows")
    classes = stage(rows.filter("n > 0").groupBy("c", "n", "g").agg(
        F.min(F.struct("_id", "_th")).alias("rep"), F.count("*").alias("size")), "op5-classes")
    live = stage(_told_apart(stage(_live_postings(rows), "op5-live")), "op5-told-apart")
    repeated = not rows.groupBy("_id", "_th").count().filter("count > 1").isEmpty()
    groups = live.select("g").union(classes.groupBy("g").count().filter("count > 1").select("g")).distinct()
    few = stage(classes.join(groups, "g").select("g", "n", "c", "size", "rep._id", "rep._th")
                .join(rows.select("_id", "_th", "bits").distinct(), ["_id", "_th"]), "op5-few")

    roots, known_sets, links, turn = stage(few.select("c", F.col("c").alias("root")), "op5-roots"), None, None, 0
    total, exact = few.count(), count_links
    while True:
        nodes = stage(few.select("g", "n", "c", "bits").join(roots.select("c", "root"), "c"), "op5-nodes")
        pairs = stage(_bounded(_group_pairs(live, few, percent), few, percent) if count_links else
                      _cross_pairs(live, nodes, percent) if exact else _hub_pairs(live, nodes, turn, percent), "op5-pairs")
        ends = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
        wanted = few.join(ends, "c", "left_semi").select("c", "_id", "_th")
        if known_sets is not None:
            wanted = wanted.join(known_sets.select("c"), "c", "left_anti")
        wanted = stage(wanted, "op5-wanted")
        with batches_of(docs.sparkSession):
            more = stage(_sets(d, wanted, words, repeated), "op5-sets")
        known_sets = more if known_sets is None else known_sets.union(more)
        ends = stage(ends, "op5-ends")
        links = stage(_verified(pairs, known_sets.join(small(ends), "c", "left_semi"), percent), "op5-links")
        of = lambda s: roots.select(F.col("c").alias(s), F.col("root").alias(f"r{s}"))
        across = links.join(of("a"), "a").join(of("b"), "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        if exact:
            if across.isEmpty():
                break
            merged = components(across).select(F.col("c").alias("root"), F.col("root").alias("to"))
        else:  # hubs need no closure: what this leaves apart the next turn finds
            merged = _merged(across)
        roots = stage(roots.select("c", "root").join(merged, "root", "left").select(
            "c", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "op5-roots")
        if exact:
            break
        turn, exact = turn + 1, roots.filter("moved").count() <= HUB_SHARE * total

    labelled = classes.select("c", "size", F.col("rep._id").alias("low")).join(roots.select("c", "root"), "c", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "c"))
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component"))
    known = labelled.join(lowest, "root").select("c", "component", "size")
    if count_links:
        degree = (links.select(F.col("a").alias("c"), F.col("sizeb").alias("w"))
                  .union(links.select("b", "sizea")).groupBy("c").agg(F.sum("w").alias("others")))
        known = known.join(degree, "c", "left").withColumn(
            "n_links", F.col("size") - 1 + F.coalesce("others", F.lit(0)))
    known = stage(known.drop("size"), "op5-known")
    no_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    degree = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return (rows.select("_id", "_th", "n", "c").join(known, "c", "left")
            .withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id")))
            .select(no_id("_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                    no_id("component").alias("component_id"), *degree, "_id", "_th"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id (then text hash); of
    repeated rows one. Rows without words all stay. Columns as they were, whatever their names."""
    found = stage(jaccard_components(docs, words, percent, count_links=False).withColumn(
        "k", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", F.lit(NO_ID)))), "op5-found")
    first = found.filter(F.col("k").isNotNull()).groupBy("k").agg(F.min(F.struct("_id", "_th")).alias("r"))
    gone = stage(found.join(first, "k").filter(F.struct("_id", "_th") != F.col("r")).select("_id", "_th").distinct(), "op5-gone")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
                        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th"), F.struct("*").alias("row"))
    # The keys of what goes are few and short: whole texts are not dealt out by them.
    kept = keyed.join(small(gone), ["_id", "_th"], "left_anti")
    twice = stage(found.filter(F.col("k").isNotNull()).groupBy("_id", "_th").count().filter("count > 1")
                  .select("_id", "_th"), "op5-twice")
    if not twice.isEmpty():
        kept = kept.join(small(twice), ["_id", "_th"], "left_anti").unionByName(
            kept.join(small(twice), ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]))
    return kept.select("row.*")
