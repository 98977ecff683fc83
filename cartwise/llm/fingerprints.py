"""Document fingerprints: one-permutation MinHash with optimal densification.

Every five-word shingle is hashed once. The top bits name one of ``BINS`` bins, the
smallest hash of a bin is its value. An empty bin takes the value of a full one by
optimal densification: its own fixed sequence of pseudo-random bins, the same for all
documents, is tried until a full bin comes. Of each value the low ``LOW_BITS`` bits are
stored, packed as hex text; the likeness of two fingerprints is the share of equal
bins, corrected for bins that agree by chance (one in 2 ** LOW_BITS).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwise.llm.common import NO_ID, partitions, texts

SHINGLE = 5
BIN_BITS, LOW_BITS = 8, 8
BINS = 1 << BIN_BITS
#: Probes tried one by one before the whole sequence is searched.
FIRST_PROBES = 6


def _probes() -> list[list[int]]:
    """For each bin the order in which it looks at the others: drawn from a rule with a
    fixed seed, each a full permutation, so every search ends."""
    out = []
    for j in range(BINS):
        order = [k for k in range(BINS) if k != j]
        random.Random(j).shuffle(order)
        out.append(order)
    return out


def _ints(values: list[int], kind: str = "int") -> Column:
    """An array of constants as one literal (folded), not one expression for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the packed fingerprint (hex text) of column ``text``; no words: empty text.

    Words are lower-cased runs without white space; fewer than five words make one shingle.
    """
    words, hashes, mins, slots = (f"_{name}_{k}" for k in ("words", "hashes", "mins", "slots"))
    shingles = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - SHINGLE)),
        lambda i: F.xxhash64(*[F.get(words, i + o) for o in range(SHINGLE)]))
    bin_of = lambda h: F.shiftright(h, 64 - BIN_BITS).cast("int") + BINS // 2
    low = lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))),
                           LOW_BITS // 4, "0")
    none = F.lit(None).cast("string")
    gap = lambda n: F.array_repeat(none, n)
    probes = _probes()
    head = [_ints([p[t] for p in probes]) for t in range(FIRST_PROBES)]
    rest = _ints([x for p in probes for x in p[FIRST_PROBES:]])
    width = BINS - 1 - FIRST_PROBES
    at = lambda j: F.get(slots, j)
    last = F.get(mins, F.size(mins) - 1)
    return (
        df.withColumn(words, F.array_remove(F.split(F.lower(F.col(text)), r"\s+"), ""))
        .withColumn(hashes, F.sort_array(
            F.when(F.size(words) >= SHINGLE, shingles)
            .otherwise(F.array(F.xxhash64(F.array_join(words, " "))))))
        # In sorted order a bin's hashes stand together, the smallest first.
        .withColumn(mins, F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(hashes, i - 1)))))
        .withColumn(slots, F.concat(
            F.flatten(F.transform(mins, lambda h, i: F.concat(
                gap(bin_of(h) - 1 - F.when(i == 0, F.lit(-1)).otherwise(bin_of(F.get(mins, i - 1)))),
                F.array(low(h))))),
            gap(BINS - 1 - bin_of(last))))
        .withColumn(name, F.when(F.size(words) == 0, F.lit("")).otherwise(F.array_join(
            F.transform(slots, lambda v, j: F.coalesce(
                v, *[at(F.get(h, j)) for h in head],
                F.get(F.filter(F.transform(F.slice(rest, j * width + 1, width), at),
                               lambda x: x.isNotNull()), 0))), "")))
        .drop(words, hashes, mins, slots))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance from two packed fingerprints, between 0 and 1. Two without
    words are alike (1), one without words is unlike any other (0)."""
    bins = lambda c: F.regexp_extract_all(c, F.lit("." * (LOW_BITS // 4)), F.lit(0))
    same = F.size(F.filter(F.zip_with(bins(a), bins(b), lambda x, y: x == y), lambda e: e))
    chance = 2.0 ** -LOW_BITS
    return (F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0)
            .otherwise(F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))))


def _ranges(spark: SparkSession, ids: DataFrame) -> list[int]:
    """First ids of consecutive ranges, about four for each shuffle partition: their number
    follows the session, not the data."""
    wanted = 4 * partitions(spark)
    cuts = sorted({int(c) for c in ids.approxQuantile(
        "_id", [i / wanted for i in range(1, wanted)], 0.2 / wanted)})
    cell = F.size(F.filter(_ints(cuts, "long"), lambda c: c <= F.col("_id"))) if cuts else F.lit(0)
    return sorted(r["a"] for r in ids.groupBy(cell.alias("r")).agg(F.min("_id").alias("a")).collect())


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Rows are ordered by doc_id (the key; null first), rows that repeat it by text; the next
    document of a row is that of the next row, after the last the first (a single row is its
    own next). The edited text is the text with its last floor(n_chars / 2) code points
    replaced by as many of the next document's first ones, or all it has. Null texts are
    empty, an empty table gives no rows.

    Texts are fingerprinted where they are read and exchanged once, by ranges of the id. The
    first rows of each range also go to the range before as guests, so the next row is
    always a neighbour in the same range.
    """
    spark = docs.sparkSession
    t = texts(docs).withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
    starts = _ranges(spark, t.select("_id")) or [0]
    at = _ints(starts, "long")
    own = F.size(F.filter(at, lambda a: a <= F.col("_id"))) - 1
    place = lambda n, guest: F.struct(n.alias("range"), F.lit(guest).alias("guest"))
    dealt = (
        with_fingerprint(t, "text", "fingerprint").withColumn("_own", own)
        .withColumn("_to", F.explode(F.when(
            F.get(at, F.col("_own")) == F.col("_id"),
            F.array(place(F.col("_own"), False),
                    place(F.pmod(F.col("_own") - 1, F.lit(len(starts))), True)))
            .otherwise(F.array(place(F.col("_own"), False)))))
        .select("doc_id", "_id", "text", "fingerprint", "_to.range", "_to.guest"))
    order = Window.partitionBy("range").orderBy("guest", "_id", "text")
    paired = (dealt.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(order))
              .filter(~F.col("guest"))
              .withColumn("n_chars", F.length("text").cast("long"))
              .withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
              .withColumn("_edited", F.concat(
                  F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_half")).cast("int")),
                  F.substring("next.text", F.lit(1), F.col("_half"))))
              .select("doc_id", "n_chars", "fingerprint", F.col("next.fingerprint").alias("_next"), "_edited"))
    return with_fingerprint(paired, "_edited", "edited_fingerprint").select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
