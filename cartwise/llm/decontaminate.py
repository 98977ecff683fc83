"""Benchmark decontamination by spaced-seed hashing.

Each fixed mask names the token offsets a seed reads; the others are ignored, so a
substituted word breaks only the seeds that read it. Seeds of all training positions
are joined to the seeds of the benchmark, a hit fixes a diagonal (document position
less item position), and every diagonal is verified token by token over the whole
item: it counts when enough of the item's tokens, or of the tokens of a long stretch
of it, stand at their places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import NO_ID, row_key, small, texts
from cartwise.session import stage

#: Token offsets that a seed reads (weight 6, the span differs).
MASKS = [(0, 1, 2, 4, 5, 7), (0, 2, 3, 4, 7, 8), (0, 1, 4, 6, 8, 9)]
SPAN = max(m[-1] for m in MASKS) + 1
GAP = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP), "")


def _seeds(df: DataFrame, at: str) -> DataFrame:
    """One row per position and mask; the hash carries the mask's number. Sequences
    shorter than a mask's span have no seed of it."""
    seeds = F.array(*[F.when(F.col("n") > F.col(at) + m[-1],
                             F.xxhash64(F.lit(i), *[F.get("w", F.col(at) + o) for o in m]))
                      for i, m in enumerate(MASKS)])
    least = min(m[-1] for m in MASKS)
    return (df.withColumn("n", F.size("w")).filter(F.col("n") > least)
            .withColumn(at, F.explode(F.sequence(F.lit(0), F.col("n") - 1 - least)))
            .withColumn("seed", F.explode(seeds)).filter(F.col("seed").isNotNull()))


def _verified(docs: DataFrame, items: DataFrame, similarity: float = 0.7,
              stretch: int = 20, stretch_similarity: float = 0.8) -> DataFrame:
    """The verified diagonals: (doc_id, _id, _th, item_id, diagonal, n_match, n_item, similarity),
    each with the key of its row. See ``contaminated``."""
    bench = (items.select(F.col("item_id").cast("long").alias("item_id"),
                          tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
             .filter(F.size("w") > 0).distinct())
    bench = stage(bench, "op9-items")
    train = row_key(texts(docs)).select("doc_id", "_id", "_th", tokens(F.col("text")).alias("w"))
    least = min(m[-1] for m in MASKS)

    bench_seeds = stage(_seeds(bench, "ipos").select("seed", "item_id", "ipos", F.xxhash64("w").alias("iw")),
                        "op9-seeds")
    hits = (_seeds(train, "dpos").select("_id", "_th", "dpos", "seed")
            .join(small(bench_seeds), "seed")
            .select("_id", "_th", "item_id", "iw", (F.col("dpos") - F.col("ipos")).alias("diagonal")))
    short = bench.filter(F.size("w") <= least)
    lengths = [r[0] for r in short.select(F.size("w")).distinct().collect()]  # <= least values
    if lengths:
        whole = reduce(DataFrame.unionByName, [
            train.filter(F.size("w") >= n).withColumn("diagonal", F.explode(F.sequence(F.lit(0), F.size("w") - n)))
            .select("_id", "_th", "diagonal",
                    F.xxhash64(F.lit(n), *[F.get("w", F.col("diagonal") + i) for i in range(n)]).alias("seed"))
            for n in lengths])
        keys = reduce(DataFrame.unionByName, [
            short.filter(F.size("w") == n)
            .select("item_id", F.xxhash64("w").alias("iw"),
                    F.xxhash64(F.lit(n), *[F.get("w", F.lit(i)) for i in range(n)]).alias("seed"))
            for n in lengths])
        hits = hits.unionByName(whole.join(small(stage(keys, "op9-short")), "seed")
                                .select("_id", "_th", "item_id", "iw", "diagonal"))
    hits = stage(hits.distinct(), "op9-hits")

    # The words around each hit: only documents with a hit come to the verification.
    # Few hits travel to the texts; beyond a million both sides are exchanged.
    item = bench.select("item_id", F.xxhash64("w").alias("iw"), F.col("w").alias("item"))
    places = (train.select("doc_id", "_id", "_th", "w").join(small(hits), ["_id", "_th"])
              .select("doc_id", "_id", "_th", "item_id", "iw", "diagonal", "w").join(small(item), ["item_id", "iw"])
              .select("doc_id", "_id", "_th", "item_id", "item", "diagonal",
                      F.slice("w", F.greatest(F.lit(0), F.col("diagonal")) + 1,
                              F.greatest(F.lit(0), F.size("item") + F.least(F.lit(0), F.col("diagonal"))))
                      .alias("near")))
    lead = F.greatest(F.lit(0), -F.col("diagonal"))
    equal = F.transform("item", lambda t, i: F.when(F.get("near", i - lead) == t, 1).otherwise(0))
    scored = (places.withColumn("equal", equal)
              .withColumn("n_item", F.size("item"))
              .withColumn("n_match", F.aggregate("equal", F.lit(0), lambda a, x: a + x))
              .withColumn("similarity", F.col("n_match") / F.col("n_item")))
    best_stretch = F.when(F.col("n_item") >= stretch, F.array_max(F.transform(
        F.sequence(F.lit(1), F.col("n_item") - (stretch - 1)),
        lambda s: F.aggregate(F.slice("equal", s, stretch), F.lit(0), lambda a, x: a + x)))).otherwise(0)
    kept = scored.filter((F.col("similarity") >= similarity)
                         | (best_stretch >= stretch * stretch_similarity))
    return kept.select("doc_id", "_id", "_th", "item_id", "diagonal", "n_match", "n_item", "similarity")


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.7,
                 stretch: int = 20, stretch_similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_match, n_item, similarity, first_word, n_places) per document and item.

    Tokens are lower-cased runs of letters and digits. A pair is reported when on one diagonal
    at least ``similarity`` of the item's tokens stand in the document, or a window of
    ``stretch`` tokens has ``stretch_similarity`` of them. The values are those of the best
    diagonal, ``n_places`` counts the verified ones. Items with fewer tokens than the shortest
    mask spans are matched whole, as exact token sequences. Null or empty texts and items
    without tokens match nothing, repeated rows are reported once per (doc_id, item_id), an
    empty table on either side gives no rows.
    """
    best = F.max(F.struct("n_match", (-F.col("diagonal")).alias("back"), "n_item", "similarity"))
    return (_verified(docs, items, similarity, stretch, stretch_similarity).groupBy("doc_id", "item_id")
            .agg(best.alias("b"), F.countDistinct("diagonal").alias("n_places"))
            .select("doc_id", "item_id", F.col("b.n_match").cast("long").alias("n_match"),
                    F.col("b.n_item").cast("long").alias("n_item"), "b.similarity",
                    F.greatest(F.lit(0), -F.col("b.back")).cast("long").alias("first_word"), "n_places"))


def decontaminate(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """The documents without a verified overlap, all columns as they were. A row is judged by its
    own text: others of its id, or other rows without an id, don't take it with them."""
    bad = stage(_verified(docs, items, **limits).select("_id", "_th").distinct(), "op9-bad")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
                        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th"), F.struct("*").alias("row"))
    return keyed.join(small(bad), ["_id", "_th"], "left_anti").select("row.*")
