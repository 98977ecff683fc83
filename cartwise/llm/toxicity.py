"""Toxicity scoring: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed unigrams, bigrams and skip-grams (one or two words
left out) of the whole text. FTRL-proximal keeps a learning rate per coordinate and an
L1 term, so rare noise stays at exactly zero and the model is a short list of
(coordinate, weight), broadcast to score all rows where they are.

Training is rounds of parallel FTRL: each task runs through its share of the training
rows from the common state, Spark averages the tasks' states per coordinate over the
tasks that touched it, and the next round starts from there. The state has a fixed
size (two numbers per touched coordinate of ``2 ** BITS``); the training rows are a
sample whose expected size is the parameter ``max_train``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import texts
from cartwise.session import stage

BITS = 18
WORD = re.compile(r"[^\W_]+")
ODD = np.uint64(0x9E3779B97F4A7C15)
#: (distance of the second word, salt): bigrams and skip-grams.
PAIRS = ((1, 0x51ED270B), (2, 0x2545F491), (3, 0x6C8E9CF5))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class _Words(dict):
    """Word hashes, remembered up to a fixed number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = (zlib.crc32(word.encode()) * 0x9E3779B1 ^ zlib.adler32(word.encode()[::-1]) << 17) & (1 << 62) - 1
        return h


def features(text: str, words: dict) -> np.ndarray:
    """Sorted distinct coordinates of a text; coordinate 0 is the constant."""
    h = np.fromiter(map(words.__getitem__, WORD.findall(text.lower())), dtype=np.uint64)
    parts = [h]
    for gap, salt in PAIRS:
        if len(h) > gap:
            parts.append(h[:-gap] * np.uint64(salt | 1) + h[gap:])
    all_ = np.concatenate(parts)
    slots = (all_ * ODD >> np.uint64(64 - BITS)).astype(np.int32)
    return np.union1d(slots, np.zeros(1, np.int32))


def _weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    w = (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)
    return np.where(np.abs(z) <= l1, 0.0, w)


def ftrl_pass(rows: Iterator[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray,
              alpha: float, beta: float, l1: float, l2: float) -> None:
    """Runs FTRL-proximal over the rows, in place."""
    for x, y in rows:
        zi, ni = z[x], n[x]
        w = _weights(zi, ni, alpha, beta, l1, l2)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - y
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
        z[x] = zi + g - sigma * w
        n[x] = ni + g * g


def _learner(state, turn: int, passes: int, *rates: float):
    """One task's part of a round: some passes over its own training texts."""
    def learn(batches):
        words = _Words()
        rows = [(features(t, words), int(y)) for b in batches for t, y in zip(b["text"], b["y"])]
        if not rows:
            return
        at, z0, n0 = state.value
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        z[at], n[at] = z0, n0
        before = n.copy()
        for k in range(passes):  # an order that depends on the rows alone, another one each pass
            rows.sort(key=lambda r: zlib.crc32(r[0].tobytes(), turn * passes + k))
            ftrl_pass(rows, z, n, *rates)
        new = np.flatnonzero(n != before)
        yield pd.DataFrame({"at": new, "z": z[new], "n": n[new]})
    return learn


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 24_000, rounds: int = 3, passes: int = 2, shares: int = 3,
        alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0) -> dict[int, float]:
    """Weights learned from labelled rows that are not held out.

    ``max_train`` bounds the expected number of training rows: beyond it a share of them,
    chosen by a hash of the id, is used. Labels other than 0 and 1 are left out. Without
    training rows the model is empty and every score is 0.5.
    """
    spark = docs.sparkSession
    y = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y"))
         .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))))
    total = y.count()
    if not total:
        return {}
    share = min(1.0, max_train / total)
    y = (y.filter(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
         .groupBy("_id").agg(F.max("_y").alias("_y")))

    # Stored as one file, so one task, for each share: the rounds read them where they are.
    train = stage(
        texts(docs).join(F.broadcast(y), F.col("doc_id") == F.col("_id"))  # at most max_train rows
        .select(F.col("_y").alias("y"), "text").repartition(shares), "op3-train")
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for turn in range(rounds):
        at = np.flatnonzero(n)
        state = spark.sparkContext.broadcast((at, z[at], n[at]))
        learn = _learner(state, turn, passes, alpha, beta, l1, l2)
        got = (train.mapInPandas(learn, "at int, z double, n double")
               .groupBy("at").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow())
        at = got["at"].to_numpy()
        z[at], n[at] = got["z"].to_numpy(), got["n"].to_numpy()
        state.destroy()
    w = _weights(z, n, alpha, beta, l1, l2)
    return {int(i): float(w[i]) for i in np.flatnonzero(w)}


def _scorer(spark, weights: dict[int, float]):
    """A column function: text -> probability of label 1."""
    model = spark.sparkContext.broadcast((np.array(list(weights), np.int64), np.array(list(weights.values()))))

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, values = model.value
        w = np.zeros(1 << BITS)
        w[at] = values
        words = _Words()
        for b in batches:
            logit = np.array([w[features(t, words)].sum() for t in b], np.float64)
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))))
    return F.pandas_udf(apply, "double")


def reject(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """The documents that score under 0.5, all columns as they were; null texts score as empty.
    An empty model (no usable training row, or nothing learned) tells nothing and rejects none."""
    if not weights:
        return docs
    p = _scorer(docs.sparkSession, weights)
    return docs.filter(p(F.coalesce(F.col("text").cast("string"), F.lit(""))) < 0.5)


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; see ``score_documents``."""
    p = _scorer(docs.sparkSession, weights)
    return (texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def score_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Fits on the labelled rows outside the held-out fold and scores every whole text.

    Null and empty texts get the score of the constant alone. Repeated rows get equal scores.
    Labels, language, source and id are no features (the id only names the fold).
    """
    return score(docs, fit(docs, labels, **params))
