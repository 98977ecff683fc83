"""Importance resampling of documents towards the distribution of a target set.

Features are runs of consecutive words; each falls into one of a fixed number of buckets
by the CRC-32 of its bytes. Every bucket has a gain, the log ratio of its shares in the
target and in the documents; a document's weight is the mean gain of its features, and
Gumbel noise from its id turns "the highest scores" into a draw without replacement.

CRCs are computed a batch at a time: the distinct features of a batch, grouped by equal
length, are two-dimensional byte arrays, whose columns update the CRCs of all rows at
once, and the buckets are scattered back to the places of the features.

The corpus goes by twice, text never leaves the task that reads it: bucket counts first
(at most ``buckets`` rows from a task), weights next. Scores are whole numbers of
thousandths of a log ratio, so there are at most some 115,000 different ones whatever
the input, and ranks come from counts per score, not from one global sort.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.common import texts
from cartwise.session import stage

#: Bytes after folding: A-Z lower-cased, separators (ASCII other than letters and digits) blank.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
             for b in range(256))
#: Bytes of text whose features are held at once, and features whose buckets are remembered.
CHUNK_BYTES, MEMO = 4 << 20, 500_000
#: Longer features are cut into blocks of this many bytes, all of which form one matrix.
BLOCK = 512
#: Rows of one score and id that are numbered by one task.
CELL_BITS = 20


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


TABLE = _table()


def _columns(rows: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The CRC states of all rows of a byte matrix, from the states before it, column by column."""
    for column in np.ascontiguousarray(rows.T):
        crc = TABLE[(crc ^ column) & 0xFF] ^ crc >> 8
    return crc


def _long_crcs(items: list[bytes]) -> np.ndarray:
    """CRC-32 of items of over BLOCK bytes. Zero bytes in front of a zero state change nothing and
    inverting the first four bytes stands for the usual start, so items are filled up at the front."""
    raw = [bytes(x ^ 0xFF for x in i[:4]) + i[4:] for i in items]
    raw = [bytes(-len(i) % BLOCK) + i for i in raw]
    blocks = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, BLOCK)
    own = _columns(blocks, np.zeros(len(blocks), np.uint32))
    # a state moved over BLOCK zero bytes, by each of its bits
    moved = _columns(np.zeros((32, BLOCK), np.uint8), np.uint32(1) << np.arange(32, dtype=np.uint32)).tolist()
    out, at = [], 0
    own = own.tolist()
    for i in raw:
        state = 0
        for _ in range(len(i) // BLOCK):
            ahead = own[at]
            while state:
                low = state & -state
                ahead ^= moved[low.bit_length() - 1]
                state ^= low
            state, at = ahead, at + 1
        out.append(state ^ 0xFFFFFFFF)
    return np.array(out, np.uint32)


def crc32_all(items: list[bytes]) -> np.ndarray:
    """The CRC-32 of every item, by one matrix for each length."""
    out = np.zeros(len(items), np.uint32)
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    order = np.argsort(np.minimum(lengths, BLOCK + 1), kind="stable")
    cuts = np.flatnonzero(np.diff(np.minimum(lengths[order], BLOCK + 1))) + 1
    for at in np.split(order, cuts):
        if not len(at):
            continue
        group, n = [items[i] for i in at.tolist()], int(lengths[at[0]])
        if n > BLOCK:
            out[at] = _long_crcs(group)
        else:
            rows = np.frombuffer(b"".join(group), np.uint8).reshape(len(at), n)
            out[at] = ~_columns(rows, np.full(len(at), 0xFFFFFFFF, np.uint32))
    return out


def words(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def features(found: list[bytes], shortest: int, longest: int) -> list[bytes]:
    """Runs of ``shortest`` to ``longest`` consecutive words, repeats included."""
    if longest == shortest == 1:
        return found
    return [b" ".join(found[i:i + n]) for n in range(shortest, longest + 1) for i in range(len(found) - n + 1)]


class _Buckets(dict):
    """Feature -> bucket, for the features seen of late."""

    def learn(self, lists: list[list[bytes]], buckets: int) -> None:
        if len(self) > MEMO:
            self.clear()
        new = list(set(chain.from_iterable(lists)).difference(self))
        self.update(zip(new, (crc32_all(new) % np.uint32(buckets)).tolist()))


def _chunks(column: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in column:
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def bucketed(column: pa.Array, buckets: int, runs: tuple[int, int], memo: _Buckets) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """For some documents at a time: their numbers of words, and the buckets of their features."""
    for chunk in _chunks(column):
        split = [words(t) for t in chunk]
        lists = [features(w, *runs) for w in split]
        memo.learn(lists, buckets)
        yield [len(w) for w in split], [np.fromiter(map(memo.__getitem__, f), np.int64, len(f)) for f in lists]


def bucket_counts(docs: DataFrame, buckets: int, runs: tuple[int, int]) -> np.ndarray:
    """How many features of all texts fall into each bucket: one number per bucket comes back."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memo = np.zeros(buckets, np.int64), _Buckets()
        for b in batches:
            for _, found in bucketed(b.column("text"), buckets, runs, memo):
                total += np.bincount(np.concatenate(found), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    got = (docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
           .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    k, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_corpus + k) / ((s + 1.0) * (all_target + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: tuple[int, int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, memo = model.value, _Buckets()
        for b in batches:
            n_words, n, weight = [], [], []
            for w, found in bucketed(b.column("text"), len(g), runs, memo):
                n_words += w
                n += [len(f) for f in found]
                weight += [int(g[f].sum()) // len(f) if len(f) else 0 for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n, weight))],
                names=["doc_id", "n_words", "n_features", "weight"])

    return (docs.select("doc_id", F.col("text").cast("binary").alias("text"))
            .mapInArrow(apply, "doc_id long, n_words long, n_features long, weight long"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel variate, rounded down, from a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Adds ``rank`` to the ``percent`` of the eligible rows with the highest scores.

    ``scored`` is stored and has a distinct ``_row`` per row. Ties go to the smaller id (null
    first), then to the earlier row. Counts per score say where each score's ranks begin; within
    a score the rows are numbered in cells, so that no task orders more than one cell's rows.
    """
    eligible = scored.filter(F.col("n_words") >= min_words)
    every = Window.orderBy(F.desc("score"))  # over the different scores, of which there are few
    starts = stage(eligible.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
                   .withColumn("above", F.sum("n").over(every) - F.col("n")), "resample-scores")
    total = starts.agg(F.sum("n")).first()[0] or 0
    drawn = percent * total // 100
    last = starts.filter(F.col("above") < drawn).agg(F.min("score")).first()[0]
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    inside = (F.col("n_words") >= min_words) & (F.col("score") >= last)
    top = scored.filter(inside).withColumn("_cell", F.shiftright("_row", CELL_BITS))
    before = (top.groupBy("score", "doc_id", "_cell").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), "_cell")) - F.col("_n"))
              .join(F.broadcast(starts.select("score", "above")), "score")
              .select("score", F.col("doc_id").alias("_id"), F.col("_cell").alias("_c"), (F.col("above") + F.col("_before")).alias("_start")))
    number = F.row_number().over(Window.partitionBy("score", "doc_id", "_cell").orderBy("_row"))
    top = (top.withColumn("_number", number).alias("t")
           .join(before.alias("b"), (F.col("t.score") == F.col("b.score")) & F.col("doc_id").eqNullSafe(F.col("_id"))
                 & (F.col("_cell") == F.col("_c"))))
    rank = F.col("_start") + F.col("_number")
    top = top.select(*[F.col(f"t.{c}") for c in scored.columns], F.when(rank <= drawn, rank).alias("rank"))
    return top.unionByName(scored.filter(~inside).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, runs: tuple[int, int] = (1, 1), buckets: int = 10_000,
             min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null where it isn't drawn.

    Null and empty texts have no features and weight 0. A null id hashes as the empty text.
    Equal texts have equal weights; repeated rows have equal scores and ranks of their own.
    An empty target leaves only the corpus' own frequencies to weigh by; without documents
    the result is empty.
    """
    docs, goal = texts(docs), texts(target, id_col="item_id")
    gain = gains(bucket_counts(docs, buckets, runs), bucket_counts(goal, buckets, runs))
    scored = stage(weigh(docs, gain, runs).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
                   .withColumn("_row", F.monotonically_increasing_id()), "resample-scored")
    return ranked(scored, percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")
