"""Removal of repeated 400-byte strings by merged Burrows-Wheeler transforms.

1. Candidates. Every 400-byte string holds 337 64-byte grams; the one with the least hash
   (the leftmost of equals) is its anchor. Equal strings have equal anchors, so only runs
   of strings whose anchor hash occurs more than once can repeat; all others are settled.
2. Transforms. The runs' bytes are dealt by anchor to tasks, bounded bytes each, an anchor with
   very many runs to several. A task builds the transforms of shards of its strings and merges
   them by iterative interleave refinement (``transforms``): intervals of two suffixes or more
   at depth 400 are the repeated strings, neighbouring repeated starts one span. All strings
   of an anchor that lies in one task are settled there.
3. Anchors of several tasks. Each task gives one row for each different string; rows with equal
   bytes meet in a grouping by the string itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.common import NO_ID, texts
from cartwise.llm.transforms import merged_intervals
from cartwise.session import stage

LENGTH = 400
GRAM = 64
SPAN = LENGTH - GRAM + 1
CHUNK = 1 << 22
TASK_BYTES = 1 << 20
#: Runs of one anchor that a task takes; more are dealt over several.
ANCHOR_RUNS = 2048
_C = [np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1) for i in range(6)]
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A5A5A5)
S32 = np.uint64(32)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position."""
    x = _BYTE[data]
    for i in range(6):
        x = x[:-(1 << i)] * _C[i] + x[1 << i:]
        if i in (2, 5):
            x = (x ^ (x >> S32)) * _C[0]
    return x ^ (x >> S32)


def anchor_runs(data: np.ndarray):
    """(hash, first, last): runs of string starts with one anchor, over the whole text."""
    out = []
    for c in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
        x = gram_hashes(data[c:c + CHUNK + LENGTH - 1])
        n = len(x) - SPAN + 1
        low = np.uint64((1 << 23) - 1)
        key = (x & ~low) | np.arange(len(x), dtype=np.uint64)
        pad = np.full(-(-len(x) // SPAN) * SPAN, np.iinfo(np.uint64).max, np.uint64)
        pad[:len(x)] = key
        blocks = pad.reshape(-1, SPAN)
        head = np.minimum.accumulate(blocks, axis=1).ravel()
        tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(tail[:n], head[SPAN - 1:SPAN - 1 + n]) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out.append((x[at[first]].view(np.int64), first + c, np.r_[first[1:], n] - 1 + c))
    return tuple(np.concatenate(k) for k in zip(*out))


def _repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    """One task's runs: spans of locally repeated strings, and the strings that other tasks may hold."""
    # Equal contexts stand for each other; each is read once.
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(c, len(seen)) for c in pdf["bytes"]], np.int64)
    copies = np.bincount(which)
    shared = np.zeros(len(seen), bool)
    np.logical_or.at(shared, which, pdf["shared"].to_numpy())
    contexts = list(seen)
    circles, places, interval = merged_intervals(contexts, LENGTH)
    base, owners = circles.base, circles.owner
    starts = circles.place[circles.offset <= circles.size - LENGTH]
    owner = owners[starts]
    # A number for each different string: those of the intervals, then the ones that stand once.
    block = np.full(len(circles.data), -1, np.int64)
    block[places] = interval
    lone = starts[block[starts] < 0]
    block[lone] = (interval[-1] if len(interval) else 0) + 1 + np.arange(len(lone))
    of = block[starts]
    weight = np.bincount(of, copies[owner])
    again = weight[of] > 1  # for each start, in text order
    rows = []
    # Neighbouring repeated starts of a context are one interval.
    edge = np.flatnonzero(again & np.r_[True, ~again[:-1] | (owner[1:] != owner[:-1])])
    stop = np.flatnonzero(again & np.r_[~again[1:] | (owner[1:] != owner[:-1]), True])
    spans: dict[int, list] = {}
    for s, e in zip(edge, stop):
        spans.setdefault(int(owner[s]), []).append((int(starts[s] - base[owner[s]]), int(starts[e] - base[owner[e]])))
    for th, a, w in zip(pdf["th"], pdf["a"], which):
        rows += [(th, a + s, a + e + LENGTH, None, None) for s, e in spans.get(int(w), ())]
    # One row for each different string with an anchor that other tasks hold too.
    first = np.unique(of, return_index=True)[1]
    first = first[shared[owner[first]]]
    if len(first):
        where = {}
        for th, a, w in zip(pdf["th"], pdf["a"], which):
            where.setdefault(int(w), (th, a))
        for i in first:
            p, (th, a) = int(starts[i]), where[int(owner[i])]
            at = int(a + p - base[owner[i]])
            rows.append((th, at, at + LENGTH, circles.data[p:p + LENGTH].tobytes(), int(weight[of[i]])))
    return pd.DataFrame(rows, columns=["th", "s", "e", "string", "n"])


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): per row (doc_id, _id, th, n_bytes); per repeated text (th, spans), the
    maximal runs of covered bytes as a sorted array of (s, e)."""
    d = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "text",
                           F.xxhash64("text").alias("th"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = stage(d.drop("text"), "op6-rows")
    # A text that stands twice is covered by its copy; one row of it speaks for all.
    reps = stage(rows.filter(F.col("n_bytes") >= LENGTH).groupBy("th").agg(
        F.min("_id").alias("rep"), F.count("*").alias("copies"), F.max("n_bytes").alias("n")), "op6-reps")

    def find(batches):
        for b in batches:
            parts = []
            for th, t in zip(b["th"], b["text"]):
                h, first, last = anchor_runs(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))
                parts.append(pd.DataFrame({"th": th, "h": h, "a": first, "b": last}))
            if parts:
                yield pd.concat(parts)

    runs = stage(d.filter(F.col("n_bytes") >= LENGTH).select("th", "text")
                 .mapInPandas(find, "th long, h long, a long, b long").distinct(), "op6-runs")
    repeated = stage(runs.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "op6-anchors")
    found = stage(runs.join(repeated, "h"), "op6-candidates")
    total = found.agg(F.sum(F.col("b") - F.col("a") + LENGTH)).first()[0] or 0
    shards = max(1, -(-total // TASK_BYTES))
    parts = F.ceil(F.col("m") / ANCHOR_RUNS)
    dealt = found.select(
        "th", "a", "b", (parts > 1).alias("shared"),
        F.pmod(F.xxhash64("h", F.pmod(F.xxhash64("th", "a"), parts)), F.lit(shards)).alias("shard"))
    per_text = (dealt.groupBy("th").agg(F.collect_list(F.struct("a", "b", "shared", "shard")).alias("runs"))
                .join(reps.select("th", F.col("rep").alias("_id")), "th"))

    def cut(batches):
        for b in batches:
            out = []
            for th, t, rs in zip(b["th"], b["text"], b["runs"]):
                data = t.encode("utf-8", "surrogatepass")
                out += [(r["shard"], th, r["a"], r["shared"], data[r["a"]:r["b"] + LENGTH]) for r in rs]
            yield pd.DataFrame(out, columns=["shard", "th", "a", "shared", "bytes"])

    contexts = (d.select("_id", "th", "text").join(per_text, ["th", "_id"]).select("th", "text", "runs")
                .mapInPandas(cut, "shard long, th long, a long, shared boolean, bytes binary"))
    local = stage(contexts.groupBy("shard").applyInPandas(
        _repeats, "th long, s long, e long, string binary, n long"), "op6-shards")

    alive = local.filter(F.col("n").isNotNull())
    more = alive.groupBy("string").agg(F.sum("n").alias("all")).filter("all > 1").select("string")
    alive = alive.join(more, "string", "left_semi")
    # A text that stands several times is one run here but covered as a whole.
    whole = reps.filter("copies > 1").select("th", F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))
    spans = (local.filter(F.col("n").isNull()).select("th", "s", "e")
             .union(alive.select("th", "s", "e")).union(whole))
    order = Window.partitionBy("th").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (spans.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1))
              .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("th", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
              .groupBy("th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")))
    return rows, stage(merged, "op6-spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Each byte covered by a 400-byte string that also starts anywhere else (same document
    included, judged on the input) is removed; strings never cross documents. Null texts are
    empty; texts under 400 bytes keep all; repeated rows of 400 bytes or more lose all their
    bytes, as each is covered by the other; an empty table gives no rows.
    """
    _, spans = removed_spans(docs)
    gaps = F.col("spans")
    some = spans.select("th", "spans")
    elements = some.agg(F.sum(F.size("spans"))).first()[0] or 0
    if elements <= 1_000_000:
        some = F.broadcast(some)
    t = texts(docs).select("doc_id", F.col("text").cast("binary").alias("data"),
                           F.xxhash64("text").alias("th")).join(some, "th", "left")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(gaps, lambda x: x["e"]))
    ends = F.concat(F.transform(gaps, lambda x: x["s"]), F.array(F.octet_length("data").cast("long")))
    piece = lambda p: F.substring("data", (p["a"] + 1).cast("int"), (p["z"] - p["a"]).cast("int"))
    kept = F.unhex(F.array_join(F.zip_with(  # joined as text, in one go
        starts, ends, lambda a, z: F.hex(piece(F.struct(a.alias("a"), z.alias("z"))))), ""))
    removed = F.aggregate(gaps, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return t.select(
        "doc_id", F.octet_length("data").cast("long").alias("n_bytes"),
        F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size(gaps), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2(F.when(gaps.isNull(), F.col("data")).otherwise(kept), 256).alias("kept_sha256"))
