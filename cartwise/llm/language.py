"""Language identification: a bidirectional gated recurrent network over the bytes of a text.

A text's UTF-8 bytes are read in consecutive windows of ``WINDOW`` bytes, all of them, by
two gated recurrent layers, one forwards and one backwards; each window starts from state
zero. At every byte the two states give a probability of each language. A document's
probabilities are the mean over its bytes; ``label_spans`` returns the labels of the bytes.

The network is trained in numpy by backpropagation through time, from a bounded sample:
of each of the ``max_langs`` most frequent languages an expected ``per_lang`` documents,
of each document ``per_doc`` windows. A round is a Spark job: each task runs Adam over its
share of the windows from the common weights (a fixed number of floats), which are then
averaged. Windows of many texts go through the network side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import texts
from cartwise.llm.toxicity import held_out
from cartwise.session import stage

WINDOW = 64
HIDDEN = 12
#: Stands after the last byte of a text. Its update gate is open, so it leaves the state as it is.
PAD, OPEN = 256, 30.0
#: Windows that go through the network together, and bytes of text held at once.
BLOCK, CHUNK_BYTES = 2048, 4 << 20
UNDETERMINED = "und"


def shapes(k: int) -> list[tuple[int, ...]]:
    """For each direction: input rows of reset, update and candidate, their state matrices, output; then the output's constant."""
    one = [(PAD + 1, HIDDEN)] * 3 + [(HIDDEN, HIDDEN)] * 3 + [(HIDDEN, k)]
    return [*one, *one, (k,)]


def unpack(flat: np.ndarray, k: int) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(k):
        n = int(np.prod(s))
        out.append(flat[at:at + n].reshape(s))
        at += n
    return out


def initial(k: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = np.concatenate([(rng.standard_normal(s) * (0.3 if len(s) > 1 else 0)).ravel() for s in shapes(k)]).astype(np.float32)
    for p in (1, 8):
        unpack(flat, k)[p][PAD] = OPEN
    return flat


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _layer(x: np.ndarray, p: list[np.ndarray]) -> tuple[np.ndarray, list]:
    """The states at every step of one direction; x is (steps, windows). Also what learning needs."""
    er, ez, en, ur, uz, un, _ = p
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    states, kept = [], []
    for row in x:
        r, z, u = sigmoid(er[row] + h @ ur), sigmoid(ez[row] + h @ uz), h @ un
        n = np.tanh(en[row] + r * u)
        kept.append((h, r, z, n, u))
        h = n + z * (h - n)
        states.append(h)
    return np.stack(states), kept


def _layer_gradient(x: np.ndarray, p: list[np.ndarray], kept: list, d_states: np.ndarray) -> list[np.ndarray]:
    """Backpropagation through the steps: the gradients of the layer's input rows and state matrices."""
    *_, ur, uz, un, _ = p
    carried = np.zeros_like(d_states[0])
    grads = []
    for (h, r, z, n, u), d in zip(reversed(kept), d_states[::-1]):
        dh = d + carried
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * u * r * (1 - r)
        du = dn * r
        carried = dh * z + dr @ ur.T + dz @ uz.T + du @ un.T
        grads.append((dr, dz, dn, du))
    dr, dz, dn, du = (np.concatenate(g) for g in zip(*grads))
    at, h = x[::-1].ravel(), np.concatenate([k[0] for k in reversed(kept)])
    rows = [np.stack([np.bincount(at, g[:, j], PAD + 1) for j in range(HIDDEN)], 1) for g in (dr, dz, dn)]
    rows[1][PAD] = 0  # stays open
    return [*rows, h.T @ dr, h.T @ dz, h.T @ du]


def gradient(x: np.ndarray, y: np.ndarray, flat: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """Mean cross entropy over all bytes of the windows x (steps, windows) with labels y, and its gradient."""
    p = unpack(flat, k)
    forward, kept_f = _layer(x, p[:7])
    backward, kept_b = _layer(x[::-1], p[7:14])
    backward = backward[::-1]
    logits = forward @ p[6] + backward @ p[13] + p[14]
    e = np.exp(logits - logits.max(-1, keepdims=True))
    prob = e / e.sum(-1, keepdims=True)
    real = (x != PAD)[..., None] / np.float32(max(1, (x != PAD).sum()))
    loss = -float((np.log(np.take_along_axis(prob, np.broadcast_to(y[None, :, None], (*x.shape, 1)), -1) + 1e-9) * real).sum())
    prob[:, np.arange(len(y)), y] -= 1
    d = prob * real
    flat_d = d.reshape(-1, k)
    grads = [*_layer_gradient(x, p[:7], kept_f, d @ p[6].T), forward.reshape(-1, HIDDEN).T @ flat_d,
             *_layer_gradient(x[::-1], p[7:14], kept_b, (d @ p[13].T)[::-1]), backward.reshape(-1, HIDDEN).T @ flat_d, flat_d.sum(0)]
    return loss, np.concatenate([g.ravel() for g in grads]).astype(np.float32)


def adam(windows: np.ndarray, y: np.ndarray, flat: np.ndarray, k: int, epochs: int, rate: float, seed: int, batch: int = 256) -> np.ndarray:
    flat, m, v, step = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            some = order[at:at + batch]
            _, g = gradient(np.ascontiguousarray(windows[some].T), y[some], flat, k)
            g *= min(1.0, 1.0 / (float(np.linalg.norm(g)) + 1e-9))
            step += 1
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            flat -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return flat.astype(np.float32)


def to_windows(chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in windows (one text's last one filled with PAD), and where each text's begin."""
    counts = np.array([-(-len(t) // WINDOW) for t in chunk], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.full(int(starts[-1]) * WINDOW, PAD, np.int16)
    for t, s in zip(chunk, starts.tolist()):
        flat[s * WINDOW:s * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
    return flat.reshape(-1, WINDOW), starts


def _run(x: np.ndarray, p: list[np.ndarray], out: np.ndarray, backwards: bool) -> None:
    """Adds one direction's part of the logits at every step to ``out`` (steps, windows, languages). The halves of
    the sigmoids, s(a) = (1 + tanh(a / 2)) / 2, are folded into the weights."""
    half = np.float32(0.5)
    er, ez, en, ur, uz, un, w = p[0] * half, p[1] * half, p[2], p[3] * half, p[4] * half, p[5] * half, p[6]
    size = (x.shape[1], HIDDEN)
    h, r, z, n, u = (np.zeros(size, np.float32) for _ in range(5))
    o = np.empty(out.shape[1:], np.float32)
    for i in range(len(x) - 1, -1, -1) if backwards else range(len(x)):
        row = x[i]
        np.take(er, row, axis=0, out=r, mode="clip")
        np.matmul(h, ur, out=u)
        r += u
        np.tanh(r, out=r)
        np.take(ez, row, axis=0, out=z, mode="clip")
        np.matmul(h, uz, out=u)
        z += u
        np.tanh(z, out=z)
        np.take(en, row, axis=0, out=n, mode="clip")
        np.matmul(h, un, out=u)
        r += 1
        u *= r
        n += u
        np.tanh(n, out=n)
        z += 1
        z *= half
        h -= n
        h *= z
        h += n
        np.matmul(h, w, out=o)
        out[i] += o


def probabilities(windows: np.ndarray, flat: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of windows: the probabilities of the languages at every byte (steps, windows, languages), and
    the bytes that are real."""
    p = unpack(flat, k)
    for at in range(0, len(windows), BLOCK):
        x = np.ascontiguousarray(windows[at:at + BLOCK].T).astype(np.intp)
        out = np.broadcast_to(p[14], (*x.shape, k)).copy()
        _run(x, p[:7], out, False)
        _run(x, p[7:14], out, True)
        out -= out.max(-1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(-1, keepdims=True)
        yield out, x != PAD


def pooled(chunk: list[bytes], flat: np.ndarray, k: int) -> np.ndarray:
    """Mean probabilities over all bytes of each text, (texts, languages); empty texts get zeros."""
    windows, starts = to_windows(chunk)
    sums = [np.zeros((0, k))]
    for prob, real in probabilities(windows, flat, k):
        if not real[-1].all():
            prob *= real[..., None]
        sums.append(prob.sum(0, dtype=np.float64))
    total = np.concatenate([np.zeros((1, k)), np.cumsum(np.concatenate(sums), 0)])
    lengths = np.array([max(1, len(t)) for t in chunk])[:, None]
    return np.clip((total[starts[1:]] - total[starts[:-1]]) / lengths, 0, 1)


def _held(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of pieces of a batch."""
    first, held, size = 0, [], 0
    for i, t in enumerate(batch.column("text")):
        held.append(t.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _cutter(langs: dict[str, int], per_doc: int):
    """Training windows of sampled documents: places and a quarter of the lengths are drawn from the row's key."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, ws = [], []
            for lang, key, t in zip(*(b.column(c).to_pylist() for c in ("lang", "key", "text"))):
                rng = np.random.default_rng(key & (1 << 63) - 1)
                for s in rng.integers(0, max(1, len(t) - WINDOW // 2), min(per_doc, 1 + len(t) // WINDOW)).tolist():
                    n = WINDOW if rng.random() < 0.75 else int(rng.integers(4, WINDOW))
                    ys.append(langs[lang])
                    ws.append(t[s:s + n])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ws, pa.binary())], names=["y", "w"])
    return cut


def _learner(model, k: int, epochs: int, rate: float, turn: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((w, y) for b in batches for w, y in zip(b.column("w").to_pylist(), b.column("y").to_pylist()) if w)
        if rows:
            windows, _ = to_windows([w for w, _ in rows])
            flat = adam(windows, np.array([y for _, y in rows], np.int64), model.value, k, epochs, rate, turn)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "flat"])
    return learn


class Model:
    """The learned languages, sorted, and the network's weights (none without training rows)."""

    def __init__(self, langs: list[str], flat: np.ndarray | None):
        self.langs, self.flat = langs, flat


def fit(docs: DataFrame, per_lang: int = 800, per_doc: int = 12, max_langs: int = 64, shares: int = 3, rounds: int = 4,
        epochs: int = 2, rate: float = 0.01) -> Model:
    """The network learned from documents with a language outside the held-out fold.

    Bounded by ``max_langs`` languages (the most frequent, ties by name), an expected ``per_lang`` documents of each
    and ``per_doc`` windows of each document. Documents are chosen by a hash of id and text; a row counts once
    however often it is repeated.
    """
    spark = docs.sparkSession
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                        F.col("text").cast("string").alias("text"))
            .filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))))
    seen = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    counts = {r["lang"]: r["n"] for r in seen}
    langs = sorted(counts)
    if not langs:
        return Model([], None)
    limits = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1 << 20, (per_lang << 20) // counts[lang] + 1))])
    key = F.xxhash64("doc_id", "text")
    chosen = (rows.filter(F.col("text").rlike(r"\p{L}")).withColumn("key", key).filter(F.pmod("key", F.lit(1 << 20)) < limits[F.col("lang")])
              .select("lang", "key", F.col("text").cast("binary").alias("text")))
    windows = chosen.mapInArrow(_cutter({lang: i for i, lang in enumerate(langs)}, per_doc), "y int, w binary")
    train = stage(windows.groupBy("y", "w").agg(F.count(F.lit(1))).select("y", "w").repartition(shares), "op11-train")  # one file a share
    k, flat = len(langs), initial(len(langs))
    for turn in range(rounds):
        model = spark.sparkContext.broadcast(flat)
        got = train.mapInArrow(_learner(model, k, epochs, rate * 0.6 ** turn, turn), "n long, flat binary").collect()  # one row a share
        model.destroy()
        if not got:
            return Model([], None)
        total = sum(r["n"] for r in got)
        flat = sum(np.frombuffer(r["flat"], np.float32) * np.float32(r["n"] / total) for r in sorted(got, key=lambda r: bytes(r["flat"])))
    return Model(langs, flat)


def _bytes(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"), F.col("text").rlike(r"\p{L}").alias("letters"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; see ``identify_languages``."""
    k, langs = len(model.langs), model.langs
    if not k:
        return texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                                  F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model.flat)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letters = b.column("letters").to_numpy(zero_copy_only=False)
            names, scores = [], []
            for first, held in _held(b):
                known = letters[first:first + len(held)]
                prob = pooled([t if ok else b"" for t, ok in zip(held, known)], shared.value, k)
                names += [langs[i] if ok else UNDETERMINED for i, ok in zip(prob.argmax(1).tolist(), known)]
                scores += np.where(known, prob.max(1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return (_bytes(docs).mapInArrow(apply, "doc_id long, lang_pred string, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang): runs of bytes (end exclusive) with the same most likely language, of whole texts."""
    k, langs = len(model.langs), model.langs
    shared = docs.sparkSession.sparkContext.broadcast(model.flat)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for first, held in _held(b):
                windows, starts = to_windows(held)
                if not len(windows):
                    continue
                best = np.concatenate([prob.argmax(-1).T for prob, _ in probabilities(windows, shared.value, k)]).ravel()
                out: list[tuple] = []
                for i, (t, s) in enumerate(zip(held, starts.tolist())):
                    own = best[s * WINDOW:s * WINDOW + len(t)]
                    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []
                    out += [(ids[first + i], x, y, langs[own[x]]) for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "start", "end", "lang"])

    return _bytes(docs).mapInArrow(apply, "doc_id long, start long, end long, lang string")


def identify_languages(docs: DataFrame, **params) -> DataFrame:
    """Fits on the documents with a language outside the held-out fold and predicts every whole text's.

    Null, empty and letterless texts are ``und`` with score 0; so are all, if no language could be learned.
    Repeated rows get equal answers. Language, source and id are no inputs of a prediction (the id only names the fold).
    """
    return predict(docs, fit(docs, **params))
