"""Language identification: gradients against differences, windows against a step-by-step network, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from cartwise.llm import language as L

SMALL_SF = "/root/testdata/sf0.01"


def step_by_step(text: bytes, flat: np.ndarray, k: int) -> np.ndarray:
    """Probabilities at every byte, one byte and one window at a time, in doubles."""
    p = [a.astype(np.float64) for a in L.unpack(flat, k)]
    out = []
    for at in range(0, len(text), L.WINDOW):
        part = text[at:at + L.WINDOW]

        def states(seq, q):
            h, got = np.zeros(L.HIDDEN), []
            for b in seq:
                r = 1 / (1 + np.exp(-(q[0][b] + h @ q[3])))
                z = 1 / (1 + np.exp(-(q[1][b] + h @ q[4])))
                n = np.tanh(q[2][b] + r * (h @ q[5]))
                h = (1 - z) * n + z * h
                got.append(h)
            return got
        f, b = states(part, p[:7]), states(part[::-1], p[7:14])[::-1]
        for x, y in zip(f, b):
            e = np.exp(x @ p[6] + y @ p[13] + p[14])
            out.append(e / e.sum())
    return np.array(out)


def test_gradient():
    """Backpropagation through time against central differences, windows of unequal length."""
    k, rng = 3, np.random.default_rng(0)
    flat = L.initial(k).astype(np.float64)
    windows, _ = L.to_windows([rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (64, 9, 30, 64)])
    x, y = np.ascontiguousarray(windows.T), np.array([0, 2, 1, 2])

    _, g = L.gradient(x, y, flat, k)
    used = np.flatnonzero(g)
    for i in rng.choice(used, 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (L.gradient(x, y, up, k)[0] - L.gradient(x, y, down, k)[0]) / 2e-4
        assert abs(slope - g[i]) < 2e-3 * max(0.05, abs(slope))


def test_windows_cover_whole_texts():
    k, rng = 4, random.Random(3)
    flat = L.initial(k, 5)
    held = [rng.randbytes(n) for n in (0, 1, 5, 63, 64, 65, 128, 1000, 0, 5000)]
    prob = L.pooled(held, flat, k)
    for t, got in zip(held, prob):
        want = step_by_step(t, flat, k).mean(0) if t else np.zeros(k)
        assert np.allclose(got, want, atol=2e-4)


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SMALL_SF}/documents.parquet")
    return docs, L.fit(docs)


def test_held_out_accuracy(fitted):
    docs, model = fitted
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = L.predict(docs, model).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(truth)
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in held if r["lang_pred"] != L.UNDETERMINED]
    assert sum(right) / len(right) > 0.95


def test_spans_cover_texts(fitted):
    docs, model = fitted
    some = docs.limit(20)
    sizes = {r["doc_id"]: len((r["text"] or "").encode()) for r in some.collect()}
    spans = L.label_spans(some, model).orderBy("doc_id", "start").collect()
    for i, n in sizes.items():
        own = [r for r in spans if r["doc_id"] == i]
        assert [r["start"] for r in own] + [n] == [0] + [r["end"] for r in own]
        assert all(a["lang"] != b["lang"] for a, b in zip(own, own[1:]))


def test_odd_rows(spark, fitted):
    """Nulls, empties, letterless and very long texts, repeated rows, clashing columns; nothing to learn from."""
    _, model = fitted
    rows = [(1, None, "en"), (2, "", None), (3, "12 34 -- !", "de"), (4, "the and of " * 40_000, None), (None, "the of and this", "en"),
            (5, "a", "en")] + [(6, "de la que les une", "fr")] * 30
    docs = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], "doc_id long, text string, lang string, score int, key string, letters binary").repartition(3)
    got = L.predict(docs, model).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert len({(r["lang_pred"], round(r["score"], 4)) for r in got if r["doc_id"] == 6}) == 1
    alone = L.identify_languages(docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("lang is null"))
    assert {r["lang_pred"] for r in alone.collect()} <= {"und"}
    assert L.identify_languages(docs.limit(0)).collect() == []
    few = L.identify_languages(docs, per_lang=2, per_doc=2, rounds=1, epochs=1).collect()
    assert len(few) == len(rows) and {r["lang_pred"] for r in few} <= {"und", "en", "fr", "de"}
