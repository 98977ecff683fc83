"""The numbered operators against brute force, and on nulls, empties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import pytest

import corpus_pipeline
from cartwise.llm import html_extract, jaccard_join, licenses, suffix_dedup
from cartwise.llm import sanitise as sanitise_module
from cartwise.llm.common import batches_of
from cartwise.llm.decontaminate import contaminated, decontaminate
from cartwise.llm.fingerprints import fingerprint_documents
from cartwise.llm.html_extract import extract_pages, main_text
from cartwise.llm.jaccard_join import drop_near_duplicates, jaccard_components
from cartwise.llm.licenses import scan_licenses
from cartwise.llm.packing import best_fit, pack_documents
from cartwise.llm.sanitise import digest, find_personal_data, sanitise
from cartwise.llm.sharding import shard_documents
from cartwise.llm.suffix_dedup import remove_repeats
from cartwise.llm.toxicity import fit, reject, score_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, w int, seed string"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdeéü") for _ in range(RNG.randint(2, 8))) for _ in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = [prose(rng, rng.randint(1, 160)) for _ in range(50)]
    base = prose(rng, 200)
    for i in range(8):  # near copies, each with one other word
        w = base.split()
        w[rng.randrange(len(w))] = f"new{i}"
        out.append(" ".join(w))
    passage = prose(rng, 90)
    out += [prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(4)]
    out += [base, base, "", None, "   ", "one", "One  two", "a" * 900, prose(rng, 6000),
            "mail joe.q@mail.example.org, card 4111 1111 1111 1111; ip 10.0.0.255 or 10.0.0.256, +49 (30) 1234567.",
            "Released under the MIT License. Apache License, Version 2.0; CC BY-NC"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "id is null", None, None, None, None, None, None)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_fingerprints(docs, empty, texts):
    got = by_id(fingerprint_documents(docs))
    order = ["id is null"] + [t or "" for t in texts]
    ids = [None] + [i * 3 for i in range(len(texts))]
    assert set(got) == set(ids)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for k, (i, t) in enumerate(zip(ids, order)):
        nxt = order[(k + 1) % len(order)]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near_edited"] - true) < 0.15 and 0 <= r["near_next"] <= 1
    assert got[62 * 3]["fingerprint"] == got[63 * 3]["fingerprint"]
    assert fingerprint_documents(empty).collect() == []


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        w = prose(rng, 40).split()
        if bad:
            w[rng.randrange(40)] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows.append((None, None))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = by_id(score_documents(d, y))
    held = [(got[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held)
    assert sum(r["predicted"] == t for r, t in held) / len(held) > 0.95
    assert 0 <= got[None]["score"] <= 1
    assert {r["score"] for r in score_documents(docs, y.limit(0)).collect()} == {0.5}
    assert score_documents(empty, y).collect() == []


def test_sharding(docs, empty, texts):
    rows = shard_documents(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = (texts[r["doc_id"] // 3] or "") if r["doc_id"] is not None else "id is null"
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        assert r["law"] == "bytes" and 0 <= r["shard"] < 8
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shard_documents(empty).collect() == []


def test_sharding_splits_a_hot_group_evenly(spark):
    d = spark.range(4000).selectExpr("id as doc_id", "if(id < 1500, 'same text', concat('t ', id)) as text")
    size = collections.Counter()
    for r in shard_documents(d).collect():
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 8
    assert max(abs(v - mean) for v in size.values()) < 0.01 * mean + 12


def test_sharding_cuts_repeated_rows(spark):
    """One row (id and text) repeated 1,500 times among 4,000 rows, and 800 rows without an id."""
    d = spark.range(4000).selectExpr("if(id < 1500, 7, if(id < 2300, null, id)) as doc_id",
                                     "if(id < 1500, 'same text', concat('t ', id)) as text").repartition(5)
    rows = shard_documents(d).collect()
    size, n = collections.Counter(), collections.Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
        n[r["doc_id"]] += 1
    assert n[7] == 1500 and n[None] == 800 and len(rows) == 4000
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(abs(v - mean) for v in size.values()) < 0.01 * mean + 12
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_near_duplicates_keep_a_callers_columns(spark):
    """Columns named as the private ones keep their values; of repeated rows one stays."""
    rng = random.Random(12)
    base = prose(rng, 80)
    rows = [(1, base, "u1", "k1", 5), (2, base + " end", "u2", "k2", 6), (3, prose(rng, 60), "u3", "k3", 7),
            (3, None, "u4", "k4", 8), (None, "", "u5", None, 9)]
    rows = [*rows, rows[2], rows[2]]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id string, _th string, row int")
    kept = drop_near_duplicates(d)
    assert kept.columns == d.columns and kept.dtypes == d.dtypes
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], *rows[2:5]], key=str)


def _jaccard(texts, n, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    low, links = {i: i for i in sets}, collections.Counter()

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in sets}, links


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_join(docs, texts, empty, n, percent):
    sets, low, links = _jaccard(texts, n, percent)
    got = by_id(jaccard_components(docs, n, percent))
    assert sum(links.values()) > 10
    for i in sets:
        r = got[i * 3]
        assert (r["n_shingles"], r["component_id"], r["n_links"]) == (len(sets[i]), low[i] * 3, links[i]), i
    assert got[None]["component_id"] is None
    assert jaccard_components(empty).collect() == []
    alone = by_id(jaccard_components(docs, n, percent, count_links=False))  # by hubs, then across components
    assert {i: r["component_id"] for i, r in alone.items()} == {i: r["component_id"] for i, r in got.items()}
    kept = drop_near_duplicates(docs, n, percent)
    assert kept.columns == docs.columns
    want = {i * 3 for i in sets if low[i] == i} | {None}
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, want))


def test_roots_of_several_classes_are_told_apart_by_their_bitmaps(spark):
    """Classes of one member whose bitmaps are far apart make no pair, in roots of one class or of more."""
    far, near = [(0, 1), (0, 3)], [(-1, 5), (-1, 5)]
    rows = [(c, 100, c, root, [first, word, *[first] * 6]) for c, (root, (first, word)) in enumerate(
        [(0, far[0]), (0, far[1]), (2, near[0]), (2, near[1]), (4, (-1, 7))])]
    nodes = spark.createDataFrame(rows, "g long, n int, c long, root long, bits array<long>")
    live = spark.createDataFrame([(7, c, 100, 0) for c in range(5)], "member long, g long, n int, pos int")
    got = jaccard_join._cross_pairs(live, nodes, 90).collect()
    assert sorted(map(tuple, got)) == [(2, 4), (3, 4)]


def test_classes_go_to_the_hub_that_links_them_in_one_turn(spark):
    """Whatever its number: smaller roots go to it too."""
    edges = [(min(5, i), max(5, i)) for i in range(10) if i != 5] + [(20, 21)]
    got = jaccard_join._merged(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [*((i, 5) for i in range(10) if i != 5), (21, 20)]


def test_of_members_held_by_the_same_groups_the_first_stays(spark):
    """It has the least place in all of them; members that other groups hold too are kept."""
    held = {10: [(1, 4), (2, 2), (3, 5)], 11: [(1, 3), (2, 1), (3, 2)], 12: [(1, 5), (2, 7), (3, 6)], 13: [(1, 0), (2, 0)],
            14: [(2, 9), (3, 9)], 15: [(1, 8), (2, 8)]}
    live = spark.createDataFrame([(m, g, 100, p) for m, gs in held.items() for g, p in gs],
                                 "member long, g long, n int, pos int")
    got = jaccard_join._told_apart(live)
    assert got.columns == live.columns
    assert sorted(map(tuple, got.collect())) == [(m, g, 100, p) for m in (11, 13, 14) for g, p in held[m]]


def test_whole_texts_are_not_dealt_out_for_a_few_keys_or_spans(spark, monkeypatch):
    """Neither where near copies go nor where personal data are replaced; both give the same rows when the keys are many."""
    rng = random.Random(21)
    base = prose(rng, 80)
    rows = [(1, base), (2, base + " end"), (3, prose(rng, 60)), (3, "a@b.org, 10.0.0.1 and a@b.org: " + base), (None, "a@b.org"),
            (4, None), (5, "a@b.org"), (5, "a@b.org"), (6, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        outs = [f(d) for f in (drop_near_duplicates, sanitise)]
        for out in outs:
            plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
            # Only what repeats is dealt out, to drop it.
            dealt = [x for x in plan.splitlines() if re.search(r"\bExchange hashpartitioning", x)]
            assert "SortMergeJoin" not in plan and len(dealt) <= (out is outs[0]), plan
        few = [sorted(map(str, out.collect())) for out in outs]
        monkeypatch.setattr(jaccard_join, "small", lambda df, *rows: df)
        monkeypatch.setattr(sanitise_module, "LIST_ROWS", 0)
        assert few == [sorted(map(str, f(d).collect())) for f in (drop_near_duplicates, sanitise)]
    finally:
        spark.conf.set(key, before)


def test_texts_go_to_python_in_small_batches(spark):
    """And the session's own number is back afterwards, also if the work fails."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), batches_of(spark, 30):
        sizes = spark.range(100).coalesce(1).mapInPandas(lambda bs: (b.assign(id=len(b)) for b in bs), "id long").collect()
        raise ValueError
    assert max(r["id"] for r in sizes) == 30 and spark.conf.get(key) == before


@pytest.mark.parametrize("anchor_runs,task_bytes", [(2048, 1 << 20), (2, 1 << 12)])
def test_repeats(docs, texts, empty, anchor_runs, task_bytes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ANCHOR_RUNS", anchor_runs)
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", task_bytes)
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + 400] for b in data for i in range(len(b) - 399))
    got = by_id(remove_repeats(docs))
    total = 0
    for k, b in enumerate(data):
        cover = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i:i + 400]] > 1:
                cover[i:i + 400] = b"\1" * 400
        kept = bytes(x for x, c in zip(b, cover) if not c)
        runs = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        r = got[k * 3]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), sum(cover), runs)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        total += sum(cover)
    assert total > 3000
    assert remove_repeats(empty).collect() == []


def test_repeats_marks_passages_of_400_bytes_alone(spark):
    """n_removed tells rows with a repeated 400-byte string from the others, exactly: a passage of 60 words that
    is shorter than 400 bytes is no such string, one of 400 bytes is."""
    rng = random.Random(40)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(n)) for _ in range(60))
    short, long = word(5), word(9)
    assert len(short) < 400 < len(long)
    rows = [(i, f"{prose(rng, 80)} {short if i % 2 else long} {prose(rng, 80)}") for i in range(20)]
    rows += [(100 + i, prose(rng, 200)) for i in range(20)]
    got = by_id(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, _ in rows:
        planted = i < 100 and i % 2 == 0
        assert (got[i]["n_removed"] >= len(long)) == planted and (got[i]["n_removed"] == 0) == (not planted)
        assert got[i]["n_spans"] == int(planted)


def test_licenses(docs, texts, empty):
    got = by_id(scan_licenses(docs))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, la) for p, la in phrases.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        r = got[i * 3]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert r["base_labels"] == ",".join(sorted({la for _, la in places}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(","))
        at = [k for k, _ in places]
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
    assert scan_licenses(empty).collect() == []


def test_license_template_with_a_word_put_in(spark):
    t = ("permission is hereby granted free of charge to any NICE person obtaining a copy of this software and "
         "associated documentation files to deal in the software without restriction")
    r = scan_licenses(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert r["labels"] == "mit" and r["base_labels"] == "" and r["n_base"] == 0 and 0.7 <= r["score"] <= 1


def test_whole_license_texts_and_equal_hashes(spark):
    """A long license with a paragraph missing; a passage of one; words of one in another order."""
    whole = next(t for la, t in licenses.TEMPLATES if la == "mit" and len(t) > 400).split()
    rows = [(1, " ".join(whole[:60] + whole[90:])), (2, "see " + " ".join(whole[20:70]) + " there"), (3, " ".join(sorted(whole))),
            (4, " ".join(whole[100:125])), (5, "This work is licensed under the GNU General Public License, version 3.")]
    got = by_id(scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["labels"] for i in range(1, 6)] == ["mit", "mit", "", "", "gpl"]
    assert got[4]["score"] < 0.7 and got[5]["base_labels"] == ""


def test_personal_data(docs, texts, empty):
    def luhn(v):
        ds = [int(c) for c in v if c in "0123456789"][::-1]
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(ds)) % 10 == 0

    n = lambda v: sum(c in "0123456789" for c in v)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= n(v) <= 19 and luhn(v)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= n(v) <= 15)]
    got = by_id(digest(find_personal_data(docs)))
    for i, t in enumerate(texts):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p, f in kinds for m in re.finditer(p, t or "") if f(m[0])]
        assert got[i * 3]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[i * 3]["spans"].startswith(",".join(spans))
    assert digest(find_personal_data(empty)).collect() == []
    clean = by_id(sanitise(docs))
    assert clean[(len(texts) - 2) * 3]["text"] == \
        "mail [EMAIL], card [CARD]; ip [IP] or 10.0.0.256, [PHONE]."
    assert clean[0]["text"] == texts[0] and clean[None]["text"] == "id is null"


def test_revealing_terms(spark):
    rows = [(i, f"{prose(random.Random(i), 30)}. ask Quillfeather about it: quill@mail.example.org now please") for i in range(6)]
    rows += [(100 + i, prose(random.Random(100 + i), 40) + " ask about it now please") for i in range(300)]
    got = by_id(digest(find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))))
    for i, t in rows[:6]:
        terms = [t[int(a):int(b)] for k, a, b in (s.split(":") for s in got[i]["spans"].split(",")) if k == "term"]
        assert terms == ["Quillfeather"]
    assert all(got[i]["spans"] == "" for i, _ in rows[6:])


def test_callers_columns_and_their_values_pass(spark):
    """Columns with the names of private ones keep types and values through every filtering stage; repeated
    rows stay repeated."""
    rng = random.Random(21)
    item = prose(rng, 30)
    rows = [(1, "write to joe.q@mail.example.org", "u1", "k1", 5, 3, b"a"), (2, prose(rng, 30), "u2", "k2", 6, 4, b"b"),
            (3, item, "u3", "k3", 7, 5, b"c"), (None, None, "u4", None, 8, None, None)]
    rows += [rows[1], rows[0]]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id string, _th string, row int, _bad_id int, es binary")
    key = lambda r: str(tuple(r))
    clean = sanitise(d)
    assert clean.dtypes == d.dtypes
    want = [(r[0], "write to [EMAIL]" if r[0] == 1 else r[1], *r[2:]) for r in rows]
    assert sorted(map(tuple, clean.collect()), key=key) == sorted(want, key=key)
    kept = decontaminate(d, spark.createDataFrame([(1, item, "x")], "item_id long, text string, _id string"))
    assert kept.dtypes == d.dtypes
    assert sorted(map(tuple, kept.collect()), key=key) == sorted([r for r in rows if r[0] != 3], key=key)


def test_empty_tables(spark, empty):
    """No rows in, no rows and the same columns out."""
    for out in (sanitise(empty), drop_near_duplicates(empty), reject(empty, {1: 1.0}),
                decontaminate(empty, spark.createDataFrame([(1, "x")], "item_id long, text string"))):
        assert out.columns == empty.columns and out.collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract_pages(pages).collect() == []


def test_many_mentions_and_terms_in_one_text(spark):
    """Two texts that share 3,000 addresses and 3,000 names: one class of entities, one of terms, no product."""
    rng = random.Random(31)
    names = [f"Zq{i}x" for i in range(3000)]
    long = " ".join(f"{n} {n.lower()}@mail.example.org" for n in names)
    rows = [(1, long), (2, long + " and so on")] + [(100 + i, prose(rng, 40)) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    found = {r["doc_id"]: r for r in find_personal_data(d).collect()}
    assert time.perf_counter() - began < 120
    for i in (1, 2):
        assert found[i]["n_email"] == 3000
        assert {s["value"] for s in found[i]["terms"]} >= set(names)
    assert all(not found[100 + i]["terms"] for i in range(200))
    text = {r["doc_id"]: r["text"] for r in sanitise(d).collect()}
    assert text[1] == " ".join(["[REMOVED] [EMAIL]"] * 3000)


def test_revealing_terms_of_the_whole_text(spark):
    """A name far from the mention, short names, and every place of a revealing term."""
    rows = [(i, f"Quillfeather, Wu {i}. {prose(random.Random(i), 90)}. mail quill@mail.example.org now, "
                f"{prose(random.Random(50 + i), 60)} Quillfeather") for i in range(6)]
    rows += [(100 + i, prose(random.Random(100 + i), 150) + " mail now") for i in range(300)]
    found = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    terms = {r["doc_id"]: [s["value"] for s in r["terms"]] for r in found}
    assert [terms[i] for i in range(6)] == [["Quillfeather", "Wu", "Quillfeather"]] * 6
    assert not any(terms[i] for i, _ in rows[6:])
    for r in found[:6]:
        assert all(dict(rows)[r["doc_id"]][s["start"]:s["end"]] == s["value"] for s in r["terms"])


def test_marks_around_a_term_do_not_change_it(spark):
    marked = ["'Quillfeather'", "_Quillfeather_", "-Quillfeather", "Quillfeather-", "Quillfeather"]
    common = ["'harbour'", "_harbour_", "-harbour", "harbour'", "harbour"]
    rows = [(i, f"{m} at the {common[i]}: quill@mail.example.org") for i, m in enumerate(marked)]
    rows += [(100 + i, f"at the {common[i % 5]}, no. {i}") for i in range(100)]
    found = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    terms = {r["doc_id"]: [s["value"] for s in r["terms"]] for r in found}
    assert [terms[i] for i in range(5)] == [["Quillfeather"]] * 5
    assert not any(terms[i] for i, _ in rows[5:])


def test_decontamination(spark, docs, empty):
    rng = random.Random(8)
    items = [(i, prose(rng, 30)) for i in range(20)] + [(90, "tiny item here"), (91, ""), (92, None)]
    changed = items[4][1].split()
    for k in (3, 11, 19, 26):
        changed[k] = "zzz"
    d = [(1, prose(rng, 50) + " " + items[2][1] + " " + prose(rng, 20)), (2, " ".join(changed)),
         (3, prose(rng, 400)), (4, "a Tiny, item here!"), (5, None), (6, items[5][1][:60])]
    got = contaminated(spark.createDataFrame(d, "doc_id long, text string"),
                       spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["n_match"] for r in got.collect()} == {(1, 2): 30, (2, 4): 26, (4, 90): 3}
    it = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate(docs, it).count() == docs.count()
    assert contaminated(empty, it).collect() == [] and contaminated(docs, it.limit(0)).collect() == []


def test_decontamination_keeps_clean_rows_of_a_bad_id(spark):
    rng = random.Random(9)
    item, clean = prose(rng, 30), [prose(rng, 60) for _ in range(3)]
    d = spark.createDataFrame([(None, item), (None, clean[0]), (None, None), (7, item + " end"), (7, clean[1]),
                               (8, clean[2]), (8, item), (8, item)], SCHEMA.split(", lang")[0])
    it = spark.createDataFrame([(1, item)], "item_id long, text string")
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, decontaminate(d, it).collect()), key=key) == sorted(
        [(None, clean[0]), (None, None), (7, clean[1]), (8, clean[2])], key=key)
    assert {(r["doc_id"], r["item_id"], r["n_places"]) for r in contaminated(d, it).collect()} == {
        (None, 1, 1), (7, 1, 1), (8, 1, 1)}


def test_packing(docs, texts, empty):
    rows = pack_documents(docs, capacity=256).collect()
    bins = collections.defaultdict(list)
    words = collections.Counter()
    for r in rows:
        bins[r["bin_id"]].append(r)
        words[r["doc_id"]] += r["n_words"]
    for i, t in enumerate(texts):
        assert words[i * 3] == len((t or "").split())
    for b in bins.values():
        assert sum(r["n_words"] for r in b) == b[0]["bin_words"] <= 256
        assert len({r["doc_id"] for r in b} & {62 * 3, 63 * 3}) < 2  # copies never share a bin
        per_source = collections.Counter((r["doc_id"] or 0) // 3 % 4 if (r["doc_id"] or 0) // 3 % 9 else None for r in b)
        assert max(per_source.values()) <= 2
    assert pack_documents(empty).collect() == []


def test_best_fit_takes_the_tightest_compatible_bin():
    # 9, 8, 7 open bins; 1 goes to the bin of 9; its source is full there for the other 1.
    got = best_fit([(9, "a", 1, "p9"), (8, "b", 2, "p8"), (7, "c", 3, "p7"), (1, "a", 4, "q1"), (1, "d", 3, "r1")], 10, 1)
    assert got == [["p9", "r1"], ["p8", "q1"], ["p7"]]


def test_extraction(spark):
    model = html_extract.train()
    rng = random.Random(77)
    right = total = 0
    for _ in range(100):
        page, y = html_extract.labelled_page(rng)
        z = html_extract.viterbi(html_extract.block_features(html_extract.leaf_blocks(page)), model)
        right, total = right + sum(a == b for a, b in zip(y, z)), total + len(y)
    assert right / total > 0.97
    page = ('<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>'
            '<a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div><article><h1>Head &amp; more'
            '</h1><p><b>First\n  part.<br><p>Second &lt;b&gt; part.</article><footer>&copy; me</footer>')
    want = "Head & more\nFirst part.\nSecond <b> part."
    assert main_text(page, model) == want
    rows = [(1, "u", page, "x"), (2, None, None, "y"), (None, "v", "", None), (1, "u", page, "x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(((r["page_id"] or 0), r["text"], r["n_chars"]) for r in got) == \
        [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0)]


def test_unclosed_elements_lose_no_article_text():
    """A silent element without end tag ends where its surroundings end; formulas stay."""
    blocks = lambda page: [b[1] for b in html_extract.leaf_blocks(page)]
    for tag in ("object", "video", "audio", "canvas", "select", "template", "button", "svg", "math"):
        got = blocks(f"<article><h1>Head</h1><p>First <{tag}><i>in</i></p><p>Second</p></article><footer>f</footer>")
        assert [g for g in got if g not in ("First", "First in")] == ["Head", "Second", "f"] and len(got) == 4
    assert blocks("<p>so <math><mi>a</mi><mo>+</mo><mn>1</mn></math> holds</p><p>next</p>") == ["so a+1 holds", "next"]
    assert blocks("<div><p>one <svg><path d='x'><p>two</div>three") == ["one", "two", "three"]
    assert blocks("<p>a <object><p>in</p><object>in</object> in</object> b</p>") == ["a b"]
    assert blocks("x <y and z") == ["x <y and z"]


def test_block_reading_is_linear():
    def seconds(page):
        began = time.perf_counter()
        html_extract.block_features(html_extract.leaf_blocks(page))
        return time.perf_counter() - began

    for unit in ("<a href=x ", "<div>x", "<b>", "<!x", '<a b="', "<p>x", "<ul><li>x", "<svg>", "&amp", "<"):
        assert seconds(unit * 20_000) < 3, unit


def test_pipeline_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near duplicates", "decontamination", "personal data", "packing"]


def test_an_empty_model_rejects_nothing(spark, docs):
    labels = "doc_id long, toxic int"
    unusable = [[], [(0, None), (None, 1)], [(10 ** 9 + i, i % 2) for i in range(40)]]
    assert [i for i in range(0, 60, 3) if zlib.crc32(str(i).encode()) % 5 == 0]
    unusable.append([(i, 1) for i in range(0, 60, 3) if zlib.crc32(str(i).encode()) % 5 == 0])
    for rows in unusable:
        kept = reject(docs, fit(docs, spark.createDataFrame(rows, labels)))
        assert kept.columns == docs.columns and kept.count() == docs.count()


def test_pipeline_run(spark, tmp_path):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(700):
        w = prose(rng, 40).split()
        if i % 3 == 0:
            w[rng.randrange(40)] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(w), "en", f"s{i % 5}"))
        labels.append((i, int(i % 3 == 0)))
    item, base = prose(rng, 30), prose(rng, 60)
    planted = {1000: item, 1001: base, 1002: base + " more", 1003: "write to joe.q@mail.example.org " + prose(rng, 30)}
    rows += [(i, t, "en", "s") for i, t in planted.items()]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    for name, known in (("labels", y), ("none", y.limit(0))):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        known.write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        kept = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
        assert kept & set(planted) == {1001, 1003}
        toxic, fine = {i for i, v in labels if v}, {i for i, v in labels if not v}
        if name == "none":
            assert kept == toxic | fine | {1001, 1003}
        else:
            assert len(kept & toxic) < 0.1 * len(toxic) and len(kept & fine) > 0.95 * len(fine)


def test_pipeline_of_no_documents(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                         ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_everywhere(spark):
    """Rows repeated with id and text, equal ids with other texts, ids that are null: an answer for each row."""
    rng = random.Random(50)
    base = prose(rng, 120)
    rows = [(1, base)] * 5 + [(1, prose(rng, 40)), (1, None), (2, base + " more")] + [(None, base)] * 3 + [(None, None), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ids = collections.Counter(i for i, _ in rows)
    for out in (fingerprint_documents(d), shard_documents(d), jaccard_components(d, 3, 90, count_links=False),
                remove_repeats(d), scan_licenses(d), digest(find_personal_data(d)), pack_documents(d)):
        assert collections.Counter(r["doc_id"] for r in out.collect()) == ids
    groups = collections.defaultdict(set)
    for r in jaccard_components(d, 3, 90, count_links=False).collect():
        groups[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert groups[3] == {(0, 3)} and groups[2] == {(119, None)} and (118, None) in groups[None]
    removed = collections.Counter((r["n_bytes"], r["n_removed"]) for r in remove_repeats(d).collect())
    assert removed[(len(base.encode()), len(base.encode()))] == 8
    copies = [r["copy"] for r in pack_documents(d).collect() if r["doc_id"] == 1]
    assert sorted(copies) == [0, 0, 0, 1, 2, 3, 4]
