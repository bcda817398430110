"""Top-k search and licence scans against brute force; the classifier by held-out accuracy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import license_scan as ls
from partloom.llm import quality_fm as fm
from partloom.llm import topk_search as tk


def brute_top(vectors, k):
    w = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in w:
        if q % 50 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(w[q], w[c], strict=False)), c) for c in w if c != q))[:k]
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize(("queries", "candidates"), [(512, 4096), (1, 7)])
def test_top_k_matches_brute_force(spark, queries, candidates):
    r = random.Random(2)
    vectors = [(i, [float(np.float32(r.choice([0.0, r.uniform(-1, 1)]))) for _ in range(8)]) for i in range(160)]
    vectors += [(200 + i, vectors[3][1]) for i in range(9)]  # ties
    vectors += [(300, None), (350, [float("nan")] * 8), (400, [1.0, None] + [0.0] * 6), (450, [float("inf")] * 8), (None, [1.0] * 8), (500, []), (550, [3e7] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, score int, rank int")
    out = tk.top_k(tk.quantised(df), F.col("vec_id") % 50 == 0, tk.TopK(5, queries, candidates))
    assert {tuple(x) for x in out.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(vectors, 5)


def test_top_k_of_huge_and_repeated_vectors(spark):
    vectors = [(0, [1e300, -1.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [2.0**52, 1.0]), (50, [1.0, 0.0]), (50, [0.5, 0.0]), (4, [0.25, 0.0]), (4, [0.75, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for p in (tk.TopK(), tk.TopK(3, 1, 2, 1)):
        got = [tuple(r) for r in tk.top_k(tk.quantised(df), F.col("vec_id") % 50 == 0, p).orderBy("query_id", "rank").select("query_id", "vec_id", "score").collect()]
        top = 2**63 - 1
        assert got[: p.k][:2] == [(0, 1, top), (0, 3, top)]  # 1 beats 3 by its exact score
        assert got[p.k :][:3] == [(50, 0, top), (50, 1, top), (50, 3, 128 * 2**60)][:3] or got[p.k :][:2] == [(50, 0, top), (50, 1, top)]


def test_top_k_of_few_rows(spark):
    assert tk.top_k(tk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>")), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert tk.top_k(tk.quantised(one), F.col("vec_id") % 50 == 0).count() == 0


def brute_contains(text, templates, p):
    """Templates of which some window of 2n shingles at a multiple of n holds enough."""
    words = ls.normal_words((text or "").encode())
    s = [tuple(words[i : i + p.shingle]) for i in range(max(1, len(words) - p.shingle + 1))] if words else []
    out = set()
    for name, t in templates.items():
        tw = ls.normal_words(t.encode())
        own = {tuple(tw[i : i + p.shingle]) for i in range(max(1, len(tw) - p.shingle + 1))} if tw else set()
        n = len(own)
        if n and any(len(own & set(s[a : a + 2 * n])) / n >= p.containment for a in range(0, len(s), n)):
            out.add(name)
    return out


def test_license_scan_matches_brute_force(spark):
    r = random.Random(4)
    p, templates = ls.LicenseScan(), ls.TEMPLATES
    texts = []
    for i in range(80):
        filler = [f"w{r.randrange(500)}" for _ in range(r.randrange(0, 120))]
        words = r.choice(list(templates.values())).split()
        if i % 4 == 1:
            words[r.randrange(len(words))] = "other"
        if i % 4 == 2:
            words = words[: len(words) // 2]
        if i % 5 == 0:
            words = [w.upper() for w in words]
        at = r.randrange(len(filler) + 1)
        texts.append(" ".join(filler[:at] + words + filler[at:]))
    texts += ["", None, "MIT", " ".join(["Released under the MIT License."] * 3)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, license string")
    got = {}
    rows = ls.scan_licenses(df).collect()
    for x in rows:
        got.setdefault(x.doc_id, set()).add(x.license)
        assert x.containment >= p.containment and x.n_words >= 1
    assert got == {i: b for i, t in enumerate(texts) if (b := brute_contains(t, templates, p))}
    assert sum(x.doc_id == len(texts) - 1 for x in rows) == 1 or sum(x.doc_id == len(texts) - 1 for x in rows) == 3


def test_license_scan_of_nothing(spark):
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert ls.scan_licenses(df, {"blank": " ", "own": "A, b c d e"}).count() == 1


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeiou") for _ in range(r.randrange(2, 9)))
    rows, labels = [], []
    for i in range(400):
        n = r.randrange(20, 120)
        kind = i % 8
        if kind == 0:
            text = " ".join(word().upper() + "!!" for _ in range(n))
        elif kind == 1:
            text = (word() + " ") * n
        else:
            text = ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n // 9 + 1))
        rows.append((i, text, "en", "s", len(text)))
        if i % 3:
            labels.append((i, int(kind > 1), 0))
    rows += [(900, None, "en", "s", 0), (901, "", None, None, None), (902, "x " * 200000, "en", "s", 400000), (None, "plain words here", "en", "s", 16)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, b) for a, b, _ in labels)


def test_classifier_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    out = fm.score_quality(docs, fm.fit_on(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_labels_and_metadata_have_no_say(labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("quality", F.when(fm.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in fm.score_quality(docs, fm.fit_on(docs, labels)).collect()}
    moved = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    b = {r.doc_id: r.score for r in fm.score_quality(moved, fm.fit_on(moved, flipped)).collect()}
    assert a == b


def test_classifier_without_labels_or_rows(labelled, empty):
    docs, labels, _ = labelled
    blank = fm.fit_on(docs, labels.where("doc_id < 0"))
    assert {round(r.score, 6) <= 1 for r in fm.score_quality(docs, blank).collect()} == {True}
    assert fm.score_quality(empty, fm.fit_on(empty, labels)).count() == 0


def test_sum_of_squares_equals_all_pairs():
    r = np.random.default_rng(0)
    m = fm.Model(0.1, r.standard_normal(16 + fm.STATS).astype(np.float32), r.standard_normal((16 + fm.STATS, 3)).astype(np.float32), np.zeros(fm.STATS), np.ones(fm.STATS))
    at, x, stats = np.array([1, 5, 9]), np.array([0.5, 0.2, 0.7], np.float32), r.standard_normal((1, fm.STATS))
    f = np.concatenate([at, np.arange(16, 16 + fm.STATS)])
    v = np.concatenate([x, m.dense(stats)[0]])
    raw = 0.1 + sum(m.weight[i] * a for i, a in zip(f, v, strict=True))
    raw += sum(float(m.factor[f[i]] @ m.factor[f[j]]) * v[i] * v[j] for i in range(len(f)) for j in range(i))
    assert m.scores([at], [x], stats)[0] == pytest.approx(1 / (1 + math.exp(-raw)), rel=1e-4)


def test_license_scan_finds_notices_with_words_inserted_wherever_they_start(spark):
    notice = [f"t{i}" for i in range(30)]  # 26 shingles, of which an insertion leaves 22
    texts = []
    for inserted in (4, 10, 30, 400):
        for start in range(26):
            texts.append(" ".join([f"a{i}" for i in range(start)] + notice[:15] + [f"x{i}" for i in range(inserted)] + notice[15:] + [f"z{i}" for i in range(60)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in ls.scan_licenses(df, {"notice": " ".join(notice)}).collect()}
    words = [30 + n for n in (4, 10, 30, 400) for _ in range(26)]
    assert [(i, got[i].start_word, got[i].n_words, got[i].containment) for i in sorted(got)] == [(i, i % 26, n, 22 / 26) for i, n in enumerate(words)]


def holds_anywhere(text, template, p):
    """Whether the text's shingles, wherever they are, hold enough of the template's."""
    words, own = (ls.normal_words(t.encode()) for t in (text, template))
    sets = [{tuple(w[i : i + p.shingle]) for i in range(max(1, len(w) - p.shingle + 1))} for w in (words, own)]
    return len(sets[0] & sets[1]) / len(sets[1]) >= p.containment


def test_license_scan_matches_brute_force_without_a_grid(spark):
    r = random.Random(5)
    p, texts = ls.LicenseScan(), []
    for _ in range(120):
        words = r.choice(list(ls.TEMPLATES.values())).split()
        for _ in range(r.randrange(3)):
            i = r.randrange(len(words) + 1)
            words[i:i] = [f"w{r.randrange(500)}" for _ in range(r.choice([1, 5, 20, 60]))]
        texts.append(" ".join([f"w{r.randrange(500)}" for _ in range(r.randrange(80))] + words + [f"w{r.randrange(500)}" for _ in range(r.randrange(80))]))
    got = {(x.doc_id, x.license) for x in ls.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(i, name) for i, t in enumerate(texts) for name, template in ls.TEMPLATES.items() if holds_anywhere(t, template, p)}


def test_windows_guarantee_retrieval_and_recall_is_high(spark):
    """Per template the window, overlap and bands give the stated probability; measured at every offset with words inserted."""
    p = ls.LicenseScan()
    library = ls.Library(ls.TEMPLATES, p, ls.word_table())
    plan = library.plan()
    assert len(plan) == len(ls.TEMPLATES)
    for _, n, length, stride, bands, miss in plan:
        assert 2 * n <= length < 4 * n and stride == max(1, length // 4) and miss <= 1.4e-6 and bands <= 64
        assert length - stride + 1 >= 1.5 * n or n == 1
    r = random.Random(11)
    held = tried = 0
    for k, template in enumerate(ls.TEMPLATES.values()):
        words = ls.normal_words(template.encode())
        for offset in range(0, 40, 3):
            body = list(words)
            if len(words) > 12:
                at = r.randrange(5, len(words) - 5)
                body[at:at] = [b"inserted%d" % i for i in range(r.randrange(1, 8))]
            text = [b"a%d" % i for i in range(offset)] + body + [b"z%d" % i for i in range(30)]
            x = ls.shingles(text, p, ls.word_table())
            if len(np.intersect1d(x, library.sets[k])) / len(library.sets[k]) >= p.containment:
                tried += 1
                held += k in library.retrieved(x, [len(x)])[0]
    assert tried > 150 and held / tried >= 0.99
    texts = [ls.shingles([b"q%d" % (i % 50 + 100 * t) for i in range(90)], p, ls.word_table()) for t in range(4)] + [library.sets[0]]
    found = library.retrieved(np.concatenate(texts), [len(t) for t in texts])
    assert found[:3] == [set()] * 3 and 0 in found[4]  # the last two may share a window


def test_templates_from_a_table(spark, monkeypatch):
    t = spark.createDataFrame([("own", "one two three four five six"), (None, "x"), ("blank", None), ("own", "a")], "name string, text string")
    df = spark.createDataFrame([(1, "so one two three four five six"), (2, None)], "doc_id long, text string")
    assert [(x.doc_id, x.license, x.n_words) for x in ls.scan_licenses(df, t).collect()] == [(1, "own", 6)]
    monkeypatch.setattr(ls, "MOST_TEMPLATES", 1)
    with pytest.raises(ValueError, match="templates"):
        ls.scan_licenses(df, t)


def test_license_scan_gives_a_match_for_each_of_adjacent_copies(spark):
    notice = [f"t{i}" for i in range(30)]
    early, late = (notice[:i] + [f"x{j}" for j in range(20)] + notice[i:] for i in (8, 22))
    texts = [notice * k for k in (1, 2, 3, 5, 40)] + [early + late + early, late + early, notice[9:14] + ["far"] * 500 + notice[:11] + ["other"] + notice[11:]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for x in ls.scan_licenses(df, {"notice": " ".join(notice)}).collect():
        got.setdefault(x.doc_id, []).append((x.start_word, x.n_words, x.containment))
    for i, k in enumerate((1, 2, 3, 5, 40)):
        assert sorted(got[i]) == [(30 * c, 30, 1.0) for c in range(k)]
    assert sorted(got[5]) == [(50 * c, 50, 22 / 26) for c in range(3)] and sorted(got[6]) == [(50 * c, 50, 22 / 26) for c in range(2)]
    assert got[7] == [(505, 31, 22 / 26)]  # the stray shingle at the front is not worth the gap


def test_license_scan_of_very_many_copies_is_quick():
    n, copies = 26, 4000
    at = [c * (n + 4) + i for c in range(copies) for i in range(n)]
    assert ls.stretches(at, list(range(n)) * copies, 21, n) == [(c * (n + 4), c * (n + 4) + n - 1, n) for c in range(copies)]


def test_license_scan_of_many_templates_and_forced_collisions(spark, monkeypatch):
    r = random.Random(7)
    templates = {f"t{k}": " ".join(f"w{r.randrange(4000)}" for _ in range(40)) for k in range(300)}
    texts = [f"start {templates[f't{k}']} end" for k in range(0, 300, 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(i, f"t{7 * i}") for i in range(len(texts))}
    assert {(x.doc_id, x.license) for x in ls.scan_licenses(df, templates).collect()} == want
    whole = ls.hash_words
    monkeypatch.setattr(ls, "hash_words", lambda words, table: whole(words, table) & np.uint64(3))
    few = {k: templates[k] for k in ("t0", "t1", "t7")}
    got = {(x.doc_id, x.license) for x in ls.scan_licenses(df, few).collect()}
    assert got <= {(0, "t0"), (1, "t7")}  # words decide, whatever the hashes say
    assert ls.scan_licenses(df, {}).count() == 0


def test_classifier_needs_pairs_of_words(spark):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(1500):  # a word is good with one partner and bad with another; noise hides it
        a, b = r.choice("pq"), r.choice("pq")
        noise = [f"n{r.randrange(60)}" for _ in range(6)]
        label = int(a == b) if r.random() < 0.95 else int(a != b)
        rows.append((i, " ".join([f"first{a}", f"second{b}", *noise]), None))
        labels.append((i, label))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int")
    truth = dict(labels.collect())
    p = fm.QualityFM(epochs=40)
    out = [x for x in fm.score_quality(docs, fm.fit_on(docs, labels, p), p).collect() if x.held_out]
    right = sum((x.score >= 0.5) == truth[x.doc_id] for x in out) / len(out)
    assert right > 0.8, right
