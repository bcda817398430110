"""Exact, near and substring dedup against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import exact_dedup as ex
from partloom.llm import near_dedup as nd
from partloom.llm import substring_dedup as sd
from partloom.llm.components import connected
from partloom.llm.words import WindowHasher, hash_words, word_table


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(clashing, rows, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(clashing, nd.NearDedup(shingle=k)).collect()}
    assert got == brute_components(rows, k)


def test_small_blocks_give_the_same_links(docs, rows):
    p = nd.NearDedup(shingle=4, block=5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs, p).collect()}
    assert got == brute_components(rows, 4)


def test_near_duplicates_empty_and_odd_ids(spark, empty):
    assert nd.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df).collect())
    assert got == [(-1, 2, None, True), (7, 2, 7, True), (7, 2, 7, True), (8, 0, 8, True)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = x[:800], x[100:]
    s = nd.fast_sketch(np.concatenate([a, b, x[:1]]), np.repeat([0, 1, 2], [800, 800, 1]), 3, 128)
    assert (s != nd.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 700 / 900) < 0.15


def test_components_on_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.id: r.comp for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_window_hashes_tell_windows_apart():
    w = hash_words([b"a", b"b", b"a", b"b", b"a", b"c"], word_table())
    at = np.arange(5)
    h = WindowHasher(w)(at, at + 2)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


def brute_substrings(rows, window):
    words = {i: (t or "").encode().split() for i, t, *_ in rows}
    seen = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("window", "minimizer"), [(35, 15), (20, 7), (6, 3)])
def test_substring_dedup_matches_brute_force(clashing, rows, window, minimizer):
    out = sd.substring_dedup(clashing, sd.SubstringDedup(window, minimizer))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == brute_substrings(rows, window)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "STEP", 64)
    rows = [(0, " ".join(f"w{i % 97 if 300 < i < 500 else i}" for i in range(900))), (1, " ".join(f"w{i}" for i in range(100, 260)))]
    out = sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == brute_substrings(rows, 35)


def test_substring_repeated_ids_and_empty(spark, empty):
    assert sd.substring_dedup(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (1, text), (None, text + " tail"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in sd.substring_dedup(df).collect())
    assert got == [(0, 51, 50), (1, 50, 50), (1, 50, 50), (2, 0, 0)]


def test_exact_dedup_matches_brute_force(clashing, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    for history in (F.col("doc_id") < 100, F.lit(False), F.lit(True)):
        out = ex.exact_dedup(clashing, history, ex.ExactDedup(bucket=16))
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()} == want


def test_exact_dedup_empty_and_null_ids(spark, empty):
    assert ex.exact_dedup(empty, ex.older_half(empty)).count() == 0
    df = spark.createDataFrame([(None, "x"), (None, "x"), (3, "y"), (None, "y")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in ex.exact_dedup(df, ex.older_half(df)).collect())
    assert got == [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 3, 2, False), (3, 3, 2, True)]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_perfect_hash_is_minimal(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    shifts = ex.build(digests, 4)
    assert sorted(ex.find(digests, shifts, n).tolist()) == list(range(n))


def test_sketch_filter_misses_far_less_than_the_banding():
    p = nd.NearDedup()
    s, n = p.percent / 100, p.coordinates
    fails = sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(p.least_agree))
    assert fails < (1 - s**p.rows) ** p.bands / 100


def test_substring_dedup_tries_again_when_hashes_collide(spark, rows, docs, monkeypatch):
    whole = sd.seeded_hashes
    monkeypatch.setattr(sd, "seeded_hashes", lambda words, seed: whole(words, seed) & np.uint64(1) if seed < 2 else whole(words, seed))
    out = sd.substring_dedup(docs, sd.SubstringDedup(20, 7))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == brute_substrings(rows, 20)
    with pytest.raises(RuntimeError, match="collided"):
        sd.substring_dedup(docs, sd.SubstringDedup(20, 7, seeds=(0, 1)))


def test_repeated_paths_are_compacted_up_to_branches(spark):
    common = [f"c{i}" for i in range(120)]
    texts = [[f"{k}a{i}" for i in range(10)] + common + [f"{k}z{i}" for i in range(10)] for k in range(3)]
    texts.append(common[60:])  # a branch: here the second half has no first half before it
    df = spark.createDataFrame([(k, " ".join(t).encode()) for k, t in enumerate(texts)], "key long, text binary")
    p = sd.SubstringDedup(20, 7)
    found = {r.key: sorted((s.start, s.n) for s in r.solid or []) for r in sd.repeated_spans(df, p).collect()}
    for k in range(3):
        assert len(found[k]) <= 6 and sum(n for _, n in found[k]) > 60, found
    solid = spark.createDataFrame([(k, i, 1, i) for k in range(2) for i in range(50)] + [(2, 0, 1, 25)], "key long, start int, n int, id long")
    got = {(r.key, r.start, r.n, r.path) for r in sd.compacted(solid).collect()}
    assert got == {(k, 0, 25, 0) for k in range(2)} | {(k, 25, 1, 25) for k in range(2)} | {(k, 26, 24, 26) for k in range(2)} | {(2, 0, 1, 25)}  # an end branches too


def test_a_hub_and_a_bucket_of_many_rows_are_split(spark, monkeypatch):
    from partloom.llm import components, runtime

    for module in (runtime, components):
        monkeypatch.setattr(module, "HOT", 4)
    monkeypatch.setattr(components, "FEW", 3)
    edges = [(0, i) for i in range(1, 60)] + [(500, i) for i in range(400, 450)] + [(i, i + 1) for i in range(600, 620)]
    got = {r.id: r.comp for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{i: 400 for i in [*range(400, 450), 500]}, **{i: 600 for i in range(600, 621)}}
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)] + [(100 + i, " ".join(base)) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), nd.NearDedup(hub=7)).collect()}
    assert got == brute_components(rows, 5)
    out = ex.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 110)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out.collect()} == {(i, i, 1) for i in range(40)} | {(100 + i, 139, 40) for i in range(40)}


def test_lookups_stay_small_whatever_the_history(spark, tmp_path, monkeypatch):
    """An empty history, and one row far from the others' doc_ids: no bucket gets more than a few times its share."""
    df = spark.range(40_000).select((F.col("id") + 10**12).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    df = df.union(spark.createDataFrame([(0, "text 7"), (1, "alone")], "doc_id long, text string"))
    seen = spark.sparkContext.accumulator(0)
    most = spark.sparkContext.accumulator(0, type("Most", (), {"zero": lambda self, v: 0, "addInPlace": lambda self, a, b: max(a, b)})())
    plain = ex._look_up

    def counted(key, incoming, held):
        seen.add(len(incoming))
        most.add(len(incoming))
        return plain(key, incoming, held)

    monkeypatch.setattr(ex, "_look_up", counted)
    p = ex.ExactDedup(bucket=512)
    for history in (F.lit(False), F.col("doc_id") < 10, ex.older_half(df)):
        got = ex.exact_dedup(df, history, p)
        assert got.where("not kept").collect()[0].doc_id == 0 and got.count() == 40_002
        assert most.value <= 3 * 512
    assert 0.4 < df.where(ex.older_half(df)).count() / 40_002 < 0.6


def test_a_boilerplate_just_under_the_window_is_dealt_out(spark, monkeypatch):
    """34 words that open every text: distinct stretches of one minimizer, which no task should meet all of."""
    from partloom.llm import runtime

    monkeypatch.setattr(runtime, "HOT", 8)
    rng = random.Random(8)
    head = " ".join(f"boiler{i}" for i in range(34))
    rows = [(i, f"{head} " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(20))) for i in range(1500)]
    rows += [(9000, rows[0][1]), (9001, "x " + " ".join(rows[1][1].split()[:40]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.substring_dedup(df).collect()}
    assert got == brute_substrings(rows, 35)
    paths = spark.createDataFrame([(1, i, 1) for i in range(3000)] + [(i, i, 1) for i in range(2, 400)], "anchor long, whole long, n int")
    anchors = runtime.materialise(paths.groupBy("anchor").agg(F.count("*").alias("kinds")), "anchors")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = runtime.keyed_join(paths, anchors, ["anchor"], "kinds").withColumn("task", F.spark_partition_id())
        assert met.count() == paths.count() and met.groupBy("task").count().agg(F.max("count")).first()[0] < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
